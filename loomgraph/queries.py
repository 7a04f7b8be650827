"""The registered queries of the engine: (spark, sf_dir) to a DataFrame. SQL for each is in oracles.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reasoning
from .config import EmbeddingConfig, ExtractionConfig
from .functions import scores, vectors
from .functions.text import formal, local_name, parsed_response
from .operators import distill as D
from .operators import graph, infer, kg, ontology, similarity, verify
from .operators.extract import ReplayExtractor, RuleExtractor, chunked
from .plans.partitions import balanced
from .plans.prompts import extraction_prompt
from .plans.sparql import sparql
from .plans.written import new_path
from .sources import rdf
from .streaming.extract import event_triples
from .tables import read, relational_kg

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = dict(reasoning.QUERIES)
CFG = ExtractionConfig()


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return balanced(read(spark, sf_dir, "documents").select("doc_id", "text"))


def distilled(spark: SparkSession, sf_dir: str, cfg: ExtractionConfig = CFG) -> D.Extraction:
    return D.distill(documents(spark, sf_dir), RuleExtractor(), cfg)


def small_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations, regions, customers and suppliers only."""
    return relational_kg(spark, sf_dir).filter(F.col("p").isin("kg:inRegion", "kg:locatedIn"))


def part_ontology(spark: SparkSession) -> ontology.Ontology:
    """A small fixed schema over the relational graph."""
    classes = [
        (0, "onto:Place", "Place", "somewhere", []), (1, "onto:Region", "Region", "a part of the world", ["onto:Place"]), (2, "onto:Nation", "Nation", "a country", ["onto:Place"]),
        (3, "onto:Agent", "Agent", "who acts", []), (4, "onto:Customer", "Customer", "who buys", ["onto:Agent"]), (5, "onto:Supplier", "Supplier of goods", "who sells", ["onto:Agent"]),
        (6, "onto:Event", "Purchase event", "what happens", []), (7, "onto:View", "page view", "a look", ["onto:Event"]), (8, "onto:Click", "click", "a press", ["onto:Event"]),
    ]
    props = [
        (0, "object", "kg:inRegion", "in region", "", "onto:Nation", "onto:Region"), (1, "object", "kg:locatedIn", "located in", "", "onto:Customer", "onto:Nation"),
        (2, "object", "kg:placedBy", "placed by", "", None, "onto:Customer"), (3, "data", "kg:balance", "balance", "", "onto:Agent", None),
    ]
    axioms = [
        ("SubClassOf", ["onto:Nation", "onto:Place"], None, None), ("DisjointClasses", ["onto:Place", "onto:Agent"], None, None), ("EquivalentClasses", ["onto:Customer", "onto:Buyer"], None, None),
        ("FunctionalObjectProperty", ["kg:locatedIn"], None, None), ("ObjectPropertyDomain", ["kg:inRegion", "onto:Nation"], None, None),
    ]
    from .schemas import AXIOM, ONTO_CLASS, ONTO_PROPERTY

    return ontology.Ontology(spark.createDataFrame(classes, ONTO_CLASS), spark.createDataFrame(props, ONTO_PROPERTY), spark.createDataFrame(axioms, AXIOM), "onto:")


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rdf:type statements of the relational graph's entities; supplier 1 is a place too, which breaks a rule."""
    one = lambda name, key, cls: read(spark, sf_dir, name).select(F.concat(F.lit(f"kg:{name}/"), F.col(key).cast("string")).alias("s"), F.lit(ontology.TYPE).alias("p"), F.lit(cls).alias("o"))
    out = one("nation", "n_nationkey", "onto:Nation").unionByName(one("region", "r_regionkey", "onto:Region")).unionByName(one("customer", "c_custkey", "onto:Customer")).unionByName(one("supplier", "s_suppkey", "onto:Supplier"))
    return out.unionByName(one("supplier", "s_suppkey", "onto:Place").filter(F.col("s") == "kg:supplier/1"))


# Extraction.


@query
def extract_knowledge(spark, sf_dir):
    x = distilled(spark, sf_dir)
    kept = verify.validate(x.triples).filter(F.col("confidence") >= scores.threshold(None, CFG.confidence_threshold))
    return kept.select("doc_id", "seq", "s", "p", "o", "confidence", "confidence_level")


@query
def chunk_counts(spark, sf_dir):
    return chunked(documents(spark, sf_dir)).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


@query
def chunks(spark, sf_dir):
    return chunked(documents(spark, sf_dir))


@query
def entity_mentions(spark, sf_dir):
    raw = D.raw_entities(RuleExtractor()(documents(spark, sf_dir)))
    return D.aggregate_entities(raw, CFG.entity_ns).select("doc_id", "uri", "label", "n", "source")


@query
def entity_boost(spark, sf_dir):
    return distilled(spark, sf_dir).entities.select("doc_id", "uri", "n", "confidence")


@query
def entity_limit(spark, sf_dir):
    return distilled(spark, sf_dir, ExtractionConfig(max_entities=5)).entities.select("doc_id", "uri", "rank")


@query
def entity_levels(spark, sf_dir):
    e = distilled(spark, sf_dir).entities
    return e.groupBy(scores.level(F.col("confidence")).alias("level")).agg(F.count("*").alias("n"))


def _linked(spark, sf_dir):
    extracted = RuleExtractor()(documents(spark, sf_dir))
    e = D.limited(D.aggregate_entities(D.raw_entities(extracted), CFG.entity_ns), CFG.max_entities)
    D.tune(spark)
    return D.link(D.raw_relations(D.with_places(extracted)), e, CFG.property_ns)


@query
def relation_pairs(spark, sf_dir):
    return _linked(spark, sf_dir).select("doc_id", "chunk_idx", "rel_idx", F.col("s.uri").alias("s"), "p", F.col("o.uri").alias("o"))


@query
def relation_types(spark, sf_dir):
    return distilled(spark, sf_dir).relations


@query
def triple_scores(spark, sf_dir):
    return distilled(spark, sf_dir).triples.select("doc_id", "seq", "s", "o", "evidence", "neural", "confidence_level", "confidence")


@query
def triple_limit(spark, sf_dir):
    return distilled(spark, sf_dir, ExtractionConfig(max_triples=2)).triples.select("doc_id", "seq", "s", "o")


@query
def evidence_buckets(spark, sf_dir):
    return distilled(spark, sf_dir).triples.groupBy("evidence").agg(F.count("*").alias("n"))


@query
def confidence_levels(spark, sf_dir):
    return distilled(spark, sf_dir).triples.groupBy("confidence_level").agg(F.count("*").alias("n"))


@query
def hybrid_filter(spark, sf_dir):
    return distilled(spark, sf_dir).triples.filter(F.col("confidence") >= scores.threshold(0.85, 0.7)).select("doc_id", "seq", "s", "o", "confidence")


@query
def doc_confidence(spark, sf_dir):
    x = distilled(spark, sf_dir)
    return D.summaries(x.extracted, x.triples).select("doc_id", "text_length", "n_chunks", "n_triples", F.round("confidence", 9).alias("confidence"), "level")


@query
def fact_score(spark, sf_dir):
    x = distilled(spark, sf_dir)
    return D.fact_scores(documents(spark, sf_dir), x.triples).select("doc_id", F.round("fact_score", 9).alias("fact_score"))


@query
def reasoning_paths(spark, sf_dir):
    paths = verify.reasoning_paths(verify.validate(distilled(spark, sf_dir).triples))
    return paths.select("doc_id", F.size("reasoning_path").alias("n"), F.array_join("reasoning_path", "\n").alias("path"))


@query
def rejected_triples(spark, sf_dir):
    """Statements whose two ends are one entity count as rejected here."""
    t = distilled(spark, sf_dir).triples
    v = verify.validate(t, t.filter("s = o").select("s", "p", "o"))
    return v.filter("not valid").select("doc_id", "seq", "s", "confidence", "confidence_level")


@query
def verify_summary(spark, sf_dir):
    return verify.verify_summary(verify.verify(distilled(spark, sf_dir).triples))


@query
def verify_refuted(spark, sf_dir):
    t = distilled(spark, sf_dir).triples
    v = verify.verify(t, refuted=t.filter("s = o"))
    return v.groupBy("status", "confidence_level").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query
def certificates(spark, sf_dir):
    return verify.certificates(verify.verify(distilled(spark, sf_dir).triples))


@query
def formal_triples(spark, sf_dir):
    return relational_kg(spark, sf_dir).select("seq", formal(F.col("s"), F.col("p"), F.col("o")).alias("f")).select("seq", "f.*")


@query
def extraction_prompts(spark, sf_dir):
    schema = part_ontology(spark).prompt_schema(2)
    c = chunked(documents(spark, sf_dir))
    return c.select("doc_id", "chunk_idx", F.md5(extraction_prompt(F.col("chunk"), schema).cast("binary")).alias("prompt_md5"))


def _responses(spark, sf_dir):
    """Stored answers for the first sentence of each document: plain, fenced, bare fenced, or junk, by id. Its second
    and third word are entities that the text need not spell so."""
    words = F.split(F.col("text"), r"[^\p{L}]+")
    a, b = F.try_element_at(words, F.lit(2)), F.try_element_at(words, F.lit(3))
    body = F.to_json(F.struct(
        F.array(F.struct(F.concat(F.lit("X "), a).alias("text"), F.lit("Name").alias("type")), F.struct(b.alias("text"), F.lit("Name").alias("type"))).alias("entities"),
        F.array(F.struct(F.concat(F.lit("x "), F.lower(a)).alias("subject"), F.lit("Works In").alias("predicate"), b.alias("object"))).alias("relations"),
    ))
    kind = F.col("doc_id") % 4
    answer = F.when(kind == 0, body).when(kind == 1, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).when(kind == 2, F.concat(F.lit("```\n"), body, F.lit("\n```"))).otherwise("no idea")
    return documents(spark, sf_dir).filter(b.isNotNull() & (b != "") & (a != "")).select("doc_id", F.lit(0).alias("chunk_idx"), answer.alias("response"))


@query
def parsed_responses(spark, sf_dir):
    x = _responses(spark, sf_dir).select("doc_id", parsed_response(F.col("response")).alias("x"))
    return x.select("doc_id", F.size("x.entities").alias("n_entities"), F.size("x.relations").alias("n_relations"), F.try_element_at("x.relations", F.lit(1))["predicate"].alias("predicate"))


@query
def replay_triples(spark, sf_dir):
    x = D.distill(documents(spark, sf_dir), ReplayExtractor(_responses(spark, sf_dir)), CFG)
    return x.triples.select("doc_id", "s", "p", "o", "evidence", "neural", "confidence")


# The relational graph.


@query
def kg_sizes(spark, sf_dir):
    t = relational_kg(spark, sf_dir).withColumn("graph_id", F.lit("kg"))
    g = kg.KnowledgeGraph("kg", graph.nodes(t).withColumn("graph_id", F.lit("kg")), t.select("graph_id", F.col("p").alias("uri")).distinct(), t)
    return kg.sizes(g)


@query
def kg_by_subject(spark, sf_dir):
    return kg.by_subject(relational_kg(spark, sf_dir), "kg:order/7").select("s", "p", "o")


@query
def kg_by_predicate(spark, sf_dir):
    return kg.by_predicate(relational_kg(spark, sf_dir), "kg:locatedIn").select("s", "p", "o")


@query
def kg_neighbors(spark, sf_dir):
    return kg.neighbors(relational_kg(spark, sf_dir), "kg:nation/3")


@query
def kg_predicate_counts(spark, sf_dir):
    return kg.predicate_counts(relational_kg(spark, sf_dir))


@query
def kg_predicate_examples(spark, sf_dir):
    return kg.predicate_examples(relational_kg(spark, sf_dir), F.col("seq"), F.col("s"), F.col("o")).select("p", "rank", "s", "o")


@query
def kg_distinct_triples(spark, sf_dir):
    return kg.predicate_counts(kg.distinct_triples(relational_kg(spark, sf_dir)))


@query
def kg_display(spark, sf_dir):
    e = read(spark, sf_dir, "customer").select(F.concat(F.lit("kg:customer/"), "c_custkey").alias("uri"), F.col("c_name").alias("label"))
    e = e.unionByName(read(spark, sf_dir, "nation").select(F.concat(F.lit("kg:nation/"), "n_nationkey").alias("uri"), F.col("n_name").alias("label")))
    return kg.display(relational_kg(spark, sf_dir), e)


@query
def kg_upsert(spark, sf_dir):
    """Users as entities written once for each event: the last one stays, at the place of the first."""
    e = read(spark, sf_dir, "events").select(F.lit("kg").alias("graph_id"), F.col("event_id").alias("seq"), F.concat(F.lit("kg:user/"), "user_id").alias("uri"), F.col("event_type").alias("label"))
    return kg.last_written(e)


@query
def kg_edges(spark, sf_dir):
    return graph.edges(relational_kg(spark, sf_dir))


@query
def kg_degree(spark, sf_dir):
    return graph.degrees(graph.edges(relational_kg(spark, sf_dir)))


@query
def kg_walks(spark, sf_dir):
    w = graph.walks(graph.edges(relational_kg(spark, sf_dir)), num_walks=2, length=4, seed=42)
    return w.select("start", "walk", F.array_join("path", ">").alias("path"))


@query
def kg_biased_walks(spark, sf_dir):
    w = graph.biased_walks(graph.edges(relational_kg(spark, sf_dir)), 2, 4, 0.5, 2.0)
    return w.select("start", "walk", F.array_join("path", ">").alias("path"))


@query
def node_embeddings(spark, sf_dir):
    cfg = EmbeddingConfig(num_walks=2, walk_length=6, embedding_dim=16, epochs=1)
    return graph.embed(relational_kg(spark, sf_dir), cfg).select("uri", F.size("vec").alias("dim"))


@query
def kg_ntriples(spark, sf_dir):
    return rdf.ntriples(relational_kg(spark, sf_dir))


@query
def kg_ntriples_read(spark, sf_dir):
    return rdf.parse_ntriples(rdf.ntriples(relational_kg(spark, sf_dir))).select("s", "p", "o", "o_is_literal")


@query
def literals_round_trip(spark, sf_dir):
    """Texts as literals with their languages, written as N-Triples and read again; blank nodes for their sources."""
    t = read(spark, sf_dir, "documents").select(
        F.concat(F.lit("_:"), "source").alias("s"), F.concat(F.lit("kg:doc/"), "doc_id").alias("p"), F.col("text").alias("o"), F.lit(True).alias("o_is_literal"), F.col("lang").alias("o_lang")
    )
    back = rdf.parse_ntriples(rdf.ntriples(t))
    return back.select("s", "p", F.md5(F.col("o").cast("binary")).alias("o_md5"), "o_lang", "o_type")


@query
def kg_turtle_read(spark, sf_dir):
    """The graph written as Turtle and read again."""
    t = relational_kg(spark, sf_dir).withColumn("graph_id", F.lit("kg"))
    g = kg.KnowledgeGraph("kg", graph.nodes(t).withColumn("graph_id", F.lit("kg")), t.select("graph_id", F.col("p").alias("uri")).distinct(), t)
    path = new_path(spark, "turtle")
    rdf.write(g, path)
    return rdf.read(spark, path).triples.select("s", "p", "o", "o_is_literal")


@query
def kg_json_read(spark, sf_dir):
    """The graph written as JSON rows and read again: its statements, name, ontology and metadata."""
    t = relational_kg(spark, sf_dir).withColumn("graph_id", F.lit("trade"))
    e = graph.nodes(t).withColumn("graph_id", F.lit("trade"))
    g = kg.KnowledgeGraph("trade", e, t.select("graph_id", F.col("p").alias("uri")).distinct(), t, "onto:", {"tables": 7})
    back = rdf.from_json_rows(rdf.kg_json(g))
    return back.triples.select("seq", "s", "p", "o", "graph_id", F.lit(back.ontology_uri).alias("ontology_uri"), F.lit(back.metadata["tables"]).alias("tables"))


@query
def kg_registered(spark, sf_dir):
    """Entities after the order lines are added to a graph that knows the parts only."""
    t = relational_kg(spark, sf_dir).withColumn("graph_id", F.lit("kg"))
    parts = read(spark, sf_dir, "part").select(F.lit("kg").alias("graph_id"), F.concat(F.lit("kg:part/"), "p_partkey").alias("uri"))
    g = kg.KnowledgeGraph("kg", parts, t.select("graph_id", F.col("p").alias("uri")).limit(0), t.limit(0)).add_triples(t.filter("p = 'kg:contains'"))
    return g.entities.select("uri").unionByName(g.relations.select("uri"))


@query
def extraction_graph(spark, sf_dir):
    """The extraction as one graph for each document."""
    x = distilled(spark, sf_dir)
    return kg.to_graph(x).triples.select("graph_id", "seq", "s", "p", "o", "confidence")


@query
def provenance_records(spark, sf_dir):
    x = distilled(spark, sf_dir)
    return D.summaries(x.extracted, x.triples, ontology_uri="onto:").select("doc_id", "text_length", "n_chunks", "extraction_method", "ontology")


def table_ontology(spark, sf_dir) -> ontology.Ontology:
    """An ontology of what the tables hold, written as RDF/XML and loaded: kinds of events, parts, brands and customers as
    classes, a property for each kind of event and a price for each kind of part. As many elements as there are kinds."""
    t = lambda name: read(spark, sf_dir, name)
    tops = spark.createDataFrame([(x,) for x in ("Brand", "Customer", "Event", "Part")], "x string")
    about = lambda tag, kind, col: F.concat(F.lit(f'<owl:{tag} rdf:about="'), F.lit(kind), F.col(col), F.lit('">'))
    word = lambda tag, *xs: F.concat(F.lit(f"<rdfs:{tag}>"), *[x.cast("string") for x in xs], F.lit(f"</rdfs:{tag}>"))
    link = lambda tag, *xs: F.concat(F.lit(f'<{tag} rdf:resource="'), *[F.lit(x) if isinstance(x, str) else x for x in xs], F.lit('"/>'))

    def kinds(table: str, col: str) -> DataFrame:
        return t(table).filter(F.col(col).isNotNull()).groupBy(F.col(col).alias("x")).agg(F.count("*").alias("n"))

    def classes(table: str, col: str, kind: str, *more) -> DataFrame:
        line = F.concat(about("Class", f"onto:{kind.lower()}/", "x"), word("label", F.col("x")), word("comment", F.lit("seen "), F.col("n"), F.lit(" times")), link("rdfs:subClassOf", f"onto:{kind}"), *more, F.lit("</owl:Class>"))
        return kinds(table, col).select(line.alias("line"))

    lines = [
        tops.select(F.concat(about("Class", "onto:", "x"), F.lit("</owl:Class>")).alias("line")),
        classes("events", "event_type", "Event"), classes("customer", "c_mktsegment", "Customer"),
        classes("part", "p_type", "Part", link("owl:disjointWith", "onto:Event")), classes("part", "p_brand", "Brand", link("owl:equivalentClass", "onto:maker/", F.col("x"))),
        kinds("events", "event_type").select(F.concat(about("ObjectProperty", "kg:", "x"), word("label", F.col("x"), F.lit(" made")), link("rdfs:domain", "onto:User"), link("rdfs:range", "onto:event/", F.col("x")), F.lit("</owl:ObjectProperty>")).alias("line")),
        kinds("part", "p_type").select(F.concat(about("DatatypeProperty", "kg:price/", "x"), link("rdfs:domain", "onto:part/", F.col("x")), link("rdf:type", "http://www.w3.org/2002/07/owl#FunctionalProperty"), F.lit("</owl:DatatypeProperty>")).alias("line")),
    ]
    rows = lines[0]
    for x in lines[1:]:
        rows = rows.unionByName(x)
    path = new_path(spark, "owl")
    rows.agg(F.concat(F.lit("<rdf:RDF>"), F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("</rdf:RDF>"))).write.text(path)  # a few dozen kinds
    return rdf.read_owl(spark, path)


@query
def ontology_individuals(spark, sf_dir):
    """Nations and regions as an RDF/XML file of individuals, loaded as an ontology."""
    one = lambda name, key, cls: read(spark, sf_dir, name).select(F.format_string(f'<owl:NamedIndividual rdf:about="kg:{name}/%d"><rdf:type rdf:resource="onto:{cls}"/></owl:NamedIndividual>', key).alias("value"))
    path = new_path(spark, "owl")
    rows = one("nation", "n_nationkey", "Nation").unionByName(one("region", "r_regionkey", "Region"))
    rows.agg(F.concat(F.lit("<rdf:RDF>"), F.array_join(F.collect_list("value"), "\n"), F.lit("</rdf:RDF>"))).write.text(path)  # 30 rows at any size
    o = rdf.read_owl(spark, path)
    n = o.statistics().filter("kind = 'individuals'").select(F.col("n").alias("individuals"))
    return o.types().select(F.col("s").alias("uri"), F.col("o").alias("type")).join(F.broadcast(n))


@query
def policy_violations(spark, sf_dir):
    """What the axioms of the schema refute of the whole graph."""
    o = part_ontology(spark)
    policies = verify.Policies()
    policies.add_ontology(o)
    policies.add("more", [("ObjectPropertyRange", ["kg:placedBy", "onto:Supplier"]), "a sentence refutes nothing"])
    return policies.refuted(relational_kg(spark, sf_dir), ontology.entity_types(typed(spark, sf_dir), o))


@query
def ontology_consistency(spark, sf_dir):
    o = part_ontology(spark)
    types = ontology.entity_types(typed(spark, sf_dir), o)
    found = [ontology.domain_range_violations(relational_kg(spark, sf_dir).filter("p = 'kg:inRegion'"), types, o.properties), ontology.disjoint_violations(types, o.axioms)]
    return spark.createDataFrame([(k, ontology.is_consistent(v)) for k, v in zip(("regions", "disjointness"), found)], "rule string, consistent boolean")


@query
def kg_turtle(spark, sf_dir):
    return rdf.turtle(relational_kg(spark, sf_dir))


@query
def kg_json(spark, sf_dir):
    t = relational_kg(spark, sf_dir).withColumn("graph_id", F.lit("kg"))
    e = graph.nodes(t).select(F.lit("kg").alias("graph_id"), "uri")
    g = kg.KnowledgeGraph("kg", e, t.select("graph_id", F.col("p").alias("uri")).distinct(), t)
    return rdf.kg_json(g).groupBy("kind").agg(F.count("*").alias("n"))


@query
def local_names(spark, sf_dir):
    return relational_kg(spark, sf_dir).select(local_name(F.col("s")).alias("s_name"), local_name(F.col("o")).alias("o_name"))


# Vectors.


def _vectors(spark, sf_dir):
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("uri"), F.col("embedding").alias("vec"))


@query
def cosine_topk(spark, sf_dir):
    return similarity.find_similar(_vectors(spark, sf_dir), 7, 10).select("uri", F.round("similarity", 6).alias("similarity"))


@query
def euclid_topk(spark, sf_dir):
    return similarity.find_similar(_vectors(spark, sf_dir), 7, 10, "euclidean").select("uri", F.round("similarity", 6).alias("similarity"))


@query
def pair_similarity(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    a, b = v.withColumnsRenamed({"uri": "a", "vec": "va"}), v.select((F.col("uri") - 1).alias("a"), F.col("vec").alias("vb"))
    return a.join(b, "a").select("a", F.round(vectors.cosine(F.col("va"), F.col("vb")), 6).alias("cosine"), F.round(vectors.negative_distance(F.col("va"), F.col("vb")), 6).alias("distance"))


@query
def text_topk(spark, sf_dir):
    docs = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return similarity.nearest_texts("the thing that was", docs, similarity.HashedNgrams(64), 5).select("doc_id", F.round("similarity", 6).alias("similarity"))


@query
def translation_scores(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    at = lambda i, n: v.select((F.col("uri") - i).alias("k"), F.col("vec").alias(n))
    x = at(0, "h").join(at(1, "r"), "k").join(at(2, "t"), "k")
    h, r, t = F.col("h"), F.col("r"), F.col("t")
    return x.select("k", F.round(vectors.transe_score(h, r, t), 6).alias("transe"), F.round(vectors.distmult_score(h, r, t), 6).alias("distmult"))


@query
def translation_training(spark, sf_dir):
    cfg = EmbeddingConfig(embedding_dim=8, epochs=2)
    return graph.embed(relational_kg(spark, sf_dir), cfg, "transe").select("uri", F.size("vec").alias("dim"))


# Ontologies, rules, inference.


@query
def type_mapping(spark, sf_dir):
    labels = read(spark, sf_dir, "events").select("event_type").distinct().unionByName(spark.createDataFrame([("",), ("ion",), ("supplier",), ("e",)], "event_type string"))
    return D.map_labels(labels, "event_type", part_ontology(spark).classes, "class_uri")


@query
def relation_mapping(spark, sf_dir):
    """The kinds of events, as they stand, in capitals and with a word more, as labels of relations."""
    from .functions.text import property_uri

    kinds = read(spark, sf_dir, "events").select("event_type").distinct()
    labels = kinds.select(F.explode(F.array("event_type", F.upper("event_type"), F.concat("event_type", F.lit(" Twice")))).alias("label"))
    x = D.map_labels(labels, "label", table_ontology(spark, sf_dir).object_properties, "mapped")
    return x.select("label", F.coalesce("mapped", property_uri(F.col("label"), CFG.property_ns)).alias("uri"))


@query
def ontology_statistics(spark, sf_dir):
    return table_ontology(spark, sf_dir).statistics()


@query
def ontology_hierarchy(spark, sf_dir):
    return table_ontology(spark, sf_dir).hierarchy().select("parent", F.array_join("children", ",").alias("children"))


@query
def ontology_triples(spark, sf_dir):
    return table_ontology(spark, sf_dir).to_triples()


@query
def ontology_axioms(spark, sf_dir):
    o = table_ontology(spark, sf_dir)
    return ontology.verbalize(o.normalized().withColumn("verbalization", F.lit(""))).select("axiom_type", "verbalization")


@query
def entity_types(spark, sf_dir):
    return ontology.entity_types(typed(spark, sf_dir), part_ontology(spark))


@query
def inferred_types(spark, sf_dir):
    t = relational_kg(spark, sf_dir)
    types = ontology.entity_types(typed(spark, sf_dir), part_ontology(spark))
    e = ontology.with_inferred_types(graph.nodes(t), types)
    return e.select("uri", F.array_join("inferred_types", ",").alias("types"))


@query
def ontology_prompt_terms(spark, sf_dir):
    """The first terms that a prompt lists, as rows."""
    o = table_ontology(spark, sf_dir)
    rows = o.classes.select(F.lit("class").alias("kind"), "ord", "label").unionByName(o.object_properties.select(F.lit("relation").alias("kind"), "ord", "label"))
    return rows.filter("ord < 20")


@query
def provenance_summary(spark, sf_dir):
    x = distilled(spark, sf_dir)
    s = D.summaries(x.extracted, x.triples)
    return s.groupBy(F.lit("extractor").alias("method")).agg(F.sum("text_length").alias("text_length"), F.sum("n_chunks").alias("n_chunks"), F.sum("n_triples").alias("n_triples"), F.count("*").alias("n_docs"))


@query
def domain_range_violations(spark, sf_dir):
    types = ontology.entity_types(typed(spark, sf_dir), part_ontology(spark))
    return ontology.domain_range_violations(relational_kg(spark, sf_dir), types, part_ontology(spark).properties)


@query
def functional_violations(spark, sf_dir):
    return ontology.functional_violations(relational_kg(spark, sf_dir), ["kg:suppliedBy", "kg:placedBy"])


@query
def disjoint_violations(spark, sf_dir):
    o = part_ontology(spark)
    return ontology.disjoint_violations(ontology.entity_types(typed(spark, sf_dir), o), o.axioms)


@query
def transitive_closure(spark, sf_dir):
    t = small_kg(spark, sf_dir).withColumn("p", F.lit("kg:within"))
    return infer.transitive(t, "kg:within")


@query
def symmetric_closure(spark, sf_dir):
    return infer.symmetric(relational_kg(spark, sf_dir), "kg:inRegion")


@query
def inferred_triples(spark, sf_dir):
    t = small_kg(spark, sf_dir).withColumn("p", F.lit("kg:within"))
    return infer.infer(t, transitive_of=("kg:within",), inverse_of=(("kg:within", "kg:holds"),), max_inferences=100)


# Graph patterns.


@query
def bgp_two_hops(spark, sf_dir):
    return sparql("PREFIX kg: <kg:> SELECT ?c ?r WHERE { ?c kg:locatedIn ?n . ?n kg:inRegion ?r }", relational_kg(spark, sf_dir))


@query
def bgp_star(spark, sf_dir):
    q = "PREFIX kg: <kg:> SELECT ?o ?c ?p WHERE { ?o kg:placedBy ?c ; kg:contains ?p . ?c kg:locatedIn <kg:nation/5> }"
    return sparql(q, relational_kg(spark, sf_dir))


@query
def bgp_optional(spark, sf_dir):
    q = "PREFIX kg: <kg:> SELECT ?c ?o WHERE { ?c kg:locatedIn <kg:nation/5> . OPTIONAL { ?o kg:placedBy ?c } }"
    return sparql(q, relational_kg(spark, sf_dir))


@query
def bgp_union(spark, sf_dir):
    q = "PREFIX kg: <kg:> SELECT DISTINCT ?x WHERE { { ?x kg:locatedIn <kg:nation/1> } UNION { ?x kg:inRegion <kg:region/2> } }"
    return sparql(q, relational_kg(spark, sf_dir))


@query
def bgp_unbound(spark, sf_dir):
    """A variable that the first OPTIONAL may leave unbound is bound by the second."""
    q = (
        'PREFIX kg: <kg:> SELECT ?n ?v WHERE { ?n kg:inRegion ?r . OPTIONAL { ?v kg:locatedIn ?n . FILTER(REGEX(?v, "supplier/[1-9]$")) }'
        ' OPTIONAL { ?v kg:locatedIn ?n . FILTER(CONTAINS(?v, "customer")) } }'
    )
    return sparql(q, relational_kg(spark, sf_dir))


@query
def bgp_group(spark, sf_dir):
    q = "PREFIX kg: <kg:> SELECT ?r (COUNT(?c) AS ?n) (COUNT(DISTINCT ?n1) AS ?nations) WHERE { ?c kg:locatedIn ?n1 . ?n1 kg:inRegion ?r } GROUP BY ?r"
    return sparql(q, relational_kg(spark, sf_dir))


@query
def bgp_filter(spark, sf_dir):
    q = 'PREFIX kg: <kg:> SELECT ?s ?o WHERE { ?s kg:locatedIn ?o . FILTER(CONTAINS(?s, "supplier") && (?o = "kg:nation/1" || REGEX(?o, "/2[0-9]$"))) }'
    return sparql(q, relational_kg(spark, sf_dir))


@query
def bgp_order_limit(spark, sf_dir):
    return sparql("SELECT ?s ?o WHERE { ?s <kg:placedBy> ?o } ORDER BY DESC(?s) ?o LIMIT 20 OFFSET 5", relational_kg(spark, sf_dir))


@query
def hybrid_retrieval(spark, sf_dir):
    """Events' users by pattern, ranked by the similarity of vectors of the same number."""
    v = _vectors(spark, sf_dir).select(F.concat(F.lit("kg:user/"), "uri").alias("uri"), "vec")
    answers = sparql("SELECT DISTINCT ?u WHERE { ?u <kg:performed> ?e }", relational_kg(spark, sf_dir))
    q = v.filter("uri = 'kg:user/1'").select(F.col("vec").alias("q")).limit(1)
    x = answers.join(v.withColumnRenamed("uri", "u"), "u").join(F.broadcast(q))
    return x.select("u", F.round(vectors.cosine(F.col("vec"), F.col("q")), 6).alias("similarity")).orderBy(F.desc("similarity"), "u").limit(10)


# Streams.


@query
def event_stream_triples(spark, sf_dir):
    """The events as a stream of files, read to their end and written to the shared folder."""
    events = read(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema)
    if events.inputFiles()[0].endswith("/events.parquet"):  # one file: a stream reads its folder
        stream = stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    else:
        stream = stream.parquet(f"{sf_dir}/events.parquet")
    out = new_path(spark, "stream")
    started = event_triples(stream, "kg:").drop("ts").writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    started.awaitTermination()
    return spark.read.parquet(f"{out}/data")


@query
def event_hour_counts(spark, sf_dir):
    """The windowed count of a stream, over a batch."""
    from .streaming.extract import mention_counts

    e = event_triples(read(spark, sf_dir, "events"), "kg:").select(F.col("o").alias("uri"), F.col("ts").cast("timestamp").alias("ts"))
    return mention_counts(e, "ts").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "uri", "n")
