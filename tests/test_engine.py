"""Hand-computed cases of the engine's semantics."""

import json
import math

import pytest
from pyspark.sql import functions as F

from loomgraph.config import Config, EmbeddingConfig, ExtractionConfig
from loomgraph.engine import Engine
from loomgraph.functions import scores, vectors
from loomgraph.functions.text import entity_uri, local_name, parsed_response, property_uri, sentences
from loomgraph.operators import distill as D
from loomgraph.operators import graph, infer, kg, ontology, similarity, verify
from loomgraph.operators.extract import CallableExtractor, ReplayExtractor
from loomgraph.plans.prompts import LanguageModel, PromptTemplate, fenced
from loomgraph.plans.sparql import SparqlError, is_select, sparql
from loomgraph.sources import rdf
from loomgraph.sources.turtle import TurtleError, parse_turtle


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_sentences(spark):
    assert one(spark, sentences(F.lit("Ada met Bob. Bob met Ada!\n Who? "))) == ["Ada met Bob.", "Bob met Ada!", "Who?"]
    assert one(spark, sentences(F.lit(None).cast("string"))) == [] == one(spark, sentences(F.lit("  ")))


def test_uris(spark):
    assert one(spark, entity_uri(F.lit("Foo-Bar é X"), "e/")) == "e/foobar__x"
    assert one(spark, property_uri(F.lit("Works In!"), "p/")) == "p/works_in!"
    assert [one(spark, local_name(F.lit(x))) for x in ("http://a/b#c", "http://a/b", "c")] == ["c", "b", "c"]


@pytest.mark.parametrize(("n", "want"), [(1, 0.8500000000000001), (2, 0.9), (3, 0.9500000000000001), (4, 1.0), (9, 1.0)])
def test_boost(spark, n, want):
    assert one(spark, scores.boosted(F.lit(n))) == want


@pytest.mark.parametrize(("c", "want"), [(0.99, "verified"), (0.90, "high"), (0.70, "medium"), (0.50, "low"), (0.4999, "uncertain")])
def test_level(spark, c, want):
    assert one(spark, scores.level(F.lit(c))) == want


@pytest.mark.parametrize(("d", "want"), [(49, 1.0), (50, 0.8), (199, 0.8), (200, 0.6), (None, 0.3)])
def test_evidence(spark, d, want):
    far = F.lit(0) if d is None else F.lit(1 + d)
    assert one(spark, scores.evidence(F.lit("a"), F.lit("b"), F.lit(1), far)) == want


def test_evidence_of_empty_label(spark):
    assert one(spark, scores.evidence(F.lit(""), F.lit("b"), F.lit(1), F.lit(2))) == 0.5


@pytest.mark.parametrize(("a", "b", "ev", "neural", "hybrid"), [(1, 1, 0.3, 0.69, 0.7829999999999999), (2, 2, 0.3, 0.7050000000000001, 0.7935), (4, 4, 0.3, 0.7350000000000001, 0.8145), (4, 4, 1.0, 0.875, 0.9124999999999999)])
def test_scores(spark, a, b, ev, neural, hybrid):
    n = scores.neural(scores.boosted(F.lit(a)), scores.boosted(F.lit(b)), F.lit(ev))
    assert one(spark, n) == neural and one(spark, scores.hybrid(n)) == hybrid


def test_threshold():
    assert scores.threshold(None, 0.7) == scores.threshold(0, 0.7) == 0.7 and scores.threshold(0.85, 0.7) == 0.85


def respond(entities, relations):
    return json.dumps({"entities": [{"text": t, "type": "Name"} for t in entities], "relations": [dict(zip(("subject", "predicate", "object"), r)) for r in relations]})


def replay(spark, answers):
    return ReplayExtractor(spark.createDataFrame([(1, i, a) for i, a in enumerate(answers)], "doc_id long, chunk_idx int, response string"))


@pytest.fixture
def ada(spark):
    docs = spark.createDataFrame([(1, "Ada met Bob. Bob met Ada. Bob left.")], "doc_id long, text string")
    answers = [respond(["Ada", "Bob"], [("Ada", "met", "Bob")]), respond(["Bob", "Ada"], []), respond(["Bob"], [])]
    return docs, replay(spark, answers)


def test_distill(ada):
    x = D.distill(*ada)
    assert {(r.label, r.n, r.confidence) for r in x.entities.collect()} == {("Ada", 2, 0.9), ("Bob", 3, 0.9500000000000001)}
    t = x.triples.first()
    assert (t.evidence, t.neural, t.confidence) == (1.0, 0.8525, 0.8967499999999999) and t.confidence_level == "medium"
    s = x.summary.first()
    assert (s.n_chunks, s.n_triples, s.level) == (3, 1, "medium")


def test_messy_documents(spark):
    from loomgraph.operators.extract import RuleExtractor

    rows = [(1, "Ada met Bob.", "x"), (1, "Bob met Ada.", "x"), (2, None, "x"), (3, "", "x"), (None, "Eve met Bob.", "x"), (4, "no names", None)]
    x = D.distill(spark.createDataFrame(rows, "doc_id long, text string, label string"), RuleExtractor())
    assert {(r.doc_id, r.label, r.n) for r in x.entities.collect()} == {(1, "Ada", 2), (1, "Bob", 2)}
    assert {r.doc_id for r in x.triples.collect()} == {1} and x.triples.count() == 2
    assert {(r.doc_id, r.n_chunks) for r in x.summary.filter("doc_id > 1").collect()} == {(2, 0), (3, 0), (4, 1)}
    none = D.distill(spark.createDataFrame([], "doc_id long, text string"), RuleExtractor())
    assert none.triples.count() == none.entities.count() == none.summary.count() == 0


def test_names_within_words(spark):
    from loomgraph.operators.extract import RuleExtractor

    x = RuleExtractor()(spark.createDataFrame([(1, 'TOKEN = "9233A8ECF7"!! An iPhone, \u00c9t\u00e9_2.')], "doc_id long, text string"))
    names = [[e.text for e in c.entities] for c in x.first().chunks]
    assert names == [["TOKEN", "A8ECF7"], ["An", "Phone", "\u00c9t\u00e9_2"]]


def test_mean_confidence_in_any_order(spark):
    from itertools import accumulate

    values = [0.825] * 7 + [0.8302499999999999] * 7 + [0.881] * 5 + [0.853] * 7 + [0.8354999999999999] * 5 + [0.8634999999999999]
    extracted = spark.createDataFrame([(1, "x", [])], "doc_id long, text string, chunks array<string>")
    rows = [(1, k, v) for k, v in enumerate(values)]
    mean = list(accumulate(reversed(values)))[-1] / len(values)  # sum() would compensate
    for order in (rows, rows[::-1], sorted(rows, key=lambda r: r[2]), rows[16:] + rows[:16]):
        triples = spark.createDataFrame(order, "doc_id long, seq int, confidence double").coalesce(1)
        assert D.summaries(extracted, triples).first().confidence == mean


def test_spellings_and_limits(spark):
    docs = spark.createDataFrame([(1, "Foo-Bar is FooBar of Zed.")], "doc_id long, text string")
    answers = [respond(["Foo-Bar", "FooBar", "Zed"], [("FooBar", "of", "Zed"), ("Foo-Bar", "of", "Zed"), ("foo-bar", "by", "Zed"), ("Zed", "of", "Nobody")])]
    x = D.distill(docs, replay(spark, answers))
    assert {(r.label, r.n) for r in x.entities.collect()} == {("Foo-Bar", 2), ("Zed", 1)}
    assert x.triples.count() == 2 and x.relations.count() == 2
    one_triple = D.distill(docs, replay(spark, answers), ExtractionConfig(max_triples=1))
    assert one_triple.triples.count() == 1 and one_triple.relations.count() == 2
    assert D.distill(docs, replay(spark, answers), ExtractionConfig(max_entities=1)).triples.count() == 0


def test_responses(spark):
    body = respond(["A"], [])
    rows = [body, f"text\n```json\n{body}\n```", f"```\n{body}\n```", "junk", "```json\n{broken\n```", "{}", '{"entities": [{"text": null}]}', None]
    df = spark.createDataFrame([(r,) for r in rows], "r string").select(parsed_response(F.col("r")).alias("x"))
    assert [[e.text for e in r.x.entities] for r in df.collect()] == [["A"], ["A"], ["A"], [], [], [], [""], []]


def test_engine_paths(spark, ada):
    docs, ex = ada
    e = Engine(spark, extractor=ex)
    assert e.extract_knowledge(docs).triples.count() == 1
    assert e.extract_knowledge(docs, confidence_threshold=0.95).triples.count() == 0
    v = e.extract_knowledge(docs, verify_triples=True, confidence_threshold=0.95).triples.first()
    assert (v.confidence, v.confidence_level, v.status) == (1.0, "verified", "verified")
    refuted = e.extract_knowledge(docs, verify_triples=True, refuted=v_stmt(spark, v)).triples.first()
    assert refuted.status == "refuted" and refuted.confidence == pytest.approx(0.089675) and refuted.confidence_level == "uncertain"
    assert e.extract_knowledge(docs, rejected=v_stmt(spark, v)).triples.count() == 0
    g = e.extract_to_graph(docs)
    assert len(g) == 1 and g.entities.count() == 2
    assert e.statistics()["components"]["extractor"] == "ReplayExtractor"


def v_stmt(spark, v):
    return spark.createDataFrame([(v.s, v.p, v.o)], "s string, p string, o string")


def test_gate(spark):
    t = spark.createDataFrame([(1, 0.79), (2, 0.8)], "seq int, confidence double").selectExpr("1 as doc_id", "seq", "'a' as s", "'p' as p", "'b' as o", "confidence", "'medium' as confidence_level")
    assert [(r.confidence, r.status) for r in verify.verify(t).orderBy("seq").collect()] == [(0.79, "unknown"), (1.0, "verified")]


def test_callable_extractor(spark):
    docs = spark.createDataFrame([(1, "Ada met Bob. Nothing.")], "doc_id long, text string")
    ex = CallableExtractor(lambda chunks: ['{"entities": [{"text": "%s", "type": "t"}]}' % c.split()[0].strip(".") for c in chunks])
    assert {r.label for r in D.distill(docs, ex).entities.collect()} == {"Ada", "Nothing"}


def triples(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "seq long, s string, p string, o string")


def test_neighbors_and_edges(spark):
    t = triples(spark, [("a", "p", "b"), ("c", "q", "a"), ("a", "r", "a")])
    assert {r.neighbor for r in kg.neighbors(t, "a").collect()} == {"a", "b", "c"}
    t = triples(spark, [("a", "p", "b"), ("b", "q", "a"), ("a", "r", "a")])
    assert {tuple(r) for r in graph.edges(t).collect()} == {("a", "b", "q"), ("a", "a", "r")}
    e = spark.createDataFrame([("d",)], "uri string")
    assert {r.uri for r in graph.nodes(t, e).collect()} == {"a", "b", "d"}
    assert {(r.node, r.degree) for r in graph.degrees(graph.edges(t)).collect()} == {("a", 2), ("b", 1)}


def test_walks(spark):
    t = triples(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("c", "p", "d")])
    e = graph.edges(t)
    near = {(r.node, r.next) for r in graph.arcs(e).collect()}
    for w in (graph.walks(e, 3, 12, 7), graph.biased_walks(e, 3, 6, 0.25, 4.0, 7)):
        rows = w.collect()
        assert len(rows) == 12 and all((x, y) in near for r in rows for x, y in zip(r.path, r.path[1:]))
    again = graph.walks(e, 3, 12, 7)
    assert sorted(map(str, again.collect())) == sorted(map(str, graph.walks(e, 3, 12, 7).collect()))


def test_embeddings(spark):
    t = triples(spark, [("a", "p", "b"), ("b", "p", "c")])
    cfg = EmbeddingConfig(num_walks=2, walk_length=4, embedding_dim=4, epochs=1)
    for method in ("rdf_walk", "node2vec", "transe", "distmult"):
        rows = graph.embed(t, cfg, method).collect()
        assert {r.uri for r in rows} == {"a", "b", "c"} and all(len(r.vec) == 4 for r in rows)
    with pytest.raises(ValueError, match="unknown"):
        graph.embed(t, cfg, "other")


def test_similarity(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 2.0]), ("c", [2.0, 0.0]), ("z", [0.0, 0.0])], "uri string, vec array<float>")
    top = similarity.find_similar(v.filter("uri <> 'z'"), "a", 2).collect()
    assert [(r.uri, r.similarity) for r in top] == [("c", 1.0), ("b", 0.0)]
    assert similarity.find_similar(v, "nobody").count() == 0
    assert math.isnan(similarity.find_similar(v, "z", 1).first().similarity)
    with pytest.raises(ValueError, match="metric"):
        similarity.find_similar(v, "a", 1, "other")
    assert one(spark, vectors.cosine(F.lit(None).cast("array<double>"), F.array(F.lit(1.0)))) == 0.0


def test_bag_and_upsert(spark):
    t = triples(spark, [("a", "p", "b"), ("a", "p", "b")])
    assert t.count() == 2 and kg.distinct_triples(t).count() == 1
    e = spark.createDataFrame([("g", 1, "u", "old"), ("g", 2, "v", "x"), ("g", 3, "u", "new")], "graph_id string, seq long, uri string, label string")
    assert {(r.seq, r.uri, r.label) for r in kg.last_written(e).collect()} == {(1, "u", "new"), (2, "v", "x")}


def test_closure_ends_on_cycles(spark):
    t = triples(spark, [("a", "p", "b"), ("b", "p", "c"), ("c", "p", "a"), ("x", "p", "y")])
    got = {(r.s, r.o) for r in infer.closure(t).collect()}
    assert got == {(a, b) for a in "abc" for b in "abc"} | {("x", "y")}
    assert infer.infer(t, symmetric_of=("p",), max_inferences=2).count() == 2 and infer.infer(t).count() == 0


def test_sparql_errors(spark):
    t = triples(spark, [("a", "p", "b")])
    for q in ("ASK { ?s ?p ?o }", "SELECT ?s WHERE { ?s ?p ?o", "SELECT ?s WHERE { ?s ?p }", "SELECT ?s WHERE { }", "SELECT (X(?s) AS ?y) WHERE { ?s ?p ?o }"):
        with pytest.raises(SparqlError):
            sparql(q, t)
    assert is_select(" select ?x") and not is_select("who?")
    assert sparql("SELECT * WHERE { ?s <p> ?o . OPTIONAL { ?o <q> ?z } FILTER(!BOUND(?z)) }", t).count() == 1
    assert sparql("SELECT ?s WHERE { ?s <p> ?s }", t).count() == 0


def test_questions(spark):
    t = triples(spark, [("a", "p", "b")])
    e = Engine(spark, model=LanguageModel(lambda prompt: "Sure:\n```sparql\nSELECT ?o WHERE { <a> <p> ?o }\n```"))
    assert e.query("what does a have?", t).first().o == "b"
    with pytest.raises(ValueError, match="language model"):
        Engine(spark).query("what?", t)
    assert fenced("```\nx\n```") == "x" and fenced(" y ") == "y"
    assert LanguageModel(str.upper).explain([]) == "No reasoning path is recorded."
    with pytest.raises(KeyError):
        PromptTemplate("n", "{a}").format(b="c")


def test_files(spark, tmp_path):
    t = triples(spark, [("http://a", "http://p", 'x "q" \\ \n y')]).withColumn("o_is_literal", F.lit(True)).withColumn("graph_id", F.lit("g"))
    e = spark.createDataFrame([("g", "http://a", "A")], "graph_id string, uri string, label string")
    g = kg.KnowledgeGraph("g", e, spark.createDataFrame([("g", "http://p")], "graph_id string, uri string"), t, None, {"k": 1})
    for fmt in ("parquet", "ntriples", "json", "turtle"):
        rdf.write(g, str(tmp_path / fmt), fmt)
        back = rdf.read(spark, str(tmp_path / fmt), fmt)
        assert [tuple(r) for r in back.triples.select("s", "p", "o", "o_is_literal").collect()] == [("http://a", "http://p", 'x "q" \\ \n y', True)]
        assert {r.uri for r in back.entities.collect()} == {"http://a"}
        if fmt in ("parquet", "json"):
            assert (back.name, back.ontology_uri, back.metadata) == ("g", None, {"k": 1})
    assert json.loads(rdf.as_document(g))["metadata"] == {"k": 1}
    with pytest.raises(ValueError, match="format"):
        rdf.write(g, "x", "other")


def test_escapes_tags_and_blank_nodes(spark):
    rows = [("_:b1", "http://p", "C:\\new\\table", True, None, None), ("http://a", "http://p", "_:b1", False, None, None), ("http://a", "http://p", "caf\u00e9 \U0001f600\t\n\r\"", True, "en-GB", None), ("http://x y", "http://p", "1", True, None, "http://t>")]
    t = spark.createDataFrame(rows, "s string, p string, o string, o_is_literal boolean, o_lang string, o_type string")
    lines = rdf.ntriples(t)
    assert {tuple(r) for r in rdf.parse_ntriples(lines).collect()} == set(rows) and any(r.value.startswith("_:b1 ") for r in lines.collect())
    text = "\n".join(r.value for r in lines.collect())
    assert set(parse_turtle(text)) == set(rows)
    odd = spark.createDataFrame([('<a> <p> "caf\\u00E9 \\uD83D\\uDE00 \\U0001F600 \\\\n"@en .',), ("# no statement",), ("_:a.b <p> _:c . # so",)], "value string")
    assert rdf.parse_ntriples(spark.createDataFrame([("",), (None,), ("  # x",)], "value string")).count() == 0
    broken = spark.createDataFrame([("<a> <b> broken .",), ("<a> <b> <c> .",)], "value string")
    with pytest.raises(Exception, match="not a statement"):
        rdf.parse_ntriples(broken).collect()
    assert rdf.parse_ntriples(broken, malformed="drop").count() == 1
    masks = spark.createDataFrame([("a", "b", "\ufdd0y \ufdd1 \\ \" x", True)], "s string, p string, o string, o_is_literal boolean")
    assert [r.o for r in rdf.parse_ntriples(rdf.ntriples(masks)).collect()] == ["\ufdd0y \ufdd1 \\ \" x"]
    assert {(r.s, r.o, r.o_lang) for r in rdf.parse_ntriples(odd).collect()} == {("a", "caf\u00e9 \U0001f600 \U0001f600 \\n", "en"), ("_:a.b", "_:c", None)}


def test_turtle():
    text = """@prefix ex: <http://e/> . @base <http://b/> .
PREFIX : <http://d/>
ex:a a ex:T ; ex:p "x\\ty"@en , 'q' , \"\"\"lo"ng
x\"\"\" , 12 , -1.5 , 1e3 , true ; ex:q [ ex:r _:b1 ; ex:s () ] , ( 1 ex:z ) ; .
[] ex:p <rel> . # comment
:x :y.z :w\\,v .
"""
    got = parse_turtle(text, "f")
    xsd, rdfns = "http://www.w3.org/2001/XMLSchema#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
    of = lambda s, p: [(o, k) for a, b, o, _, _, k in got if a == s and b == p]
    assert of("http://e/a", rdfns + "type") == [("http://e/T", None)] and of("http://d/x", "http://d/y.z") == [("http://d/w,v", None)]
    assert of("http://e/a", "http://e/p") == [("x\ty", None), ("q", None), ('lo"ng\nx', None), ("12", xsd + "integer"), ("-1.5", xsd + "decimal"), ("1e3", xsd + "double"), ("true", xsd + "boolean")]
    (node, _), (head, _) = of("http://e/a", "http://e/q")
    assert of(node, "http://e/s") == [(rdfns + "nil", None)] and of(head, rdfns + "first") == [("1", xsd + "integer")]
    assert sum(o == "http://b/rel" for _, _, o, *_ in got) == 1 and len(got) == 18
    for bad in ("<a> <b> <c>", "<a> <b> .", "x:a <b> <c> .", "<a> 'b' <c> .", "<a> <b> 'c"):
        with pytest.raises(TurtleError):
            parse_turtle(bad)


def test_unbound_variables(spark):
    t = triples(spark, [("a", "p", "x"), ("b", "p", "x"), ("c", "p", "x"), ("a", "q", "1"), ("b", "r", "2"), ("a", "r", "1"), ("2", "z", "n"), ("1", "z", "m")])
    got = sparql("SELECT ?s ?v WHERE { ?s <p> ?o . OPTIONAL { ?s <q> ?v } OPTIONAL { ?s <r> ?v } }", t)
    assert {tuple(r) for r in got.collect()} == {("a", "1"), ("b", "2"), ("c", None)}
    got = sparql("SELECT ?s ?v ?n WHERE { { ?s <p> ?o } UNION { ?s <q> ?v } { ?v <z> ?n } }".replace("{ ?v <z> ?n } }", "?v <z> ?n }"), t)
    assert {tuple(r) for r in got.collect()} == {("a", "1", "m")} | {(s, v, n) for s in "abc" for v, n in (("1", "m"), ("2", "n"))}


def test_added_triples(spark):
    t = triples(spark, [("a", "p", "b"), ("a", "q", "x")]).withColumn("o_is_literal", F.col("p") == "q").withColumn("graph_id", F.lit("g"))
    e = spark.createDataFrame([("g", "a", "A")], "graph_id string, uri string, label string")
    g = kg.KnowledgeGraph("g", e, spark.createDataFrame([], "graph_id string, uri string"), t.limit(0)).add_triples(t)
    assert {(r.uri, r.label) for r in g.entities.collect()} == {("a", "A"), ("b", None)} and {r.uri for r in g.relations.collect()} == {"p", "q"}
    assert len(g) == 2 and g.triples.filter("ts is null").count() == 0
    again = g.add_triples(t, F.lit("2024-01-01").cast("timestamp"))
    assert again.entities.count() == 2 and again.triples.filter("year(ts) = 2024").count() == 2


def test_biased_walk_weights(spark):
    """Steps follow the weights: back one time in seven, to a common neighbour two, away four, with p = 2 and q = 1/2."""
    t = triples(spark, [("s", "e", "h"), ("h", "e", "c"), ("s", "e", "c"), ("h", "e", "x")])
    rows = graph.biased_walks(graph.edges(t), 3000, 3, 2.0, 0.5, 1).filter("start = 's' and path[1] = 'h'").groupBy(F.col("path")[2].alias("to")).count().collect()
    n = {r.to: r["count"] for r in rows}
    total = sum(n.values())
    assert total > 1000 and all(abs(n[k] / total - w / 3.5) < 0.05 for k, w in (("s", 0.5), ("c", 1.0), ("x", 2.0)))


OWL = """<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o">
<owl:Class rdf:about="x#Animal"><rdfs:label>Animal</rdfs:label><rdfs:comment>moves</rdfs:comment></owl:Class>
<owl:Class rdf:about="x#Dog"><rdfs:subClassOf rdf:resource="x#Animal"/><owl:disjointWith rdf:resource="x#Cat"/></owl:Class>
<owl:Class rdf:about="x#Cat"><rdfs:subClassOf rdf:resource="x#Animal"/></owl:Class>
<owl:NamedIndividual rdf:about="x#rex"><rdf:type rdf:resource="x#Dog"/><rdfs:label>Rex</rdfs:label></owl:NamedIndividual>
<owl:ObjectProperty rdf:about="x#eats"><rdfs:label>eats</rdfs:label><rdfs:domain rdf:resource="x#Animal"/><rdfs:range rdf:resource="x#Animal"/></owl:ObjectProperty>
</rdf:RDF>"""


def test_ontology_file(spark, tmp_path):
    for name in ("x/a", "y/a", "y/b", "y/c"):  # the same in one file, and over several
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(OWL if name[2] == "a" else "<rdf:RDF></rdf:RDF>")
    e = Engine(spark)
    assert e.statistics()["components"]["ontology"] == {"loaded": False}
    assert e.load_ontology(str(tmp_path / "y")).classes.count() == 3
    o = e.load_ontology(str(tmp_path / "x/a"))
    counts = e.statistics()["components"]["ontology"]
    assert counts["loaded"] and (counts["classes"], counts["individuals"], counts["data_properties"]) == (3, 1, 0)
    assert [(r.s, r.o) for r in o.types().collect()] == [("x#rex", "x#Dog")]
    assert {(r.uri, r.label, tuple(r.parents)) for r in o.classes.collect()} == {("x#Animal", "Animal", ()), ("x#Dog", "Dog", ("x#Animal",)), ("x#Cat", "Cat", ("x#Animal",))}
    assert o.object_properties.first().domain == "x#Animal"
    typed = triples(spark, [("rex", ontology.TYPE, "x#Dog"), ("rex", ontology.TYPE, "x#Cat")])
    types = ontology.entity_types(typed, o)
    assert ontology.disjoint_violations(types, o.axioms).count() == 1
    facts = triples(spark, [("rex", "x#eats", "rex"), ("stone", "x#eats", "rex")])
    assert ontology.is_consistent(ontology.domain_range_violations(facts, types, o.properties))
    p = verify.Policies()
    p.add("a", ["x"])
    p.add("a", ["y"])
    p.add_ontology(o)
    assert {tuple(r) for r in p.refuted(facts, types).collect()} == {("rex", "x#eats", "rex"), ("stone", "x#eats", "rex")}
    assert p.by_name["a"] == ["y"] and ["x#Dog", "x#Animal"] in p.axioms("SubClassOf")
    assert "- eats" in o.prompt_schema()
    assert {r.n for r in ontology.empty(spark).statistics().collect()} == {0}


def test_config(tmp_path):
    c = Config()
    c.extraction.max_entities = 3
    c.save(str(tmp_path / "c.json"))
    assert Config.load(str(tmp_path / "c.json")) == c
    with pytest.raises(KeyError):
        Config.from_dict({"nothing": 1})


def test_logger(tmp_path):
    import loomgraph

    log = loomgraph.setup_logger("debug", str(tmp_path / "x.log"))
    log.debug("hello")
    assert "hello" in (tmp_path / "x.log").read_text() and len(loomgraph.setup_logger().handlers) == 1


def test_unknown_provider():
    from loomgraph.config import LLMConfig
    from loomgraph.plans.prompts import connect

    with pytest.raises(ValueError, match="provider"):
        connect(LLMConfig(provider="other"))


def test_inferred_types(spark):
    e = spark.createDataFrame([("a", ["X"]), ("b", None), ("c", None)], "uri string, inferred_types array<string>")
    types = spark.createDataFrame([("a", "Y"), ("b", "Z"), ("b", "W")], "uri string, type string")
    assert {r.uri: r.inferred_types for r in ontology.with_inferred_types(e, types).collect()} == {"a": ["X"], "b": ["W", "Z"], "c": None}


def test_axioms_of_files(spark, tmp_path):
    """Equivalence, property characteristics, inverses; several domains hold together, disjointness of any number of classes."""
    (tmp_path / "o.owl").write_text("""<rdf:RDF>
<owl:Class rdf:about="A"><owl:equivalentClass rdf:resource="B"/></owl:Class>
<owl:ObjectProperty rdf:about="p"><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#FunctionalProperty"/><rdf:type rdf:resource="http://www.w3.org/2002/07/owl#TransitiveProperty"/>
<owl:inverseOf rdf:resource="q"/><rdfs:subPropertyOf rdf:resource="r"/><rdfs:domain rdf:resource="A"/><rdfs:domain rdf:resource="C"/></owl:ObjectProperty>
<owl:DatatypeProperty rdf:about="d"><owl:equivalentProperty rdf:resource="e"/></owl:DatatypeProperty>
<owl:SymmetricProperty rdf:about="s"/><owl:FunctionalProperty rdf:about="d"/>
</rdf:RDF>""")
    o = rdf.read_owl(spark, str(tmp_path / "o.owl"))
    got = {(r.axiom_type, *r.components) for r in o.axioms.collect()}
    assert got == {
        ("EquivalentClasses", "A", "B"), ("FunctionalObjectProperty", "p"), ("TransitiveObjectProperty", "p"), ("InverseObjectProperties", "p", "q"), ("SubObjectPropertyOf", "p", "r"),
        ("ObjectPropertyDomain", "p", "A"), ("ObjectPropertyDomain", "p", "C"), ("EquivalentDataProperties", "d", "e"), ("SymmetricObjectProperty", "s"), ("FunctionalDataProperty", "d"),
    }
    types = spark.createDataFrame([("x", "A"), ("y", "A"), ("y", "C"), ("z", "D"), ("z", "E")], "uri string, type string")
    facts = triples(spark, [("x", "p", "w"), ("y", "p", "w"), ("w", "t", "z"), ("v", "d", "1"), ("v", "d", "2")])
    p = verify.Policies()
    p.add_ontology(o)
    p.add("apart", [("DisjointClasses", ["C", "D", "E"])])
    assert {tuple(r) for r in p.refuted(facts, types).collect()} == {("x", "p", "w"), ("w", "t", "z"), ("v", "d", "1"), ("v", "d", "2")}


def test_labels_by_index(spark):
    schema = spark.createDataFrame([(2, "u2", "Located In"), (0, "u0", None), (1, "u1", "in"), (3, "u3", ""), (4, "u4", "é x")], "ord int, uri string, label string")
    labels = spark.createDataFrame([("",), ("in",), ("IN",), ("located in",), ("catedx",), (" ",), ("É",), (None,), ("xyz",)], "l string")
    got = {r.l: r.m for r in D.map_labels(labels, "l", schema, "m").collect()}
    assert got == {"": "u1", "in": "u1", "IN": "u1", "located in": "u2", "catedx": None, " ": "u2", "É": "u4", None: None, "xyz": None}
    assert {r.m for r in D.map_labels(labels, "l", schema.limit(0), "m").collect()} == {None}


def test_reasoning_of_the_engine(spark, tmp_path):
    """The loaded ontology's axioms as rules over a graph, what each result rests on, and its classification."""
    (tmp_path / "o.owl").write_text("""<rdf:RDF>
<owl:Class rdf:about="Dog"><rdfs:subClassOf rdf:resource="Animal"/><owl:equivalentClass rdf:resource="Hound"/></owl:Class><owl:Class rdf:about="Animal"/>
<owl:ObjectProperty rdf:about="owns"><rdfs:range rdf:resource="Dog"/><owl:inverseOf rdf:resource="ownedBy"/></owl:ObjectProperty></rdf:RDF>""")
    e = Engine(spark)
    with pytest.raises(ValueError, match="ontology"):
        e.classify()
    e.load_ontology(str(tmp_path / "o.owl"))
    graph_ = triples(spark, [("ann", "owns", "rex"), ("tom", ontology.TYPE, "Animal")])
    out = e.reason(graph_)
    assert {tuple(r) for r in out["triple"].collect()} == {("ann", "owns", "rex"), ("rex", "ownedBy", "ann")}
    assert {tuple(r) for r in out["type"].collect()} == {("tom", "Animal"), ("rex", "Dog"), ("rex", "Hound"), ("rex", "Animal")}
    why = {(r.c0, r.c1): r.why for r in e.explain(graph_, "type").collect()}
    assert why["rex", "Dog"] == ["range(owns, Dog)", "triple(ann, owns, rex)"] and why["tom", "Animal"] == ["type(tom, Animal)"]
    assert {tuple(r) for r in e.classify().collect()} == {("Dog", "Animal"), ("Hound", "Animal"), ("Dog", "Hound"), ("Hound", "Dog")}


def test_arcs_are_numbered_in_one_shuffle_and_walks_do_not_depend_on_lists(spark, monkeypatch):
    e = spark.createDataFrame([(f"n{i}", f"n{j}") for i in range(12) for j in range(i, 12, 1 + i % 3)], "a string, b string")
    rows = lambda df: sorted(map(str, df.collect()))
    numbered = graph._numbered(e)
    assert numbered._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert rows(numbered) == rows(graph._numbered(e, hot=5))
    made = lambda: (rows(graph.walks(e, 2, 10, 3)), rows(graph.biased_walks(e, 2, 6, 0.5, 2.0, 3)))
    whole = made()
    monkeypatch.setattr(graph, "LIST", 3)
    assert made() == whole


def test_gradients_are_summed_without_exploding_them(spark):
    from loomgraph.operators.translate import _apply

    vec = spark.createDataFrame([("a", [0.5, 0.0]), ("b", [0.0, 0.5])], "uri string, v array<double>")
    steps = spark.createDataFrame([("a", [1.0, 2.0]), ("a", [3.0, -2.0])], "uri string, g array<double>")
    out = _apply(vec, steps, "uri", 0.1, 2)
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.uri: [round(x, 9) for x in r.v] for r in out.collect()} == {"a": [0.3, 0.0], "b": [0.0, 0.5]}
