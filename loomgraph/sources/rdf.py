"""Graph files: N-Triples, Turtle, JSON, parquet; and RDF/XML ontologies through the XML reader."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.kg import KnowledgeGraph
from ..operators.ontology import Ontology
from .turtle import read_turtle

BLANK = r"_:[^\s.]+(?:\.+[^\s.]+)*"
#: Escaped backslashes and quotes are masked, so that a literal ends at the next quote and no pattern recurses over long ones. Where a
#: line holds a mask itself, that is written as an escape first.
MASKS = (("\\\\", "\ufdd0"), ('\\"', "\ufdd1"))
#: What parts the terms of a line that was matched; and the characters that a line must not hold as they are.
CUT = "\ufdd2"
OWN = (*(mask for _, mask in MASKS), CUT)
TERM = rf'(<[^>]*>|{BLANK}|"[^"]*"(?:\^\^<[^>]*>|@[A-Za-z]+(?:-[A-Za-z0-9]+)*)?)'
LINE = rf"^\s*{TERM}\s+(<[^>]*>)\s+{TERM}\s*\.\s*(?:#.*)?$"
#: The escapes of the format; letters that stand for a character, and the characters.
ESCAPED = r"(?s)(?:\\u[0-9A-Fa-f]{4})+|\\U[0-9A-Fa-f]{8}|\\.|[^\\]+"
LETTERS = (("t", "\t"), ("b", "\b"), ("n", "\n"), ("r", "\r"), ("f", "\f"))


def _unescaped(text: Column) -> Column:
    """Escapes undone in one pass from left to right, so that an escaped backslash is no part of another escape."""

    def one(t: Column) -> Column:
        second = F.substring(t, 2, 1)
        simple = second
        for letter, char in LETTERS:
            simple = F.when(second == letter, F.lit(char)).otherwise(simple)
        short = F.decode(F.unhex(F.regexp_replace(t, r"\\u", "")), "UTF-16BE")
        wide = F.decode(F.unhex(F.substring(t, 3, 8)), "UTF-32")
        return F.when(~F.startswith(t, F.lit("\\")), t).when(t.rlike(r"^\\u[0-9A-Fa-f]{4}"), short).when(t.rlike(r"^\\U[0-9A-Fa-f]{8}"), wide).otherwise(simple)

    return F.when(F.contains(text, F.lit("\\")), F.array_join(F.transform(F.regexp_extract_all(text, F.lit(ESCAPED), F.lit(0)), one), "")).otherwise(text)


def _term(raw: Column) -> Column:
    """The value of a term: iri without brackets, literal without quotes, blank node with its mark; escapes undone."""
    literal = F.regexp_extract(raw, r'^"([^"]*)"', 1)
    inner = F.when(F.startswith(raw, F.lit("<")), F.substring(raw, F.lit(2), F.length(raw) - 2)).when(F.startswith(raw, F.lit('"')), literal)
    for escape, mask in MASKS:
        inner = F.replace(inner, F.lit(mask), F.lit(escape))
    return F.coalesce(_unescaped(inner), raw)


def parse_ntriples(lines: DataFrame, col: str = "value", malformed: str = "raise") -> DataFrame:
    """s, p, o, o_is_literal, o_lang, o_type of the lines that hold a statement. Null and empty lines and remarks hold none; any other line
    is an error when it is read, or is left out if malformed is "drop"."""
    if malformed not in ("raise", "drop"):
        raise ValueError(f"malformed is raise or drop, not {malformed!r}")
    masked = F.col(col)
    for mask in OWN:
        masked = F.replace(masked, F.lit(mask), F.lit(f"\\u{ord(mask):04X}"))
    for escape, mask in MASKS:
        masked = F.replace(masked, F.lit(escape), F.lit(mask))
    # Lines without an escape or a mask, which are most, are not rewritten; each line is matched once.
    special = reduce(or_, [F.contains(F.col(col), F.lit(x)) for x in ("\\", *OWN)])
    line = F.when(special, masked).otherwise(F.col(col))
    # The three terms, and what is left; a line that does not match stays one part.
    parts = F.split(F.regexp_replace(line, LINE, f"$1{CUT}$2{CUT}$3{CUT}"), CUT)
    # Made by a generator, so that no later step matches the line again.
    lines = lines.select(F.explode(F.array(parts)).alias("x"))
    whole, first = F.size("x") == 4, F.col("x")[0]
    if malformed == "raise":
        blank = F.col("x").isNull() | first.rlike(r"^\s*(?:#.*)?$")
        whole = F.when(whole, True).when(blank, False).otherwise(F.raise_error(F.concat(F.lit("not a statement of N-Triples: "), F.substring(first, 1, 200))).cast("boolean"))
    rows = lines.filter(whole).select(first.alias("a"), F.col("x")[1].alias("b"), F.col("x")[2].alias("c"))
    tail = F.when(F.startswith("c", F.lit('"')), F.regexp_extract("c", r'(?s)^"[^"]*"(.*)$', 1))
    lang = F.when(F.startswith(tail, F.lit("@")), F.substring(tail, F.lit(2), F.length(tail)))
    kind = F.when(F.startswith(tail, F.lit("^^")), _unescaped(F.substring(tail, F.lit(4), F.length(tail) - 4)))
    return rows.select(
        _term(F.col("a")).alias("s"), _term(F.col("b")).alias("p"), _term(F.col("c")).alias("o"), F.startswith("c", F.lit('"')).alias("o_is_literal"),
        lang.alias("o_lang"), kind.alias("o_type"),
    )


def read_ntriples(spark: SparkSession, path: str, malformed: str = "raise") -> DataFrame:
    return parse_ntriples(spark.read.text(path), malformed=malformed)


def _node(col: Column) -> Column:
    """A resource as the format spells it: blank nodes by their mark, iris in brackets without what they must not hold."""
    iri = col
    for char in ("\\", "<", ">", '"', "{", "}", "|", "^", "`", " ", "\n", "\r", "\t"):
        iri = F.replace(iri, F.lit(char), F.lit(f"\\u{ord(char):04X}"))
    iri = F.when(col.rlike(r'[\\<>"{}|^` \n\r\t]'), iri).otherwise(col)  # few have any
    blank = F.startswith(col, F.lit("_:")) & col.rlike(f"^{BLANK}$")
    return F.when(blank, col).otherwise(F.concat(F.lit("<"), iri, F.lit(">")))


def _object(triples: DataFrame) -> Column:
    """The object of each triple as the format spells it; o_is_literal, o_lang and o_type are heeded where the table has them."""
    if "o_is_literal" not in triples.columns:
        return _node(F.col("o"))
    quoted = F.col("o")
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(a), F.lit(b))
    has = lambda name: F.col(name) if name in triples.columns else F.lit(None).cast("string")
    tag = F.when(has("o_lang").isNotNull(), F.concat(F.lit("@"), has("o_lang"))).when(has("o_type").isNotNull(), F.concat(F.lit("^^"), _node(has("o_type")))).otherwise("")
    return F.when(F.coalesce(F.col("o_is_literal"), F.lit(False)), F.concat(F.lit('"'), quoted, F.lit('"'), tag)).otherwise(_node(F.col("o")))


def ntriples(triples: DataFrame) -> DataFrame:
    """One line for each triple; o_is_literal, o_lang and o_type are heeded where the table has them."""
    return triples.select(F.concat(_node(F.col("s")), F.lit(" "), _node(F.col("p")), F.lit(" "), _object(triples), F.lit(" .")).alias("value"))


def turtle(triples: DataFrame) -> DataFrame:
    """A block for each subject: its predicates and objects, sorted. A subject's block is cut into several of 1000
    statements, so that no row grows with the graph."""
    lines = triples.select(_node(F.col("s")).alias("s"), F.concat(_node(F.col("p")), F.lit(" "), _object(triples)).alias("po")).filter("s is not null and po is not null")
    counts = lines.groupBy("s").agg(F.count("*").alias("n"))
    part = F.pmod(F.xxhash64("po"), F.ceil(F.col("n") / 1000))
    blocks = lines.join(counts, "s").groupBy("s", part.alias("part")).agg(F.sort_array(F.collect_list("po")).alias("po"))
    return blocks.select("s", F.concat("s", F.lit(" "), F.array_join("po", " ;\n    "), F.lit(" .")).alias("block"))


def _head(kg: KnowledgeGraph) -> DataFrame:
    """What a graph has besides its tables, as one row: its metadata is JSON, so that it comes back as it was."""
    import json

    row = (kg.name, kg.ontology_uri, json.dumps(kg.metadata, sort_keys=True))
    return kg.triples.sparkSession.createDataFrame([row], "graph_id string, ontology_uri string, metadata string")


def write(kg: KnowledgeGraph, path: str, fmt: str = "turtle") -> None:
    """parquet and json keep everything; ntriples and turtle the statements."""
    if fmt == "parquet":
        for name in ("entities", "relations", "triples"):
            getattr(kg, name).write.mode("overwrite").parquet(f"{path}/{name}")
        _head(kg).write.mode("overwrite").parquet(f"{path}/graph")
    elif fmt == "ntriples":
        ntriples(kg.triples).write.mode("overwrite").text(path)
    elif fmt == "turtle":
        turtle(kg.triples).select("block").write.mode("overwrite").text(path)
    elif fmt == "json":
        kg_json(kg).select("value").write.mode("overwrite").text(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")


def read(spark: SparkSession, path: str, fmt: str = "turtle", name: str = "kg") -> KnowledgeGraph:
    """The graph at a path. parquet and json restore its name, ontology_uri and metadata too, where they were written;
    of statements alone, entities are the ends that are no literals, relations the predicates."""
    if fmt == "parquet":
        e, r, t = (spark.read.parquet(f"{path}/{n}") for n in ("entities", "relations", "triples"))
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/graph")
        known = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)
        name, uri, metadata = _restored(spark.read.parquet(f"{path}/graph"), name) if known else (name, None, {})
        return KnowledgeGraph(name, e, r, t, uri, metadata)
    if fmt in ("ntriples", "turtle"):
        found = read_ntriples(spark, path) if fmt == "ntriples" else read_turtle(spark, path)
        t = found.withColumn("graph_id", F.lit(name)).withColumn("seq", F.monotonically_increasing_id())
        e = t.select(F.col("s").alias("uri")).unionByName(t.filter("not o_is_literal").select(F.col("o").alias("uri"))).distinct()
        return KnowledgeGraph(name, e.select(F.lit(name).alias("graph_id"), "uri"), t.select(F.lit(name).alias("graph_id"), F.col("p").alias("uri")).distinct(), t)
    if fmt == "json":
        return from_json_rows(spark.read.text(path), name)
    raise ValueError(f"unknown format {fmt!r}")


def _restored(head: DataFrame, name: str) -> tuple[str, str | None, dict]:
    import json

    row = head.select("graph_id", "ontology_uri", "metadata").first()  # one row a graph
    return (row.graph_id, row.ontology_uri, json.loads(row.metadata or "{}")) if row else (name, None, {})


def kg_json(kg: KnowledgeGraph) -> DataFrame:
    """A JSON object on a row for each part of the graph: kind (graph, entity, relation, triple), body. One row
    for a graph would grow with it; `as_document` makes that of a graph known to be small."""
    row = lambda df, kind: df.select("graph_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*[c for c in df.columns if c != "graph_id"])).alias("body"))
    rows = row(_head(kg), "graph").unionByName(row(kg.entities, "entity")).unionByName(row(kg.relations, "relation")).unionByName(row(kg.triples, "triple"))
    return rows.select("graph_id", "kind", "body", F.to_json(F.struct("graph_id", "kind", "body")).alias("value"))


def as_document(kg: KnowledgeGraph, most: int = 100_000) -> str:
    """A small graph as one JSON document: name, ontology_uri, metadata, entities, relations, triples."""
    import json

    n = kg.triples.count()
    if n > most:
        raise ValueError(f"{n} triples are too many for one document; write rows instead")
    rows = lambda df: [json.loads(r.j) for r in df.select(F.to_json(F.struct("*")).alias("j")).collect()]
    return json.dumps({"name": kg.name, "ontology_uri": kg.ontology_uri, "metadata": kg.metadata, "entities": rows(kg.entities), "relations": rows(kg.relations), "triples": rows(kg.triples)}, sort_keys=True)


def from_json_rows(lines: DataFrame, name: str = "kg") -> KnowledgeGraph:
    """The graph of the rows that kg_json wrote, all parts restored: name, ontology_uri and metadata too."""
    from ..schemas import ENTITY, RELATION, TRIPLE

    x = lines.select(F.from_json("value", "graph_id string, kind string, body string").alias("x")).select("x.*")

    def part(kind: str, schema: str) -> DataFrame:
        rows = x.filter(F.col("kind") == kind).select(F.col("graph_id").alias("g"), F.from_json("body", schema).alias("b"))
        return rows.select("g", "b.*").drop("graph_id").withColumnRenamed("g", "graph_id")

    name, uri, metadata = _restored(part("graph", "ontology_uri string, metadata string"), name)
    return KnowledgeGraph(name, part("entity", ENTITY), part("relation", RELATION), part("triple", TRIPLE), uri, metadata)


def read_owl(spark: SparkSession, path: str) -> Ontology:
    """Named classes, properties and individuals of an RDF/XML ontology, of one file or several, with the axioms on them: subclasses,
    disjoint and equivalent classes, domains and ranges (the property's own columns hold the first), sub-, equivalent and
    inverse properties, functional, inverse functional, transitive and symmetric ones. ord is the order of the file, and tells files
    apart by its high bits."""
    schema = (
        "`_rdf:about` string, `rdfs:label` array<struct<_VALUE:string,`_xml:lang`:string>>, `rdfs:comment` array<struct<_VALUE:string,`_xml:lang`:string>>,"
        " `rdfs:subClassOf` array<struct<`_rdf:resource`:string>>, `rdfs:domain` array<struct<`_rdf:resource`:string>>, `rdfs:range` array<struct<`_rdf:resource`:string>>,"
        " `owl:disjointWith` array<struct<`_rdf:resource`:string>>, `rdf:type` array<struct<`_rdf:resource`:string>>, `owl:equivalentClass` array<struct<`_rdf:resource`:string>>,"
        " `rdfs:subPropertyOf` array<struct<`_rdf:resource`:string>>, `owl:inverseOf` array<struct<`_rdf:resource`:string>>, `owl:equivalentProperty` array<struct<`_rdf:resource`:string>>"
    )
    linked = lambda c: F.coalesce(F.filter(F.transform(f"`{c}`", lambda x: x["_rdf:resource"]), lambda x: x.isNotNull()), F.array().cast("array<string>"))

    def tag(name: str) -> DataFrame:
        return spark.read.format("xml").option("rowTag", name).schema(schema).load(path).filter(F.col("`_rdf:about`").isNotNull())

    uri, order = F.col("`_rdf:about`"), F.monotonically_increasing_id()
    first = lambda c, f: F.try_element_at(F.col(f"`{c}`"), F.lit(1))[f]
    label = F.coalesce(first("rdfs:label", "_VALUE"), F.element_at(F.split(uri, "[#/]"), -1))
    about = F.coalesce(first("rdfs:comment", "_VALUE"), F.lit(""))
    parents = linked("rdfs:subClassOf")
    classes = tag("owl:Class").select(order.alias("ord"), uri.alias("uri"), label.alias("label"), about.alias("description"), parents.alias("parents"), linked("owl:disjointWith").alias("apart"), linked("owl:equivalentClass").alias("same"))

    links = {"domains": "rdfs:domain", "ranges": "rdfs:range", "above": "rdfs:subPropertyOf", "inverse": "owl:inverseOf", "same": "owl:equivalentProperty", "types": "rdf:type"}

    def props(name: str, kind: str) -> DataFrame:
        return tag(name).select(order.alias("ord"), F.lit(kind).alias("kind"), uri.alias("uri"), label.alias("label"), about.alias("description"), first("rdfs:domain", "_rdf:resource").alias("domain"), first("rdfs:range", "_rdf:resource").alias("range"), *[linked(x).alias(c) for c, x in links.items()])

    individuals = tag("owl:NamedIndividual").select(uri.alias("uri"), label.alias("label"), linked("rdf:type").alias("types"))

    def axiom(kind: str, pairs: DataFrame) -> DataFrame:
        return pairs.select(F.lit(kind).alias("axiom_type"), F.array(*pairs.columns).alias("components"), F.lit(None).cast("string").alias("verbalization"), F.lit(None).cast("string").alias("logical_form"))

    properties = props("owl:ObjectProperty", "object").unionByName(props("owl:DatatypeProperty", "data"))
    axioms = axiom("SubClassOf", classes.select("uri", F.explode("parents").alias("parent")))
    pairs = lambda df, c: df.select("uri", F.explode(c).alias("other"))
    named = {"object": "Object", "data": "Data"}
    found = [("DisjointClasses", classes, "apart"), ("EquivalentClasses", classes, "same"), ("ObjectPropertyDomain", properties, "domains"), ("ObjectPropertyRange", properties, "ranges")]
    found += [(f"Sub{n}PropertyOf", properties.filter(F.col("kind") == k), "above") for k, n in named.items()] + [(f"Equivalent{n}Properties", properties.filter(F.col("kind") == k), "same") for k, n in named.items()]
    found.append(("InverseObjectProperties", properties, "inverse"))
    for kind, df, c in found:
        axioms = axioms.unionByName(axiom(kind, pairs(df, c)))
    # What a property is: as an element of its own, or as a type of the property's element.
    for character in ("Functional", "InverseFunctional", "Transitive", "Symmetric"):
        own = tag(f"owl:{character}Property").select(uri.alias("uri"), F.lit("object").alias("kind"))
        typed = properties.filter(F.exists("types", lambda t: F.endswith(t, F.lit(f"#{character}Property")))).select("uri", "kind")
        every = own.join(properties.select("uri", F.col("kind").alias("known")).distinct(), "uri", "left").select("uri", F.coalesce("known", "kind").alias("kind")).unionByName(typed).distinct()
        for k, n in named.items():
            axioms = axioms.unionByName(axiom(f"{character}{n}Property", every.filter(F.col("kind") == k).select("uri")))
    axioms = axioms.unionByName(axiom("ClassAssertion", individuals.select("uri", F.explode("types").alias("type"))))
    return Ontology(classes.drop("apart", "same"), properties.drop(*links), axioms, path, individuals)
