"""The knowledge graph: three tables, bag semantics for triples, graph_id on every row."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class KnowledgeGraph:
    """entities(graph_id, seq, uri, ..), relations(graph_id, seq, uri, ..), triples(graph_id, seq, s, p, o, ..)."""

    name: str
    entities: DataFrame
    relations: DataFrame
    triples: DataFrame
    ontology_uri: str | None = None
    metadata: dict = field(default_factory=dict)

    def __len__(self) -> int:
        return self.triples.count()

    def by_subject(self, uri: str) -> DataFrame:
        return by_subject(self.triples, uri)

    def by_predicate(self, uri: str) -> DataFrame:
        return by_predicate(self.triples, uri)

    def neighbors(self, uri: str) -> DataFrame:
        return neighbors(self.triples, uri)

    def add_entities(self, more: DataFrame) -> KnowledgeGraph:
        return KnowledgeGraph(self.name, last_written(self.entities.unionByName(more, allowMissingColumns=True)), self.relations, self.triples, self.ontology_uri, self.metadata)

    def add_relations(self, more: DataFrame) -> KnowledgeGraph:
        return KnowledgeGraph(self.name, self.entities, last_written(self.relations.unionByName(more, allowMissingColumns=True)), self.triples, self.ontology_uri, self.metadata)

    def add_triples(self, more: DataFrame, at: Column | None = None) -> KnowledgeGraph:
        """The graph with more triples. Their ends that are no literals and their predicates are registered, unless the graph
        knows them already; triples without a time get `at`, or else the current one."""
        t = more if "graph_id" in more.columns else more.withColumn("graph_id", F.lit(self.name))
        now = F.current_timestamp() if at is None else at
        t = t.withColumn("ts", F.coalesce(F.col("ts"), now) if "ts" in t.columns else now)
        resource = ~F.coalesce(F.col("o_is_literal"), F.lit(False)) if "o_is_literal" in t.columns else F.lit(True)
        ends = t.select("graph_id", F.col("s").alias("uri")).unionByName(t.filter(resource).select("graph_id", F.col("o").alias("uri"))).distinct()
        new = lambda rows, known: rows.join(known.select("graph_id", "uri").distinct(), ["graph_id", "uri"], "left_anti")
        e = self.entities.unionByName(new(ends, self.entities), allowMissingColumns=True)
        r = self.relations.unionByName(new(t.select("graph_id", F.col("p").alias("uri")).distinct(), self.relations), allowMissingColumns=True)
        return KnowledgeGraph(self.name, e, r, self.triples.unionByName(t, allowMissingColumns=True), self.ontology_uri, self.metadata)


def by_subject(triples: DataFrame, uri: str) -> DataFrame:
    return triples.filter(F.col("s") == uri)


def by_predicate(triples: DataFrame, uri: str) -> DataFrame:
    return triples.filter(F.col("p") == uri)


def neighbors(triples: DataFrame, uri: str) -> DataFrame:
    """Objects of its triples and subjects of triples on it, each once; a self-loop gives the node itself."""
    out = triples.filter(F.col("s") == uri).select(F.col("o").alias("neighbor"))
    into = triples.filter(F.col("o") == uri).select(F.col("s").alias("neighbor"))
    return out.unionByName(into).distinct()


def last_written(rows: DataFrame, key: tuple[str, ...] = ("graph_id", "uri")) -> DataFrame:
    """One row for each key: the last by seq, at the place of the first."""
    rest = [c for c in rows.columns if c not in (*key, "seq")]
    agg = rows.groupBy(*key).agg(F.min("seq").alias("seq"), F.max_by(F.struct(*rest), "seq").alias("x"))
    return agg.select(*key, "seq", "x.*").select(*rows.columns)


def distinct_triples(triples: DataFrame) -> DataFrame:
    """Facts once each: the bag's explicit duplicate removal."""
    return triples.select("s", "p", "o").distinct()


def predicate_counts(triples: DataFrame) -> DataFrame:
    return triples.groupBy("p").agg(F.count("*").alias("n"))


def predicate_examples(triples: DataFrame, *order: Column, n: int = 5) -> DataFrame:
    """The first n triples of each predicate; the ranked window keeps n rows of a task before they meet."""
    w = Window.partitionBy("p").orderBy(*order)
    return triples.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)


def sizes(kg: KnowledgeGraph) -> DataFrame:
    one = lambda df, kind: df.groupBy("graph_id").agg(F.count("*").alias("n")).withColumn("kind", F.lit(kind))
    return one(kg.entities, "entities").unionByName(one(kg.relations, "relations")).unionByName(one(kg.triples, "triples"))


def display(triples: DataFrame, entities: DataFrame) -> DataFrame:
    """Triples with the labels of both ends; those with an unknown end are left out."""
    e = entities.select(F.col("uri"), F.col("label"))
    s = e.withColumnsRenamed({"uri": "s", "label": "s_label"})
    o = e.withColumnsRenamed({"uri": "o", "label": "o_label"})
    return triples.join(s, "s").join(o, "o").select("s", "p", "o", "s_label", "o_label")


def to_graph(extraction, name: str = "kg", per_document: bool = True) -> KnowledgeGraph:
    """The tables of an extraction as one graph, or one for each document; the name is a hash of the text where none is given."""
    gid = F.concat(F.lit(name + "_"), F.col("doc_id").cast("string")) if per_document else F.lit(name)
    e = extraction.entities.select(
        gid.alias("graph_id"), F.col("rank").cast("long").alias("seq"), "uri", "label", F.lit("individual").alias("entity_type"), "ontology_type",
        F.array("label").alias("mentions"), "confidence", "source",
    )
    r = extraction.relations.select(gid.alias("graph_id"), F.xxhash64("uri").alias("seq"), "uri", "label")
    t = extraction.triples.select(
        gid.alias("graph_id"), F.col("seq").cast("long").alias("seq"), "s", "p", "o", F.lit(False).alias("o_is_literal"), "confidence",
        "confidence_level", "provenance", F.current_timestamp().alias("ts"), F.sha2(F.concat_ws("|", gid, F.col("seq").cast("string"), "s", "p", "o"), 256).alias("id"),
    )
    return KnowledgeGraph(name, e if per_document else last_written(e), r if per_document else last_written(r), t)
