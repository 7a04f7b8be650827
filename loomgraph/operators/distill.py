"""From extracted chunks to entities, linked relations and scored triples, for a whole corpus at once.

Rows are exploded once and dealt by doc_id once: the aggregations, windows and joins below are all
within a document and keep that partitioning.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import ExtractionConfig
from ..functions import scores
from ..functions.text import entity_uri, property_uri, snippet


def tune(spark: SparkSession) -> None:
    """Let joins on (doc_id, more) use rows dealt by doc_id alone."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def with_places(extracted: DataFrame) -> DataFrame:
    """Relations of the chunks with s_pos and o_pos, the first places of their ends in the document (0: absent), in any case.

    An end links by its lower-cased label, so its place is the entity's too. The lower-cased text is bound once for a
    row, and only ends of relations are looked up in it, not all mentions."""
    placed = F.transform(
        F.array(F.lower("text")),
        lambda low: F.transform(
            "chunks", lambda c: F.struct(
                c["chunk"].alias("chunk"),
                F.transform(c["relations"], lambda r: F.struct(
                    r["subject"].alias("subject"), r["predicate"].alias("predicate"), r["object"].alias("object"),
                    F.position(F.lower(r["subject"]), low).alias("s_pos"), F.position(F.lower(r["object"]), low).alias("o_pos"),
                )).alias("relations"),
            ),
        ),
    )
    return extracted.select("doc_id", placed[0].alias("chunks"))


def _exploded(docs: DataFrame) -> DataFrame:
    """A row for each chunk. The outer form keeps the optimizer from testing the size of the array, which
    would extract every document twice."""
    return docs.select("doc_id", F.posexplode_outer("chunks").alias("chunk_idx", "c")).filter("c is not null")


def raw_entities(extracted: DataFrame) -> DataFrame:
    chunks = _exploded(extracted)
    rows = chunks.select("doc_id", "chunk_idx", snippet(F.col("c.chunk")).alias("source"), F.posexplode("c.entities").alias("ent_idx", "e"))
    return rows.select("doc_id", "chunk_idx", "ent_idx", "source", "e.text", "e.type")


def raw_relations(placed: DataFrame) -> DataFrame:
    chunks = _exploded(placed)
    rows = chunks.select("doc_id", "chunk_idx", F.col("c.chunk").alias("chunk"), F.posexplode("c.relations").alias("rel_idx", "r"))
    return rows.select("doc_id", "chunk_idx", "rel_idx", "chunk", "r.subject", "r.predicate", "r.object", "r.s_pos", "r.o_pos")


def aggregate_entities(raw: DataFrame, ns: str) -> DataFrame:
    """One row for each entity of a document: mentions counted, the rest from the first one."""
    first = F.struct("chunk_idx", "ent_idx")
    found = raw.withColumn("uri", entity_uri(F.col("text"), ns)).repartition("doc_id")
    out = found.groupBy("doc_id", "uri").agg(
        F.count("*").alias("n"), F.min(F.struct(first.alias("at"), F.col("text").alias("label"), "type", "source")).alias("x")
    )
    return out.select("doc_id", "uri", "n", "x.label", "x.type", "x.source", "x.at", scores.boosted(F.col("n")).alias("confidence"))


def limited(entities: DataFrame, n: int) -> DataFrame:
    """The first n entities of each document, in order of their first mention."""
    order = Window.partitionBy("doc_id").orderBy("at")
    return entities.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def map_labels(rows: DataFrame, label_col: str, schema: DataFrame | None, out: str) -> DataFrame:
    """rows with `out`: the uri of the first schema label, by ord, that equals or holds the row's label; null without any.

    The empty label is held by every other. Distinct row labels are matched, not rows, and by an index of the schema: a label is looked
    up by its first three letters among the runs of up to three letters of the schema's labels, and what is found is verified."""
    if schema is None:
        return rows.withColumn(out, F.lit(None).cast("string"))
    low = F.lower(F.col(label_col))
    s = schema.select(F.col("ord"), F.col("uri").alias("s_uri"), F.lower("label").alias("s_label"))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.length("s_label"), F.lit(1))), lambda i: F.transform(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda n: F.substring("s_label", i, n)))
    index = s.filter("s_label is not null").select("ord", "s_uri", "s_label", F.explode(F.array_distinct(F.flatten(runs))).alias("key")).filter("key <> ''")
    first = s.filter("s_label is not null").agg(F.min(F.struct("ord", "s_uri", "s_label")).alias("x")).filter("x is not null").select("x.*", F.lit("").alias("key"))
    labels = rows.select(low.alias("low")).distinct().withColumn("key", F.substring("low", 1, 3))
    matched = labels.join(index.unionByName(first), "key").filter(F.contains(F.col("s_label"), F.col("low"))).groupBy("low").agg(F.min(F.struct("ord", "s_uri")).alias("m"))
    return rows.join(matched.select("low", F.col("m.s_uri").alias(out)), low == F.col("low"), "left").drop("low")


def link(raw: DataFrame, entities: DataFrame, ns: str, schema: DataFrame | None = None) -> DataFrame:
    """Relations whose ends name entities of their document, by the first spelling of each; p is the mapped or built uri."""
    e = entities.filter("label <> ''").select(
        "doc_id", F.lower("label").alias("low"), F.struct("uri", "label", "confidence").alias("e")
    )
    ends = raw.repartition("doc_id").withColumn("s_low", F.lower("subject")).withColumn("o_low", F.lower("object"))
    s = e.select("doc_id", F.col("low").alias("s_low"), F.col("e").alias("s"))
    o = e.select("doc_id", F.col("low").alias("o_low"), F.col("e").alias("o"))
    linked = ends.join(s, ["doc_id", "s_low"]).join(o, ["doc_id", "o_low"])
    mapped = map_labels(linked, "predicate", schema, "mapped")
    return mapped.select(
        "doc_id", "chunk_idx", "rel_idx", "chunk", "predicate", "s", "o", "s_pos", "o_pos", F.coalesce("mapped", property_uri(F.col("predicate"), ns)).alias("p")
    )


def relation_types(linked: DataFrame) -> DataFrame:
    """The relations of each document, labelled as first seen."""
    x = F.min(F.struct("chunk_idx", "rel_idx", "predicate")).alias("x")
    return linked.groupBy("doc_id", F.col("p").alias("uri")).agg(x).select("doc_id", "uri", F.col("x.predicate").alias("label"))


def score_triples(linked: DataFrame, max_triples: int) -> DataFrame:
    """The first max_triples of each document, with evidence, neural confidence, its level, and hybrid confidence."""
    order = Window.partitionBy("doc_id").orderBy("chunk_idx", "rel_idx")
    kept = linked.withColumn("seq", F.row_number().over(order)).filter(F.col("seq") <= max_triples)
    ev = scores.evidence(F.col("s.label"), F.col("o.label"), F.col("s_pos"), F.col("o_pos"))
    kept = kept.withColumn("evidence", ev)
    kept = kept.withColumn("neural", scores.neural(F.col("s.confidence"), F.col("o.confidence"), F.col("evidence")))
    return kept.select(
        "doc_id", "seq", F.col("s.uri").alias("s"), "p", F.col("o.uri").alias("o"), "evidence", "neural",
        scores.level(F.col("neural")).alias("confidence_level"), scores.hybrid(F.col("neural")).alias("confidence"),
        F.struct(F.col("chunk").alias("source_chunk"), F.lit("extractor").alias("extraction_method")).alias("provenance"),
    )


def summaries(extracted: DataFrame, triples: DataFrame, confidence_col: str = "confidence", method: str = "extractor", ontology_uri: str | None = None) -> DataFrame:
    """Per document: chunks, text length, triples, mean confidence (0 without triples) and its level, and how it was
    extracted: the method and the ontology's iri (null without one). The mean adds from a document's last triple
    to its first, so that it rounds alike however the rows are dealt."""
    last_first = F.sort_array(F.collect_list(F.struct("seq", F.col(confidence_col).alias("x"))), asc=False)
    agg = triples.groupBy("doc_id").agg(F.count("*").alias("n_triples"), last_first.alias("xs"))
    agg = agg.select("doc_id", "n_triples", (F.aggregate("xs", F.lit(0.0), lambda t, x: t + x["x"]) / F.col("n_triples")).alias("mean"))
    base = extracted.select("doc_id", F.length("text").cast("long").alias("text_length"), F.size("chunks").alias("n_chunks"))
    out = base.join(agg, "doc_id", "left").withColumn("confidence", F.coalesce("mean", F.lit(0.0)))
    return out.select(
        "doc_id", "text_length", "n_chunks", F.coalesce("n_triples", F.lit(0)).alias("n_triples"), "confidence", scores.level(F.col("confidence")).alias("level"),
        F.lit(method).alias("extraction_method"), F.lit(ontology_uri).cast("string").alias("ontology"),
    )


def fact_scores(docs: DataFrame, triples: DataFrame) -> DataFrame:
    """The share of a document's triples with evidence of 0.7 or more; 0 without triples."""
    agg = triples.groupBy("doc_id").agg(F.avg(F.when(F.col("evidence") >= 0.7, 1.0).otherwise(0.0)).alias("f"))
    return docs.select("doc_id").join(agg, "doc_id", "left").select("doc_id", F.coalesce("f", F.lit(0.0)).alias("fact_score"))


@dataclass
class Extraction:
    """The tables of one corpus, lazily built over one extraction."""

    extracted: DataFrame
    entities: DataFrame
    relations: DataFrame
    triples: DataFrame
    summary: DataFrame


def distill(docs: DataFrame, extractor, cfg: ExtractionConfig | None = None, classes: DataFrame | None = None, properties: DataFrame | None = None) -> Extraction:
    """Entities, relations, triples and summaries of documents (doc_id, text).

    Null and empty texts have no chunks and get a summary of zeros. Rows without an id take no part. Rows that share an id are
    one document: their mentions add up, in the order of their chunks. An empty table gives empty tables; further columns
    are ignored."""
    cfg = cfg or ExtractionConfig()
    tune(docs.sparkSession)
    extracted = extractor(docs.filter(F.col("doc_id").isNotNull()))
    entities = aggregate_entities(raw_entities(extracted), cfg.entity_ns)
    entities = map_labels(limited(entities, cfg.max_entities), "type", classes, "ontology_type")
    linked = link(raw_relations(with_places(extracted)), entities, cfg.property_ns, properties)
    triples = score_triples(linked, cfg.max_triples)
    return Extraction(extracted, entities, relation_types(linked), triples, summaries(extracted, triples))
