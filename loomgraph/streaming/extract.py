"""The stateless front of extraction on streams, and windowed counts over events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import entity_uri
from ..operators.distill import raw_entities


def mention_stream(docs: DataFrame, extractor, ns: str) -> DataFrame:
    """Entity mentions of a stream of documents (doc_id, text): a document is one row, so no state is kept."""
    return raw_entities(extractor(docs)).withColumn("uri", entity_uri(F.col("text"), ns))


def mention_counts(mentions: DataFrame, time_col: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Mentions of each entity in tumbling windows; rows later than the watermark are left out, and state behind it goes."""
    return mentions.withWatermark(time_col, late).groupBy(F.window(time_col, width).alias("w"), "uri").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "uri", "n")


def event_triples(events: DataFrame, ns: str) -> DataFrame:
    """Events as triples: user performed event type. Works on batches and streams alike."""
    return events.select(
        "event_id", F.concat(F.lit(ns + "user/"), F.col("user_id").cast("string")).alias("s"), F.lit(ns + "performed").alias("p"),
        F.concat(F.lit(ns + "event/"), F.col("event_type")).alias("o"), "ts",
    )
