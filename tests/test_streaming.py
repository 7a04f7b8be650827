"""Streams give what batches give."""

from loomgraph.operators.extract import RuleExtractor
from loomgraph.streaming.extract import event_triples, mention_counts, mention_stream


def test_mentions(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = mention_stream(stream, RuleExtractor(), "e/").writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    key = ["doc_id", "chunk_idx", "ent_idx", "uri"]
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select(key).collect()))
    assert got == sorted(map(tuple, mention_stream(docs, RuleExtractor(), "e/").select(key).collect()))


def test_windowed_counts(spark, data, tmp_path):
    from pyspark.sql import functions as F

    events = spark.read.parquet(f"{data}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    shape = lambda df: event_triples(df, "kg:").select(F.col("o").alias("uri"), F.col("ts").cast("timestamp").alias("ts"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = mention_counts(shape(stream), "ts").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, mention_counts(shape(events), "ts").collect()))
