"""The given tables, and the graph that the relational ones make."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def relational_kg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The relational tables as triples (seq, s, p, o): a bag, numbered by rule and key."""
    t = lambda name: read(spark, sf_dir, name)
    uri = lambda kind, col: F.concat(F.lit(f"kg:{kind}/"), F.col(col).cast("string"))

    def rule(n: int, table: str, key, s, p: str, o) -> DataFrame:
        return t(table).select((F.lit(n * 10**12) + key).cast("long").alias("seq"), s.alias("s"), F.lit(f"kg:{p}").alias("p"), o.alias("o"))

    line = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    parts = [
        rule(1, "nation", F.col("n_nationkey"), uri("nation", "n_nationkey"), "inRegion", uri("region", "n_regionkey")),
        rule(2, "customer", F.col("c_custkey"), uri("customer", "c_custkey"), "locatedIn", uri("nation", "c_nationkey")),
        rule(3, "supplier", F.col("s_suppkey"), uri("supplier", "s_suppkey"), "locatedIn", uri("nation", "s_nationkey")),
        rule(4, "orders", F.col("o_orderkey"), uri("order", "o_orderkey"), "placedBy", uri("customer", "o_custkey")),
        rule(5, "lineitem", line, uri("order", "l_orderkey"), "contains", uri("part", "l_partkey")),
        rule(6, "lineitem", line, uri("part", "l_partkey"), "suppliedBy", uri("supplier", "l_suppkey")),
        rule(7, "events", F.col("event_id"), uri("user", "user_id"), "performed", uri("event", "event_type")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def order_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(s, p, o): each order and the next one of its customer, by number."""
    following = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    x = read(spark, sf_dir, "orders").select("o_orderkey", following.alias("next")).filter("next is not null")
    return x.select(F.concat(F.lit("kg:order/"), "o_orderkey").alias("s"), F.lit("kg:followedBy").alias("p"), F.concat(F.lit("kg:order/"), "next").alias("o"))
