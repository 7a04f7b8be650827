"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import cut


def connected_components(edges: DataFrame) -> DataFrame:
    """node, root: for edges (a, b) of one orderable type, each node's smallest reachable node.

    Nodes are only those in edges. Every step is two aggregations with map-side minima and two
    equi-joins by merging (never a broadcast), whose hot nodes the adaptive skew join splits; it is written to the shared folder.
    Loops, repeated and reversed edges change nothing; rows with a null end are dropped.
    """
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"), ((F.col("a").isNotNull()) & (F.col("b").isNotNull())).alias("ok"))
    e = cut(e.filter("ok and u <> v").select("u", "v").distinct(), "edges")
    seen = None
    while True:
        state = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen or state[0] == 0:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low.hint("merge"), "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "stars")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
