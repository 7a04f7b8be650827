"""Partitioning of small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .written import written

SMALL = 32 << 20


def balanced(df: DataFrame, small: int = SMALL) -> DataFrame:
    """df dealt over the cores if its files are small: such a table is often a single row group, which one task
    would read while the others idle. Larger inputs, and small ones in splits enough, keep their splits and are not shuffled."""
    if df.isStreaming:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size <= small and df.rdd.getNumPartitions() < cores else df


def places(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `place`, their number in the order of the keys: sorted by ranges, numbered within each and moved on by the sizes of the
    ranges before (as many numbers as there are partitions)."""
    x = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()), "sorted")
    part, own = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r.part: r.n for r in x.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for k in range(max(sizes, default=-1) + 1):
        before.append(total)
        total += sizes.get(k, 0)
    if not before:
        return x.withColumn("place", own).drop("at")
    return x.withColumn("place", own + F.element_at(F.array(*[F.lit(b).cast("long") for b in before]), (part + 1).cast("int"))).drop("at")
