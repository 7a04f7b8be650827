"""Forward inference by fixpoint loops: semi-naive joins, duplicates removed, lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.written import written


def closure(pairs: DataFrame) -> DataFrame:
    """All (s, o) reachable over one or more pairs, each once. Cycles end, as only new pairs go on.

    Distances double each round, so the rounds grow with the logarithm of the longest one. What is known up to a distance goes on
    only to pairs that far apart, so on a path each pair is made once. Where nodes have one pair at most on one of their sides (paths, trees),
    no pair comes twice before a cycle closes, and until then none is compared with those known."""
    known = written(pairs.select("s", "o", F.lit(1).alias("d")).distinct())
    single = any(not known.groupBy(end).count().filter("count > 1").limit(1).count() for end in ("s", "o"))
    single, far, most = single and not known.filter("s = o").limit(1).count(), known, 1
    while far.limit(1).count():
        steps = far.select(F.col("s").alias("m"), "o")
        found = known.select("s", F.col("o").alias("m"), "d").join(steps, "m").select("s", "o", (F.col("d") + most).alias("d"))
        new = written(found) if single else None
        single = single and not new.filter("s = o").limit(1).count()
        if not single:
            new = written(found.groupBy("s", "o").agg(F.min("d").alias("d")).join(known, ["s", "o"], "left_anti").select("s", "o", "d"))
        known, most = known.unionByName(new), 2 * most
        far = new.filter(F.col("d") == most)
    return known.select("s", "o")


def transitive(triples: DataFrame, predicate: str) -> DataFrame:
    x = triples.filter(F.col("p") == predicate)
    return closure(x).select("s", F.lit(predicate).alias("p"), "o")


def symmetric(triples: DataFrame, predicate: str) -> DataFrame:
    x = triples.filter(F.col("p") == predicate).select("s", "p", "o")
    return x.unionByName(x.select(F.col("o").alias("s"), "p", F.col("s").alias("o"))).distinct()


def inverse(triples: DataFrame, predicate: str, other: str) -> DataFrame:
    return triples.filter(F.col("p") == predicate).select(F.col("o").alias("s"), F.lit(other).alias("p"), F.col("s").alias("o")).distinct()


def inherited(triples: DataFrame, sub: str, parent: str) -> DataFrame:
    """Statements of a subproperty as statements of its parent."""
    return triples.filter(F.col("p") == sub).select("s", F.lit(parent).alias("p"), "o").distinct()


def infer(triples: DataFrame, transitive_of: tuple[str, ...] = (), symmetric_of: tuple[str, ...] = (), inverse_of: tuple[tuple[str, str], ...] = (), max_inferences: int | None = None) -> DataFrame:
    """New statements by the rules named, none that is already asserted; the first max_inferences in order, if given."""
    base = triples.select("s", "p", "o").distinct()
    parts = [transitive(triples, p) for p in transitive_of] + [symmetric(triples, p) for p in symmetric_of] + [inverse(triples, p, q) for p, q in inverse_of]
    if not parts:
        return base.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    new = out.distinct().join(base, ["s", "p", "o"], "left_anti")
    return new if max_inferences is None else new.orderBy("s", "p", "o").limit(max_inferences)
