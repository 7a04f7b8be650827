"""Exact top-k search by exhaustive term-at-a-time accumulation.

Each vector is a sparse row of integer weights over its dimensions (the terms). Rows and
queries are dealt into blocks; for a pair of blocks the postings of each term are scattered,
weighted by the queries, into a dense score array. Each query then selects its best rows of
the block by partition, and the selections of all blocks are merged by a ranked window.
"""

from __future__ import annotations

from math import floor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import cut

#: Rows of a data block and of a query block at most. Both are sent once for each opposite block, so
#: bytes moved for a pair are small against its DATA_BLOCK * QUERY_BLOCK * terms additions.
DATA_BLOCK, QUERY_BLOCK = 65536, 65536
#: Rows and queries scored at once, so that the score array stays in the processor's cache; pairs of blocks for each core.
TILE_ROWS, TILE_QUERIES, PAIRS = 2048, 32, 8
LONG = 1 << 63


def weights(vectors: pa.ListArray) -> list[np.ndarray]:
    """floor(256 * x) of every component: whole numbers in doubles, exact ones in objects beyond 2**53."""
    flat = np.asarray(vectors.values).astype(np.float64)
    offs = np.asarray(vectors.offsets)
    if np.abs(flat).max(initial=0.0) < 2.0**45:
        flat = np.floor(256.0 * flat)
    else:
        flat = np.array([floor(256 * x) if abs(x) < 2.0**45 else 256 * int(x) for x in flat.tolist()], dtype=object)
    return [flat[a:b] for a, b in zip(offs[:-1], offs[1:])]


def kind(most: int, terms: int):
    """The narrowest type that holds sums of so many products up to `most`: int32, int64 or Python's numbers."""
    bound = most * max(terms, 1)
    return np.int32 if bound < 1 << 31 else np.int64 if bound < LONG else object


def postings(vectors: list[np.ndarray], dtype=np.int64) -> list[tuple[np.ndarray | None, np.ndarray]]:
    """Per term: (rows that hold it, their weights); rows is None where every row holds it."""
    wide = max((len(v) for v in vectors), default=0)
    dense = np.zeros((len(vectors), wide), dtype=dtype)
    for i, v in enumerate(vectors):
        dense[i, : len(v)] = v
    out = []
    for t in range(wide):
        rows = np.flatnonzero(dense[:, t])
        out.append((None, np.ascontiguousarray(dense[:, t])) if len(rows) == len(dense) else (rows, dense[rows, t]))
    return out


def accumulate(queries: list[np.ndarray], index: list[tuple[np.ndarray | None, np.ndarray]], n: int, dtype=np.int64) -> np.ndarray:
    """Scores of queries by n rows: each query scatters its weighted postings, term after term."""
    scores = np.zeros((len(queries), n), dtype=dtype)
    queries = [q.astype(dtype) for q in queries]
    for t, (at, weight) in enumerate(index):
        for i, q in enumerate(queries):
            if t >= len(q) or not q[t]:
                continue
            if at is None:
                scores[i] += q[t] * weight
            else:
                scores[i, at] += q[t] * weight
    return scores


def select(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best scores; ids ascend, so ties go to the smaller id. Rows with id `own` are left out."""
    take = np.flatnonzero(ids != own)
    if len(take) > k:
        s = scores[take]
        floor = np.partition(s, len(s) - k)[len(s) - k]
        over = take[s > floor]
        take = np.concatenate([over, take[s == floor][: k - len(over)]])
    return take[np.lexsort((ids[take], -scores[take]))]


def as_columns(scores: list[int]) -> tuple[list[int], list[str]]:
    """(score held within a long, text that orders the scores beyond it as their numbers do; empty for all others)."""
    held, more = [], []
    for s in scores:
        held.append(max(-LONG, min(LONG - 1, s)))
        digits = str(abs(s))
        if -LONG <= s < LONG:
            more.append("")
        elif s > 0:
            more.append(f"{len(digits):06d}{digits}")
        else:
            more.append(f"{999999 - len(digits):06d}" + "".join(str(9 - int(d)) for d in digits))
    return held, more


def top_k_search(vectors: DataFrame, k: int = 5, query_every: int = 50, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id, score: the k rows of highest integer inner product for each query.

    Components become floor(256 * x). Queries are the rows whose id is divisible by query_every,
    candidates all rows with another id. Vectors that are null or hold null or non-finite
    components take no part, nor do rows with a null id. Components missing in the shorter of two
    vectors count as zero; an empty vector scores zero with all. Ranks go by the exact scores; one that
    no long holds is given as the nearest long. Repeated candidate rows are each ranked; repeated query
    rows are one query for each vector they hold, ranked together. Empty tables and tables without
    queries give an empty result. Columns other than the two are ignored.
    """
    spark = vectors.sparkSession
    x = F.col("v")
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    src = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vec_col].cast("array<double>").alias("v")).filter(F.col("id").isNotNull() & fine)
    # Equal rows fall together before they are dealt, so that none of them fills a block; no query ranks more than k of them.
    rows = cut(src.groupBy("id", "v").agg(F.count("*").alias("n")), "vectors")
    is_query = F.col("id") % query_every == 0
    n, nq = rows.agg(F.sum(F.least("n", F.lit(k))), F.count_if(is_query)).first()
    n = n or 0
    query_blocks = max(1, -(-nq // QUERY_BLOCK))
    # Blocks must not be fewer than the cores can take while the table is small.
    wanted = -(-PAIRS * spark.sparkContext.defaultParallelism // query_blocks)
    data_blocks = max(1, -(-n // DATA_BLOCK), min(wanted, -(-n // TILE_ROWS)))
    deal = lambda blocks: F.pmod(F.xxhash64("id", "v", "copy"), F.lit(blocks)).cast("int")
    pair = [F.col("qb"), F.col("db")]
    each = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = rows.filter(is_query).select("id", "v", F.lit(0).alias("copy")).withColumn("qb", deal(query_blocks)).withColumn("db", each(data_blocks)).withColumn("is_query", F.lit(True))
    copies = rows.select("id", "v", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)).cast("int"))).alias("copy"))
    right = copies.withColumn("db", deal(data_blocks)).withColumn("qb", each(query_blocks)).withColumn("is_query", F.lit(False))

    def score(table: pa.Table) -> pa.Table:
        flags = np.asarray(table.column("is_query"))
        ids = np.asarray(table.column("id"))
        parts = [v for chunk in table.column("v").chunks for v in weights(chunk)]
        most = [int(max(v.max(), -v.min())) if len(v) else 0 for v in parts]
        terms = max(map(len, parts), default=0)
        q = np.flatnonzero(flags)
        d = np.flatnonzero(~flags)
        d = d[np.argsort(ids[d], kind="stable")]
        best: list[list] = [[] for _ in q]
        for b in range(0, len(d), TILE_ROWS):
            ds = d[b : b + TILE_ROWS]
            tile = [parts[i] for i in ds]
            dtype, index, top = None, [], max(most[i] for i in ds)
            for a in range(0, len(q), TILE_QUERIES):
                qs = [parts[i] for i in q[a : a + TILE_QUERIES]]
                if (need := kind(top * max(most[i] for i in q[a : a + TILE_QUERIES]), terms)) != dtype:
                    dtype, index = need, postings(tile, need)
                s = accumulate(qs, index, len(ds), dtype)
                for j, i in enumerate(q[a : a + TILE_QUERIES]):
                    at = select(s[j], ids[ds], ids[i], k)
                    best[a + j].append((ids[ds][at].tolist(), s[j][at].tolist()))
        out: list[tuple[int, int, int]] = []
        for i, mine in zip(q.tolist(), best):
            found = sorted((-s, v) for vs, ss in mine for v, s in zip(vs, ss))[:k]
            out += [(int(ids[i]), v, -s) for s, v in found]
        held, more = as_columns([s for *_, s in out])
        return pa.table({"query_id": pa.array([x for x, *_ in out], pa.int64()), "vec_id": pa.array([x for _, x, _ in out], pa.int64()), "score": pa.array(held, pa.int64()), "more": pa.array(more, pa.string())})

    found = left.unionByName(right).groupBy(*pair).applyInArrow(score, "query_id long, vec_id long, score long, more string")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("more"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
    )
