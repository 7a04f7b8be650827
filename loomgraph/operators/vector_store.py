"""A vector store on parquet: inverted lists by k-means, product-quantised residuals, exact re-ranking.

Vectors are dealt to the list of their nearest centre; a list is a folder, so that a search reads the lists it probes and no others.
Beside each vector stands a code of a few bytes, its residual from the centre in pieces that are each the number of the nearest
word of a codebook. A search ranks the rows of the probed lists by their codes through one table of distances for a query, the best few
by their whole vectors, and then all others that their codes do not place beyond these, so that codes lose no answer.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.written import written

#: Rows that centres and codebooks are fitted on at most (those of least hash); the model's size depends on this and not on the table's.
SAMPLE = 20_000
#: Centres at most; pieces of a code; words of a codebook at most; rows of a list's file at most.
LISTS, PIECES, WORDS, FILE_ROWS = 1024, 8, 256, 500_000
#: Queries that one pass over the store answers, about; more are dealt to several passes by the hash of their id.
QUERIES_AT_ONCE = 1000
#: What rounding may add to a distance: unit vectors that lie at most about 1e-8 apart have a similarity of one.
SLACK = 1e-7


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 20) -> np.ndarray:
    """k centres of the rows of x by Lloyd's steps; an empty cluster starts again at the row farthest from its centre."""
    k = min(k, len(x))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        at, gap = _nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, at, x)
        n = np.bincount(at, minlength=k)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
        for empty in np.flatnonzero(n == 0):
            far = int(gap.argmax())
            centres[empty], gap[far] = x[far], 0.0
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centre of each row, ties to the first, and the squared distance."""
    gap = (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None]
    at = gap.argmin(1)
    return at, np.maximum(gap[np.arange(len(x)), at], 0.0)


class Model:
    """Centres of the lists and a codebook for each piece of a residual."""

    def __init__(self, centres: np.ndarray, books: list[np.ndarray]):
        self.centres, self.books = centres, books
        self.cuts = np.cumsum([0] + [b.shape[1] for b in books])

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at, _ = _nearest(x, self.centres)
        rest = x - self.centres[at]
        codes = [_nearest(rest[:, a:b], book)[0].astype(np.uint8) for a, b, book in zip(self.cuts, self.cuts[1:], self.books)]
        return at, np.stack(codes, axis=1)

    def probes(self, q: np.ndarray, n: int) -> np.ndarray:
        """The n nearest lists of each query, nearest first."""
        gap = (self.centres**2).sum(1)[None] - 2 * q @ self.centres.T
        return np.argsort(gap, axis=1, kind="stable")[:, :n]

    def errors(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Distances of rows of one list from what their codes stand for."""
        rest = x - self.centres[which]
        return np.sqrt(sum(((rest[:, a:b] - book[codes[:, k]]) ** 2).sum(1) for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books))))

    def gaps(self, q: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Squared distances of one query to rows of one list, by their codes."""
        rest = q - self.centres[which]
        out = np.zeros(len(codes))
        for k, (a, b, book) in enumerate(zip(self.cuts, self.cuts[1:], self.books)):
            out += ((book - rest[a:b]) ** 2).sum(1)[codes[:, k]]
        return out


def fit(vectors: DataFrame, lists: int | None = None, pieces: int = PIECES, seed: int = 42) -> Model:
    """A model fitted on SAMPLE rows at most; lists is the square root of the number of rows unless it is given, and no more than
    LISTS or the rows of the sample."""
    n = vectors.count()
    sample = vectors.select("uri", "vec").orderBy(F.xxhash64(F.col("uri").cast("string"), F.lit(seed)), F.col("uri")).limit(SAMPLE).collect()
    if not sample:
        raise ValueError("a store needs a vector")
    x = np.array([r.vec for r in sample], dtype=np.float64)
    rng = np.random.default_rng(seed)
    centres = _means(x, min(LISTS, lists or max(1, round(n**0.5))), rng)
    rest = x - centres[_nearest(x, centres)[0]]
    cuts = np.linspace(0, x.shape[1], min(pieces, x.shape[1]) + 1).astype(int)
    return Model(centres, [_means(rest[:, a:b], WORDS, rng) for a, b in zip(cuts, cuts[1:])])


def unit(vectors: DataFrame) -> DataFrame:
    """(uri, vec) with vectors of length one; rows that are null, hold a null or no finite number, or have no length are left out."""
    v = vectors.select("uri", F.transform("vec", lambda c: c.cast("double")).alias("vec"))
    v = v.filter("uri is not null and vec is not null").filter(F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, c: a + c * c))
    return v.withColumn("size", size).filter("size > 0").select("uri", F.transform("vec", lambda c: c / F.col("size")).alias("vec"))


def build(vectors: DataFrame, path: str, lists: int | None = None, pieces: int = PIECES, seed: int = 42) -> Model:
    """Write the store of (uri, vec) at path: rows under `rows/list=..`, the model under `model`. Ids are kept as they are, ids repeated are
    rows of their own; vectors must be of one length."""
    v = unit(vectors)
    model = fit(v, lists, pieces, seed)

    def dealt(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                at, codes = model.encode(np.stack(batch["vec"].to_numpy()).astype(np.float64))
                yield pd.DataFrame({"uri": batch["uri"], "vec": batch["vec"], "code": [c.tobytes() for c in codes], "list": at.astype(np.int32)})

    kind = v.schema["uri"].dataType.simpleString()
    rows = v.mapInPandas(dealt, f"uri {kind}, vec array<double>, code binary, list int")
    # A list is dealt to one task for its rows up to a file's worth, a larger one to several by the hash of the id.
    share = F.pmod(F.xxhash64(F.col("uri").cast("string")), F.lit(max(1, v.count() // (len(model.centres) * FILE_ROWS) + 1)))
    rows.repartition("list", share).sortWithinPartitions("list").write.option("maxRecordsPerFile", FILE_ROWS).partitionBy("list").parquet(f"{path}/rows")
    spark = vectors.sparkSession
    parts = [("centres", json.dumps(model.centres.tolist()))] + [(f"book{k:03d}", json.dumps(b.tolist())) for k, b in enumerate(model.books)]
    spark.createDataFrame(parts, "part string, numbers string").coalesce(1).write.parquet(f"{path}/model")
    return model


def load(spark: SparkSession, path: str) -> Model:
    """The model of a store; its size is that of the centres and codebooks."""
    parts = {r.part: np.array(json.loads(r.numbers)) for r in spark.read.parquet(f"{path}/model").collect()}
    return Model(parts.pop("centres"), [parts[k] for k in sorted(parts)])


def probed(spark: SparkSession, path: str, queries: DataFrame, probes: int) -> DataFrame:
    """The rows of the lists that any of the queries (uri, vec) probes: a scan of those folders only."""
    model = load(spark, path)
    q = unit(queries).collect()
    wanted = sorted({int(x) for r in q for x in model.probes(np.array([r.vec]), probes)[0]})
    return spark.read.parquet(f"{path}/rows").filter(F.col("list").isin(wanted))


def search(spark: SparkSession, path: str, queries: DataFrame, k: int = 10, probes: int = 8, refine: int = 10, own: bool = False) -> DataFrame:
    """query, rank, uri, similarity: the k rows of greatest cosine similarity to each query (uri, vec), of the probes lists nearest to it; with as
    many probes as lists, exactly. Of the rows of a batch the refine * k nearest by their codes are ranked by whole vectors, then those of the
    others that could still be among the k, given how far a code is from its row. A query's own uri is left out unless own is set. Ties go to the smaller uri; queries without a direction have no answers.

    The queries of one pass are collected; what a pass of several has found is written before the next."""
    model, store = load(spark, path), spark.read.parquet(f"{path}/rows")
    asked = unit(queries)
    passes = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    if passes == 1:
        return _answered(store, model, asked, k, probes, refine, own)
    out = None
    for i in range(passes):
        mine = asked.filter(F.pmod(F.xxhash64(F.col("uri").cast("string")), F.lit(passes)) == i)
        found = written(_answered(store, model, mine, k, probes, refine, own), "answers")
        out = found if out is None else out.unionByName(found)
    return out


def _least(by: np.ndarray, n: int) -> np.ndarray:
    """The places of the n least, with all that tie with the last of them."""
    return np.arange(len(by)) if len(by) <= n else np.flatnonzero(by <= np.partition(by, n - 1)[n - 1])


def _answered(store: DataFrame, model: Model, queries: DataFrame, k: int, probes: int, refine: int, own: bool) -> DataFrame:
    """One pass of search. A task keeps the k best of each query over all its rows and sends only these on."""
    spark, kind = store.sparkSession, store.schema["uri"].dataType.simpleString()
    schema = f"query {kind}, uri {kind}, similarity double"
    asked = queries.collect()
    if not asked:
        return spark.createDataFrame([], schema).select("query", F.lit(1).alias("rank"), "uri", "similarity")
    names, q = [r.uri for r in asked], np.array([r.vec for r in asked], dtype=np.float64)
    wanted: dict[int, list[int]] = {}
    for i, lists in enumerate(model.probes(q, probes)):
        for x in lists:
            wanted.setdefault(int(x), []).append(i)
    keep = k * refine
    whole = keep >= store.count()
    exact = whole and probes >= len(model.centres)  # all lists for all queries: a batch needs no grouping
    most = k + 1  # one more, as the query's own row may be among them

    def ranked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, tuple] = {}
        for batch in batches:
            for which, rows in [(-1, batch)] if exact and len(batch) else batch.groupby("list"):
                x, uri = np.stack(rows["vec"].to_numpy()).astype(np.float64), rows["uri"].to_numpy()
                vec = x.T.copy()
                if not whole:
                    codes = np.frombuffer(b"".join(rows["code"]), dtype=np.uint8).reshape(len(rows), -1)
                    errors = model.errors(x, int(which), codes)
                for i in range(len(q)) if exact else wanted[int(which)]:

                    def near(at):
                        out = np.zeros(len(at))
                        for part, c in zip(vec, q[i]):  # added part by part, so that equal vectors are equally similar wherever they stand
                            out += part[at] * c
                        return out

                    old = best.get(i, (uri[:0], np.zeros(0)))
                    at = np.arange(len(uri))
                    if not whole:
                        gaps = model.gaps(q[i], int(which), codes)
                        first = _least(gaps, keep + 1)
                        known = np.concatenate([old[1], near(first)])
                        if len(first) < len(uri) and len(known) >= most:
                            # Unit vectors of similarity s lie sqrt(2 - 2 s) apart, and a row no nearer than its code less the code's error.
                            reach = np.sqrt(max(2 - 2 * np.partition(known, -most)[-most], 0)) + SLACK
                            at = np.union1d(first, np.flatnonzero(np.sqrt(gaps) - errors <= reach))
                    found = tuple(np.concatenate(pair) for pair in zip(old, (uri[at], near(at))))
                    at = _least(-found[1], most)
                    if len(at) > 2 * most:  # many alike: those of least id
                        at = at[pd.DataFrame({"by": -found[1][at], "uri": found[0][at]}).sort_values(["by", "uri"]).index[:most]]
                    best[i] = tuple(x[at] for x in found)
        for i, (uri, similarity) in best.items():
            yield pd.DataFrame({"query": names[i], "uri": uri, "similarity": similarity})

    rows = store.filter(F.col("list").isin(sorted(wanted))).mapInPandas(ranked, schema)
    if not own:
        rows = rows.filter("uri <> query")
    order = Window.partitionBy("query").orderBy(F.desc("similarity"), "uri")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query", "rank", "uri", "similarity")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (queries, recall): the share of the exact answers (query, uri) that are among those found."""
    hit = found.select("query", "uri").distinct().withColumn("hit", F.lit(1))
    x = exact.select("query", "uri").distinct().join(hit, ["query", "uri"], "left")
    return x.agg(F.count_distinct("query").alias("queries"), (F.count("hit") / F.count("*")).alias("recall"))
