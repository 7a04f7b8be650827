"""Toxicity by maximum-scoring segment search.

Tokens are lower-cased runs of letters and digits; a token's features are the whole token and its
first bytes. Each feature's log-odds between toxic and clean documents has an informative
Dirichlet prior from the counts of both together; only features whose log-odds stand out of their
standard error enter the model, and a token scores as its longest feature that does. All other
tokens score a small negative drift, so that segments end. A linear-time scan finds every maximal
scoring segment of a text; extreme-value statistics of clean text (Karlin-Altschul lambda and K)
turn segment scores into chances, and the sum of the significant ones is mapped to a score.
"""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import blake2b
from math import exp, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_rows, crc_mod, cut
from .kernels import BYTE, LOWER, R1, R2, Rolling, Texts, column, mix, pieces

#: Labelled documents of a class to learn from, about. It bounds the model too: a feature needs LEAST_DOCS of them.
SAMPLE_PER_CLASS = 20_000
#: Documents of prior weight; least z-score, log-odds and documents of a feature; score of a token outside the model.
PRIOR, LEAST_Z, LEAST_ODDS, LEAST_DOCS, DRIFT = 500.0, 4.0, 1.0, 5, 0.1
PREFIXES = (4, 5, 6, 7, 8)
#: Bytes of text whose features are counted at once.
COUNTED = 1 << 18

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


class Tokens:
    """Byte spans of the tokens of each row; ptr[i]:ptr[i+1] are those of row i."""

    def __init__(self, texts: Texts, store: dict):
        data, offs = texts.data, texts.offs
        inside = np.zeros(len(data) + 2, dtype=bool)
        inside[1:-1] = _TOKEN[data]
        cuts = np.zeros(len(data) + 1, dtype=bool)
        cuts[offs] = True
        self.start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cuts[:-1]))
        self.end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cuts[1:])) + 1
        self.ptr = np.searchsorted(self.start, offs)
        self.roll = Rolling(BYTE[LOWER[data]] if len(data) else BYTE[data], R1, store)

    def features(self):
        """(level, positions of tokens, feature hashes), the longest features last."""
        size = self.end - self.start
        for n in PREFIXES:
            at = np.flatnonzero(size > n)
            yield at, mix(self.roll.span(self.start[at], self.start[at] + n) ^ np.uint64(n))
        yield np.arange(len(size)), self.roll.span(self.start, self.end)


@dataclass
class Model:
    """Sorted feature hashes with scores; extreme-value parameters; logistic map of the aggregate."""

    keys: np.ndarray
    scores: np.ndarray
    lam: float = 1.0
    k: float = 0.1
    slope: float = 1.0
    offset: float = -1.0


def token_scores(tokens: Tokens, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(positions, scores) of the tokens in the model."""
    out = np.zeros(len(tokens.start))
    if len(model.keys):
        for at, h in tokens.features():
            spot = np.minimum(np.searchsorted(model.keys, h), len(model.keys) - 1)
            hit = model.keys[spot] == h
            out[at[hit]] = model.scores[spot[hit]]
    at = np.flatnonzero(out)
    return at, out[at]


def segments(at: list[int], score: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first token, last token + 1, score) in linear time.

    Tokens not listed score -drift. Candidates are kept with the totals before and after them; a new
    one joins back over the last candidate that began lower and ended lower than it ends."""
    out: list[tuple[int, int, float, float]] = []
    last: list[int] = []  # for each candidate, the nearest earlier one that began at a lower total
    total, nxt = 0.0, 0
    for p, s in zip(at, score):
        total -= drift * (p - nxt)
        nxt = p + 1
        before, total = total, total + s
        if s <= 0:
            continue
        a, b, low, high = p, p + 1, before, total
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= low:
                j = last[j]
            if j < 0 or out[j][3] >= high:
                out.append((a, b, low, high))
                last.append(j)
                break
            a, low = out[j][0], out[j][2]
            del out[j:], last[j:]
    return [(a, b, high - low) for a, b, low, high in out]


def evidence(found: list[tuple[int, int, float]], n: int, model: Model) -> float:
    """Sum over segments of their normalised scores above what n tokens of clean text give by chance."""
    base = log(max(model.k * n, 1.0))
    return sum(max(0.0, model.lam * s - base) for _, _, s in found)


def score_rows(texts: Texts, model: Model, store: dict):
    """(tokens, segments, evidence) of each row."""
    tokens = Tokens(texts, store)
    at, s = token_scores(tokens, model)
    n = np.diff(tokens.ptr)
    bounds = np.searchsorted(at, tokens.ptr)
    found: list[list] = []
    total = np.zeros(texts.n)
    for i in range(texts.n):
        a, b = bounds[i], bounds[i + 1]
        mine = segments((at[a:b] - tokens.ptr[i]).tolist(), s[a:b].tolist()) if b > a else []
        found.append(mine)
        if mine:
            total[i] = evidence(mine, int(n[i]), model)
    return n, found, total


def _count(batches):
    """Documents of each class that hold a feature: aggregated per batch before they are sent. Six features of a token take many
    times its bytes, so batches are cut finer here."""
    store: dict = {}
    for b in pieces(batches, "text", COUNTED):
        texts = Texts(column(b, "text"))
        tokens = Tokens(texts, store)
        toxic = np.asarray(column(b, "toxic")).astype(np.int64)
        row = np.repeat(np.arange(texts.n), np.diff(tokens.ptr))
        keys, rows = [], []
        for at, h in tokens.features():
            keys.append(h)
            rows.append(row[at])
        h, r = np.concatenate(keys), np.concatenate(rows)
        order = np.lexsort((h, r))
        h, r = h[order], r[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
        h, y = h[new], toxic[r[new]]
        uniq, back = np.unique(h, return_inverse=True)
        n1 = np.bincount(back, weights=y, minlength=len(uniq)).astype(np.int64)
        n = np.bincount(back, minlength=len(uniq))
        yield pa.RecordBatch.from_arrays([pa.array(uniq.view(np.int64)), pa.array(n1), pa.array(n - n1)], names=["f", "n1", "n0"])


def _sketch(batches):
    """A hash of each text and two min-hashes of its runs of three tokens, which near copies mostly share."""
    store: dict = {}
    other: dict = {}
    for b in pieces(batches, "text"):
        texts = Texts(column(b, "text"))
        tokens = Tokens(texts, store)
        h = tokens.roll.span(tokens.start, tokens.end)
        roll = Rolling(h, R2, other)
        n = np.diff(tokens.ptr)
        at = np.arange(len(h))
        end = np.minimum(at + 3, np.repeat(tokens.ptr[1:], n))
        run = roll.span(at, end)
        full = np.flatnonzero(n)
        out = [pa.array(_whole(texts).view(np.int64))]
        for salt in (np.uint64(0x51ED270B), np.uint64(0xC2B2AE3D)):
            low = np.zeros(texts.n, dtype=np.uint64)
            if len(full):
                low[full] = np.minimum.reduceat(mix(run ^ salt), tokens.ptr[full])
            out.append(pa.array(low.view(np.int64)))
        yield pa.RecordBatch.from_arrays([*out, column(b, "text"), column(b, "toxic")], names=["id", "m1", "m2", "text", "toxic"])


def _whole(texts: Texts) -> np.ndarray:
    return np.array([int.from_bytes(blake2b(texts.row(i), digest_size=8).digest(), "little") for i in range(texts.n)], dtype=np.uint64)


def without_copies(known: DataFrame) -> DataFrame:
    """One of each group of equal or nearly equal texts, so that the words of a much-copied one are no evidence."""
    rows = cut(known.mapInArrow(_sketch, "id long, m1 long, m2 long, text string, toxic int").dropDuplicates(["id"]), "sketches")
    first = lambda m: rows.groupBy(m).agg(F.min("id").alias("id"))
    return rows.join(first("m1"), ["m1", "id"], "left_semi").join(first("m2"), ["m2", "id"], "left_semi").select("text", "toxic")


def sampled_labels(labels: DataFrame, fold: int, folds: int, label_col: str, per_class: int) -> DataFrame:
    """doc_id and toxic of about per_class training labels of each class, chosen by a hash of the id."""
    y = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("toxic"))
        .filter(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_mod(F.col("doc_id"), folds) != fold))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    share = {r.toxic: min(1.0, per_class / r.n) for r in y.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    return y.filter(draw < F.when(F.col("toxic") == 1, share.get(1, 0.0)).otherwise(share.get(0, 0.0)))


def train(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, label_col: str = "toxic", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fit on about per_class labelled documents of each class whose crc32(doc_id) modulo folds is not fold."""
    chosen = sampled_labels(labels, fold, folds, label_col, per_class)
    # At most about 2 * per_class ids are sent to all executors.
    known = cut(without_copies(docs.join(F.broadcast(chosen), "doc_id").select("text", "toxic")), "labelled")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    empty = Model(np.zeros(0, np.uint64), np.zeros(0))
    if not n1 or not n0:
        return empty
    counts = known.mapInArrow(_count, "f long, n1 long, n0 long").groupBy("f").agg(F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    # Informative Dirichlet prior: PRIOR documents spread as the feature is over both classes.
    a = F.lit(PRIOR) * (F.col("n1") + F.col("n0")) / float(n1 + n0)
    y1, y0 = F.col("n1") + a * n1 / (n1 + n0), F.col("n0") + a * n0 / (n1 + n0)
    w1, w0 = n1 + PRIOR * n1 / (n1 + n0), n0 + PRIOR * n0 / (n1 + n0)
    odds = F.log(y1 / (w1 - y1 + 1.0)) - F.log(y0 / (w0 - y0 + 1.0))
    z = odds / F.sqrt(1 / y1 + 1 / y0)
    model = (
        counts.filter(F.col("n1") + F.col("n0") >= LEAST_DOCS).select("f", odds.alias("s"), F.abs(z).alias("z"))
        .filter((F.col("z") >= LEAST_Z) & (F.abs("s") >= LEAST_ODDS)).collect()
    )
    keys = np.array([r.f for r in model], dtype=np.int64).view(np.uint64)
    order = np.argsort(keys)
    fitted = Model(keys[order], np.array([r.s for r in model])[order])
    if not len(keys):
        return empty
    clean = known.filter("toxic = 0")
    fitted.lam = decay(clean, fitted)
    fitted.k = location(clean, fitted)
    fitted.slope, fitted.offset = fit_map(known, fitted)
    return fitted


def decay(clean: DataFrame, model: Model) -> float:
    """lambda with E[exp(lambda * token score)] = 1 over clean text."""

    def spread(batches):
        store: dict = {}
        hist: dict[float, int] = {}
        for b in pieces(batches, "text"):
            tokens = Tokens(Texts(column(b, "text")), store)
            _, s = token_scores(tokens, model)
            v, c = np.unique(np.round(s, 1), return_counts=True)
            for x, y in zip(v.tolist(), c.tolist()):
                hist[x] = hist.get(x, 0) + y
            hist[-DRIFT] = hist.get(-DRIFT, 0) + len(tokens.start) - len(s)
        yield pa.RecordBatch.from_arrays([pa.array(list(hist), pa.float64()), pa.array(list(hist.values()), pa.int64())], names=["s", "c"])

    rows = clean.mapInArrow(spread, "s double, c long").groupBy("s").agg(F.sum("c").alias("c")).collect()  # a row for each tenth of a score
    s = np.array([r.s for r in rows])
    p = np.array([r.c for r in rows], dtype=float)
    top = float(np.max(model.scores, initial=1.0))
    # One occurrence of the best score is granted, so that a clean text without any has a finite lambda.
    s, p = np.append(s, max(top, 0.5)), np.append(p, 1.0)
    p /= p.sum()
    if (p * s).sum() >= 0:
        return 0.3
    lo, hi = 0.0, 1.0
    while (p * np.exp(np.minimum(hi * s, 700))).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (lo, mid)
    return hi


def location(clean: DataFrame, model: Model) -> float:
    """K of the law that the best segment of n clean tokens exceeds x with chance 1 - exp(-K n exp(-lambda x)).

    Maximum likelihood over the clean texts; scores below the least positive one of the model are censored there, as a
    text without any tells no more: K = texts above / sum of n exp(-lambda x) over all texts."""
    floor = float(min((s for s in model.scores if s > 0), default=1.0))

    def tell(batches):
        store: dict = {}
        above, total = 0, 0.0
        for b in pieces(batches, "text"):
            n, found, _ = score_rows(Texts(column(b, "text")), model, store)
            best = np.array([max((s for _, _, s in mine), default=0.0) for mine in found])
            above += int((best > floor).sum())
            total += float((n * np.exp(-model.lam * np.maximum(best, floor))).sum())
        yield pa.RecordBatch.from_arrays([pa.array([above], pa.int64()), pa.array([total], pa.float64())], names=["above", "total"])

    above, total = clean.mapInArrow(tell, "above long, total double").agg(F.sum("above"), F.sum("total")).first()
    # Half a text above is granted where there is none.
    return max(above or 0, 0.5) / max(total or 0.0, 1e-300) if total else 0.1


def fit_map(known: DataFrame, model: Model) -> tuple[float, float]:
    """Logistic map from evidence to the chance of the label, on counts of rounded evidence."""

    def tell(batches):
        store: dict = {}
        for b in pieces(batches, "text"):
            _, _, total = score_rows(Texts(column(b, "text")), model, store)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.round(total * 4) / 4, 100.0)), column(b, "toxic")], names=["x", "toxic"])

    rows = known.mapInArrow(tell, "x double, toxic int").groupBy("x").agg(F.sum("toxic").alias("n1"), F.count("*").alias("n")).collect()  # 401 at most
    x = np.minimum(np.array([r.x for r in rows]), 20.0)
    n, y = np.array([r.n for r in rows], dtype=float), np.array([r.n1 for r in rows], dtype=float)
    n, y = n / n.sum(), y / n.sum()
    slope, offset = 1.0, -1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * x + offset, -30, 30)))
        weight = n * p * (1 - p)
        err = y - n * p
        g = np.array([(err * x).sum() - 1e-4 * slope, err.sum()])
        h = np.array([[(weight * x * x).sum() + 1e-4, (weight * x).sum()], [(weight * x).sum(), weight.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        slope, offset = slope + float(np.clip(step[0], -1, 1)), offset + float(np.clip(step[1], -1, 1))
        if np.abs(step).max() < 1e-6:
            break
    return max(slope, 1e-3), offset


SEGMENT = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("p", pa.float64())]))


def score_toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", with_passages: bool = True, level: float = 0.05, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, score, predicted and, if wanted, passages: every segment with a chance under `level`
    in clean text, as (first token, end, score, p).

    Null or empty texts score as text without evidence. Null ids and repeated rows are kept; an empty
    table gives an empty result; other columns are ignored but for those named in carry. Whole texts
    are scanned.
    """
    arrow_rows(docs.sparkSession)

    def run(batches):
        store: dict = {}
        for b in pieces(batches, "text"):
            n, found, total = score_rows(Texts(column(b, "text")), model, store)
            score = 1 / (1 + np.exp(-np.clip(model.slope * np.minimum(total, 20.0) + model.offset, -30, 30)))
            out, names = [column(b, "doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"]
            if with_passages:
                passages = []
                for k, mine in zip(n.tolist(), found):
                    chance = [(a, e, s, -np.expm1(-exp(min(50.0, log(max(model.k * k, 1.0)) - model.lam * s)))) for a, e, s in mine]
                    passages.append([{"start": a, "end": e, "score": s, "p": float(p)} for a, e, s, p in chance if p < level])
                out, names = [*out, pa.array(passages, SEGMENT)], [*names, "passages"]
            yield pa.RecordBatch.from_arrays([*out, *(column(b, f"carry_{c}" if c != text_col else "text") for c in carry)], names=[*names, *carry])

    kept = [c for c in carry if c != text_col]
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"), *[docs[c].alias(f"carry_{c}") for c in kept])
    more = ", passages array<struct<start:int,end:int,score:double,p:double>>" if with_passages else ""
    more += "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return src.mapInArrow(run, f"doc_id long, score double, predicted int{more}")


def toxicity(docs: DataFrame, labels: DataFrame, fold: int = 0, folds: int = 5, with_passages: bool = True) -> DataFrame:
    """score_toxicity of all docs by a model learned from those outside the held-out fold, with held_out.

    docs has doc_id and text, labels doc_id and toxic (other values than 0 and 1 are no labels; a
    document with several is toxic if one says so). Null ids count as the empty text in the fold."""
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    model = train(src, labels, fold, folds)
    return score_toxicity(src, model, with_passages=with_passages).withColumn("held_out", crc_mod(F.col("doc_id"), folds) == fold)
