"""Language ID by error-correcting output codes.

Every language gets a codeword from the rows of a Hadamard matrix, so that any two differ in half
of the bits. For each bit a binary n-gram classifier (naive Bayes over hashed character n-grams,
the languages of either value weighing alike) gives a margin; decoding sums the logistic loss of
every codeword against all margins, each bit weighted by its accuracy in training, and takes the
codeword of least loss. Texts whose two nearest codewords are close are flagged as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import arrow_rows, crc_mod, cut
from .kernels import LOWER, Texts, column, pieces

#: Documents of a language to learn from, about; languages whose counts are held at once.
SAMPLE_PER_LANG, LANGS_AT_ONCE = 4000, 64
HASH_BITS, SMOOTH, MARGIN, AMBIGUOUS = 15, 0.5, 6.0, 0.8
UNKNOWN = "und"

_KEEP = np.zeros(256, dtype=bool)
_KEEP[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def grams(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the n-grams of one to three bytes, offsets per row): letters in lower case, everything
    between them as one blank; each row begins and ends with a blank."""
    data, offs = texts.data, texts.offs
    letter = _KEEP[data]
    first = np.zeros(len(data), dtype=bool)
    first[offs[:-1][offs[:-1] < len(data)]] = True
    gap = ~letter
    gap[1:] &= letter[:-1] | first[1:]
    gap &= ~first | letter  # a row's own blank stands for a leading gap
    take = letter | (gap & ~first)
    sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(take, out=sums[1:])
    body = np.where(letter, LOWER[data], np.uint8(32))[take]
    n = np.diff(sums[offs])
    # Two blanks before each row; the n-grams end at each byte of it and at a closing blank.
    size = n + 3
    ends = np.cumsum(size)
    out = np.full(int(ends[-1]) if len(ends) else 0, 32, dtype=np.uint32)
    inside = np.ones(len(out), dtype=bool)
    begin = ends - size
    inside[begin], inside[begin + 1], inside[ends - 1] = False, False, False
    out[inside] = body
    a, b, c = out[2:], out[1:-1], out[:-2]
    mask, shift = np.uint32((1 << HASH_BITS) - 1), np.uint32(32 - HASH_BITS)
    three = ((a | b << np.uint32(8) | c << np.uint32(16)) * np.uint32(2654435761)) >> shift
    two = ((a | b << np.uint32(8)) * np.uint32(2246822519) >> shift) & mask
    valid = np.ones(len(out), dtype=bool)
    valid[begin] = valid[begin + 1] = False
    ok = valid[2:] if len(out) > 2 else np.zeros(0, bool)
    # Both orders side by side: bigrams in the upper half of the table.
    pair = np.empty((int(ok.sum()), 2), dtype=np.int32)
    pair[:, 0], pair[:, 1] = three[ok], two[ok] + np.uint32(1 << HASH_BITS)
    ptr = np.concatenate([[0], np.cumsum(n + 1)])
    return pair, ptr


@dataclass
class Codes:
    """langs, their codewords (+1 or -1), weights of grams per bit, weights of bits."""

    langs: list[str]
    words: np.ndarray
    grams: np.ndarray
    bits: np.ndarray = field(default_factory=lambda: np.ones(1))


def codebook(n: int) -> np.ndarray:
    """n codewords: rows of a Hadamard matrix without its constant row, columns that are constant or repeat (or negate) another left out."""
    order = 8
    while order <= n:
        order *= 2
    h = np.array([[1]])
    while len(h) < order:
        h = np.block([[h, h], [h, -h]])
    words = h[1 : n + 1]
    cols, seen = [], set()
    for c in range(order):
        col = words[:, c]
        key = tuple(col * col[0])
        if abs(col.sum()) < n and key not in seen:
            seen.add(key)
            cols.append(c)
    words = words[:, cols] if cols else np.ones((n, 1), dtype=int)
    assert len(np.unique(words, axis=0)) == n
    return words


def margins(pair: np.ndarray, ptr: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean weight of the n-grams of each row, for each bit."""
    n = np.diff(ptr)
    out = np.zeros((len(n), table.shape[0]))
    for k, w in enumerate(table):
        s = np.zeros(len(pair) + 1)
        np.cumsum(w[pair[:, 0]] + w[pair[:, 1]], out=s[1:])
        out[:, k] = s[ptr[1:]] - s[ptr[:-1]]
    return out / np.maximum(n, 1)[:, None]


def decode(f: np.ndarray, codes: Codes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(best language, its share of the weights of all codewords, the second one): loss-weighted decoding."""
    one, zero = np.logaddexp(0, -MARGIN * f) * codes.bits, np.logaddexp(0, MARGIN * f) * codes.bits
    loss = one @ (codes.words > 0).T + zero @ (codes.words < 0).T
    like = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
    like /= like.sum(axis=1, keepdims=True)
    order = np.argsort(loss, axis=1, kind="stable")
    best = order[:, 0]
    second = order[:, min(1, loss.shape[1] - 1)]
    return best, like[np.arange(len(best)), best], second


def _count(langs: list[str]):
    index = {x: i for i, x in enumerate(langs)}

    def run(batches):
        size = 2 << HASH_BITS
        total: dict[int, np.ndarray] = {}

        def flush():
            for i, row in total.items():
                g = np.flatnonzero(row)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), i, dtype=np.int32)), pa.array(g.astype(np.int32)), pa.array(row[g])], names=["i", "g", "n"])
            total.clear()

        for b in pieces(batches, "text"):
            pair, ptr = grams(Texts(column(b, "text")))
            lang = np.array([index[x] for x in column(b, "lang").to_pylist()])
            row = np.repeat(lang, np.diff(ptr))
            for i in np.unique(lang).tolist():
                if i not in total and len(total) >= LANGS_AT_ONCE:
                    yield from flush()
                total[i] = total.get(i, 0) + np.bincount(pair[row == i].ravel(), minlength=size)
        yield from flush()

    return run


def train(docs: DataFrame, fold: int = 2, folds: int = 4, per_lang: int = SAMPLE_PER_LANG) -> Codes | None:
    """Fit on about per_lang texts of each language whose crc32(doc_id) modulo folds is not fold; None without any."""
    src = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_mod(F.col("doc_id"), folds) != fold))
    sizes = src.groupBy("lang").agg(F.count("*").alias("n")).collect()  # a row for each language
    if not sizes:
        return None
    langs = sorted(r.lang for r in sizes)
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r.lang, min(1.0, per_lang / r.n))])
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    known = cut(src.filter(F.col("lang").isin(langs)).filter(draw < F.element_at(share, F.col("lang"))).select("text", "lang").distinct(), "langs")
    found = known.mapInArrow(_count(langs), "i int, g int, n long").groupBy("i", "g").agg(F.sum("n").alias("n"))
    if len(langs) > LANGS_AT_ONCE:
        found = cut(found, "grams")
    words = codebook(len(langs))
    # Sums over the languages of either value of a bit, so many languages at a time.
    one, zero = (np.zeros((words.shape[1], 2 << HASH_BITS)) for _ in range(2))
    for a in range(0, len(langs), LANGS_AT_ONCE):
        some = words[a : a + LANGS_AT_ONCE]
        rows = (found.filter(F.col("i").between(a, a + len(some) - 1)) if len(langs) > LANGS_AT_ONCE else found).toArrow()
        counts = np.zeros((len(some), 2 << HASH_BITS))
        counts[np.asarray(rows["i"]) - a, np.asarray(rows["g"])] = np.asarray(rows["n"])
        p = (counts + SMOOTH) / (counts + SMOOTH).sum(axis=1, keepdims=True)
        one += (some > 0).T.astype(float) @ p
        zero += (some < 0).T.astype(float) @ p
    n_one, n_zero = (words > 0).sum(axis=0), (words < 0).sum(axis=0)
    table = np.zeros(one.shape, dtype=np.float32)
    for k in np.flatnonzero((n_one > 0) & (n_zero > 0)):
        table[k] = np.log(one[k] / n_one[k]) - np.log(zero[k] / n_zero[k])
    codes = Codes(langs, words, table, np.ones(words.shape[1]))
    index = {x: i for i, x in enumerate(langs)}

    def wrong(batches):
        n, err = 0, np.zeros(words.shape[1], dtype=np.int64)
        for b in pieces(batches, "text"):
            pair, ptr = grams(Texts(column(b, "text")))
            truth = words[[index[x] for x in column(b, "lang").to_pylist()]]
            err += (margins(pair, ptr, codes.grams) * truth <= 0).sum(axis=0)
            n += len(b)
        k = np.arange(len(err), dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(err), pa.array(np.full(len(err), n, dtype=np.int64))], names=["k", "err", "n"])

    for r in known.mapInArrow(wrong, "k int, err long, n long").groupBy("k").agg(F.sum("err").alias("err"), F.sum("n").alias("n")).collect():
        rate = (r.err + 1) / (r.n + 2)
        codes.bits[r.k] = max(0.05, np.log((1 - rate) / rate))
    codes.bits /= codes.bits.mean()
    return codes


def identify(docs: DataFrame, codes: Codes | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, ambiguous and runner_up, one row per input row.

    lang_pred is `und` with score 0 for null texts, texts without a letter, and all texts if there
    was nothing to learn from. ambiguous: und, or a score under 0.8; runner_up: the second nearest
    language, null for und. Null ids and repeated rows are kept; an empty table gives an empty
    result; other columns, language and source included, are ignored. Whole texts count.
    """
    arrow_rows(docs.sparkSession)

    def run(batches):
        for b in pieces(batches, "text"):
            known = np.asarray(column(b, "letters").to_numpy(zero_copy_only=False)).astype(bool)
            n = len(known)
            lang, second = np.full(n, UNKNOWN, dtype=object), np.full(n, None, dtype=object)
            score = np.zeros(n)
            if codes is not None and known.any():
                pair, ptr = grams(Texts(column(b, "text")))
                best, sure, other = decode(margins(pair, ptr, codes.grams), codes)
                names = np.array(codes.langs, dtype=object)
                lang[known], score[known], second[known] = names[best][known], sure[known], names[other][known]
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(lang, pa.string()), pa.array(score), pa.array(score < AMBIGUOUS), pa.array(second, pa.string())],
                names=["doc_id", "lang_pred", "score", "ambiguous", "runner_up"],
            )

    text = docs[text_col].cast("string")
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    return src.mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean, runner_up string")


def language_id(docs: DataFrame, fold: int = 2, folds: int = 4) -> DataFrame:
    """identify of all docs (doc_id, text, lang) by codes learned outside the held-out fold, with held_out."""
    src = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"), docs["lang"].cast("string").alias("lang"))
    return identify(src, train(src, fold, folds)).withColumn("held_out", crc_mod(F.col("doc_id"), folds) == fold)
