"""Substring dedup by De Bruijn compaction over word k-mers.

Windows of `window` words are the edges of a graph, the runs of one word less at their ends its nodes. Edges are not shuffled
one by one: consecutive edges that share their smallest inner m-mer (their anchor) are one piece of a path, known by its first
node, its last node and its length, which together hold every word of it; equal edges always lie in pieces of one anchor, at
the same distance from it. So

1. pieces (anchor, nodes, source coordinates) replace edges, about one for 14 edges, and a join keeps those whose anchor
   occurs twice or more;
2. equal pieces are one segment of the graph; where an anchor has several and one occurs once only, one piece of each is
   expanded into its edges, and the edges in several of them are segments too;
3. at a node where one segment ends, one begins and both occur at the same places, nothing branches: joins on the nodes link
   such segments, and pointer doubling compacts each chain of links into one path, so that a repeated passage is one span;
4. each occurrence of a path is verified at its source coordinates: the words there are hashed cryptographically, and a
   path stands if all its occurrences are equal and cover the same part of it. For the anchors of all other paths (nodes whose
   hashes collide) every window is counted by such a hash of its words instead;
5. the words of all spans are removed from the whole text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import arrow_rows, cut, forget, release, written
from .kernels import R2, Rolling, Texts, Words, column, normalised, pieces

#: Words of a window and of an anchor; bits of a node's hash (the result does not depend on them, only the work does).
WINDOW, ANCHOR, NODE_BITS = 35, 8, 64


def anchors(word_hash: np.ndarray, ptr: np.ndarray, window: int, anchor: int, store: dict):
    """(start of each window, position of its anchor, rolling hash of words). The anchor is the
    window's smallest m-mer by hash, the first of equal ones, and so depends on its words alone."""
    n = len(word_hash)
    roll = Rolling(word_hash, R2, store)
    stop = np.repeat(ptr[1:], np.diff(ptr))
    if n < window:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), roll
    at = np.arange(n - anchor + 1)
    # The low bits hold the position, so the minimum also tells where it is. Batches longer than
    # 2**22 words (one very long row) take a wider field and a shorter hash.
    bits = max(22, int(n).bit_length())
    mask = np.uint64((1 << bits) - 1)
    key = (roll.span(at, at + anchor) & ~mask) | at.astype(np.uint64)
    width, have = window - anchor + 1, 1
    low = key
    while 2 * have <= width:
        low = np.minimum(low[: len(low) - have], low[have:])
        have *= 2
    if have < width:
        low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
    starts = np.flatnonzero(np.arange(n - window + 1) + window <= stop[: n - window + 1])
    return starts, (low[starts] & mask).astype(np.int64), roll


def path_pieces(word_hash: np.ndarray, ptr: np.ndarray, window: int, anchor: int, store: dict, bits: int = NODE_BITS):
    """Maximal runs of windows with one anchor: (row, first window, windows, anchor hash, first node, last node)."""
    starts, at, roll = anchors(word_hash, ptr, window, anchor, store)
    if not len(starts):
        z = np.zeros(0, np.int64)
        return z, z, z, *[z.astype(np.uint64)] * 3
    new = np.ones(len(starts), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(starts)))
    begin, pos = starts[first], at[first]
    row = np.searchsorted(ptr, begin, side="right") - 1
    return row, begin - ptr[row], count, roll.span(pos, pos + anchor), node(roll, begin, window, bits), node(roll, begin + count, window, bits)


def node(roll: Rolling, at: np.ndarray, window: int, bits: int) -> np.ndarray:
    """The hash of the node that begins at a word."""
    return roll.span(at, at + window - 1) & np.uint64((1 << bits) - 1)


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _find_pieces(window: int, anchor: int, bits: int):
    def run(batches):
        store: dict = {}
        for b in pieces(batches, "text"):
            texts = Texts(column(b, "text"))
            words = Words(texts)
            row, start, count, a, u, v = path_pieces(words.hashes(texts), words.ptr, window, anchor, store, bits)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id").take(take), column(b, "th").take(take), _signed(a), _signed(u), _signed(v), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32))],
                names=["doc_id", "th", "a", "u", "v", "start", "n"],
            )

    return run


def _listed(b: pa.RecordBatch, words: Words):
    """(owner, a, start of the window, first word, k, n) of each window of the pieces listed in todo."""
    items = column(b, "todo")
    flat = items.flatten()
    owner = np.repeat(np.arange(len(b)), np.diff(np.asarray(items.offsets)))
    a, start, n, k = (np.asarray(flat.field(i)) for i in range(4))
    each = np.repeat(np.arange(len(owner)), n)
    local = start[each].astype(np.int64) + np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
    return owner[each], a[each], local, words.ptr[owner[each]] + local, k[each].astype(np.int64), n[each]


def _expand(window: int, bits: int):
    """The nodes of the listed pieces of each document: one more than a piece has edges."""

    def run(batches):
        store: dict = {}
        for b in pieces(batches, "text"):
            texts = Texts(column(b, "text"))
            words = Words(texts)
            roll = Rolling(words.hashes(texts), R2, store)
            items = column(b, "todo")
            flat = items.flatten()
            owner = np.repeat(np.arange(len(b)), np.diff(np.asarray(items.offsets)))
            start, n = (np.asarray(flat.field(i)).astype(np.int64) for i in (1, 2))
            ends = np.append(0, np.cumsum(n + 1))
            at = np.repeat(words.ptr[owner] + start - ends[:-1], n + 1) + np.arange(ends[-1])
            nodes = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), _signed(node(roll, at, window, bits)))
            take = pa.array(owner)
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").take(take), column(b, "th").take(take), flat.field(0), flat.field(1), flat.field(3), nodes], names=["doc_id", "th", "a", "start", "k", "nodes"])

    return run


def _digest(raw: bytes) -> bytes:
    return hashlib.blake2b(raw, digest_size=16).digest()


def _windows(window: int):
    """Cryptographic hashes of the words of each window of the listed pieces."""

    def run(batches):
        for b in pieces(batches, "text"):
            texts = Texts(column(b, "text"))
            words = Words(texts)
            out, _, begin, end = normalised(texts, words)
            raw = out.tobytes()
            owner, _, local, at, _, _ = _listed(b, words)
            take = pa.array(owner)
            hashes = [_digest(raw[x:y]) for x, y in zip(begin[at].tolist(), end[at + window - 1].tolist())]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id").take(take), column(b, "th").take(take), pa.array(hashes, pa.binary()), pa.array(local.astype(np.int32))], names=["doc_id", "th", "w", "start"])

    return run


SPAN = "struct<start:int,len:int,path:bigint,low:int>"
PROOF = pa.list_(pa.struct([("path", pa.int64()), ("low", pa.int32()), ("len", pa.int32()), ("w", pa.binary())]))


def _remove(digest: bool):
    """Cut the words of the spans of each document out of it; and a proof of each span, the hash of its words."""

    def run(batches):
        for b in pieces(batches, "text"):
            texts = Texts(column(b, "text"))
            words = Words(texts)
            items = column(b, "spans")
            flat = items.flatten()
            count = np.diff(np.asarray(items.offsets))
            owner = np.repeat(np.arange(len(b)), count)
            edge = np.zeros(len(words.start) + 1, dtype=np.int64)
            proofs = []
            if len(owner):
                start = words.ptr[owner] + np.asarray(flat.field(0)).astype(np.int64)
                size = np.asarray(flat.field(1)).astype(np.int64)
                np.add.at(edge, start, 1)
                np.add.at(edge, start + size, -1)
                out, _, begin, end = normalised(texts, words)
                raw = out.tobytes()
                proofs = [_digest(raw[x:y]) for x, y in zip(begin[start].tolist(), end[start + size - 1].tolist())]
            gone = np.cumsum(edge[:-1]) > 0
            out, offs, _, _ = normalised(texts, words, ~gone)
            raw = out.tobytes()
            removed = np.bincount(words.rows()[gone], minlength=len(b)).astype(np.int64)
            spans = zip(offs[:-1].tolist(), offs[1:].tolist())
            kept = [hashlib.sha256(raw[s:e]).hexdigest() if digest else raw[s:e].decode("utf-8", "replace") for s, e in spans]
            each = pa.StructArray.from_arrays([flat.field(2), flat.field(3), flat.field(1), pa.array(proofs, pa.binary())], fields=list(PROOF.value_type))
            proof = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), each)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), column(b, "th"), pa.array(words.count.astype(np.int64)), pa.array(removed), pa.array(kept, pa.string()), proof],
                names=["doc_id", "th", "n_words", "n_removed", "kept_sha256" if digest else "kept_text", "proofs"],
            )

    return run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("th"), text.alias("text"))


def _same(left: DataFrame, right: DataFrame):
    return left["doc_id"].eqNullSafe(right["doc_id"]) & left["th"].eqNullSafe(right["th"])


def _todo(src: DataFrame, rows: DataFrame) -> DataFrame:
    """Source texts with the pieces (a, start, n, k) of them that rows list."""
    todo = rows.groupBy("doc_id", "th").agg(F.collect_list(F.struct("a", "start", "n", "k")).alias("todo"))
    return src.join(todo, _same(src, todo)).select(src["doc_id"], src["th"], src["text"], "todo")


def compacted(segments: DataFrame) -> DataFrame:
    """id, head, off: for each segment that is linked to another, the first segment of its path and the edges before it.

    segments has id (struct u, v, n), k, its occurrences, and sums over where they begin and end. Each round of pointer doubling joins the segments that have not
    found their head with what they point to; rings, which have none, stay apart."""
    first = segments.groupBy(F.col("id.u").alias("at")).agg(F.count("*").alias("m"), F.min(F.struct("id", "k", "begins")).alias("to")).filter("m = 1")
    last = segments.groupBy(F.col("id.v").alias("at")).agg(F.count("*").alias("m"), F.min(F.struct("id", "k", "ends")).alias("from")).filter("m = 1")
    links = last.drop("m").join(first.drop("m"), "at").filter("from.k = to.k and from.ends = to.begins and from.id <> to.id")
    links = cut(links.select(F.col("from.id").alias("prev"), F.col("to.id").alias("id")), "links")
    heads = links.join(links.select(F.col("id").alias("prev")), "prev", "left_anti").select(F.col("prev").alias("id"))
    heads = heads.select("id", F.col("id").alias("head"), F.lit(0).cast("long").alias("off"), F.lit(True).alias("done"))
    table = cut(heads.unionByName(links.select("id", F.col("prev").alias("head"), F.col("prev.n").cast("long").alias("off"), F.lit(False).alias("done"))), "pointers")
    forget(links)
    left = table.filter("not done").count()
    while left:
        old = table.select(F.col("id").alias("head"), F.col("head").alias("next"), F.col("off").alias("more"), F.col("done").alias("found"))
        moved = table.filter("not done").join(old, "head").select("id", F.col("next").alias("head"), (F.col("off") + F.col("more")).alias("off"), F.col("found").alias("done"))
        before, table = table, cut(table.filter("done").unionByName(moved), "pointers")
        forget(before)
        steps, left = left, table.filter("not done").count()
        if left == steps:
            break
    return table.filter("done").select("id", "head", "off")


def repeated_paths(src: DataFrame, window: int, anchor: int, bits: int = NODE_BITS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pieces with a shared anchor; anchors and paths of the segments; spans: doc_id, th, start, len, path, low, the path's edges before it)."""
    found = cut(src.mapInArrow(_find_pieces(window, anchor, bits), "doc_id long, th long, a long, u long, v long, start int, n int"), "pieces")
    # Written tables on both sides of the joins let the adaptive skew join split a hot anchor.
    shared = cut(found.groupBy("a").agg(F.count("*").alias("m")).filter("m > 1").select("a"), "anchors")
    every, found = found, cut(found.join(shared, "a"), "shared")
    forget(every, shared)
    one = F.struct("doc_id", "th", "start")
    # Half a hash, so that no sum over places overflows; equal sums for other places are found out when paths are verified.
    places = lambda at: F.sum(F.xxhash64("doc_id", "th", at).bitwiseAND(F.lit(0xFFFFFFFF)))
    ends = places(F.col("start") + F.col("n")).alias("ends")
    classes = cut(found.groupBy("a", "u", "v", "n").agg(F.count("*").alias("k"), F.min(one).alias("one"), places(F.col("start")).alias("begins"), ends), "classes")
    forks = cut(classes.groupBy("a").agg(F.count("*").alias("m"), F.min("k").alias("least")).filter("m > 1 and least = 1").select("a"), "forks")
    edges = _todo(src, classes.join(forks, "a").select("one.doc_id", "one.th", "a", "one.start", "n", "k"))
    forked = cut(edges.mapInArrow(_expand(window, bits), "doc_id long, th long, a long, start int, k long, nodes array<bigint>"), "nodes")
    each = F.transform(F.sequence(F.lit(0), F.size("nodes") - 2), lambda i: F.struct(F.col("nodes")[i].alias("u"), F.col("nodes")[i + 1].alias("v"), (F.col("start") + i).alias("start")))
    edges = forked.select("doc_id", "th", "a", "k", (F.size("nodes") - 1).alias("of"), F.explode(each).alias("e")).select("doc_id", "th", "a", "k", "of", "e.*")
    # One row of each class at most has an edge, so that few share one, and a window counts them where they are.
    edges = edges.withColumn("m", F.count("*").over(Window.partitionBy("u", "v"))).filter("m > 1").drop("m")
    edges = cut(edges.withColumn("n", F.lit(1)), "edges")
    forget(forked, forks)
    again = edges.groupBy("a", "u", "v", "n").agg(F.sum("k").alias("k"), F.count("*").alias("m"), places(F.col("start")).alias("begins"), ends)
    again = cut(again.filter("m > 1").drop("m"), "again")
    names = ["a", F.struct("u", "v", "n").alias("id"), "k", "begins", "ends"]
    repeated = cut(classes.filter("k > 1").select(*names).unionByName(again.select(*names)), "segments")
    since = written()
    chains = compacted(repeated.groupBy("id").agg(F.max("k").alias("k"), F.max("begins").alias("begins"), F.max("ends").alias("ends")))
    # A path is known by a hash of its first segment; paths that share one are found out when they are verified.
    path = F.xxhash64(F.coalesce("head.u", "id.u"), F.coalesce("head.v", "id.v"), F.coalesce("head.n", "id.n")).alias("path")
    heads = cut(repeated.join(chains, "id", "left").select("a", "id.u", "id.v", "id.n", path, F.coalesce("off", F.lit(0)).cast("int").alias("off")).distinct(), "heads")
    release(src.sparkSession, since, keep_last=True)  # the pointers, which only these heads read
    forget(repeated)
    key = ["a", "u", "v", "n"]
    # All pieces of several occurrences; of each piece that shares an edge, that edge, unless it is the piece.
    whole = found.join(heads.join(classes.filter("k > 1").select(*key), key, "left_semi"), key)
    single = edges.filter("k = 1 or of > 1").join(heads.join(again.select(*key), key, "left_semi"), key)
    columns = ["doc_id", "th", "start", "n", "path", "off"]
    placed = whole.select(*columns).unionByName(single.select(*columns))
    spans = placed.groupBy("doc_id", "th", "path", (F.col("start") - F.col("off")).alias("origin")).agg(
        F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("stop"), F.sum("n").alias("got")
    )
    # Equal rows of the input give every piece as often.
    rows = src.groupBy("doc_id", "th").agg(F.count("*").alias("rows")).filter("rows > 1")
    spans = cut(spans.join(rows, _same(spans, rows), "left").select(spans["*"], F.coalesce("rows", F.lit(1)).alias("rows")), "occurrences")
    gaps = F.col("got") != F.col("rows") * (F.col("stop") - F.col("start"))
    joined = spans.filter(~gaps).select("doc_id", "th", "start", (F.col("stop") - F.col("start") + (window - 1)).alias("len"), "path", (F.col("start") - F.col("origin")).alias("low"))
    if spans.filter(gaps).limit(1).count():
        # Occurrences that lack a segment in between: their segments stay apart.
        open_ = spans.filter(gaps).select(F.col("doc_id").alias("d"), F.col("th").alias("t"), F.col("path").alias("q"), F.col("origin").alias("o"))
        same = F.col("doc_id").eqNullSafe(F.col("d")) & F.col("th").eqNullSafe(F.col("t")) & (F.col("path") == F.col("q")) & (F.col("start") - F.col("off") == F.col("o"))
        apart = placed.join(open_, same, "left_semi").select("doc_id", "th", "start", (F.col("n") + (window - 1)).alias("len"), "path", F.col("off").alias("low")).distinct()
        joined = joined.unionByName(cut(apart, "apart"))
    forget(classes, edges, again)
    return found, heads, joined


def substring_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, digest: bool = False,
    node_bits: int = NODE_BITS,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed and kept_text (kept_sha256 with digest=True).

    A word goes if it lies in a run of `window` words that also starts anywhere else, in the same
    document or another; runs are judged on the input. Every copy goes, the first included.
    Kept words are joined by single spaces.

    Null or empty texts have no words and keep the empty text. Rows repeated with the same id and
    text count as copies of each other and each loses the shared words; rows with one id and
    different texts are told apart by text. Null ids are kept. Empty tables give an empty result.
    Other columns are ignored.
    """
    if not 2 <= anchor <= window:
        raise ValueError("anchor must be from 2 to window, so that the nodes of a piece hold all its words")
    arrow_rows(docs.sparkSession)
    src = _source(docs, id_col, text_col)
    found, heads, spans = repeated_paths(src, window, anchor, node_bits)
    kept = "kept_sha256" if digest else "kept_text"
    schema = f"doc_id long, th long, n_words long, n_removed long, {kept} string, proofs array<struct<path:bigint,low:int,len:int,w:binary>>"
    columns = ["doc_id", "n_words", "n_removed", kept]

    def removed(some: DataFrame, spans: DataFrame) -> DataFrame:
        listed = cut(spans.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "len", "path", "low")).alias("spans")), "spans")
        joined = some.join(listed, _same(some, listed), "left")
        joined = joined.select(some["doc_id"], some["th"], some["text"], F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))
        return joined.mapInArrow(_remove(digest), schema)

    checked = cut(removed(src, spans), "checked")
    proofs = checked.select(F.inline("proofs")).groupBy("path", "low", "len", "w").agg(F.count("*").alias("k"))
    doubtful = cut(proofs.groupBy("path").agg(F.count("*").alias("ways"), F.min("k").alias("least")).filter("ways > 1 or least < 2").select("path"), "doubtful")
    if not doubtful.limit(1).count():
        return checked.select(*columns)
    again = cut(heads.join(doubtful, "path", "left_semi").select("a").distinct(), "doubted")
    windows = _todo(src, found.join(again, "a").withColumn("k", F.lit(1).cast("long"))).mapInArrow(_windows(window), "doc_id long, th long, w binary, start int")
    windows = cut(windows, "windows")
    real = windows.join(windows.groupBy("w").agg(F.count("*").alias("k")).filter("k > 1").select("w"), "w").select("doc_id", "th", "start").distinct()
    real = real.select("doc_id", "th", "start", F.lit(window).alias("len"), F.lit(None).cast("long").alias("path"), F.lit(0).alias("low"))
    touched = cut(windows.select("doc_id", "th").distinct().unionByName(spans.join(doubtful, "path", "left_semi").select("doc_id", "th").distinct()).distinct(), "touched")
    fine = spans.join(doubtful, "path", "left_anti").unionByName(real)
    fine = fine.join(touched, _same(fine, touched), "left_semi")
    rest = removed(src.join(touched, _same(src, touched), "left_semi"), fine)
    return checked.join(touched, _same(checked, touched), "left_anti").select(*columns).unionByName(rest.select(*columns))
