"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces and their log scores come from a model file whose place is a parameter; nothing is
trained. Files of another kind hold merge ranks instead of log scores, which `scores="zipf"`
(the default) turns into log(1 / rank) up to a constant; "file" takes the numbers as they are.

Blanks become the whitespace marker and a text begins with one more. No piece holds a marker
after another character, so a text falls apart into units (markers, then other characters) that
are segmented on their own: each distinct unit of a batch once. For all of them together, every
start walks the trie at once, and the best path is then taken position by position. Characters
that no piece covers fall back to the pieces of their UTF-8 bytes.
"""

from __future__ import annotations

import hashlib
import struct
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .frames import arrow_rows
from .kernels import Texts, column, numbered, pieces

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# Fixed values of the file format: kinds of pieces, and how much below the least score an unknown character is.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE_PIECE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i, out, shift = i + 1, out | (c & 127) << shift, shift + 7
        if c < 128:
            return out, i


def _fields(b: bytes):
    """(number, value) of the fields of a serialised message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            value, i = b[i : i + n], i + n
        yield tag >> 3, value


def read_model(raw: bytes) -> list[tuple[str, float, int]]:
    """(piece, score, kind) in order of ids."""
    out = []
    for number, value in _fields(raw):
        if number == 1:
            d = dict(_fields(value))
            out.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
    return out


def double_array(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(base, check, value) of a trie over bytes: child c of state s is base[s] + c if check there is s; value is the key's place or -1."""
    children: list[dict[int, int]] = [{}]
    ends = [-1]
    for n, key in enumerate(keys):
        s = 0
        for c in key:
            if c not in children[s]:
                children[s][c] = len(children)
                children.append({})
                ends.append(-1)
            s = children[s][c]
        ends[s] = n
    size = 4 * len(children) + 1024
    base, check, value = [0] * size, [-1] * size, [-1] * size
    check[0] = -2
    # Free places are linked; wide nodes look from where the last wide node went, as low places are scattered there.
    after, before = list(range(1, size + 1)), list(range(-1, size - 1))
    head, wide = 1, 1
    work = [(0, 0)]
    for node, state in work:  # grows while it is walked
        kids = sorted(children[node].items())
        if not kids:
            continue
        first = kids[0][0]
        spot = head if len(kids) < 4 else max(head, wide)
        while check[spot] != -1:
            spot += 1
        while spot <= first or any(check[spot - first + c] != -1 for c, _ in kids[1:]):
            spot = after[spot]
        if len(kids) >= 4:
            wide = spot
        b = spot - first
        base[state] = b
        for c, child in kids:
            t = b + c
            check[t], value[t] = state, ends[child]
            if t == head:
                head = after[t]
            if before[t] >= 0:
                after[before[t]] = after[t]
            if after[t] < size:
                before[after[t]] = before[t]
            work.append((child, t))
    top = max(i for i in range(size) if check[i] != -1) + 257
    base, check, value = (x + [f] * max(0, top - size) for x, f in ((base, 0), (check, -1), (value, -1)))
    return tuple(np.array(x[:top], dtype=np.int32) for x in (base, check, value))


@dataclass
class Vocabulary:
    """Trie of the pieces (markers as blanks), their ids and log scores, and the bytes of every id."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    ids: np.ndarray
    scores: np.ndarray
    byte_ids: np.ndarray
    unknown_id: int
    unknown_score: float
    flat: np.ndarray
    offs: np.ndarray

    @property
    def size(self) -> int:
        return len(self.offs) - 1


@lru_cache(maxsize=4)
def load_vocabulary(path: str = MODEL, scores: str = "zipf") -> Vocabulary:
    """Read on the driver; about 2 MB are sent to the executors."""
    with open(path, "rb") as f:
        return vocabulary(read_model(f.read()), scores)


def vocabulary(model: list[tuple[str, float, int]], scores: str = "zipf") -> Vocabulary:
    usable = [i for i, (p, _, kind) in enumerate(model) if kind in (NORMAL, USER) and p]
    for i in usable:
        if MARK in model[i][0].lstrip(MARK):
            raise ValueError(f"piece {model[i][0]!r} holds a marker after other characters")
    given = np.array([model[i][1] for i in usable], dtype=np.float64)
    if scores == "zipf":
        ranks = -given
        last = ranks[ranks < 1e8].max(initial=1.0)
        log_scores = -np.log(np.where(ranks < 1e8, ranks, last + 1) + 2.0)
    elif scores == "file":
        log_scores = given
    else:
        raise ValueError(f"unknown scores {scores!r}")
    keys = [model[i][0].replace(MARK, " ").encode() for i in usable]
    base, check, value = double_array(keys)
    byte_ids = np.full(256, -1, dtype=np.int32)
    unknown, spelled = 0, []
    for i, (p, _, kind) in enumerate(model):
        if kind == BYTE_PIECE:
            byte_ids[int(p[3:5], 16)] = i
            spelled.append(bytes([int(p[3:5], 16)]))
        elif kind == UNKNOWN:
            unknown = i
            spelled.append(b" \xe2\x81\x87 ")
        elif kind == CONTROL:
            spelled.append(b"")
        else:
            spelled.append(p.replace(MARK, " ").encode())
    offs = np.concatenate([[0], np.cumsum([len(x) for x in spelled])]).astype(np.int64)
    return Vocabulary(
        base, check, value, np.array(usable, dtype=np.int32), log_scores, byte_ids, unknown,
        float(log_scores.min(initial=0.0)) - UNKNOWN_PENALTY, np.frombuffer(b"".join(spelled), dtype=np.uint8), offs,
    )


def ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[i], start[i] + 1, .. of size[i] numbers each, joined."""
    total = np.cumsum(size)
    return np.repeat(start - (total - size), size) + np.arange(total[-1] if len(total) else 0)


def segment(data: np.ndarray, begin: np.ndarray, end: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets per unit) of the best paths of the units data[begin:end]."""
    size = end - begin
    at = ragged(begin, size)
    flat = data[at]
    n = len(flat)
    stop = np.repeat(np.cumsum(size), size)
    rel = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    head = (flat & 0xC0) != 0x80
    head |= rel == 0
    starts = np.flatnonzero(head)
    nxt = np.minimum(np.append(starts[1:], n), stop[starts])
    # All starts walk the trie together.
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    pos, state, depth = starts, np.zeros(len(starts), dtype=np.int64), 0
    single = np.zeros(n, dtype=bool)
    char_end = np.zeros(n, dtype=np.int64)
    char_end[starts] = nxt
    while len(pos):
        step = v.base[state] + flat[pos + depth]
        ok = v.check[step] == state
        pos, state = pos[ok], step[ok]
        depth += 1
        piece = v.value[state]
        hit = piece >= 0
        found.append((pos[hit], pos[hit] + depth, piece[hit]))
        single[pos[hit & (char_end[pos] == pos + depth)]] = True
        more = pos + depth < stop[pos]
        pos, state = pos[more], state[more]
    lone = starts[~single[starts]]
    found.append((lone, char_end[lone], np.full(len(lone), -1)))
    a, b, piece = (np.concatenate(x).astype(np.int64) for x in zip(*found))
    score = np.where(piece >= 0, v.scores[np.maximum(piece, 0)], v.unknown_score)
    # Best path, position after position; of equal paths the one whose last piece is longest.
    rel_end = rel[b - 1] + 1
    order = np.lexsort((a, b, rel_end))
    a, b, piece, score, rel_end = a[order], b[order], piece[order], score[order], rel_end[order]
    best = np.full(n + 1, -np.inf)  # by end; the start of a unit is told by rel == 0
    back = np.full(n + 1, -1, dtype=np.int64)
    bounds = np.flatnonzero(np.append(True, rel_end[1:] != rel_end[:-1])) if len(a) else np.zeros(0, np.int64)
    for lo, hi in zip(bounds, np.append(bounds[1:], len(a))):
        aa, bb = a[lo:hi], b[lo:hi]
        c = np.where(rel[aa] == 0, 0.0, best[aa]) + score[lo:hi]
        first = np.flatnonzero(np.append(True, bb[1:] != bb[:-1]))
        top = np.maximum.reduceat(c, first)
        group = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(bb))))
        win = np.flatnonzero(c == top[group])
        pick = win[np.append(True, group[win][1:] != group[win][:-1])]
        # `best` of a position is only read by later ends of the same unit.
        best[bb[pick]], back[bb[pick]] = c[pick], lo + pick
    # Unit ends double as the starts of their neighbours, so back is read before any of them is reached.
    cur = np.cumsum(size)
    first_byte = cur - size
    live = np.flatnonzero(size > 0)
    where, took, turn = [], [], 0
    rank = []
    cur = cur.copy()
    while len(live):
        edge = back[cur[live]]
        where.append(live)
        took.append(edge)
        rank.append(np.full(len(live), turn))
        cur[live] = a[edge]
        live = live[cur[live] > first_byte[live]]
        turn += 1
    if not where:
        return np.zeros(0, np.int32), np.zeros(len(size) + 1, np.int64)
    where, took, rank = np.concatenate(where), np.concatenate(took), np.concatenate(rank)
    order = np.lexsort((-rank, where))
    where, took = where[order], took[order]
    kind = piece[took]
    wide = np.where(kind >= 0, 1, b[took] - a[took])
    out = np.empty(int(wide.sum()), dtype=np.int32)
    spot = np.cumsum(wide) - wide
    out[spot[kind >= 0]] = v.ids[kind[kind >= 0]]
    lost = np.flatnonzero(kind < 0)
    if len(lost):
        raw = v.byte_ids[flat[ragged(a[took[lost]], wide[lost])]]
        out[ragged(spot[lost], wide[lost])] = np.where(raw >= 0, raw, v.unknown_id)
    counts = np.bincount(where, weights=wide, minlength=len(size)).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(counts)])


def encode(texts: Texts, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets per row) of all rows; empty rows have none."""
    size = np.diff(texts.offs)
    full = size > 0
    # One blank before each row that is not empty.
    offs = np.concatenate([[0], np.cumsum(size + full)])
    data = np.full(int(offs[-1]), 0x20, dtype=np.uint8)
    inside = np.ones(len(data), dtype=bool)
    inside[offs[:-1][full]] = False
    data[inside] = texts.data
    blank = data == 0x20
    begin_mask = blank.copy()
    begin_mask[1:] &= ~blank[:-1]
    begin_mask[offs[:-1][full]] = True
    begin = np.flatnonzero(begin_mask)
    back, units = numbered(data, np.append(begin, len(data)))
    raw, ends = np.frombuffer(b"".join(units.to_pylist()), dtype=np.uint8), np.append(0, np.cumsum(np.asarray(pc.binary_length(units)).astype(np.int64)))
    ids, ptr = segment(raw, ends[:-1], ends[1:], v)
    width = np.diff(ptr)[back]
    out = ids[ragged(ptr[:-1][back], width)]
    row_units = np.searchsorted(begin, offs)
    total = np.concatenate([[0], np.cumsum(width)])
    return out, total[row_units]


def decode(ids: np.ndarray, offs: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets per row): pieces spelled out, markers as blanks, the blank before each row left out."""
    width = np.diff(v.offs)[ids]
    data = v.flat[ragged(v.offs[:-1][ids], width)]
    total = np.concatenate([[0], np.cumsum(width)])[offs]
    first = total[:-1][(total[1:] > total[:-1])]
    keep = np.ones(len(data), dtype=bool)
    keep[first[data[first] == 0x20]] = False
    sums = np.concatenate([[0], np.cumsum(keep)])
    return data[keep], sums[total]


def encode_documents(
    docs: DataFrame, path: str = MODEL, scores: str = "zipf", id_col: str = "doc_id", text_col: str = "text", digest: bool = False,
) -> DataFrame:
    """doc_id, n_pieces, n_fallback (pieces that are bytes), round_trip and ids (ids_sha256 of their
    little-endian 32-bit numbers with digest=True), one row per input row.

    round_trip tells that decoding gives the text back byte for byte. It is false only where bytes
    have no pieces. A literal marker in a text is spelled in bytes, so that it comes back.
    Null and empty texts have no pieces; null ids and repeated rows are kept; an empty table gives
    an empty result; other columns are ignored. Whole texts are encoded.
    """
    spark = docs.sparkSession
    arrow_rows(spark)
    shared = spark.sparkContext.broadcast(load_vocabulary(path, scores))

    def run(batches):
        v = shared.value
        is_byte = np.zeros(v.size, dtype=bool)
        is_byte[v.byte_ids[v.byte_ids >= 0]] = True
        for b in pieces(batches, "text", 1 << 20):
            texts = Texts(column(b, "text"))
            ids, offs = encode(texts, v)
            raw, ends = decode(ids, offs, v)
            same = np.diff(ends) == np.diff(texts.offs)
            if not (same.all() and np.array_equal(raw, texts.data)):
                for i in np.flatnonzero(same):
                    same[i] = np.array_equal(raw[ends[i] : ends[i + 1]], texts.data[texts.offs[i] : texts.offs[i + 1]])
            fall = np.concatenate([[0], np.cumsum(is_byte[ids])])[offs]
            if digest:
                flat = ids.astype("<i4").tobytes()
                last = pa.array([hashlib.sha256(flat[4 * s : 4 * e]).hexdigest() for s, e in zip(offs[:-1].tolist(), offs[1:].tolist())], pa.string())
            else:
                last = pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), pa.array(np.diff(offs)), pa.array(np.diff(fall).astype(np.int64)), pa.array(same), last],
                names=["doc_id", "n_pieces", "n_fallback", "round_trip", "ids_sha256" if digest else "ids"],
            )

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_pieces long, n_fallback long, round_trip boolean, " + ("ids_sha256 string" if digest else "ids array<int>"))


def decode_documents(coded: DataFrame, path: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text: the texts of the ids of each row.

    Null ids give a null text, an empty array the empty text. Ids outside the vocabulary and null elements stand for the
    unknown piece. Null doc_ids and repeated rows are kept; an empty table gives an empty result; other columns are ignored."""
    spark = coded.sparkSession
    shared = spark.sparkContext.broadcast(load_vocabulary(path))

    def run(batches):
        v = shared.value
        for b in batches:
            lists = column(b, "ids")
            size = np.asarray(pc.fill_null(lists.value_lengths(), 0)).astype(np.int64)
            flat = np.asarray(pc.fill_null(lists.flatten(), -1)).astype(np.int64)
            flat = np.where((flat >= 0) & (flat < v.size), flat, v.unknown_id)
            raw, ends = decode(flat, np.concatenate([[0], np.cumsum(size)]), v)
            texts = [raw[s:e].tobytes().decode("utf-8", "replace") if ok else None for s, e, ok in zip(ends[:-1], ends[1:], lists.is_valid().to_pylist())]
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return coded.select(coded[id_col].cast("long").alias("doc_id"), coded[ids_col].cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")
