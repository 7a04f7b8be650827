"""Vectorised text kernels shared by the operators: they work on the UTF-8 buffer of whole
Arrow batches, so the cost is a few array passes and not a Python object for each word.

Every kernel takes whole texts. Batches are only cut between rows; a single row may be as
long as it likes and needs memory in proportion to its own length.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a longer row is handled alone.
CHUNK = 2 << 20

_rng = np.random.default_rng(20240517)
#: A random 64-bit value for each byte, and the bases of the rolling hashes, two for each.
BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
R1, R2 = (0x3C6EF372, 0x1B873593), (0x27D4EB2F, 0x165667B1)
#: The rolling hashes are polynomials over the field of this prime, so no family of strings collides whatever the base.
PRIME = np.uint64((1 << 31) - 1)
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(32))


def _mod(x: np.ndarray) -> np.ndarray:
    """x modulo PRIME, for x below 2**62."""
    x = (x & PRIME) + (x >> np.uint64(31))
    return np.where(x >= PRIME, x - PRIME, x)


def powers(base: int, n: int, store: dict) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo PRIME for i < n; store keeps them for the next call."""
    if base not in store or len(store[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, int(PRIME))):
            p = np.ones(1, dtype=np.uint64)
            while len(p) < max(n, 1 << 12):
                p = np.concatenate([p, _mod(p * np.uint64(pow(b, len(p), int(PRIME))))])
            out.append(p)
        store[base] = tuple(out)
    return store[base]


class Rolling:
    """Prefix sums that give a 62-bit hash of any span in constant time: two polynomials with bases of their own
    over the halves of the values."""

    def __init__(self, values: np.ndarray, bases: tuple[int, int], store: dict):
        self.sides = []
        for k, base in enumerate(bases):
            p, inverse = powers(base, len(values) + 1, store)
            half = _mod((values >> np.uint64(31 * k)) & PRIME)
            sums = np.zeros(len(values) + 1, dtype=np.uint64)
            np.cumsum(_mod(half * p[: len(values)]), out=sums[1:])
            self.sides.append((sums, inverse))

    def span(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        a, b = (_mod(_mod(sums[end] - sums[start]) * inverse[start]) for sums, inverse in self.sides)
        return mix((a << np.uint64(31) | b) + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def numbered(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """(number of each string data[offs[i]:offs[i + 1]], the distinct strings): equal bytes, equal number."""
    strings = pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = strings.dictionary_encode()
    return np.asarray(coded.indices).astype(np.int64), coded.dictionary


class Texts:
    """Rows of one text column as bytes: data, and offs with one more entry than rows."""

    def __init__(self, column: pa.Array):
        self.null = np.asarray(column.is_null())
        column = pc.fill_null(column, "").cast(pa.large_string())
        self.n = len(column)
        if self.n == 0:
            self.data, self.offs = np.zeros(0, np.uint8), np.zeros(1, np.int64)
            return
        offs = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + self.n + 1]
        raw = column.buffers()[2]
        data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
        self.data, self.offs = data[offs[0] : offs[-1]], offs - offs[0]

    def row(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


class Words:
    """Byte spans of the words `[^\\x20\\x09-\\x0D]+` of each row; ptr[i]:ptr[i+1] are those of row i."""

    def __init__(self, texts: Texts):
        data, offs = texts.data, texts.offs
        solid = ~SPACE[data]
        self.solid = solid
        before = np.zeros(len(data), dtype=bool)
        before[1:] = solid[:-1]
        inner = offs[:-1][offs[:-1] < len(data)]
        before[inner] = False
        self.start = np.flatnonzero(solid & ~before)
        after = np.zeros(len(data), dtype=bool)
        after[:-1] = solid[1:]
        last = offs[1:] - 1
        after[last[last >= 0]] = False
        self.end = np.flatnonzero(solid & ~after) + 1
        self.ptr = np.searchsorted(self.start, offs)
        self.count = np.diff(self.ptr)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def numbers(self, texts: Texts) -> tuple[np.ndarray, pa.Array]:
        """(number of each word, the distinct words), by comparing their bytes."""
        return numbered(texts.data[self.solid], np.append(0, np.cumsum(self.end - self.start)))

    def hashes(self, texts: Texts) -> np.ndarray:
        """XXH64 of each word, computed once for each distinct one."""
        at, words = self.numbers(texts)
        return np.array([xxhash.xxh64_intdigest(w) for w in words.to_pylist()], dtype=np.uint64)[at]


def pieces(batches, column: str, limit: int = CHUNK):
    """Cut record batches between rows so that each piece has about `limit` bytes of `column` at most."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        size = np.asarray(pc.fill_null(pc.binary_length(col), 0)).astype(np.int64)
        ends, i = np.cumsum(size), 0
        while i < len(size):
            base = ends[i - 1] if i else 0
            j = max(i + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def per_row(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of values between offsets, zero for empty rows."""
    sums = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offs[1:]] - sums[offs[:-1]]


def normalised(texts: Texts, words: Words, keep: np.ndarray | None = None, lower: bool = False):
    """(bytes, offsets, start, end): kept words of each row joined by single spaces; start and end are of kept words."""
    keep = np.ones(len(words.start), dtype=bool) if keep is None else keep
    data = texts.data
    take = words.solid.copy()
    if not keep.all():
        out = ~keep
        edge = np.zeros(len(data) + 1, dtype=np.int32)
        np.add.at(edge, words.start[out], 1)
        np.add.at(edge, words.end[out], -1)
        take &= np.cumsum(edge[:-1]) == 0
    kept = np.flatnonzero(keep)
    row = words.rows()[kept]
    gap = words.end[kept[:-1]][row[:-1] == row[1:]] if len(kept) else np.zeros(0, np.int64)
    flat = (LOWER[data] if lower else data.copy()) if len(data) else data
    if len(gap):
        take[gap], flat[gap] = True, 0x20
    sums = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum(take, out=sums[1:])
    return flat[take], sums[texts.offs], sums[words.start[kept]], sums[words.end[kept]]
