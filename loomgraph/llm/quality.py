"""Quality rules: suffix-array repetition.

The words of a document are ranked by prefix doubling (only suffixes that still share a
rank are sorted again), adjacent suffixes give longest-common-prefix intervals, and the
longest interval at a word is the longest repeated substring that starts there. The union
of all repeats of `min_words` or more gives the covered words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .frames import arrow_rows
from .kernels import Texts, Words, column, numbered, per_row, pieces

#: The covered limit lies below the base rule of one half, which counts repeats of three words, so that it can reject what
#: that rule keeps; of the clean documents at sf0.1 the most covered lies at 0.2.
MIN_WORDS, MAX_COVERED, MAX_REPEAT = 10, 0.3, 200


def longest_repeats(word: np.ndarray, ptr: np.ndarray) -> np.ndarray:
    """For each word of a batch of rows, the words of the longest substring starting there that
    also starts elsewhere in the same row. word holds a number for each, ptr[i]:ptr[i+1] are the words of row i."""
    n = len(word)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    count = np.diff(ptr)
    row = np.repeat(np.arange(len(count)), count)
    stop = np.repeat(ptr[1:], count)
    order = np.lexsort((word, row))
    new = np.ones(n, dtype=bool)
    new[1:] = (word[order[1:]] != word[order[:-1]]) | (row[order[1:]] != row[order[:-1]])
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, dtype=np.int64)
    rank[order], rank[n] = head, -1
    levels, step = [rank.copy()], 1
    size = np.bincount(rank[:n], minlength=n)
    active = np.flatnonzero(size[rank[:n]] > 1)
    while len(active):
        there = active + step
        second = np.where(there < stop[active], rank[np.minimum(there, n)], -1) + 1
        order = np.argsort(rank[active] * (n + 2) + second, kind="stable")
        idx, first, second = active[order], rank[active][order], second[order]
        at = np.arange(len(idx))
        group = np.ones(len(idx), dtype=bool)
        group[1:] = first[1:] != first[:-1]
        new = group.copy()
        new[1:] |= second[1:] != second[:-1]
        g0, n0 = np.maximum.accumulate(np.where(group, at, 0)), np.maximum.accumulate(np.where(new, at, 0))
        rank[idx] = first + n0 - g0
        levels.append(rank.copy())
        step *= 2
        alone = new & np.append(new[1:], True)
        active = np.sort(idx[~alone])
    suffix = np.empty(n, dtype=np.int64)
    suffix[rank[:n]] = np.arange(n)
    # Common prefixes of neighbours in suffix order, by descent through the levels.
    a, b = suffix[:-1], suffix[1:]
    pick = np.flatnonzero(levels[0][a] == levels[0][b])
    i, j = a[pick].copy(), b[pick].copy()
    stop_pad = np.append(stop, 0)
    length = np.zeros(len(pick), dtype=np.int64)
    for k in range(len(levels) - 1, -1, -1):
        w = 1 << k
        ok = (i < n) & (j < n)
        ii, jj = np.minimum(i, n), np.minimum(j, n)
        same = ok & (levels[k][ii] == levels[k][jj]) & (ii + w <= stop_pad[ii]) & (jj + w <= stop_pad[jj])
        i, j, length = i + w * same, j + w * same, length + w * same
    out = np.zeros(n, dtype=np.int64)
    np.maximum.at(out, a[pick], length)
    np.maximum.at(out, b[pick], length)
    return out


def covered(longest: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of `least` words or more: the union of the spans."""
    starts = np.flatnonzero(longest >= least)
    edge = np.zeros(len(longest) + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + longest[starts], -1)
    return np.cumsum(edge[:-1]) > 0


_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1


def duplicate_lines(texts: Texts, words: Words) -> np.ndarray:
    """Per row: lines with a word that equal an earlier line, byte for byte."""
    data, offs = texts.data, texts.offs
    breaks = np.flatnonzero(data == 10)
    begin = np.unique(np.concatenate([offs[:-1], breaks + 1]))
    owner = np.searchsorted(offs, begin, side="right") - 1
    ok = (begin < len(data)) & (owner < texts.n)
    begin, owner = begin[ok], owner[ok]
    nxt = np.append(begin[1:], len(data))
    last = np.minimum(nxt, offs[owner + 1])
    ends = np.where((last > begin) & (data[np.maximum(last - 1, 0)] == 10), last - 1, last)
    has = np.searchsorted(words.start, ends) > np.searchsorted(words.start, begin)
    begin, ends, owner = begin[has], ends[has], owner[has]
    edge = np.zeros(len(data) + 1, dtype=np.int8)
    edge[begin] += 1
    edge[ends] -= 1
    line, _ = numbered(data[np.cumsum(edge[:-1], dtype=np.int8) > 0], np.append(0, np.cumsum(ends - begin)))
    order = np.lexsort((line, owner))
    same = np.zeros(len(line), dtype=bool)
    same[1:] = (line[order[1:]] == line[order[:-1]]) & (owner[order[1:]] == owner[order[:-1]])
    return np.bincount(owner[order][same], minlength=texts.n)


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " n_covered long, longest_repeat long, base_failed boolean, kept boolean"
)


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS,
    max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT,
) -> DataFrame:
    """One row per input row: base counts, covered words, longest repeat and the verdict.

    base_failed: under 50 words, or over half of the words in repeated 3-word windows. kept: not
    base_failed, at most `max_covered` of the words in repeats of `min_words` words or more, and
    no repeat over `max_repeat` words.

    Null or empty text: all counts zero, base_failed true. Null ids stay null. Repeated rows are
    judged each. An empty table gives an empty result. Further columns of the input are ignored,
    whatever their names. Texts of any length are judged whole.
    """
    arrow_rows(docs.sparkSession)
    permille = round(1000 * max_covered)

    def judge(batches):
        for b in pieces(batches, "text"):
            texts = Texts(column(b, "text"))
            words = Words(texts)
            longest = longest_repeats(words.numbers(texts)[0], words.ptr)
            n = words.count.astype(np.int64)
            chars = per_row(words.solid & ((texts.data & 0xC0) != 0x80), texts.offs)
            repeat3 = per_row(covered(longest, 3), words.ptr)
            cover = per_row(covered(longest, min_words), words.ptr)
            top = np.zeros(len(n), dtype=np.int64)
            full = np.flatnonzero(n > 0)
            if len(full):
                top[full] = np.maximum.reduceat(longest, words.ptr[full])
            failed = (n < 50) | (100 * repeat3 > 50 * n)
            kept = ~failed & (1000 * cover <= permille * n) & (top <= max_repeat)
            yield pa.RecordBatch.from_arrays(
                [column(b, "doc_id"), *map(pa.array, (n, chars, per_row(_SYMBOL[texts.data], texts.offs), duplicate_lines(texts, words).astype(np.int64), repeat3, cover, top, failed, kept))],
                names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered", "longest_repeat", "base_failed", "kept"],
            )

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(judge, SCHEMA)
