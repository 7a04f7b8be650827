"""Spans of words in the bytes of whole record batches, for any class of separators."""

from __future__ import annotations

import numpy as np

from .kernels import numbered


def byte_class(ranges: list[tuple[int, int]]) -> np.ndarray:
    """Which bytes lie in any of the ranges, ends included."""
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


def spans(solid: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the maximal runs of solid bytes; none crosses the end of a row."""
    before, after = np.zeros(len(solid), dtype=bool), np.zeros(len(solid), dtype=bool)
    before[1:], after[:-1] = solid[:-1], solid[1:]
    first, last = offs[:-1], offs[1:] - 1
    before[first[first < len(solid)]] = False
    after[last[last >= 0]] = False
    start = np.flatnonzero(solid & ~before)
    return start, np.flatnonzero(solid & ~after) + 1, np.searchsorted(offs, start, side="right") - 1


def word_numbers(data: np.ndarray, solid: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(number of each word, the distinct words), by comparing their bytes."""
    return numbered(data[solid], np.append(0, np.cumsum(end - start)))
