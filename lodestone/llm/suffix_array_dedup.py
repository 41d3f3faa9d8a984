"""Suffix-array deduplication of byte strings: the depth-limited radix sort."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._repeats import Search, Tokens, remove_repeats

DIGIT = 8  # bytes of a suffix that one pass compares


def split_bytes(texts: list[bytes]) -> Tokens:
    raw = np.frombuffer(b"".join(texts), np.uint8)
    return Tokens(raw, np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64), lambda i, kept: np.frombuffer(texts[i], np.uint8)[kept].tobytes())


def radix_groups(flat: np.ndarray, start: np.ndarray, group: np.ndarray, length: int, times: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Order the suffixes of ``flat`` at ``start``, each standing for so many, through
    ``length`` bytes only.

    Most-significant-digit passes refine ``group`` and drop what stands alone; returns the
    indices of the suffixes left and their groups, which are exactly the repeated windows.
    """
    times = np.ones(len(start)) if times is None else times
    flat = np.append(flat, np.zeros(DIGIT, np.uint8))
    words = np.ndarray((len(flat) - DIGIT + 1,), "<u8", np.ascontiguousarray(flat), strides=(1,))
    left = np.flatnonzero(np.bincount(group, times, 1)[group] > 1)
    group = group[left]
    for depth in [*range(0, length - DIGIT + 1, DIGIT), *([length - DIGIT] if length % DIGIT else [])]:
        digit = words[start[left] + depth]
        by = np.lexsort((digit, group))
        g, d = group[by], digit[by]
        new = np.ones(len(by), bool)
        new[1:] = (g[1:] != g[:-1]) | (d[1:] != d[:-1])
        ids = np.cumsum(new) - 1
        left = left[by]
        many = np.bincount(ids, times[left], 1)[ids] > 1
        left, group = left[many], ids[many]
        if not len(left):
            break
    return left, group


def solve_by_radix(gram, order, offset, n, weight, values, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Masks of found windows for the first holder of each context and for later ones; see _repeats."""
    windows = n - search.length + 1
    begin = np.cumsum(n) - n
    of = np.repeat(np.arange(len(n)), windows)
    index = np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    # The most significant digit is the anchor with the window's place beside it.
    anchor = np.unique(gram, return_inverse=True)[1]
    group = anchor[of] * search.length + (offset[of] - index)
    left, group = radix_groups(values, begin[of] + index, np.unique(group, return_inverse=True)[1], search.length, weight[of])
    first, later = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
    if len(left):
        least = np.full(group.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, group, order[of[left]])
        bit = np.uint64(1) << index.astype(np.uint64)
        hit = left[order[of[left]] > least[group]] if search.earlier else left
        np.bitwise_or.at(first, of[hit], bit[hit])
        np.bitwise_or.at(later, of[left], bit[left])
    return first, later


def dedup_byte_windows(docs: DataFrame, length: int = 50) -> DataFrame:
    """Remove each byte covered by a ``length``-byte string that also starts in a document
    with a smaller doc_id.

    Returns doc_id, n_tokens (bytes), n_removed, n_spans and kept (binary), a row for each
    row of ``docs``.  Null texts are empty; null ids come after all others and, like
    repeated ids, never hold a smaller one than each other.  ``length``: 16 to 63.
    """
    search = Search(length, max(8, 2 * length // 5), True, split_bytes, solve_by_radix)
    return remove_repeats(docs, search, np.uint8)
