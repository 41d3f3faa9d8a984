"""Window minimisers over token arrays, shared by the two substring operators.

A window is ``length`` consecutive tokens.  Its anchor is the left-most ``k``-gram with
the least hash inside it, so equal windows have equal anchors at equal offsets, wherever
they stand.  Anchors thin positions out about ``(length - k + 2) / 2`` times, which is
what makes exact repeat search affordable: only windows whose anchor occurs again can
themselves occur again.
"""

from __future__ import annotations

import numpy as np

_GOLDEN = np.uint64(0x9E3779B97F4A7C15)  # odd, from the golden ratio
_MIX = np.uint64(0xD6E8FEB86659FD93)  # odd, a public 64-bit mixing constant
_BASE = 0x5851F42D4C957F2D  # odd base of the polynomial hashes
_OFFSET = np.uint64((1 << 20) - 1)  # low bits that carry a position
CHUNK = 1 << 15  # tokens hashed at a time, so that the arrays stay in cache


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose high bits depend on all input bits."""
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return (x ^ (x >> np.uint64(29))) * _GOLDEN


#: A 64-bit value for each byte, made by a rule.
BYTE_VALUES = mix64(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)


def span_hash(tokens: np.ndarray, length: int, base: int = _BASE) -> np.ndarray:
    """Polynomial hashes of all runs of ``length`` tokens, by doubling."""
    n = len(tokens) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    piece, have, power, out, done, left = tokens, 1, base, None, 0, length
    while left:
        if left & 1:
            if out is None:
                out = piece
            else:
                keep = len(tokens) - (done + have) + 1
                out = out[:keep] * np.uint64(power) + piece[done : done + keep]
            done += have
        left >>= 1
        if left:
            piece = piece[: len(piece) - have] * np.uint64(power) + piece[have:]
            power = power * power & 0xFFFFFFFFFFFFFFFF
            have *= 2
    return out[:n]


def window_argmin(values: np.ndarray, width: int) -> np.ndarray:
    """Index of the left-most least value in each run of ``width`` values.

    The low 20 bits of a value give way to its index; at most 2**20 values.
    """
    best = (values & ~_OFFSET) | np.arange(len(values), dtype=np.uint64)
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    return (best & _OFFSET).astype(np.int64)


def anchors(tokens: np.ndarray, bounds: np.ndarray, length: int, k: int):
    """(at, first, last, gram, context): for each anchor its position, the first and last
    start of the windows that it stands for, a hash of its k-gram, and one of these windows.

    ``tokens`` holds documents end to end, as uint64 or as bytes, and ``bounds`` their
    n + 1 offsets; windows do not cross documents.  The windows of one anchor are
    consecutive, and fewer than ``length``, so the first and last cover all.
    """
    width, found = length - k + 1, [[] for _ in range(6)]
    for low in range(0, max(0, len(tokens) - length + 1), CHUNK):
        part = tokens[low : low + CHUNK + length - 1]
        if part.dtype == np.uint8:
            part = BYTE_VALUES[part]
        gram = mix64(span_hash(part, k))
        at = window_argmin(gram, width)
        window = span_hash(part, length)
        starts = np.arange(low, low + len(at), dtype=np.int64)
        doc = np.searchsorted(bounds, starts, side="right")
        doc_end = bounds[doc]
        inside = starts + length <= doc_end
        if not inside.all():
            starts, at, doc_end, window = starts[inside], at[inside], doc_end[inside], window[inside]
        if not len(at):
            continue
        cut = np.flatnonzero((at[1:] != at[:-1]) | (doc_end[1:] != doc_end[:-1])) + 1
        heads = np.concatenate([[0], cut])
        tails = np.concatenate([cut, [len(at)]]) - 1
        for to, x in zip(found, (at[heads] + low, starts[heads], starts[tails], gram[at[heads]], window[heads], window[tails]), strict=True):
            to.append(x)
    if not found[0]:
        empty, none = np.empty(0, np.int64), np.empty(0, np.uint64)
        return empty, empty, empty, none, none
    at, first, last, gram, left, right = (np.concatenate(x) for x in found)
    # An anchor met in two chunks is one anchor.
    heads = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (first[1:] != last[:-1] + 1)]))
    tails = np.concatenate([heads[1:], [len(at)]]) - 1
    first, last = first[heads], last[tails]
    context = mix64(mix64(left[heads]) + right[tails] * _MIX + (last - first).astype(np.uint64))
    # Least hashes are small; mixed again they are even, so that they part shards evenly.
    return at[heads], first, last, mix64(gram[heads] ^ _GOLDEN), context
