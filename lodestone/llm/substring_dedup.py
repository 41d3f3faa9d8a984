"""Substring deduplication with suffix automata of reference shards."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ._minimizers import BYTE_VALUES, mix64
from ._repeats import Search, Tokens, remove_repeats

_BASE = 0x5851F42D4C957F2D
_CHUNK = 1 << 16


class SuffixAutomaton:
    """All substrings of one or more sequences of tokens, with their numbers of occurrences."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count, self.last = [-1], [0], [0], 0

    def add(self, tokens, times: int = 1) -> None:
        """Take in a sequence that occurs so often; matches do not run across the ends of sequences."""
        follow, link, length, count = self.next, self.link, self.length, self.count
        last = 0
        for t in tokens:
            if (q := follow[last].get(t)) is not None and length[q] == length[last] + 1:
                last = q
                count[last] += times
                continue
            p, cur = last, len(length)
            follow.append({})
            link.append(0)
            length.append(length[last] + 1)
            count.append(times)
            while p >= 0 and t not in follow[p]:
                follow[p][t] = cur
                p = link[p]
            if p >= 0:
                q = follow[p][t]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    copy = len(length)
                    follow.append(dict(follow[q]))
                    link.append(link[q])
                    length.append(length[p] + 1)
                    count.append(0)
                    while p >= 0 and follow[p].get(t) == q:
                        follow[p][t] = copy
                        p = link[p]
                    link[q] = link[cur] = copy
                    if cur == last or length[cur] == length[copy]:  # the suffix was there already
                        link[cur] = link[copy]
                        count[cur], count[copy] = 0, count[cur]
                        cur = copy
            last = cur

    def finish(self) -> None:
        """Sum occurrences up the suffix links, the longest states first."""
        for v in sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True):
            if self.link[v] > 0:
                self.count[self.link[v]] += self.count[v]

    def statistics(self, tokens, most: int):
        """For each token the length of the longest match that ends there, ``most`` at
        most, and how often that match occurs."""
        follow, link, length, count = self.next, self.link, self.length, self.count
        v = size = 0
        for t in tokens:
            while v and t not in follow[v]:
                v = link[v]
                size = length[v]
            if t in follow[v]:
                v = follow[v][t]
                size += 1
                if size > most:
                    size = most
                while length[link[v]] >= size and v:
                    v = link[v]
            yield size, count[v] if v else 0


def split_words(texts: list[bytes]) -> Tokens:
    """64-bit hashes of the words of all texts; words lie between the six ASCII spaces."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    edges = np.flatnonzero(np.diff(space.view(np.int8), prepend=np.int8(1)))
    start, end = edges[::2], edges[1::2]
    size = (end - start).astype(np.int64)
    value = np.zeros(len(start), np.uint64)
    left = np.arange(len(start))
    j = 0
    while len(left):  # a letter of all words at a time, as long as they have one
        value[left] = value[left] * np.uint64(_BASE) + BYTE_VALUES[raw[start[left] + j]]
        j += 1
        left = left[size[left] > j]
    value = mix64(value + size.astype(np.uint64))
    offsets = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    bounds = np.searchsorted(start, offsets).astype(np.int64)

    def keep(i: int, kept: np.ndarray) -> bytes:
        words = texts[i].split()
        return b" ".join(words if kept.all() else [words[j] for j in np.flatnonzero(kept)])

    return Tokens(value, bounds, keep)


def solve_by_automaton(gram, order, offset, n, weight, values, search: Search) -> tuple[np.ndarray, np.ndarray]:
    """Masks of found windows for each context: the contexts of one anchor, each as often as
    it occurs, make a reference shard, whose automaton each of them is streamed through."""
    masks = np.zeros(len(n), np.uint64)
    begin = np.cumsum(n) - n
    by = np.argsort(gram, kind="stable")
    cut = np.concatenate([[0], np.flatnonzero(gram[by][1:] != gram[by][:-1]) + 1, [len(by)]])
    length = search.length
    for i, j in zip(cut, cut[1:]):
        own: dict[tuple, list[int]] = {}  # null ids may send one context from several blocks
        for c in by[i:j].tolist():
            own.setdefault(tuple(values[begin[c] : begin[c] + n[c]].tolist()), []).append(c)
        times = {tokens: int(weight[held].sum()) for tokens, held in own.items()}
        if sum(times.values()) < 2:
            continue
        automaton = SuffixAutomaton()
        for tokens, often in times.items():
            automaton.add(tokens, often)
        automaton.finish()
        for tokens, held in own.items():
            mask = 0
            for end, (size, count) in enumerate(automaton.statistics(tokens, length)):
                if size == length and count > 1:
                    mask |= 1 << (end - length + 1)
            masks[held] = mask
    return masks, masks


def dedup_word_windows(docs: DataFrame, length: int = 35) -> DataFrame:
    """Remove each word covered by a window of ``length`` words that also starts anywhere
    else, in the same document or another.

    Returns doc_id, n_tokens (words), n_removed, n_spans and kept (binary, UTF-8, the kept
    words joined by one space), a row for each row of ``docs``.  Null texts have no words;
    repeated rows are copies of each other; ids only name rows.  ``length``: 16 to 63.
    """
    search = Search(length, max(8, length // 3), False, split_words, solve_by_automaton)
    return remove_repeats(docs, search, np.uint64)
