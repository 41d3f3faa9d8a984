"""Exact search for repeated windows of tokens over a whole corpus.

Documents are dealt into blocks by ranges of doc_id.  Blocks and hash shards exchange
packed messages, so a passage that a third of all documents share costs each shard at most
one entry a block:

1. Each block sends, for each distinct (anchor, context) it holds, the anchor's hash and
   the hash of the context, i.e. of all windows that the anchor stands for.
2. A shard answers who holds an anchor that occurs again: the first holder of a context
   sends it whole, the others only claim it.  Hashes pre-aggregate here; they remove nothing.
3. A second shard gives the contexts, each with the number of its occurrences, to a solver
   of the operator (suffix automata or a radix sort), which compares them window by window.
   A window is removed only if the solver finds it.  Contexts of an anchor with over GROUP
   of them travel as single windows, which each block thins out to distinct ones and which
   are dealt by their own hash, so that no group is unbounded; the solver decides these too.
4. Blocks turn the answers into covered tokens.

All rounds are one lazy plan; the exchange that deals the documents is used three times.
Blocks and shards grow with the root of the input's bytes, so that a message between them
stays at about MESSAGE bytes and their number grows with the input, not with its square.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import id_blocks
from ._minimizers import anchors, mix64

BLOCK_BYTES = 4 << 20  # of text in a block, at least
MESSAGE = 1024  # bytes between a block and a shard, about
GROUP = 1024  # contexts of one anchor that meet whole
SENDER, CLAIM, HOT = 1, 2, 4
_MESSAGE = "_shard int, _block int, kind int, payload binary"
_REPLY = "_block int, _shard int, kind int, payload binary"


@dataclass(frozen=True)
class Tokens:
    """A block's tokens end to end: values, the documents' offsets, and what a document's
    kept part is made from."""

    values: np.ndarray  # uint64, or uint8 with table
    bounds: np.ndarray
    keep: Callable[[int, np.ndarray], bytes]


@dataclass(frozen=True)
class Search:
    """``split`` makes Tokens of a list of texts; ``solve`` flags the windows of contexts: as
    their first holder sees them, and as later holders do.

    earlier: a window counts as found if a document with a smaller doc_id has it;
    otherwise if it is found anywhere else.
    """

    length: int
    k: int
    earlier: bool
    split: Callable[[list[bytes]], Tokens]
    solve: Callable


class Block:
    """The documents of one block and their anchors, always in the same order."""

    def __init__(self, table: pa.Table, search: Search):
        ids = table.column("doc_id").to_pandas()
        texts = [t or b"" for t in table.column("text").to_pylist()]
        null = ids.isna().to_numpy()
        number = ids.fillna(0).to_numpy(np.int64)
        order = sorted(range(len(texts)), key=lambda i: (null[i], number[i], texts[i]))
        self.ids = [None if null[i] else int(number[i]) for i in order]
        rank = np.zeros(len(order), np.int64)
        for j in range(1, len(order)):
            rank[j] = rank[j - 1] + (self.ids[j] != self.ids[j - 1])
        self.tokens = search.split([texts[i] for i in order])
        at, self.first, self.last, gram, self.context = anchors(self.tokens.values, self.tokens.bounds, search.length, search.k)
        doc = np.searchsorted(self.tokens.bounds, self.first, side="right") - 1
        self.rank = rank[doc]
        self.at = at
        # Distinct (anchor, context) pairs, by anchor; each keeps its first occurrence.
        by = np.lexsort((self.first, self.context, gram))
        g, c = gram[by], self.context[by]
        new = np.ones(len(by), bool)
        new[1:] = (g[1:] != g[:-1]) | (c[1:] != c[:-1])
        self.heads = np.flatnonzero(new)
        self.pair = np.empty(len(by), np.int64)  # of each occurrence
        self.pair[by] = np.cumsum(new) - 1
        self.gram, self.ctx, self.occurrence = g[self.heads], c[self.heads], by[self.heads]
        self.count = np.diff(np.append(self.heads, len(by)))


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Rises with the hash, so that sorted hashes lie together by shard."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _cuts(sorted_hashes: np.ndarray, shards: int) -> np.ndarray:
    return np.searchsorted(_shard_of(sorted_hashes, shards), np.arange(shards + 1))


def _six(hashes: np.ndarray) -> bytes:
    """The six high bytes of each hash."""
    return np.ascontiguousarray(hashes.astype(">u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _of_six(parts: list[np.ndarray]) -> np.ndarray:
    """The numbers that six bytes each make, the two low bytes being 0."""
    out = np.zeros((sum(len(x) for x in parts) // 6, 8), np.uint8)
    out[:, :6] = np.concatenate(parts).reshape(-1, 6)
    return out.view(">u8").ravel().astype(np.uint64)


def _rows(schema: list[str], rows: list[tuple]) -> pa.Table:
    kinds = {"payload": pa.binary(), "kind": pa.int32(), "_block": pa.int32(), "_shard": pa.int32()}
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.table({n: pa.array(list(c), kinds[n]) for n, c in zip(schema, columns, strict=True)})


def _ask(search: Search, shards: int):
    """Round 1: a block's distinct (anchor, context) pairs."""

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        block, b = key[0].as_py(), Block(table, search)
        cut = _cuts(b.gram, shards)
        return _rows(
            ["_shard", "_block", "kind", "payload"],
            [(s, block, 0, _six(b.gram[i:j]) + _six(b.ctx[i:j])) for s, i, j in zip(range(shards), cut, cut[1:]) if j > i],
        )

    return ask


def _answer(search: Search, last: int):
    """Round 2: a code for each pair.  Blocks from ``last`` on hold null ids, none of which
    is smaller than another."""

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        blocks, payloads = table.column("_block").to_pylist(), table.column("payload").to_pylist()
        sizes = np.array([len(p) // 12 for p in payloads])
        gram, ctx = _pairs(payloads, sizes)
        block = np.repeat(np.array(blocks), sizes)
        by = np.lexsort((block, ctx, gram))
        g, c, order = gram[by], ctx[by], np.minimum(block[by], last)
        new_g = np.ones(len(by), bool)
        new_g[1:] = g[1:] != g[:-1]
        new_c = new_g.copy()
        new_c[1:] |= c[1:] != c[:-1]
        heads = np.flatnonzero(new_c)
        holders = np.diff(np.append(heads, len(by)))
        group = np.cumsum(new_g) - 1
        contexts = np.bincount(group[heads])[group]
        again = (contexts > 1) | (np.repeat(holders, holders) > 1)
        first = order == np.repeat(order[heads], holders) if search.earlier else new_c
        code = np.where(contexts > GROUP, HOT, np.where(first, again * SENDER, CLAIM))
        out = np.empty(len(by), np.uint8)
        out[by] = code
        ends = np.cumsum(sizes)
        return _rows(["_block", "_shard", "kind", "payload"], [(b, key[0].as_py(), 0, out[e - n : e].tobytes()) for b, e, n in zip(blocks, ends, sizes)])

    return answer


def _pairs(payloads: list[bytes], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The anchors' and the contexts' six bytes, as numbers, of packed pairs."""
    return tuple(_of_six([np.frombuffer(p, np.uint8, 6 * n, 6 * n * i) for p, n in zip(payloads, sizes)]) for i in (0, 1))


def _codes(replies: pa.Table, kind: int) -> bytes:
    """The payloads of one kind, in the order of their shards."""
    t = replies.filter(pc.equal(replies.column("kind"), kind)).sort_by("_shard")
    return b"".join(t.column("payload").to_pylist())


class Sent:
    """What a block sends in round 3, and in which order its answers come back."""

    def __init__(self, b: Block, code: np.ndarray, search: Search, shards: int):
        # What occurs again in this block alone is sent too.
        self.pairs = np.flatnonzero((code == SENDER) | ((code == 0) & (b.count > 1)))  # by anchor, so by shard
        self.cut = _cuts(b.gram[self.pairs], shards)
        self.claims = np.flatnonzero(code == CLAIM)
        self.claim_cut = _cuts(b.gram[self.claims], shards)
        hot = np.flatnonzero(code == HOT)
        occ = b.occurrence[hot]
        counts = b.last[occ] - b.first[occ] + 1
        self.hot_pair = np.repeat(hot, counts)
        self.hot_index = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        start = np.repeat(b.first[occ], counts) + self.hot_index
        hashes = _window_hashes(b.tokens.values, start, search.length)
        self.hot_rank = b.rank[b.occurrence[self.hot_pair]]
        by = np.lexsort((self.hot_rank, hashes))
        h = hashes[by]
        new = np.ones(len(by), bool)
        new[1:] = h[1:] != h[:-1]
        heads = np.flatnonzero(new)
        self.unique, self.unique_start = h[heads], start[by][heads]
        self.of = np.empty(len(by), np.int64)
        self.of[by] = np.cumsum(new) - 1
        self.least_rank = self.hot_rank[by][heads]
        self.repeats = np.bincount(self.of, b.count[self.hot_pair], len(heads)).astype(np.int64)
        self.hot_cut = _cuts(self.unique, shards)


def _window_hashes(values: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(length):
            out = out * np.uint64(0x5851F42D4C957F2D) + values[starts + j].astype(np.uint64) + np.uint64(1)
    return mix64(out)


_HEAD = (("rank", np.int32), ("count", np.uint8), ("offset", np.uint8), ("n", np.uint8))


def _pack(values: np.ndarray, begin: np.ndarray, gram: np.ndarray, ctx: np.ndarray, **head: np.ndarray) -> bytes:
    """Contexts in one message: their number, hashes, _HEAD column by column, their tokens.
    A count over 255 says no more than 255 does, that there are others."""
    n = head["n"] = head["n"].astype(np.int64)
    head["count"] = np.minimum(head["count"], 255)
    flat = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return np.int64(len(n)).tobytes() + _six(gram) + _six(ctx) + b"".join(head[name].astype(kind).tobytes() for name, kind in _HEAD) + values[flat].tobytes()


def _unpack(payloads: list[bytes], dtype) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
    """Hashes and _HEAD columns of all messages, the number of contexts in each, and all tokens."""
    sizes = np.array([int(np.frombuffer(p, np.int64, 1)[0]) for p in payloads])
    head, at = {}, np.full(len(payloads), 8)
    for name in ("gram", "ctx"):
        head[name] = _of_six([np.frombuffer(p, np.uint8, 6 * k, i) for p, k, i in zip(payloads, sizes, at)])
        at += 6 * sizes
    for name, kind in _HEAD:
        head[name] = np.concatenate([np.frombuffer(p, kind, k, i) for p, k, i in zip(payloads, sizes, at)])
        at += sizes * np.dtype(kind).itemsize
    return head, sizes, np.concatenate([np.frombuffer(p, dtype, -1, i) for p, i in zip(payloads, at)])


NONE, ALL, LATER, PARTLY = range(4)


def _full(windows: np.ndarray) -> np.ndarray:
    """A mask of so many windows."""
    return (np.uint64(1) << windows.astype(np.uint64)) - np.uint64(1)


def _pack_masks(first: np.ndarray, later: np.ndarray, full: np.ndarray) -> bytes:
    """A byte for each context, and its masks only where they are of its windows a part."""
    code = np.full(len(full), PARTLY, np.uint8)
    code[later == 0] = NONE
    code[first == full] = ALL
    code[(first == 0) & (later == full)] = LATER
    part = code == PARTLY
    return np.int64(len(full)).tobytes() + code.tobytes() + first[part].tobytes() + later[part].tobytes()


def _masks(replies: pa.Table, kind: int, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and later holders' masks, in the order in which a block sent."""
    t = replies.filter(pc.equal(replies.column("kind"), kind)).sort_by("_shard")
    first, later, low = np.zeros(len(full), np.uint64), np.zeros(len(full), np.uint64), 0
    for p in t.column("payload").to_pylist():
        n = int(np.frombuffer(p, np.int64, 1)[0])
        code, own = np.frombuffer(p, np.uint8, n, 8), slice(low, low + n)
        part = np.frombuffer(p, np.uint64, -1, 8 + n).reshape(2, -1) if len(p) > 8 + n else np.empty((2, 0), np.uint64)
        first[own] = np.where(code == ALL, full[own], np.uint64(0))
        later[own] = np.where((code == ALL) | (code == LATER), full[own], np.uint64(0))
        at = low + np.flatnonzero(code == PARTLY)
        first[at], later[at] = part
        low += n
    return first, later


def _send(search: Search, shards: int):
    """Round 3: contexts, claims of contexts that another block sends, and windows of hot anchors."""

    def send(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return _rows(["_shard", "_block", "kind", "payload"], [])
        block, b = key[0].as_py(), Block(docs, search)
        codes = _codes(replies, 0)
        s, values = Sent(b, np.frombuffer(codes, np.uint8), search, shards), b.tokens.values
        rows = [(block % shards, block, 9, codes)]  # comes back as it is
        occ = b.occurrence[s.pairs]
        begin, end = b.first[occ], b.last[occ] + search.length
        for shard, i, j in zip(range(shards), s.cut, s.cut[1:]):
            if j > i:
                own, at = s.pairs[i:j], begin[i:j]
                rows.append((shard, block, 1, _pack(values, at, gram=b.gram[own], ctx=b.ctx[own], rank=b.rank[occ[i:j]], count=b.count[own], offset=b.at[occ[i:j]] - at, n=end[i:j] - at)))
        for shard, i, j in zip(range(shards), s.claim_cut, s.claim_cut[1:]):
            if j > i:
                own = s.claims[i:j]
                rows.append((shard, block, 3, _six(b.gram[own]) + _six(b.ctx[own])))
        for shard, i, j in zip(range(shards), s.hot_cut, s.hot_cut[1:]):
            if j > i:
                h, none = s.unique[i:j], np.zeros(j - i)
                rows.append((shard, block, 2, _pack(values, s.unique_start[i:j], gram=h, ctx=h, rank=s.least_rank[i:j], count=s.repeats[i:j], offset=none, n=np.full(j - i, search.length))))
        return _rows(["_shard", "_block", "kind", "payload"], rows)

    return send


def _compare(search: Search, dtype, last: int):
    """Round 4: masks of found windows, for first and later holders of each context."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        shard = key[0].as_py()
        got = list(zip(*(table.column(c).to_pylist() for c in ("_block", "kind", "payload")), strict=True))
        rows = [(b, shard, 9, p) for b, kind, p in got if kind == 9]
        whole, claims = [x for x in got if x[1] in (1, 2)], [x for x in got if x[1] == 3]
        if not whole:
            return _rows(["_block", "_shard", "kind", "payload"], rows)
        head, sizes, values = _unpack([p for _, _, p in whole], dtype)
        blocks = np.repeat(np.array([b for b, _, _ in whole]), sizes)
        order = np.minimum(blocks, last) << 32 | head["rank"]
        weight = head["count"].astype(np.int64)
        if claims:
            counts = np.array([len(p) // 12 for _, _, p in claims])
            gram, ctx = _pairs([p for _, _, p in claims], counts)
            # Each claim finds the first context of its name: the numbers of both together.
            name = np.unique(np.stack([np.append(head["gram"], gram), np.append(head["ctx"], ctx)], 1), axis=0, return_inverse=True)[1].ravel()
            holder = np.zeros(name.max() + 1, np.int64)
            holder[name[: len(weight)][::-1]] = np.arange(len(weight))[::-1]
            of = holder[name[len(weight) :]]
            weight += np.bincount(of, minlength=len(weight))
        first, later = search.solve(head["gram"], order, head["offset"].astype(np.int64), head["n"].astype(np.int64), weight, values, search)
        ends, full = np.cumsum(sizes), _full(head["n"].astype(np.int64) - search.length + 1)
        rows += [(b, shard, kind, _pack_masks(first[e - n : e], later[e - n : e], full[e - n : e])) for (b, kind, _), e, n in zip(whole, ends, sizes)]
        if claims:
            ends = np.cumsum(counts)
            rows += [(b, shard, 3, _pack_masks(later[x], later[x], full[x])) for (b, _, _), x in zip(claims, (of[e - n : e] for e, n in zip(ends, counts)))]
        return _rows(["_block", "_shard", "kind", "payload"], rows)

    return compare


_RESULT = "doc_id long, n_tokens long, n_removed long, n_spans long, kept binary"


def _cover(search: Search, shards: int):
    """Round 5: what is covered, and the rest of each document."""

    def cover(key: tuple, docs: pa.Table, replies: pa.Table) -> pa.Table:
        b = Block(docs, search)
        s = Sent(b, np.frombuffer(_codes(replies, 9), np.uint8), search, shards)
        first, later = np.zeros(len(b.gram), np.uint64), np.zeros(len(b.gram), np.uint64)
        full = _full(b.last - b.first + 1)
        for kind, pairs in ((1, s.pairs), (3, s.claims)):
            first[pairs], later[pairs] = _masks(replies, kind, full[b.occurrence[pairs]])
        if len(s.unique):
            own, others = (x[s.of] for x in _masks(replies, 2, np.ones(len(s.unique), np.uint64)))
            bit = s.hot_index.astype(np.uint64)
            here = np.where(s.hot_rank > s.least_rank[s.of], others, own)
            np.bitwise_or.at(first, s.hot_pair, here << bit)
            np.bitwise_or.at(later, s.hot_pair, others << bit)
        after = b.rank > b.rank[b.occurrence][b.pair]
        mask = np.where(after, later[b.pair], first[b.pair]) if search.earlier else later[b.pair]
        whole = mask == full
        partly = np.flatnonzero(~whole & (mask > 0))
        bits = (mask[partly][:, None] >> np.arange(search.length, dtype=np.uint64)) & np.uint64(1) > 0
        at = (b.first[partly][:, None] + np.arange(search.length))[bits]
        begin, end = np.concatenate([b.first[whole], at]), np.concatenate([b.last[whole], at]) + search.length

        n, bounds = len(b.tokens.values), b.tokens.bounds
        step = np.bincount(begin, minlength=n + 1) - np.bincount(end, minlength=n + 1)
        covered = np.cumsum(step)[:n] > 0
        starts = covered.copy()
        starts[1:] &= ~covered[:-1]
        inner = bounds[:-1][bounds[:-1] < n]
        starts[inner] = covered[inner]
        removed = np.concatenate([[0], np.cumsum(covered)])
        spans = np.concatenate([[0], np.cumsum(starts)])
        return pa.table(
            {
                "doc_id": pa.array(b.ids, pa.int64()),
                "n_tokens": np.diff(bounds).astype(np.int64),
                "n_removed": np.diff(removed[bounds]).astype(np.int64),
                "n_spans": np.diff(spans[bounds]).astype(np.int64),
                "kept": pa.array([b.tokens.keep(i, ~covered[bounds[i] : bounds[i + 1]]) for i in range(len(b.ids))], pa.binary()),
            }
        )

    return cover


def remove_repeats(docs: DataFrame, search: Search, dtype, block_bytes: int | None = None) -> DataFrame:
    """doc_id, n_tokens, n_removed, n_spans, kept (binary) for each row of ``docs``."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    docs, last, n = id_blocks(docs, block_bytes or (lambda total: max(BLOCK_BYTES, math.isqrt(total * MESSAGE))))
    by_block = lambda df: df.groupBy("_block")
    asked = by_block(docs).applyInArrow(_ask(search, n), _MESSAGE)
    answered = asked.groupBy("_shard").applyInArrow(_answer(search, last), _REPLY)
    sent = by_block(docs).cogroup(by_block(answered)).applyInArrow(_send(search, n), _MESSAGE)
    compared = sent.groupBy("_shard").applyInArrow(_compare(search, dtype, last), _REPLY)
    return by_block(docs).cogroup(by_block(compared)).applyInArrow(_cover(search, n), _RESULT)
