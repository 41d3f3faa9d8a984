"""Near-duplicate documents by min-max hashing.

Each of PERMUTATIONS hash functions gives two values of a document's signature, its
minimum and its maximum over the document's shingles, so the hashes are evaluated half as
often as for minima alone.  BANDS bands of ROWS values bring documents of similarity s into
a common bucket with probability 1 - (1 - s**ROWS)**BANDS: over 0.9999 at 0.8.

Documents with equal shingle sets are one class.  A class is first confirmed against the
least class of a bucket, not against all of them.  In buckets that then still hold several
components, the members outside the largest one meet all others: they and the largest are
dealt into blocks of PIECE_BYTES of shingles, and every block of strays meets every block,
by counting shared shingles within a task.  Members of the largest component are sent once
for each block of strays, mostly one, so rows grow with a bucket's members; a task gives
back no pairs but links that join components, fewer than it has members.  So no pairs of a
group are written, and yet no bucket is cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, lean, texts_by_bytes
from ._components import components
from ._minimizers import mix64
from .substring_dedup import split_words

PERMUTATIONS, ROWS, BANDS = 64, 5, 25
_ODD = np.uint64(0x9E3779B97F4A7C15)
_EDGE = np.uint64(0xC2B2AE3D27D4EB4F)  # an odd constant that seals short texts
_rng = np.random.default_rng(20240229)
_A = (_rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_B = _rng.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint64).astype(np.uint32)[:, None]
PIECE_BYTES = 8 << 20  # of shingle sets in a block of a bucket
BATCH_BYTES = 4 << 20  # of texts that are made into sets together
FILTER = 1 << 20  # 64-bit words of the bitmap that is broadcast: full, it lets all texts by
TILE = 512  # sets whose shared shingles are counted at a time
_COLUMNS = 8192  # shingles that are counted at a time


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The distinct hashed shingles of each lower-cased text, sorted.

    With fewer than ``width`` words the whole sequence is one shingle; without words the
    set is empty.
    """
    tokens = split_words([t.lower() for t in texts])
    out = []
    for low, high in zip(tokens.bounds, tokens.bounds[1:]):
        w = tokens.values[low:high]
        if not len(w):
            out.append(w)
            continue
        n = min(width, len(w))
        h = w[: len(w) - n + 1].copy()
        for j in range(1, n):
            h = h * _ODD + w[j : len(w) - n + 1 + j]
        out.append(np.unique(mix64(h if n == width else h + _EDGE * np.uint64(n))))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum under each permutation; a long set goes piece by piece."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low, high = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32), np.zeros(PERMUTATIONS, np.uint32)
    for i in range(0, len(x), 4096):
        y = x[i : i + 4096] * _A + _B
        low, high = np.minimum(low, y.min(1)), np.maximum(high, y.max(1))
    return np.concatenate([low, high])


def bands(signature: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band, its number included."""
    rows = signature[: ROWS * BANDS].reshape(BANDS, ROWS).astype(np.uint64)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for j in range(ROWS):
        key = mix64(key * _ODD + rows[:, j])
    return key


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a, b = (np.bitwise_xor.reduce(mix64(s * c)) + np.add.reduce(mix64(s ^ c)) for c in (_ODD, _EDGE))
    return int(a.view(np.int64)), int(b.view(np.int64))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        yield from texts_by_bytes(batch, BATCH_BYTES)


def _digests(sets: list[np.ndarray]) -> list[pa.Array]:
    found = [_digest(s) if len(s) else (0, 0) for s in sets]
    return [pa.array([d[i] for d in found], pa.int64()) for i in (0, 1)]


def _sign(width: int):
    @lean
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            sets = shingle_sets(texts, width)
            keys = [bands(signature(s)).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
            values = np.concatenate(keys) if keys else np.empty(0, np.int64)
            yield pa.record_batch(
                [part.column("doc_id"), part.column("tag"), pa.array([len(s) for s in sets], pa.int64()), *_digests(sets), pa.ListArray.from_arrays(offsets, values)],
                names=["doc_id", "tag", "n_shingles", "d1", "d2", "keys"],
            )

    return sign


def _set_rows(width: int):
    @lean
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _texts(batches):
            found = shingle_sets(texts, width)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32)
            yield pa.record_batch([part.column("doc_id"), *_digests(found), pa.ListArray.from_arrays(offsets, np.concatenate(found).view(np.int64))], names=["id", "d1", "d2", "set"])

    return sets


def _shared(some: list[np.ndarray], others: list[np.ndarray]) -> np.ndarray:
    """How many shingles each of the sets shares with each of the others."""
    sets = some + others
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    many = times[column] > 1
    row, column = row[many], (np.cumsum(times > 1) - 1)[column[many]]
    out = np.zeros((len(some), len(others)), np.float32)
    by = np.argsort(column, kind="stable")
    row, column = row[by], column[by]
    for low in range(0, int(column[-1]) + 1 if len(column) else 0, _COLUMNS):
        i, j = np.searchsorted(column, [low, low + _COLUMNS])
        held = np.zeros((len(sets), _COLUMNS), np.float32)
        held[row[i:j], column[i:j] - low] = 1
        out += held[: len(some)] @ held[len(some) :].T
    return out.astype(np.int64)


def _tiles(indices: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Runs of indices: TILE of them, and no more shingles than TILE times _COLUMNS unless one set has more."""
    out, low, held = [], 0, 0
    for at, i in enumerate(indices.tolist()):
        if at > low and (at - low >= TILE or held + sizes[i] > TILE * _COLUMNS):
            out.append(indices[low:at])
            low, held = at, 0
        held += int(sizes[i])
    return out + [indices[low:]] if low < len(indices) else out


def _joining(rep: list[int], component: list[int], main: list[bool], sets: list[np.ndarray], percent: int) -> list[tuple]:
    """Links that join the components of one piece of a bucket: strays with the members of
    its main component if there are such, else strays with strays."""
    number = {c: i for i, c in enumerate(dict.fromkeys(component))}
    names = np.array([number[c] for c in component])
    main, n = np.array(main), np.array([len(s) for s in sets])
    across = main.any()
    tiles = _tiles(np.flatnonzero(~main), n)
    out = []
    for i, x in enumerate(tiles):
        for y in _tiles(np.flatnonzero(main), n) if across else tiles[i:]:
            apart = names[x][:, None] != names[y][None, :]
            if not apart.any():
                continue
            both = _shared([sets[k] for k in x], [sets[k] for k in y])
            linked = (100 * both >= percent * (n[x][:, None] + n[y][None, :] - both)) & apart
            for a, b in zip(*np.nonzero(linked)):
                left, right = names[x[a]], names[y[b]]
                if left != right:  # what joined before needs no link again
                    names[names == right] = left
                    out.append((rep[x[a]], rep[y[b]]))
    return out


def _join_components(percent: int, at_once: int = 1000):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    @lean
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, held = None, ([], [], [], [])
        found: list[tuple] = []

        def links() -> pa.RecordBatch:
            out = pa.record_batch([pa.array([x[i] for x in found], pa.int64()) for i in range(len(schema))], schema=schema)
            found.clear()
            return out

        for batch in batches:
            pieces = list(zip(*(batch.column(c).to_pylist() for c in _PIECE), strict=True))
            columns = [batch.column(c).to_pylist() for c in ("rep", "component", "main")]
            sets = batch.column("set")
            for i, own in enumerate(pieces):
                if own != piece:
                    if len(held[0]) > 1:
                        found += _joining(*held, percent)
                    piece, held = own, ([], [], [], [])
                for to, x in zip(held, (*(c[i] for c in columns), sets[i].values.to_numpy().view(np.uint64).copy()), strict=True):
                    to.append(x)
            if len(found) >= at_once:
                yield links()
        if len(held[0]) > 1:
            found += _joining(*held, percent)
        yield links()

    return join


_PIECE = ("key", "kind", "left", "right")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, tag: str | None = None) -> DataFrame:
    """Link documents with 100 * |A and B| >= percent * |A or B| over their shingle sets.

    Returns doc_id, n_shingles, component_id (smallest doc_id reachable) and kept
    (doc_id = component_id), a row for each row of ``docs``.  Null and empty texts, and
    rows with a null id, link with nothing; a row with a null id has no component and is
    kept.  Rows that share an id are told apart by their texts; ``tag``, a string column
    that is returned too, lets the caller do so.  ``percent`` under 70 would need other bands.
    Very long texts are one set each, in as many tiles as it takes; other columns are not
    read, whatever they are called.
    """
    scratch = Scratch(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), (F.col(tag) if tag else F.lit(None)).cast("string").alias("tag"))
    signed = scratch.keep(texts.mapInArrow(_sign(width), "doc_id long, tag string, n_shingles long, d1 long, d2 long, keys array<long>"), BATCH_BYTES)
    real = signed.where("doc_id IS NOT NULL AND n_shingles > 0")
    classes = scratch.keep(real.groupBy("d1", "d2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.min("keys").alias("keys")))
    # A class is called by its least doc_id, or by 63 bits of its digest if others have that too.
    twice = scratch.keep(classes.groupBy("id").agg(F.count("*").alias("twice")).where("twice > 1"))
    name = F.when(F.col("twice").isNull(), F.col("id")).otherwise(-1 - F.col("d1").bitwiseAND(F.lit((1 << 63) - 1)))
    classes = scratch.keep(classes.join(twice, "id", "left").withColumn("rep", name).drop("twice"))

    rows = classes.select("rep", "n", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("m"), F.min("rep").alias("pivot")).where("m > 1").drop("m")
    members = scratch.keep(rows.join(shared, "key"))
    wanted = scratch.keep(classes.select("id", "d1", "d2", "rep").join(members.select("rep").distinct(), "rep", "left_semi"))
    # The texts of the ids, through a bitmap of FILTER words at most, which spares them a
    # shuffle, and of these the sets of the classes.  What the bitmap lets by, the join drops.
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * FILTER))
    words = wanted.select(slot("id").alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS INT)))").alias("bits"))
    found = texts.withColumn("slot", slot("doc_id")).join(F.broadcast(words), F.shiftright("slot", 6) == F.col("word")).where("shiftright(bits, CAST(slot % 64 AS INT)) & 1L = 1L")
    sets = found.select("doc_id", "text").mapInArrow(_set_rows(width), "id long, d1 long, d2 long, set array<long>")
    sets = scratch.keep(sets.dropDuplicates(["id", "d1", "d2"]).join(wanted, ["id", "d1", "d2"]).select(F.col("rep").alias("doc_id"), "set"), BATCH_BYTES)

    fits = lambda x, y: (100 * F.col(x) >= percent * F.col(y)) & (100 * F.col(y) >= percent * F.col(x))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose full sets are similar enough."""
        left, right = sets.select(F.col("doc_id").alias("a"), F.col("set").alias("s")), sets.select(F.col("doc_id").alias("b"), F.col("set").alias("t"))
        both = F.size(F.array_intersect("s", "t"))
        return pairs.join(left, "a").join(right, "b").where(100 * both >= percent * (F.size("s") + F.size("t") - both)).select("a", "b").distinct()

    sizes = classes.select(F.col("rep").alias("pivot"), F.col("n").alias("n_pivot"))
    first = members.where("rep <> pivot").select("rep", "n", "pivot").distinct().join(sizes, "pivot").where(fits("n", "n_pivot"))
    links = scratch.keep(confirmed(first.groupBy(F.col("rep").alias("a")).agg(F.min("pivot").alias("b"))))
    labels = components(links, scratch)

    named = members.select("key", "rep", "n").join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    per = named.groupBy("key", "component").agg(F.sum(8 * F.col("n")).alias("bytes"), F.count("*").alias("m"))
    blocks = lambda size: F.greatest(F.lit(1), F.ceil(size / PIECE_BYTES)).cast("int")
    mixed = per.groupBy("key").agg(F.count("*").alias("n"), F.max(F.struct("m", "bytes", "component")).alias("main"), F.sum("bytes").alias("bytes")).where("n > 1")
    mixed = mixed.select("key", F.col("main.component").alias("in_main"), blocks(F.col("main.bytes")).alias("mains"), blocks(F.col("bytes") - F.col("main.bytes")).alias("strays"))
    entries = named.drop("n").join(mixed, "key").withColumn("main", F.col("component") == F.col("in_main"))
    entries = entries.withColumn("side", F.pmod(F.xxhash64("rep"), F.when(F.col("main"), F.col("mains")).otherwise(F.col("strays"))).cast("int"))
    side, upto = F.col("side"), lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    piece = lambda kind, left, right: F.struct(F.lit(kind).alias("kind"), left.alias("left"), right.alias("right"))
    of_main = F.transform(upto("strays"), lambda i: piece(0, side, i))
    of_stray = F.concat(F.transform(upto("mains"), lambda i: piece(0, i, side)), F.transform(upto("strays"), lambda i: piece(1, F.least(i, side), F.greatest(i, side))))
    entries = entries.withColumn("piece", F.explode(F.when(F.col("main"), of_main).otherwise(of_stray)))
    entries = entries.select("key", "rep", "component", "main", "piece.*")
    pieces = entries.join(sets.withColumnRenamed("doc_id", "rep"), "rep").repartition(*_PIECE).sortWithinPartitions(*_PIECE)
    joined = pieces.mapInArrow(_join_components(percent), "a long, b long")
    links = scratch.keep(links.union(joined).distinct())
    labels = components(links, scratch)

    scratch.drop_all_but(signed, classes, labels)
    of_class = classes.select("d1", "d2", "id", "rep").join(labels, F.col("rep") == F.col("node"), "left")
    # Components are called by their least doc_id.
    least = of_class.where("component IS NOT NULL").groupBy("component").agg(F.min("id").alias("found"))
    of_class = of_class.join(least, "component", "left").select("d1", "d2", F.coalesce("found", "id").alias("found"))
    component = F.when(F.col("n_shingles") > 0, F.coalesce("found", "doc_id")).otherwise(F.col("doc_id"))
    named = signed.select("doc_id", "tag", "n_shingles", "d1", "d2").join(of_class, ["d1", "d2"], "left")
    named = named.select("doc_id", *["tag"] * bool(tag), "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return named.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
