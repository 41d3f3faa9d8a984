"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector o is rotated at random and coded by the signs of its coordinates, x.  With
the stored factor f = <x, o> the estimate <x, q> / f of <o, q> is unbiased, with a standard
error of sqrt((1 - f*f) / (f*f * (D - 1))) for a rotation of D coordinates; ESTIMATORS
rotations are averaged.  A pair is recomputed exactly, in double precision, if the upper
confidence bound of its estimate reaches the threshold; all others are rejected.

The same bits, from more rotations, bring candidates together: bands of r bits, r growing
with the logarithm of the largest label's rows so that buckets stay small, and as many bands
as find a pair at the threshold with probability RECALL at any r.

Buckets are looked through twice.  First codes alone meet, a few words a vector: the bits in
which two differ bound their angle, and who has no partner within SIGMAS standard errors of
the threshold's angle leaves the bucket.  Vectors, factors and keys follow only for those
who stay; there a pair counts in the first band that it shares, so that it is weighed once.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from ._common import Scratch
from ._components import components, least_labels
from ._minimizers import mix64

RECALL = 0.999
ESTIMATORS = 4
SIGMAS = 5.0
BLOCK = 512  # members of a bucket that are compared in one piece
FULL = 6  # binary logarithm of a bucket's mean size in the largest label


@lru_cache(4)
def _rotations(dim: int, n: int) -> np.ndarray:
    """``n`` random rotations side by side: (dim, n * dim)."""
    rng = np.random.default_rng(dim)
    return np.concatenate([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)], axis=1)


def layout(rows: int, threshold: float) -> tuple[int, int]:
    """Bits in a band, and bands, for so many vectors of one label."""
    bits = min(60, max(4, math.ceil(math.log2(max(rows, 2))) - FULL))
    hit = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - hit))


def _unit(rows: list) -> np.ndarray:
    v = np.array(rows, np.float64)
    v = v / np.abs(v).max(1, keepdims=True)  # else squares of tiny or huge components vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _packed(signs: np.ndarray) -> np.ndarray:
    """Rows of bits, in whole 64-bit words."""
    bits = np.packbits(signs, axis=1)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8)))


def _code(bits: int, bands: int):
    weights = (np.uint64(1) << np.arange(bits, dtype=np.uint64))[None, None, :]

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                for low in range(0, len(at), 2000):
                    rows = at[low : low + 2000]
                    turned = _unit([vectors[i] for i in rows]) @ _rotations(dim, max(ESTIMATORS, -(-bits * bands // dim)))
                    signs = turned > 0
                    keys = (signs[:, : bits * bands].reshape(len(rows), bands, bits) * weights).sum(2, dtype=np.uint64)
                    labels = np.array([xxhash.xxh64_intdigest(x) for x in batch.column("label").take(pa.array(rows)).to_pylist()], np.uint64)
                    keys = mix64(mix64(keys + labels[:, None]) ^ mix64(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(dim)))
                    factor = np.abs(turned[:, : ESTIMATORS * dim]).reshape(len(rows), ESTIMATORS, dim).sum(2) / math.sqrt(dim)
                    part = batch.take(pa.array(rows))
                    offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * bands)
                    yield pa.record_batch(
                        [
                            part.column("rep"), part.column("which"), pa.array(labels.view(np.int64)), part.column("weight"), part.column("embedding"),
                            pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel())),
                            pa.array([r.tobytes() for r in _packed(signs[:, : ESTIMATORS * dim])], pa.binary()),
                            pa.array([r.tobytes() for r in factor.astype(np.float32)], pa.binary()),
                            pa.array([dim] * len(rows), pa.int32()),
                        ],
                        names=["rep", "which", "label", "weight", "embedding", "keys", "code", "factor", "dim"],
                    )

    return code


_PIECE = ("key", "left", "right")
_FOUND = "a long, a_which long, b long, b_which long, n long"
_STAY = "rep long, which long, key long, side int, left int, right int"


def _pieces(group: dict) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each piece of a bucket that meet each other: both halves of two blocks,
    or one block twice."""
    piece = np.array([group[c] for c in _PIECE])
    cut = np.flatnonzero((piece[:, 1:] != piece[:, :-1]).any(0)) + 1
    for i, j in zip([0, *cut], [*cut, piece.shape[1]]):
        rows = np.arange(i, j)
        if group["left"][i] == group["right"][i]:
            yield rows, rows
        else:
            left = np.array(group["side"][i:j]) == group["left"][i]
            yield rows[left], rows[~left]


def _by_piece(found: Callable[[dict], list], names: tuple[str, ...], schema: pa.Schema, at_once: int = 4000):
    """``found`` over whole pieces, of rows that are sorted by piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}

        def done(upto: int) -> pa.RecordBatch:
            out = found({c: held[c][:upto] for c in names})
            for c in names:
                held[c] = held[c][upto:]
            return pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema)], schema=schema)

        for batch in batches:
            for low in range(0, batch.num_rows, at_once):
                part = batch.slice(low, at_once)
                for c in names:
                    held[c] += part.column(c).to_pylist()
                last = tuple(held[c][-1] for c in _PIECE)
                upto = len(held["rep"])
                while upto and tuple(held[c][upto - 1] for c in _PIECE) == last:
                    upto -= 1
                if upto:
                    yield done(upto)
        if held["rep"]:
            yield done(len(held["rep"]))

    return run


def _staying(threshold: float):
    """Members whose code differs in few enough bits from that of another one."""
    names = ("rep", "which", "code", "dim", *_PIECE, "side")
    share = math.acos(threshold) / math.pi

    def stay(group: dict) -> list:
        stays = np.zeros(len(group["rep"]), bool)
        dims = np.array(group["dim"])
        for x, y in _pieces(group):
            for dim in set(dims[x].tolist()):
                a, b = x[dims[x] == dim], y[dims[y] == dim]
                n = ESTIMATORS * dim
                most = n * share + SIGMAS * math.sqrt(n * share * (1 - share)) + 1
                words = [np.frombuffer(b"".join(group["code"][i] for i in rows), np.uint64).reshape(len(rows), -1) for rows in (a, b)]
                differ = sum((np.bitwise_count(u[:, None] ^ v[None, :]).astype(np.int32) for u, v in zip(words[0].T, words[1].T)), np.zeros((len(a), len(b)), np.int32))
                near = differ <= most
                if x is y:
                    near &= a[:, None] != b[None, :]
                stays[a[near.any(1)]] = stays[b[near.any(0)]] = True
        rows = np.flatnonzero(stays).tolist()
        return [[group[c.split()[0]][i] for i in rows] for c in _STAY.split(", ")]

    kinds = {"long": pa.int64(), "int": pa.int32()}
    return _by_piece(stay, names, pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in _STAY.split(", ")]))


def _weigh(group: dict, threshold: float) -> tuple[list, ...]:
    """Links among the rows of whole pieces, which rep and which name: (a, a_which, b,
    b_which, None) to join, (a, a_which, None, None, n) to count."""
    n = len(group["rep"])
    rep, weight, key = np.array([group["rep"], group["which"]]).T, np.array(group["weight"]), np.array(group["key"])
    label, keys = np.array(group["label"]), np.array(group["keys"], np.int64)
    dims = np.array([len(v) for v in group["embedding"]])
    band = (keys == key[:, None]).argmax(1)
    at, unit, turned, code, error = np.zeros(n, np.int64), {}, {}, {}, np.zeros(n)
    for d in set(dims.tolist()):
        rows = np.flatnonzero(dims == d)
        at[rows] = np.arange(len(rows))
        unit[d] = _unit([group["embedding"][i] for i in rows])
        turned[d] = (unit[d] @ _rotations(d, ESTIMATORS)).astype(np.float32)
        f = np.array([np.frombuffer(group["factor"][i], np.float32) for i in rows])
        bits = np.unpackbits(np.array([np.frombuffer(group["code"][i], np.uint8) for i in rows]), axis=1)[:, : ESTIMATORS * d]
        signs = (bits.astype(np.float32) * 2 - 1).reshape(len(rows), ESTIMATORS, d)
        code[d] = (signs / (f[:, :, None] * np.float32(math.sqrt(d) * ESTIMATORS))).reshape(len(rows), -1)
        error[rows] = np.sqrt(((1 - f * f) / (f * f * max(1, d - 1))).mean(1) / ESTIMATORS)
    links: list[tuple[np.ndarray, np.ndarray]] = []
    for x, y in _pieces(group):
        for d in set(dims[x].tolist()):
            a, b = x[dims[x] == d], y[dims[y] == d]
            estimate = code[d][at[a]] @ turned[d][at[b]].T
            maybe = estimate + SIGMAS * error[a][:, None] + 1e-5 >= threshold
            if x is y:
                maybe &= a[:, None] < b[None, :]
            i, j = (rows[z] for rows, z in zip((a, b), np.nonzero(maybe)))
            # A pair counts in the first band that it shares.
            own = ((keys[i] == keys[j]).argmax(1) == band[i]) & (label[i] == label[j])
            i, j = i[own], j[own]
            exact = np.einsum("ij,ij->i", unit[d][at[i]], unit[d][at[j]]) >= threshold
            links.append((i[exact], j[exact]))
    if not sum(len(x) for x, _ in links):
        return [], [], [], [], []
    x, y = (np.concatenate(z) for z in zip(*links, strict=True))
    count = np.bincount(x, weight[y], n) + np.bincount(y, weight[x], n)
    some = np.flatnonzero(count)
    ids, place = np.unique(rep, axis=0, return_inverse=True)
    place = place.ravel()
    least = least_labels(place[x], place[y])
    joined = np.flatnonzero(least != np.arange(len(least)))
    a, b = np.concatenate([ids[joined], rep[some]]), ids[least[joined]]
    none = [None] * len(some)
    return a[:, 0].tolist(), a[:, 1].tolist(), b[:, 0].tolist() + none, b[:, 1].tolist() + none, [None] * len(joined) + count[some].astype(int).tolist()


def _compare(threshold: float):
    names = ("rep", "which", "label", "weight", "embedding", "keys", "code", "factor", *_PIECE, "side")
    return _by_piece(lambda group: _weigh(group, threshold), names, pa.schema([(c.split()[0], pa.int64()) for c in _FOUND.split(", ")]))


def near_vectors(vectors: DataFrame, threshold: float = 0.93) -> DataFrame:
    """Link vectors of one label whose cosine is at least ``threshold``.

    Returns vec_id, n_links (other vectors linked directly), component_id (smallest vec_id
    reachable) and kept (vec_id = component_id), a row for each row of ``vectors``
    (vec_id, embedding, label); rows that share an id are told apart by vector and label.
    Vectors with a null label, null or zero vectors, those with null or non-finite
    components, and rows with a null id link with nothing; so do vectors of different
    lengths.  Other columns are not read, whatever they are called.  Equal vectors are one class that counts with its size.
    A null id has no component and is kept.  No link is below the threshold; links at it
    are found with probability RECALL at least.
    """
    scratch = Scratch(vectors.sparkSession)
    # Floats stay floats on their way, half as long as doubles; all sums are of doubles.
    kind = "array<float>" if vectors.schema["embedding"].dataType == ArrayType(FloatType()) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), F.col("label").cast("string").alias("label"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    plain = F.transform("embedding", lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x)).cast(kind)  # -0.0 is 0.0
    rows = rows.withColumn("embedding", F.when(usable, plain)).withColumns({"which": F.xxhash64("label", "embedding"), "other": F.xxhash64("embedding", "label")})
    # Two hashes name a class: 128 bits of its label and vector.
    classes = rows.where("embedding IS NOT NULL").groupBy("which", "other").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    classes = scratch.keep(classes)
    largest = classes.groupBy("label").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    bits, bands = layout(largest, threshold)
    coded = scratch.keep(classes.mapInArrow(_code(bits, bands), f"rep long, which long, label long, weight long, embedding {kind}, keys array<long>, code binary, factor binary, dim int"))

    entries = coded.select("rep", "which", "code", "dim", F.explode("keys").alias("key"))
    shared = coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    entries = entries.join(shared, "key").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    entries = entries.withColumn("side", F.pmod(F.xxhash64("rep", "which"), F.col("blocks")).cast("int"))
    entries = entries.withColumn("facing", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"left": F.least("side", "facing"), "right": F.greatest("side", "facing")})
    dealt = lambda df: df.repartition(*_PIECE).sortWithinPartitions(*_PIECE)
    stay = dealt(entries.select("rep", "which", "code", "dim", "key", "side", "left", "right")).mapInArrow(_staying(threshold), _STAY)
    found = scratch.keep(dealt(scratch.keep(stay).join(coded.drop("dim"), ["rep", "which"])).mapInArrow(_compare(threshold), _FOUND))

    counts = found.where("n IS NOT NULL").groupBy(F.col("a").alias("rep"), F.col("a_which").alias("which")).agg(F.sum("n").alias("linked"))
    name = lambda id, which: F.struct(F.col(id).alias("rep"), F.col(which).alias("which"))
    labels = components(found.where("b IS NOT NULL").select(name("a", "a_which").alias("a"), name("b", "b_which").alias("b")), scratch)
    scratch.drop_all_but(classes, found, labels)
    of_class = classes.drop("label", "embedding").join(counts, ["rep", "which"], "left").join(labels.select("node.*", "component"), ["rep", "which"], "left")
    of_class = of_class.select("which", "other", "weight", "linked", F.coalesce(F.col("component.rep"), "rep").alias("found"))
    named = rows.select("vec_id", *(F.when(F.col("embedding").isNotNull(), F.col(c)).alias(c) for c in ("which", "other"))).join(of_class, ["which", "other"], "left")
    named = named.select(
        "vec_id",
        (F.coalesce(F.col("weight") - 1, F.lit(0)) + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("found", "vec_id").alias("component_id"),
    )
    return named.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
