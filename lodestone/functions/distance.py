"""Euclidean distance between vectors: as columns, and as a function for SQL text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

UNROLLED = 128  # dimensions up to which a distance to a constant is one generated expression


def squared_l2(a: Column, b: Column) -> Column:
    """Squared distance of two array columns in double; null if lengths or elements don't fit."""
    gaps = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: (x - y) * (x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x)


def squared_l2_to(column: Column, query: Sequence[float]) -> Column:
    """Squared distance to a constant; null where the length differs or an element is null.

    Short vectors are unrolled, so that the sum stays inside whole-stage code generation;
    long ones go to an Arrow function, whose sums over whole batches outrun an interpreted
    one element by element.
    """
    q = [float(x) for x in query]
    if len(q) <= UNROLLED:
        terms = [(F.get(column, F.lit(i)).cast("double") - F.lit(x)) for i, x in enumerate(q)]
        total = reduce(lambda s, t: s + t, [t * t for t in terms])
    else:
        total = F.arrow_udf(_squared_to(np.array(q)), "double")(column.cast("array<double>"))
    return F.when(F.size(column) == len(q), total)


def _squared_to(query: np.ndarray):
    """Arrow batches of vectors to their squared distances from ``query``."""

    def squared(a: pa.Array) -> pa.Array:
        lengths, ok, flat = _rows(a)
        good = ok & (lengths == len(query))
        out = np.full(len(a), np.nan)
        rows = flat[np.repeat(good, np.maximum(lengths, 0))].reshape(-1, len(query))
        out[good] = ((rows - query) ** 2).sum(1)
        return pa.array(out, mask=~good)

    return squared


def l2_distance(a: Column, b: Column | Sequence[float]) -> Column:
    return F.sqrt(squared_l2(a, b) if isinstance(b, Column) else squared_l2_to(a, b))


def _rows(a: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lengths, validity and flat values of a list array; a null element makes a row null."""
    lengths = pc.fill_null(pc.list_value_length(a), -1).to_numpy(zero_copy_only=False)
    flat = pc.list_flatten(a)
    ok = lengths >= 0
    if flat.null_count:
        owner = np.repeat(np.arange(len(a)), np.maximum(lengths, 0))
        ok[owner[pc.is_null(flat).to_numpy(zero_copy_only=False)]] = False
    return lengths, ok, pc.fill_null(flat, 0).to_numpy(zero_copy_only=False).astype(np.float64)


def _array_distance(a: pa.Array, b: pa.Array) -> pa.Array:
    (n, ok_a, x), (m, ok_b, y) = _rows(a), _rows(b)
    out = np.full(len(a), np.nan)
    good = ok_a & ok_b & (n == m)
    x = x[np.repeat(good, np.maximum(n, 0))]
    y = y[np.repeat(good, np.maximum(m, 0))]
    sizes = n[good]
    sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), (x - y) ** 2, len(sizes))
    out[good] = np.sqrt(sums)
    return pa.array(out, mask=~good)


def array_distance():
    """The SQL function: usable in ORDER BY, null for vectors that don't fit each other."""
    return F.arrow_udf(_array_distance, "double")


def register(spark: SparkSession) -> None:
    """Make ``array_distance(a, b)`` known to SQL text of this session."""
    spark.udf.register("array_distance", array_distance())
