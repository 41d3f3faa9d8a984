"""Many searches at once, exact or over probed clusters, and how many probes a recall needs."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS, QUERIES = 16_384, 1_024  # rows and queries that meet in one group, about
SAMPLE = 200  # searches that the number of probes is measured on
BLOCK_BYTES = 1 << 23  # of vectors in double precision that a block of rows has, about; longer vectors make smaller blocks
_CELLS = 1 << 19  # distances held at a time


def _matrix(column: pa.ChunkedArray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The vectors of ``dim`` finite components, and their places."""
    flat = column.combine_chunks()
    lengths = flat.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(lengths == dim)
    fit = flat if len(at) == len(flat) else flat.take(pa.array(at))
    v = fit.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    good = np.isfinite(v).all(1)
    return (v, at) if good.all() else (v[good], at[good])


def _meet(k: int, dim: int):
    names = ["query_id", "key", "cluster_id", "d2"]
    schema = pa.schema(zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.float64()), strict=True))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        q, qi = _matrix(left.column("asked"), dim)
        v, vi = _matrix(right.column("vector"), dim)
        if not len(q) or not len(v):
            return schema.empty_table()
        ids, keys = left.column("query_id").to_numpy()[qi], right.column("key").to_numpy()[vi]
        clusters = right.column("cluster_id").to_numpy()[vi]
        norms, out = np.einsum("ij,ij->i", v, v), [[] for _ in names]
        step = max(1, _CELLS // len(v))
        for low in range(0, len(q), step):
            some = q[low : low + step]
            own = (some**2).sum(1)
            near = some @ v.T
            near *= -2
            near += norms
            near += own[:, None]
            last = np.partition(near, min(k, len(v)) - 1, axis=1)[:, min(k, len(v)) - 1]
            # The product rounds: what may be among the k is computed anew from differences.
            last += 1e-9 * (own + norms.max())
            for j in range(len(some)):
                maybe = np.flatnonzero(near[j] <= last[j])
                d2 = ((v[maybe] - some[j]) ** 2).sum(1)
                first = np.lexsort((keys[maybe], d2))[:k]
                best = maybe[first]
                for to, x in zip(out, (np.full(len(best), ids[low + j]), keys[best], clusters[best], d2[first]), strict=True):
                    to.append(x)
        return pa.table([pa.array(np.concatenate(x), f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return meet


def nearest_of_parts(queries: DataFrame, rows: DataFrame, k: int, dim: int) -> DataFrame:
    """The ``k`` nearest rows of each query over the parts that it is in: query_id, key,
    cluster_id, distance, place from 1; ties by key.

    ``queries`` (query_id, part, vector), a row for each part; query ids are distinct.
    ``rows`` (key, part, cluster_id, vector).  Vectors that don't fit are left out.  A part
    is dealt out in blocks of about ROWS rows, BLOCK_BYTES at most, and QUERIES queries, each
    pair of blocks a group, so that no part's size bounds what a task holds.
    """
    block = max(1, min(ROWS, BLOCK_BYTES // (8 * dim)))
    sizes = rows.groupBy("part").agg(F.ceil(F.count("*") / block).cast("int").alias("row_blocks")).join(
        queries.groupBy("part").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("query_blocks")), "part")
    side = lambda n, *c: F.pmod(F.xxhash64(*c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # New names, as both may come from one table.
    left = queries.join(sizes, "part").select(F.col("query_id").alias("query_id"), F.col("part").alias("qp"), F.col("vector").alias("asked"), side("query_blocks", "query_id").alias("qb"), every("row_blocks").alias("rb"))
    right = rows.join(sizes, "part").select(F.col("key").alias("key"), F.col("cluster_id").alias("cluster_id"), F.col("part").alias("rp"), F.col("vector").alias("vector"), side("row_blocks", "key", "vector").alias("rb"), every("query_blocks").alias("qb"))
    found = left.groupBy("qp", "qb", "rb").cogroup(right.groupBy("rp", "qb", "rb")).applyInArrow(_meet(k, dim), "query_id long, key long, cluster_id int, d2 double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("d2", "key"))
    return found.withColumn("place", place).where(F.col("place") <= k).withColumn("distance", F.sqrt("d2")).drop("d2")


def exact_search_all(queries: DataFrame, rows: DataFrame, k: int, dim: int) -> DataFrame:
    """As nearest_of_parts, over all rows: ``queries`` (query_id, vector), ``rows`` (key, cluster_id, vector)."""
    return nearest_of_parts(queries.withColumn("part", F.lit(0)), rows.withColumn("part", F.lit(0)), k, dim)


def _with_order(queries: DataFrame, centroids: np.ndarray, nprobe: int) -> DataFrame:
    """``queries`` with probes: their ``nprobe`` nearest clusters in order; null if the vector doesn't fit."""
    shared = queries.sparkSession.sparkContext.broadcast(np.ascontiguousarray(centroids, np.float64))
    dim = centroids.shape[1]

    @F.arrow_udf("array<int>")
    def order(v: pa.Array) -> pa.Array:
        c, out = shared.value, [None] * len(v)
        m, at = _matrix(pa.chunked_array([v]), dim)
        norms, step = (c**2).sum(1), max(1, _CELLS // len(c))
        for low in range(0, len(m), step):
            ranks = np.argsort(norms - 2 * (m[low : low + step] @ c.T), axis=1, kind="stable")[:, :nprobe].astype(np.int32)
            for i, r in zip(at[low : low + step].tolist(), ranks, strict=True):
                out[i] = r
        return pa.array(out, pa.list_(pa.int32()))

    return queries.withColumn("probes", order(F.col("vector")))


def ivf_search_all(queries: DataFrame, assigned: DataFrame, centroids: np.ndarray, k: int, nprobe: int) -> DataFrame:
    """As exact_search_all, over each query's ``nprobe`` nearest clusters."""
    probed = _with_order(queries, centroids, nprobe).select("query_id", "vector", F.explode("probes").alias("part"))
    return nearest_of_parts(probed, assigned.withColumn("part", F.col("cluster_id")), k, centroids.shape[1])


def probes_for(recall: float, assigned: DataFrame, centroids: np.ndarray, k: int) -> int:
    """The least number of probes that finds ``recall`` of the ``k`` nearest rows of SAMPLE
    rows of ``assigned``, against brute force; all clusters where there are none.

    A neighbour is found once its cluster is probed, so its cluster's place in the query's
    order says how many probes it needs.
    """
    sample = assigned.where("cluster_id >= 0").orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select(F.col("key").alias("query_id"), "vector")
    ordered = _with_order(sample, centroids, len(centroids)).select("query_id", "probes")
    truth = exact_search_all(sample, assigned, k, centroids.shape[1]).join(ordered, "query_id")
    need = sorted(r["p"] for r in truth.select(F.array_position("probes", F.col("cluster_id")).alias("p")).collect())  # SAMPLE * k numbers
    return int(need[math.ceil(recall * len(need)) - 1]) if need else len(centroids)
