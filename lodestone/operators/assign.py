"""Nearest centroid of each row; the lowest cluster id wins ties."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_CELLS = 1 << 19  # distances held at a time
MATRIX_BYTES = 1 << 30  # of centroids that are broadcast, at most


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Index of the nearest centroid of each vector, block by block."""
    out = np.empty(len(vectors), np.int32)
    norms = (centroids**2).sum(1)
    step = max(1, _CELLS // len(centroids))
    for low in range(0, len(vectors), step):
        v = vectors[low : low + step]
        near = v @ centroids.T
        near *= -2
        near += norms
        out[low : low + step] = near.argmin(1)
    return out


def assign(df: DataFrame, column: str, centroids: np.ndarray) -> DataFrame:
    """``df`` with cluster_id, -1 for a null vector or one of another length or with null or NaN.

    Row by row in Arrow batches, no shuffle; works on a stream too.  The matrix is
    broadcast: ceil(sqrt(rows)) centroids by default, MATRIX_BYTES at most; a larger one is
    refused before anything is sent, as fewer clusters then serve better.
    """
    if centroids.size * 8 > MATRIX_BYTES:
        raise ValueError(f"{len(centroids)} centroids of {centroids.shape[1]} dimensions are over {MATRIX_BYTES} bytes; choose fewer clusters")
    shared = df.sparkSession.sparkContext.broadcast(np.ascontiguousarray(centroids, np.float64))
    dim = centroids.shape[1]

    @F.arrow_udf("int")
    def cluster(v: pa.Array) -> pa.Array:
        lengths = pc.fill_null(pc.list_value_length(v), -1).to_numpy(zero_copy_only=False)
        good = lengths == dim
        fit = v.filter(pa.array(good))
        flat = pc.list_flatten(fit).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        clean = np.isfinite(flat).all(1)
        out = np.full(len(v), -1, np.int32)
        ids = np.full(len(flat), -1, np.int32)
        if clean.any():
            ids[clean] = nearest(flat[clean], shared.value)
        out[good] = ids
        return pa.array(out)

    return df.withColumn("cluster_id", cluster(F.col(column)))
