"""Centroids: a trained set for indexes, and a deterministic one that SQL can check."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_CAP = 100_000
SAMPLE_FLOOR = 32  # points a cluster that a sample has, if the table and SAMPLE_CAP allow
POINTS = 10_000  # of the sample in a partition


def default_clusters(rows: int) -> int:
    return math.isqrt(rows - 1) + 1 if rows > 0 else 0


def sample_size(rows: int, clusters: int) -> int:
    """A twentieth of the rows, SAMPLE_CAP at most, but no fewer than clusters."""
    return min(rows, max(min(max(rows // 20, 1), SAMPLE_CAP), clusters))


def training_sample(df: DataFrame, column: str, size: int, seed: int) -> DataFrame:
    """The vectors with the ``size`` least hashes, the same for equal data and seed wherever
    they lie; equal vectors are in together, so there may be a few more.

    Only hashes meet in one task to find the bound, ``size`` of them from each task at most;
    vectors go to partitions of POINTS by their hash and stand there in its order.
    """
    vector = F.col(column).cast("array<double>")
    hashed = df.select(vector.alias(column), F.xxhash64(vector, F.lit(seed)).alias("__hash"))
    bound = hashed.select("__hash").orderBy("__hash").limit(size).agg(F.max("__hash")).first()[0]
    chosen = hashed.where(F.col("__hash") <= F.lit(bound))
    return chosen.repartition(max(1, -(-size // POINTS)), "__hash").sortWithinPartitions("__hash").drop("__hash")


def train(sample: DataFrame, column: str, clusters: int, max_iters: int, seed: int) -> np.ndarray:
    """Centroids by distributed k-means over a bounded sample; may be fewer than ``clusters``."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    points = sample.select(array_to_vector(F.col(column).cast("array<double>")).alias("features"))
    if clusters == 1:
        mean = np.array([r["features"].toArray() for r in points.take(1)])
        return mean if max_iters < 1 else _mean(points)
    model = KMeans(k=clusters, maxIter=max_iters, tol=0.0, seed=seed, featuresCol="features").fit(points)
    return np.array(model.clusterCenters())


def _mean(points: DataFrame) -> np.ndarray:
    from pyspark.ml.stat import Summarizer

    return np.array([points.select(Summarizer.mean(F.col("features"))).first()[0].toArray()])


def seeded_centroids(df: DataFrame, key: str, column: str, clusters: int) -> DataFrame:
    """(cluster_id, centroid): the vectors whose keys have the least md5 hashes."""
    chosen = df.select(F.md5(F.col(key).cast("string").cast("binary")).alias("h"), F.col(column).cast("array<double>").alias("centroid")).orderBy("h").limit(clusters)
    from pyspark.sql import Window

    return chosen.select((F.row_number().over(Window.orderBy("h")) - 1).alias("cluster_id"), "centroid")


def lloyd_step(assigned: DataFrame, column: str, centroids: DataFrame) -> DataFrame:
    """New centroids: means of what is assigned; a cluster without rows keeps its place."""
    spread = assigned.select("cluster_id", F.posexplode(F.col(column).cast("array<double>")).alias("d", "x"))
    means = spread.groupBy("cluster_id", "d").agg(F.avg("x").alias("x"))
    new = means.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("d", "x"))), lambda s: s["x"]).alias("mean"))
    return centroids.join(new, "cluster_id", "left").select("cluster_id", F.coalesce("mean", "centroid").alias("centroid"))
