"""Which clusters a query looks into, and the candidates that these give."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import squared_l2_to


def rank_clusters(centroids: DataFrame, query: Sequence[float], nprobe: int, by: Sequence[str] = ()) -> DataFrame:
    """The ``nprobe`` nearest clusters (for each ``by``, e.g. a file): cluster_id, d2, probe_rank from 1."""
    ranked = centroids.withColumn("d2", squared_l2_to(F.col("centroid"), query))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("d2", "cluster_id"))
    return ranked.withColumn("probe_rank", place).where(F.col("probe_rank") <= nprobe).select(*by, "cluster_id", "d2", "probe_rank")


def candidates(postings: DataFrame, probed: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Postings of the probed clusters with their probe_rank."""
    return postings.join(probed.select(*by, "cluster_id", "probe_rank"), [*by, "cluster_id"])


def cap_round_robin(found: DataFrame, cap: int | None, file: str, row: str) -> DataFrame:
    """``cap`` candidates at most, one of each file in turn, each file in the order of its
    probes and rows.

    Only candidates rank below the cap in their own file can be taken, which a window group
    limit enforces before anything meets in one task: at most cap rows a file.
    """
    if cap is None:
        return found
    place = F.row_number().over(Window.partitionBy(file).orderBy("probe_rank", row))
    return found.withColumn("__turn", place).where(F.col("__turn") <= cap).orderBy("__turn", file).limit(cap).drop("__turn")
