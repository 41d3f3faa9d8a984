"""Top-k by distance, exact or over candidates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.distance import squared_l2_to


def exact_topk(df: DataFrame, column: str, query: Sequence[float], k: int, key: Sequence[str] = ()) -> DataFrame:
    """The ``k`` nearest rows with their distance; ties by ``key``.  Rows whose vector is null
    or of another length are left out.  Plans as TakeOrderedAndProject: k rows a task."""
    ranked = df.withColumn("__d2", squared_l2_to(F.col(column), query)).where(F.col("__d2").isNotNull())
    return ranked.orderBy("__d2", *key).limit(k).withColumn("distance", F.sqrt("__d2")).drop("__d2")


def rank_candidates(found: DataFrame, column: str, query: Sequence[float], k: int, key: Sequence[str], where: str | None = None) -> DataFrame:
    """Exact ranking of candidates.  A filter applies to candidates only, so fewer than k
    rows may come back although more rows match."""
    return exact_topk(found.where(where) if where else found, column, query, k, key)
