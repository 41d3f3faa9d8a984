"""How much of an exact result an approximate one finds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, key: str) -> DataFrame:
    """One row: hits, truth_size and recall (0 where there is no truth)."""
    hits = truth.select(key).distinct().join(found.select(key).distinct().withColumn("__hit", F.lit(1)), key, "left")
    return hits.agg(F.count("__hit").alias("hits"), F.count("*").alias("truth_size")).withColumn(
        "recall", F.when(F.col("truth_size") > 0, F.col("hits") / F.col("truth_size")).otherwise(F.lit(0.0))
    )


def mean_recall(found: DataFrame, truth: DataFrame, query: str, key: str) -> DataFrame:
    """One row over many searches: queries, hits, truth_size, recall (their mean) and least_recall."""
    hits = truth.select(query, key).distinct().join(found.select(query, key).distinct().withColumn("__hit", F.lit(1)), [query, key], "left")
    each = hits.groupBy(query).agg(F.count("__hit").alias("hits"), F.count("*").alias("truth_size"))
    share = F.col("hits") / F.col("truth_size")
    return each.agg(F.count("*").alias("queries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.coalesce(F.sum("truth_size"), F.lit(0)).alias("truth_size"), F.coalesce(F.avg(share), F.lit(0.0)).alias("recall"), F.coalesce(F.min(share), F.lit(0.0)).alias("least_recall"))
