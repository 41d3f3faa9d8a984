"""Assign the vectors of a stream to the clusters of an index, row by row, without state."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from ..operators.assign import assign
from ..sources.index import IvfIndex


def assign_stream(stream: DataFrame, index: IvfIndex) -> DataFrame:
    """``stream`` with cluster_id; the index's centroids are read once, when this is called."""
    rows = index.centroids.orderBy("cluster_id").collect()
    return assign(stream, index.manifest.column, np.array([r["centroid"] for r in rows]))
