"""Connected components of links between documents or vectors, on the cluster."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each node of ``links`` (columns a and b, of any type with an
    order); a component is named by its smallest node.

    Each round takes the least label among a node's neighbours, then the label of that
    label, so chains shrink by half a round.  Labels stay in the shared folder.
    """
    both = scratch.keep(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = scratch.keep(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        least = labels.join(near, "node").select("node", F.least("component", "near").alias("component"))
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = scratch.keep(least.join(jump, "component").select("node", F.least("component", "further").alias("component")))
        settled = new.join(labels.withColumnRenamed("component", "old"), "node").where("component <> old").isEmpty()
        labels = new
        if settled:
            return labels


def least_labels(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least index that each of the indices in the links a - b reaches."""
    label = np.arange(int(max(a.max(), b.max())) + 1)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new
