"""Connected components of a graph of links, by least labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalpa.session import checkpoint


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of every node that has a link; component is the least node reached.

    Each turn a node takes the least label among its own and its neighbours', then that label's label. Least labels are
    pre-aggregated before the shuffle, so a node with very many links needs no task of its own. No links give no rows.
    """
    pairs = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where("node <> other")
    edges = checkpoint(pairs.union(pairs.select("other", "node")).distinct())
    labels = checkpoint(edges.groupBy("node").agg(F.least(F.min("other"), F.col("node")).alias("label")))
    while True:
        near = edges.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        least = labels.join(near, "node").select("node", "label", F.least("label", "near").alias("least"))
        up = labels.select(F.col("node").alias("least"), F.col("label").alias("far"))
        moved = checkpoint(least.join(up, "least", "left").select("node", "label", F.least("least", F.coalesce("far", "least")).alias("next")))
        changed = not moved.where("next <> label").isEmpty()
        labels = moved.select("node", F.col("next").alias("label"))
        if not changed:
            return labels.select("node", F.col("label").alias("component"))
