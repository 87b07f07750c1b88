"""Connected components of an edge table: smallest labels spread along edges, with shortcuts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """From edges (a, b): one row (node, component) per node that has an edge to another; component is the smallest node.

    Each round a node takes the smallest label among its own and its neighbours', then the label of its label, so paths
    shrink to half or less. A node with very many edges is only ever a key of sums that start before the exchange, or of
    joins that Spark splits. The labels of each round are written to the shared folder; only a count comes to the driver.
    Null ends are left out; an empty table gives no rows.
    """
    ends = edges.select("a", "b").where("a <> b").distinct()
    both = materialize(ends.union(ends.select("b", "a")).distinct())
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        lower = labels.join(near, "node").select("node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        lower = materialize(lower)
        jump = lower.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = materialize(lower.join(jump, "component", "left").select("node", "old", F.coalesce("further", "component").alias("component")))
        changed = new.where("old <> component").limit(1).count()
        labels = new.select("node", "component")
        if not changed:
            return labels
