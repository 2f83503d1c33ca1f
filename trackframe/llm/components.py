"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop_tables, materialize


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (least node reachable) for all nodes of ``edges`` (a, b).

    Labels fall to the least of the neighbours' and are followed once more
    (pointer jumping), so rounds grow with the logarithm of a chain's length.
    Each round is written to the shared folder.  No edges: no rows.
    """
    both = materialize(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("a")).alias("component")), "labels")
    while True:
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels.node == near.a).select("node", F.least("component", "near").alias("component"), F.col("component").alias("old"))
        lower = materialize(lower, "labels-lower")
        jump = lower.select(F.col("node").alias("via"), F.col("component").alias("root"))
        after = materialize(lower.join(jump, lower.component == jump.via).select("node", F.col("root").alias("component"), (F.col("root") != F.col("old")).alias("moved")), "labels")
        moved = not after.where("moved").isEmpty()
        drop_tables(lower, labels)
        labels = after.select("node", "component")
        if not moved:
            drop_tables(both)
            return labels
