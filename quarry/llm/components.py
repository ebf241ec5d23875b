"""Connected components of a graph that no machine holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node, label (the smallest node of its component) of the nodes of edges (a, b).

    Every round takes the smallest label around a node and then that label's own label, so
    the number of rounds grows with the logarithm of the longest path. Each round is a
    written table. Repeated edges, loops and either order of a and b are one edge; a graph
    without edges has no nodes. A hub's edges meet its label in a join of two plain
    shuffles, which Spark splits where it is skewed."""
    both = scratch.save(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct(), f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), f"{name}-0")
    turn = 0
    while True:
        around = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("label").alias("near"))
        near = labels.join(around, labels.node == around.a).select("node", F.col("label").alias("old"), F.least("label", "near").alias("near"))
        own = labels.select(F.col("node").alias("near"), F.col("label").alias("far"))
        turn += 1
        new = scratch.save(near.join(own, "near", "left").select("node", "old", F.least("near", "far").alias("label")), f"{name}-{turn}")
        changed = new.filter("label <> old").limit(1).count()
        labels = new.select("node", "label")
        scratch.drop(f"{name}-{turn - 1}")
        if not changed:
            scratch.drop(f"{name}-edges")
            return labels
