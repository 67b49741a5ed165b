"""Connected components of an edge table, and the classes of equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "cc") -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): the smallest node reachable.

    Each round every node takes the smallest label among its neighbours (a
    minimum, so it is combined before the shuffle and a hub is no hot spot) and
    then the label of its label, so a chain of length n needs about log n rounds.
    Labels are written after each round; the loop ends when none has changed.
    Null ends and self-loops are left out; no edges give an empty table."""
    edges = edges.where("a <> b").select("a", "b")
    both = scratch.save(edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
                        f"{name}-edges")
    labels = scratch.save(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select(
        "node", F.least("node", "low").alias("component")), f"{name}-0")
    done = 0
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "component"), "b") \
            .groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        near = labels.join(seen, "node").select(
            "node", F.col("component").alias("old"), F.least("component", "seen").alias("near"))
        step = scratch.save(
            near.join(labels.select(F.col("node").alias("near"), F.col("component").alias("far")), "near")
            .select("node", "old", F.least("near", "far").alias("component")), f"{name}-{done + 1}")
        scratch.drop(f"{name}-{done}")
        labels, done = step.select("node", "component"), done + 1
        if step.where("component <> old").isEmpty():
            scratch.drop(f"{name}-edges")
            return labels
