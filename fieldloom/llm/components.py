"""Connected components of a link table, on the cluster: min labels with pointer jumping, each round a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, component) for every id that has a link; the component is its smallest id. ``edges``: a, b."""
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = scratch.table(both, "links")
    labels = scratch.table(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    while True:
        # the least label around each node, then the label of that label
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("m"))
        step = labels.join(near, labels.id == near.a).select("id", F.col("component").alias("old"), F.least("component", "m").alias("component"))
        step = scratch.table(step, "step")
        jump = step.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = step.join(jump, "component", "left").select("id", "old", F.coalesce(F.least("component", "further"), "component").alias("component"))
        new = scratch.table(new, "labels")
        if new.where("component <> old").isEmpty():
            return new.select("id", "component")
        labels = new.select("id", "component")
