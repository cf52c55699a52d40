"""Connected components by iterative joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every end of an edge (a, b): the smallest id it can reach.

    In each round a node takes the least label among its own and its neighbours', then the
    label of that label. The rounds end when no label changes; labels go through the shared
    folder, so a lost executor costs one round at most.
    """
    both = materialize(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges"
    )
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("component")).withColumnRenamed("a", "id"), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        lower = labels.join(near, labels["id"] == near["a"], "left").select(
            "id", F.col("component").alias("old"), F.least("component", "near").alias("to")
        )
        lower = materialize(lower, "lower")
        jump = lower.select(F.col("id").alias("at"), F.col("to").alias("next"))
        after = lower.join(jump, lower["to"] == jump["at"], "left").select(
            "id", F.least("to", "next").alias("component"), (F.least("to", "next") < F.col("old")).alias("changed")
        )
        after = materialize(after, "labels")
        labels = after.select("id", "component")
        if not after.where("changed").take(1):
            return labels
