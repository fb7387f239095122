"""Connected components of an edge table, without bringing edges or labels to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) for every node of edges (a, b); label is the smallest node of its component.

    Each round hooks every label on the smallest neighbouring one, follows these hooks to their roots by pointer
    jumping and contracts the edges, so rounds grow with the logarithm of a component's diameter. No node's edges
    are gathered: only minima are aggregated, which combine before the shuffle.
    """
    left = scratch.write(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = None
    while not left.isEmpty():
        both = left.union(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooks = scratch.write(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("label")))
        while True:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("up"))
            jumped = scratch.write(hooks.join(up, "label").select("node", F.col("up").alias("label"), (F.col("up") != F.col("label")).alias("moved")))
            hooks = jumped.select("node", "label")
            if jumped.where("moved").isEmpty():
                break
        if labels is None:
            labels = hooks
        else:
            up = hooks.select(F.col("node").alias("label"), F.col("label").alias("up"))
            labels = scratch.write(labels.join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        a, b = (hooks.select(F.col("node").alias(c), F.col("label").alias(f"{c}_label")) for c in "ab")
        renamed = left.join(a, "a").join(b, "b").where("a_label != b_label")
        left = scratch.write(renamed.select(F.least("a_label", "b_label").alias("a"), F.greatest("a_label", "b_label").alias("b")).distinct())
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).limit(0)
    return labels
