"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, unstage


def connected_components(links: DataFrame) -> DataFrame:
    """``node, label`` for each node of ``links`` (``a, b`` long): the label is the least node of its component.

    Every round hooks each group to its least neighbour, doubles the hooks twice, and contracts the links, so the
    longest chain shrinks by a factor each round. Only tables are kept, never a component in one place.
    """
    both = links.where("a <> b").select("a", "b").union(links.where("a <> b").select("b", "a"))
    edges = staged(both.distinct())
    labels = staged(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")))
    while not edges.isEmpty():
        hooks = edges.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label"))
        doubled = _doubled(staged(hooks))
        hooks = doubled.select(F.col("node").alias("label"), F.col("label").alias("to"))
        new = staged(labels.join(hooks, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        step = hooks.withColumnsRenamed({"label": "a", "to": "x"})
        # Contract: links between groups that are still apart.
        rest = edges.join(step, "a").join(step.withColumnsRenamed({"a": "b", "x": "y"}), "b").where("x <> y")
        left = staged(rest.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        for used in (edges, labels, doubled):
            unstage(used)
        edges, labels = left, new
    unstage(edges)
    return labels


def _doubled(hooks: DataFrame) -> DataFrame:
    """Follow hooks four steps."""
    for _ in range(2):
        jump = hooks.select(F.col("node").alias("label"), F.col("label").alias("to"))
        further = staged(hooks.join(jump, "label", "left").select("node", F.coalesce("to", "label").alias("label")))
        unstage(hooks)
        hooks = further
    return hooks
