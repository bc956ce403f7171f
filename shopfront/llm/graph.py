"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfront.staging import stage


def _roots(parents: DataFrame) -> DataFrame:
    """Follow ``node -> parent`` (never larger) to the end, doubling the steps each time."""
    parents = stage(parents, "parents")
    while True:
        above = parents.select(F.col("node").alias("_at"), F.col("parent").alias("_next"))
        jumped = parents.join(above, parents["parent"] == above["_at"]).select(
            "node", F.col("_next").alias("parent"), (F.col("_next") != F.col("parent")).alias("_moved")
        )
        jumped = stage(jumped, "parents")
        if jumped.where("_moved").isEmpty():
            return jumped.select("node", "parent")
        parents = jumped.select("node", "parent")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (``a, b``): the smallest node it reaches.

    Each turn every node points to its smallest neighbour (a partial aggregation, so a node with a
    third of all links is no burden), pointers are followed to their roots, and links are drawn
    between the roots that are left. Every tree loses all but one of its nodes, so turns are few.
    """
    links = stage(links.select("a", "b").where("a <> b").distinct(), "links")
    mapping = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent")).select(
            "node", F.least("node", "parent").alias("parent")
        )
        roots = _roots(parents)
        if mapping is None:
            mapping = roots.withColumnRenamed("parent", "component")
        else:
            moved = roots.select(F.col("node").alias("component"), "parent")
            mapping = mapping.join(moved, "component", "left").select(
                "node", F.coalesce("parent", "component").alias("component")
            )
        mapping = stage(mapping, "components")
        left, right = (
            roots.select(F.col("node").alias(side), F.col("parent").alias(f"_{side}")) for side in "ab"
        )
        drawn = links.join(left, "a").join(right, "b").where("_a <> _b").select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")
        )
        links = stage(drawn.distinct(), "links")
        if links.isEmpty():
            return mapping
