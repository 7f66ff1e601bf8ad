"""Connected components by contraction; no group and no component meets in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorelink.session import cut_lineage


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); the root is the least node of its component.

    Each round lets every node point to its least neighbour, if that is less,
    follows the pointers, and rebuilds the edges between what is left. Only
    minima per node are aggregated, so a node with any number of neighbours is
    combined before the shuffle. An empty table gives no rows.
    """
    edges = cut_lineage(edges.select("a", "b").filter("a != b").distinct())
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        points = both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("node"), F.least("a", "b").alias("root"))
        points = cut_lineage(points)
        # Two steps along the pointers: most chains end, the next round does the rest.
        for _ in range(2):
            onward = points.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            points = points.join(onward, "root", "left").select("node", F.coalesce("_next", "root").alias("root"))
        points = cut_lineage(points)
        if labels is None:
            labels = points
        else:
            onward = points.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            labels = cut_lineage(labels.join(onward, "root", "left").select("node", F.coalesce("_next", "root").alias("root")))
        first = points.select(F.col("node").alias("a"), F.col("root").alias("_a"))
        second = points.select(F.col("node").alias("b"), F.col("root").alias("_b"))
        moved = edges.join(first, "a").join(second, "b").select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"))
        edges = cut_lineage(moved.filter("a != b").distinct())
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
