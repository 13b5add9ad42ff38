"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import materialize


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) of longs -> (node, root): the smallest node of each component.

    Each round points every node to its smallest neighbour, follows that pointer once more, and
    replaces the edges by those between the nodes pointed to, so that the edges shrink until none is
    left. Every round is written, nothing travels through the driver but a count.
    """
    edges = materialize(edges.filter("a != b").distinct(), "edges")
    labels = None
    while edges.head(1):
        both = edges.select("a", "b").union(edges.select("b", "a"))
        up = both.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), F.least("a", "low").alias("up"))
        up = materialize(up, "up")
        jump = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        up = materialize(up.join(jump, "up").select("node", "top"), "top")
        if labels is None:
            labels = up.withColumnRenamed("top", "root")
        else:
            moved = up.select(F.col("node").alias("root"), "top")
            labels = labels.join(moved, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
        labels = materialize(labels, "labels")
        ends = edges.join(up.select(F.col("node").alias("a"), F.col("top").alias("x")), "a")
        ends = ends.join(up.select(F.col("node").alias("b"), F.col("top").alias("y")), "b")
        edges = materialize(ends.filter("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
