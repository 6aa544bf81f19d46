"""Connected components by repeated contraction.

Each round maps every node to the least node next to it, follows that pointer twice more, and replaces both ends
of every edge by their images; loops and repeated edges go. A node's image always lies in its component, so the
maps of all rounds composed give the component. A round leaves at most half of the nodes, and a star is done in
one. Nothing is collected: each round writes its map and the remaining edges to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.plans.shared import drop_scratch, scratch


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (the least node reachable) of every node that has an edge to another."""
    left = scratch(edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct(), "cc-edges")
    labels: DataFrame | None = None
    nodes = 0  # of the first round, the most that any map has
    while n := left.count():
        nodes = nodes or 2 * n
        near = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = scratch(near.groupBy(F.col("a").alias("x")).agg(F.least(F.min("b"), F.first("a")).alias("y")), "cc-map", 2 * n)
        for _ in range(2):
            hop = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
            new = scratch(to.join(hop, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "cc-map", 2 * n)
            drop_scratch(to)
            to = new
        ends = left.join(to.select(F.col("x").alias("a"), F.col("y").alias("s")), "a").join(to.select(F.col("x").alias("b"), F.col("y").alias("t")), "b")
        rest = scratch(ends.where("s <> t").select(F.least("s", "t").alias("a"), F.greatest("s", "t").alias("b")).distinct(), "cc-edges", n)
        if labels is None:
            labels = to
        else:
            step = to.select(F.col("x").alias("y"), F.col("y").alias("z"))
            new = scratch(labels.join(step, "y", "left").select("x", F.coalesce("z", "y").alias("y")), "cc-map", nodes)
            drop_scratch(labels, to)
            labels = new
        drop_scratch(left)
        left = rest
    if labels is None:
        return left.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels.select(F.col("x").alias("node"), F.col("y").alias("component"))
