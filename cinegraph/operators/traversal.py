"""Neighbourhoods of property graphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cinegraph.operators.communities import both_ways


def k_hop(edges: DataFrame, origins: DataFrame, depth: int) -> DataFrame:
    """name, distance of the nodes within 1 to 3 undirected steps of an origin; the frontier alone is expanded."""
    links = both_ways(edges.select("src", "dst")).distinct()
    seen = origins.select("name").distinct().withColumn("distance", F.lit(0))
    front = seen
    for step in range(1, min(max(depth, 1), 3) + 1):
        new = front.join(links, front.name == links.x).select(F.col("y").alias("name")).distinct().join(seen, "name", "left_anti").withColumn("distance", F.lit(step))
        seen, front = seen.unionByName(new), new
    return seen.where("distance > 0")


def one_hop(edges: DataFrame, origins: DataFrame) -> DataFrame:
    """Neighbours of the origins with the direction of each edge."""
    out = edges.select(F.col("src").alias("name"), F.col("dst").alias("other"), F.lit("out").alias("direction"), "strength", "n")
    back = edges.select(F.col("dst").alias("name"), F.col("src").alias("other"), F.lit("in").alias("direction"), "strength", "n")
    return out.unionByName(back).join(origins, "name", "left_semi")
