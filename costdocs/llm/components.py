"""Connected components of a large graph by alternating star contraction.

Every round turns the edges of each node into edges to the smallest node near it, once for the
larger and once for the smaller neighbours, until nothing changes. Minima are merged before any
shuffle, the two sides of each join are written tables, and rounds are written to the shared
folder, so a node with very many neighbours is split like any other skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from costdocs.llm.common import staged


def _star(near: DataFrame, large: bool) -> DataFrame:
    """One half round over edges (u, v) in which v is a neighbour of u."""
    least = staged(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "star-minima")
    ends = near.join(least, "u")
    if large:
        return ends.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    moved = ends.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v); the root is the component's smallest node.

    Loops and repeated edges, in either direction, change nothing. No edges give no rows.
    """
    down = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    down, mark = staged(down, "edges"), None
    while True:
        both = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v")))
        larger = staged(_star(both, True).distinct(), "large-star")
        down = staged(_star(larger, False).distinct(), "small-star")
        now = down.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark = now
    roots = down.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return down.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
