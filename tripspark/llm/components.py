"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tripspark.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node that each node of the edges is linked to, over any number of links.

    Each round joins nodes with the least of their neighbours; sums come before
    the exchange and joins are plain, so adaptive execution splits a node with
    very many neighbours. The rounds grow with the logarithm of the longest chain.
    The edges of each round are cut off in the shared folder. Edges from a node to
    itself are left out.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u > v").distinct())
    before = None
    while True:
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == before or seen[0] == 0:
            break
        before = seen
        # large star: every larger neighbour of a node moves to the node's least neighbour
        around = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = cut(around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))  # so that both sides of the join are shuffled, and can be split
        large = around.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: every smaller neighbour, and the node, move to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
