"""Connected components of a narrow edge table, without collecting links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): the smallest node reachable from it.

    Alternates the large-star and small-star steps until nothing changes: about log(n) rounds for
    chains, each a grouped minimum that combines before its shuffle and a join on that minimum. A node
    with very many neighbours is a group only in the minimum; no group is ever gathered.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct()
    e = stored(e, "edges")
    seen = None
    while True:
        e = stored(_small_star(_large_star(e)), "edges")
        # (hi, lo) is a forest of stars once a round leaves count and sum of roots as they were
        now = e.agg(F.count("*"), F.sum(F.col("lo").cast("decimal(38,0)")), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now == seen:
            return e.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(e.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
        seen = now


def _large_star(e: DataFrame) -> DataFrame:
    """Each neighbour above a node is linked to the least of the node and its neighbours."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()


def _small_star(e: DataFrame) -> DataFrame:
    """Each node's neighbours below it, and the node, are linked to the least of them."""
    least = e.groupBy("hi").agg(F.min("lo").alias("m"))
    moved = e.join(least, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
    return moved.unionByName(least.select("hi", F.col("m").alias("lo"))).distinct()
