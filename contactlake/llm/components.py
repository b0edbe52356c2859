"""Connected components of a table of links."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlake.llm.tables import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and root (smallest node of its component) of every node with a link.

    Large-star and small-star steps by turns: each node's neighbours are hung on the smallest
    one near, until nothing changes; the number of rounds grows with the logarithm of the
    longest chain.  Every step is two aggregates and two joins on nodes; a hub's links are summed
    before they move, and its join is one that adaptive execution can split.
    """
    edges = stage(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    before = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = stage(large)
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = (large.join(low, "u").where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
                 .union(low.select("u", F.col("low").alias("v"))).distinct())
        edges = stage(small)
        r = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(r) == before:
            break
        before = tuple(r)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
