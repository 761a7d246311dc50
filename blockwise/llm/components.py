"""Connected components of an edge table by alternating large-star and
small-star rounds (equi-joins and grouped minima only)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from blockwise.llm.common import cut


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): every node that occurs in ``edges``, root = the smallest
    node it can reach. Loops and repeated edges are harmless; an empty edge
    table gives an empty result. Each round is one written table in the shared
    checkpoint folder, so a lost executor costs one round at most. The number
    of rounds grows with the logarithm of the longest path."""
    lo, hi = F.least(a, b), F.greatest(a, b)
    e = cut(edges.select(hi.alias("hi"), lo.alias("lo")).filter("hi <> lo").distinct())
    before = None
    while True:
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == before:
            break
        before = now
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(
            e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.filter("v > u").join(low, "u")
                 .select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct())
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").filter("lo <> m")
                 .select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
                 .union(least.select("hi", F.col("m").alias("lo"))).distinct())
        e = cut(small)
    star = e.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
    return star.union(e.select("lo", "lo").distinct())
