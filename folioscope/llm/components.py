"""Connected components as alternating large-star and small-star rounds, written to the shared folder after each.

Every round is two grouped minima with map-side combine and joins back; no neighbour list is collected, and nothing but
one boolean a round reaches the driver. The number of rounds grows with the logarithm of the longest chain. Rounds end when
the edges are stars: each node on the left has one root, and no root stands on the left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import forget, kept


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of the edges a, b (longs). No edges: an empty table."""
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    e = kept(e, "edges")
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = kept(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("x"))
        new = kept(small.select("x.u", "x.v").where("u <> v").distinct(), "small-star")
        forget(e, large)
        e = new
        roots = e.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("high"))
        if roots.where("v <> high").isEmpty() and e.join(roots.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
