"""Exact order statistics without a group's values in one task: counts over order-keeping cells, then only the cell that holds the rank."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.scratch import forget, stored

#: Cells that a range of values is cut into by one round.
CELLS = 4096
#: Values of a group that one task holds.
LIMIT = 100_000


def same_keys(a: DataFrame, b: DataFrame, by: list[str], how: str = "inner") -> DataFrame:
    """a joined with b on `by`, where nulls are equal; b's `by` leave."""
    if not by:
        return a.join(F.broadcast(b), how=how)  # one row
    renamed = b.withColumnsRenamed({c: f"_{c}_" for c in by})
    out = a.join(renamed, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"_{c}_")) for c in by)), how)
    return out if how in ("left_semi", "left_anti") else out.drop(*(f"_{c}_" for c in by))


def _magnitude(x: Column) -> Column:
    """The number of x's cell by sign and power of two; it never falls as x grows. Infinities and NaN, the largest, have cells of their own."""
    power = F.floor(F.log2(F.abs(x))) + 2000  # of doubles, from -1074 on
    return F.when(F.isnan(x), 9001).when(x == float("inf"), 9000).when(x == float("-inf"), -9000).when(x == 0, 0).when(x > 0, power).otherwise(-power).cast("int")


def _cell(x: Column, low: Column, high: Column) -> Column:
    """The number of x's cell between low and high, finite and of one magnitude; it never falls as x grows."""
    return F.least(F.floor((x - low) / (high - low) * CELLS), F.lit(CELLS - 1)).cast("int")


def selected(values: DataFrame, ranks: DataFrame, by: list[str], limit: int = LIMIT) -> DataFrame:
    """by, r, v: the r-th smallest value (from 1) of each group. values: by, v (double, not null); ranks: by, r, each within its group's size.

    A round counts the values of each range by cells, first by magnitude and then by place, and goes on with the values of the cell that holds the rank: it
    shuffles counts alone, about CELLS a range and task at most, and 53 bits take at most five rounds more. It ends when all values left of
    a range are equal, or are at most `limit`, which are then sorted.
    """
    left = stored(ranks.select(*by, "r", F.lit(0).cast("long").alias("before"), *(F.lit(None).cast("double").alias(c) for c in ("low", "high"))), "ranks")
    found, few = [], []
    while not left.isEmpty():
        rows = same_keys(values, left, by).where("low IS NULL OR v BETWEEN low AND high")
        cell = F.when(F.col("low").isNull(), _magnitude(F.col("v"))).otherwise(_cell(F.col("v"), F.col("low"), F.col("high")))
        counts = rows.groupBy(*by, "r", "before", cell.alias("c")).agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*by, "r").orderBy("c"))
        hit = counts.withColumn("upto", upto).where((F.col("upto") - F.col("n") < F.col("r")) & (F.col("r") <= F.col("upto")))
        hit = stored(hit.select(*by, "r", (F.col("upto") - F.col("n")).alias("before"), "low", "high", "n"), "ranks")
        done, short = F.col("low").eqNullSafe(F.col("high")), F.col("n") <= limit
        found.append(hit.where(done).select(*by, "r", F.col("low").alias("v")))
        few.append(hit.where(~done & short))
        forget(left)
        left = stored(hit.where(~done & ~short).drop("n"), "ranks")
    if not found:
        return ranks.select(*by, "r", F.lit(None).cast("double").alias("v")).limit(0)
    rows = same_keys(values, reduce(DataFrame.union, few), by).where("v BETWEEN low AND high")
    rows = rows.withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy(*by, "r").orderBy("v")))
    return reduce(DataFrame.union, found).union(rows.where("k = r").select(*by, "r", "v"))


def medians(df: DataFrame, col: str, by: list[str], limit: int = LIMIT) -> DataFrame:
    """by, median: of the values that aren't null (of an even number the mean of the middle two); null in groups without any.

    Groups of up to `limit` values are taken as they are; larger ones never meet in one task.
    """
    values = df.select(*by, F.col(col).cast("double").alias("v"))
    large = stored(values.groupBy(*by).agg(F.count("v").alias("n")).where(F.col("n") > limit), "large-groups")
    if large.isEmpty():
        return values.groupBy(*by).agg(F.median("v").alias("median"))
    ranks = large.select(*by, F.explode(F.array_distinct(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1))).alias("r"))
    some = same_keys(values.where("v IS NOT NULL"), large.select(*by, F.lit(1).alias("_large")), by).drop("_large")
    big = selected(some, ranks, by, limit).groupBy(*by).agg(((F.min("v") * 0.5) + (F.max("v") * 0.5)).alias("median"))
    if not by:
        return big
    return same_keys(values, large, by, "left_anti").groupBy(*by).agg(F.median("v").alias("median")).union(big)
