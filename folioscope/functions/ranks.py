"""Global ranks without one task for all rows: a prefix that keeps the order cuts rows into buckets, whose sizes are summed up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.sources.scratch import stored


def global_rank(df: DataFrame, bucket: Column, order: list[Column | str], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    """Adds 1-based ranks by (bucket, order), within the columns `by` if given. bucket must not disagree with the order.

    Only bucket sizes meet in one window; rows are ranked within their bucket.
    """
    by = by or []
    rows = df.withColumn("_bucket", bucket)
    sizes = rows.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*by, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*by, "_bucket").orderBy(*order))
    return rows.withColumn("_own", own).join(sizes, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_bucket", "_own", "_before")


def sum_before(df: DataFrame, value: Column, order: list[Column | str], name: str = "before") -> DataFrame:
    """Adds the sum of value over all rows before, by order (a total one).

    Rows are cut into ranges of the order, as many as there are shuffle partitions, and stored with the number of theirs; only sums of ranges
    meet in one window, and rows are summed up within their range.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = stored(df.withColumn("_value", value).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("_range").agg(F.sum("_value").alias("_sum"))  # n rows at most
    sums = sums.select("_range", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    own = F.coalesce(F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(F.broadcast(sums), "_range").withColumn(name, F.col("_ahead") + F.col("_own")).drop("_value", "_range", "_ahead", "_own")


def hash_key(seed: int | str, *ids: Column | str) -> Column:
    """md5 of seed and ids: a shuffle that any engine repeats."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *ids))


def hash_rank(df: DataFrame, seed: int | str, ids: list[str], name: str = "rank", by: list[str] | None = None) -> DataFrame:
    key = df.withColumn("_key", hash_key(seed, *ids))
    return global_rank(key, F.substring("_key", 1, 3), ["_key", *ids], name, by).drop("_key")
