"""Splits and samples by the rank of md5(seed:id): the same on any engine and cluster, whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.boxes import flip_classes
from folioscope.functions.ranks import hash_key, hash_rank, sum_before


def _size(df: DataFrame) -> DataFrame:
    return F.broadcast(df.agg(F.count(F.lit(1)).alias("_total")))  # one row


def three_way_split(df: DataFrame, key: str, train: float = 0.70, val: float = 0.15, seed: int = 42) -> DataFrame:
    """split: the first int(train * n) by hash rank are train, the next int(val * n) val, the rest test."""
    ranked = hash_rank(df, seed, [key], "_rank").join(_size(df))
    n_train, n_val = F.floor(F.col("_total") * train), F.floor(F.col("_total") * val)
    split = F.when(F.col("_rank") <= n_train, "train").when(F.col("_rank") <= n_train + n_val, "val").otherwise("test")
    return ranked.withColumn("split", split).drop("_rank", "_total")


def train_val_split(df: DataFrame, key: str, frac: float, rule: str = "int", seed: int = 42) -> DataFrame:
    """split: max(1, int(n * frac)) or max(1, round half even of it) rows are val."""
    ranked = hash_rank(df, seed, [key], "_rank").join(_size(df))
    part = F.col("_total") * frac
    n_val = F.greatest(F.lit(1), (F.floor(part) if rule == "int" else F.bround(part, 0)).cast("long"))
    return ranked.withColumn("split", F.when(F.col("_rank") <= n_val, "val").otherwise("train")).drop("_rank", "_total")


def group_strict_split(df: DataFrame, key: str, frac: float = 0.2) -> DataFrame:
    """split: whole groups, smallest first (then by key), go to val while what is there stays below round(n * frac)."""
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    total = F.broadcast(sizes.agg(F.sum("_n").alias("_total")))
    sizes = sum_before(sizes, F.col("_n"), ["_n", key], "_before").join(total)
    sizes = sizes.select(key, F.when(F.col("_before") < F.bround(F.col("_total") * frac, 0), "val").otherwise("train").alias("split"))
    return df.join(sizes, key)


def class_balance(split: DataFrame, cls: str = "cls") -> DataFrame:
    """Rows of each class in each split: the report that goes with a group-strict split."""
    return split.groupBy("split", cls).agg(F.count(F.lit(1)).alias("n"))


def _in_group(df: DataFrame, by: list[str], key: str, seed: int) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(hash_key(seed, key), key))


def writer_episodes(df: DataFrame, n_support: int, n_query: int, least: int, writer: str = "writer_id", key: str = "sample_id", seed: int = 42) -> DataFrame:
    """role: the first n_support of each writer with enough samples are support, the next n_query query; episodes with too few queries leave."""
    n = F.count(F.lit(1)).over(Window.partitionBy(writer))
    rows = df.withColumns({"_n": n, "_k": _in_group(df, [writer], key, seed)})
    rows = rows.where((F.col("_n") >= least) & (F.least(F.col("_n") - n_support, F.lit(n_query)) >= n_query // 2)).where(F.col("_k") <= n_support + n_query)
    return rows.withColumn("role", F.when(F.col("_k") <= n_support, "support").otherwise("query")).drop("_n", "_k")


def support_query_split(df: DataFrame, n_support: int = 50, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """role over text rows that aren't blank: the first 50 by hash are support."""
    text = df.where((F.col("cls") == "text") & (F.col("text") != ""))
    ranked = hash_rank(text, seed, [key], "_rank")
    return ranked.withColumn("role", F.when(F.col("_rank") <= n_support, "support").otherwise("query")).drop("_rank")


def round_robin_sample(df: DataFrame, stratum: str, n: int, key: str = "sample_id", seed: int = 42) -> DataFrame:
    """n rows: one of each stratum in sorted order, round after round."""
    return df.withColumn("round", _in_group(df, [stratum], key, seed)).orderBy("round", stratum).limit(n)


def fixed_sample(df: DataFrame, n: int, order: list[str], key: list[str], seed: int = 42) -> DataFrame:
    """n rows in the given order; raises when run if there are fewer."""
    chosen = df.withColumn("_h", hash_key(seed, *key)).orderBy("_h", *key).limit(n).drop("_h")
    enough = F.broadcast(df.limit(n).agg((F.count(F.lit(1)) >= n).alias("_enough")))
    checked = chosen.join(enough).where(F.when(F.col("_enough"), True).otherwise(F.raise_error(F.lit("sample larger than population")).cast("boolean")))
    return checked.drop("_enough").orderBy(*order)


def cap_per_group(df: DataFrame, n: int, by: str, key: str, seed: int = 42) -> DataFrame:
    return df.withColumn("_k", _in_group(df, [by], key, seed)).where(F.col("_k") <= n).drop("_k")


def uniform_sample(df: DataFrame, n: int, key: str, seed: int = 42) -> DataFrame:
    return df.withColumn("_h", hash_key(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def merge_annotation_sets(old: DataFrame, new: DataFrame, frac: float, key: str, seed: int = 42) -> DataFrame:
    """Both label sets, the new one with flipped classes, split into train and val by whole images."""
    both = old.withColumn("source", F.lit("old")).unionByName(flip_classes(new.withColumn("source", F.lit("new"))))
    split = train_val_split(both.select(key).distinct(), key, frac, "int", seed)
    return both.join(split, key)
