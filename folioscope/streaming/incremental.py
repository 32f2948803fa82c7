"""Incremental scoring: files that arrive are scored once, running metrics follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import scores

PAIRS = "pair_id long, writer_id string, hyp string, ref string"


def pair_stream(spark: SparkSession, in_dir: str) -> DataFrame:
    """Pairs of the files that arrive, with the file's name. A file that can't be read gives no row (see `unread_files`) and doesn't end the stream."""
    return spark.readStream.schema(PAIRS).option("ignoreCorruptFiles", True).parquet(in_dir).select("*", F.col("_metadata.file_name").alias("file"))


def scored_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"cer": scores.cer(F.col("hyp"), F.col("ref")), "wer": scores.wer(F.col("hyp"), F.col("ref"))})


def incremental_scores(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str) -> DataFrame:
    """Scores what is new in in_dir since the last call and appends it to out_dir; the checkpoint remembers what is done. Returns all scores."""
    q = scored_pairs(pair_stream(spark, in_dir)).writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out_dir)
    q.awaitTermination()
    return spark.read.parquet(out_dir)


def unread_files(spark: SparkSession, in_dir: str, out_dir: str) -> DataFrame:
    """file: what has arrived and gave no scores, to be mended and sent again under another name."""
    there = spark.read.format("binaryFile").load(in_dir).select(F.col("_metadata.file_name").alias("file"))
    return there.join(spark.read.parquet(out_dir).select("file").distinct(), "file", "left_anti")


def missing_scores(pairs: DataFrame, done: DataFrame, key: str = "pair_id") -> DataFrame:
    """The batch form: scores of the rows that have none yet."""
    return scored_pairs(pairs.join(done, key, "left_anti"))


def running_metrics(spark: SparkSession, in_dir: str, checkpoint: str, each: Callable[[DataFrame, int], None], timeout_s: int = 6 * 3600) -> bool:
    """Running mean CER by writer as files arrive, given to `each` after every batch. Returns whether it ended within the timeout."""
    sums = scored_pairs(pair_stream(spark, in_dir)).groupBy("writer_id").agg(F.avg("cer").alias("cer"), F.count(F.lit(1)).alias("n"))
    q = sums.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    ended = q.awaitTermination(timeout_s)
    if not ended:
        q.stop()
    return bool(ended)
