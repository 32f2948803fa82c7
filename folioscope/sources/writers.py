"""Writers of labels, manifests, captions and audit sheets. Each has the rows or text it writes as a DataFrame of its own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def yolo_label_text(df: DataFrame, stem: str = "image_id", order: str = "ann_id") -> DataFrame:
    """stem, split (if there), text: the label lines of each image that has boxes, by annotation id."""
    line = F.format_string("%s %.6f %.6f %.6f %.6f", F.col("cls").cast("string"), *(F.col(c).cast("double") for c in ("cx", "cy", "bw", "bh")))
    by = [stem, "split"] if "split" in df.columns else [stem]
    lines = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l"))))
    return df.groupBy(*by).agg(F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("text"))


def write_yolo_labels(df: DataFrame, path: str, stem: str = "image_id", order: str = "ann_id") -> None:
    out = yolo_label_text(df, stem, order)
    (out.write.partitionBy("split") if "split" in out.columns else out.write).mode("overwrite").parquet(path)


def caption_line() -> Column:
    return F.concat_ws(" ", "name", F.array_join("tokens", " "))


def write_captions(df: DataFrame, path: str) -> None:
    df.select(caption_line().alias("value")).write.mode("overwrite").text(path)


def tsv_rows(df: DataFrame, images: DataFrame) -> DataFrame:
    return df.join(images, "name", "left_semi").select("name", "latex")


def write_tsv_labels(df: DataFrame, images: DataFrame, path: str) -> None:
    """name and latex of samples whose image exists."""
    tsv_rows(df, images).write.mode("overwrite").option("quote", "").csv(path, sep="\t")


def audit_rows(df: DataFrame) -> DataFrame:
    """The sheet of ranked regions (rank given): id, place, integer box, confidence, latex and empty columns to fill in."""
    box = F.concat_ws(";", *(F.col(c).cast("int").cast("string") for c in ("x1", "y1", "x2", "y2")))
    return df.select(
        F.format_string("A%03d", F.col("rank").cast("int")).alias("id"), "lecture", "page", "region", box.alias("bbox"), F.format_string("%.3f", F.col("confidence").cast("double")).alias("confidence"),
        "latex", F.lit("").alias("verdict"), F.lit("").alias("notes"),
    )


def write_audit_csv(df: DataFrame, path: str) -> None:
    audit_rows(df).write.mode("overwrite").csv(path, header=True)


def split_counts(df: DataFrame, splits: list[str]) -> DataFrame:
    """split, n_samples of every listed split, empty ones too."""
    every = df.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return every.join(df.groupBy("split").agg(F.count(F.lit(1)).alias("n")), "split", "left").select("split", F.coalesce("n", F.lit(0)).alias("n_samples"))


def write_split_manifests(df: DataFrame, path: str, splits: list[str]) -> DataFrame:
    """Samples as JSON by split, and the counts beside them; returns the counts."""
    df.write.mode("overwrite").partitionBy("split").json(f"{path}/samples")
    counts = split_counts(df, splits)
    counts.write.mode("overwrite").json(f"{path}/counts")
    return counts


def dataset_info(df: DataFrame, name: str, source: str, date: str, splits: list[str], classes: list[str]) -> DataFrame:
    """One row about a dataset: splits' counts in columns n_<split>, classes, sources; the date is given, not read from the clock."""
    counts = [F.count_if(F.col("split") == s).alias(f"n_{s}") for s in splits]
    return df.agg(*counts, F.count(F.lit(1)).alias("n_total")).select(F.lit(name).alias("name"), F.lit(",".join(classes)).alias("classes"), F.lit(source).alias("source"), F.lit(date).alias("date"), "*")
