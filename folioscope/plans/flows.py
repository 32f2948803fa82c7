"""Whole flows composed of the operators: the region pipeline, replays, dataset building and evaluations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import boxes, scores, text
from folioscope.operators import aggregates, filters, matching, recognise, sampling
from folioscope.operators.joins import refine_boxes, restrict_to_split
from folioscope.sources.readers import TEXT_COLUMNS, WRITER_COLUMNS, detect_column
from folioscope.sources.scratch import forget, stored
from folioscope.sources.writers import dataset_info


def region_pipeline(det: DataFrame, points: DataFrame, candidates: DataFrame | None, features: DataFrame, recognised: DataFrame, typeset_filter: bool = True) -> DataFrame:
    """From detections to typeset regions.

    det: image_id, det_id, cls, score, x1..y2, img_w, img_h. features: det_id and the columns of is_typeset.
    recognised: det_id, text (what a vision-language recogniser read). Steps: prune, refine to ink, add ink candidates, merge,
    stitch rows, drop the header band and typeset print, route texts (maths-like text becomes maths, raw LaTeX leaves),
    normalise maths and mark garbage, then de-duplicate texts and drop those that rendered maths covers.
    """
    size = det.groupBy("image_id").agg(F.first("img_w").alias("img_w"), F.first("img_h").alias("img_h"))
    own = filters.prune_oversized(boxes.box_features(det)).select("image_id", "det_id", "cls", "score", "x1", "y1", "x2", "y2")
    # Steps are stored one after another, and go when the next is: their shuffles then don't add up on disk.
    own = refined = stored(refine_boxes(own, points).withColumn("source", F.lit("detector")), "refined")
    if candidates is not None:
        extra = filters.filter_ink_candidates(candidates, own).withColumnRenamed("cand_id", "det_id")
        own = own.unionByName(extra.select(*(F.col(c).cast(t) for c, t in own.dtypes)))
    every = stored(own, "boxes")
    forget(refined)
    merged = stored(matching.merge_detections(every), "merged")
    forget(every)
    own = joined = stored(matching.merge_row_fragments(merged), "joined")
    forget(merged)
    own = filters.drop_header_band(own.join(size, "image_id"))
    if typeset_filter:
        typeset = features.where(filters.is_typeset()).select("det_id")
        own = own.join(typeset, "det_id", "left_anti")
    rows = own.join(recognised.select("det_id", "text"), "det_id", "left").withColumn("raw", F.coalesce("text", F.lit("")))
    # Long rules are exploded from arrays of one: filters and later columns then use their value, and don't carry the rules again.
    once = lambda c: F.explode(F.array(c))
    rows = rows.withColumn("clean", once(text.clean_vlm_text(F.col("raw"))))
    rows = rows.withColumn("type", once(F.when((F.col("cls") == boxes.MATH) | filters.is_math_heavy(F.col("clean")), "math").otherwise("text")))
    rows = rows.where((F.col("type") == "math") | ((F.trim("clean") != "") & ~filters.has_raw_latex(F.col("clean"))))
    rows = rows.withColumn("latex", once(F.when(F.col("type") == "math", text.normalize_math_latex(F.col("raw"))).otherwise("")))
    rows = rows.withColumn("rendered", once((F.col("type") == "math") & ~filters.is_garbage_latex(F.col("latex"))))
    rows = rows.withColumn("latex", F.when(F.col("rendered"), F.col("latex")).otherwise(""))
    rows = rows.select("image_id", "det_id", "type", "score", "x1", "y1", "x2", "y2", "source", F.when(F.col("type") == "text", F.col("clean")).otherwise("").alias("text"), "latex", "rendered")
    rows = stored(rows, "regions")
    forget(joined)
    return _without_repeats(rows)


def without_repeats(rows: DataFrame, covered_always: bool = False) -> DataFrame:
    """Regions without repeated texts, then without texts that rendered maths covers.

    An image with fewer than two texts is left as it is by both steps, unless covered_always.
    """
    return _without_repeats(stored(rows, "regions"), covered_always)


def _without_repeats(rows: DataFrame, covered_always: bool = False) -> DataFrame:
    """rows are stored, and go."""
    out = stored(matching.dedupe_text(rows), "distinct-texts")
    if covered_always:
        forget(rows)
        return matching.drop_text_covered_by_math(out)
    several = stored(rows.where("type = 'text'").groupBy("image_id").count().where("count > 1").select("image_id"), "images")
    forget(rows)
    own = matching.drop_text_covered_by_math(out.join(several, "image_id", "left_semi"))
    return own.unionByName(out.join(several, "image_id", "left_anti"))


def replay_filters(results: DataFrame, features: DataFrame) -> DataFrame:
    """Stored regions through the header and typeset filters again: maths renormalised with its number of rows, texts that aren't blank."""
    own = filters.drop_header_band(results).join(features.where(filters.is_typeset()).select("det_id"), "det_id", "left_anti")
    latex = F.when(F.col("type") == "math", text.normalize_math_latex(F.col("latex"))).otherwise("")
    own = own.withColumn("latex", latex).withColumn("n_rows", F.when(F.col("type") == "math", F.regexp_count("latex", F.lit(r"\\\\")) + 1).otherwise(0))
    return own.where((F.col("type") == "math") | (F.trim("text") != ""))


def build_dataset(images: DataFrame, anns: DataFrame, transcripts: DataFrame, name: str, source: str, date: str, seed: int = 42) -> dict[str, DataFrame]:
    """images (with split), annotations and transcripts of each split, text episodes of the test part, and the info row. No annotations: empty tables."""
    split = sampling.three_way_split(images, "file_name", seed=seed)
    out = {"images": split, "info": dataset_info(split, name, source, date, ["train", "val", "test"], ["text", "math"])}
    for s in ("train", "val", "test"):
        own, a, t = restrict_to_split(images, anns, transcripts, split.where(F.col("split") == s))
        out[f"annotations_{s}"], out[f"transcripts_{s}"] = a, t
    out["episodes"] = sampling.support_query_split(transcripts, seed=seed)
    return out


def evaluate_text(samples: DataFrame, make: Callable, postprocess: bool = True, n_examples: int = 20, key: str = "pair_id") -> tuple[DataFrame, DataFrame]:
    """(one row: cer, wer, percentages, n_samples, n_errors; example rows) of a recogniser over samples of input and ref."""
    rows = recognise.recognize(samples, make, "input", "hyp")
    if postprocess:
        rows = rows.withColumn("hyp", text.correct_german(F.col("hyp")))
    c, w = scores.cer(F.col("hyp"), F.col("ref")), scores.wer(F.col("hyp"), F.col("ref"))
    one = rows.agg(F.avg(c).alias("cer"), F.avg(w).alias("wer"), F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("hyp") != F.col("ref")).alias("n_errors"))
    one = one.withColumns({"cer_pct": F.col("cer") * 100, "wer_pct": F.col("wer") * 100})
    return one, aggregates.example_rows(rows, n_examples, key)


def evaluate_cross_writer(rows: DataFrame, make: Callable, n: int, key: str, seed: int = 42) -> DataFrame:
    """Per-writer CER (and overall) over a sample of n rows, even across writers where there is a writer column."""
    text_col = detect_column(rows, TEXT_COLUMNS)
    writer = detect_column(rows, WRITER_COLUMNS, required=False)
    chosen = sampling.round_robin_sample(rows, writer, n, key, seed) if writer else sampling.uniform_sample(rows, n, key, seed)
    pairs = recognise.recognize(chosen, make, text_col, "hyp").withColumn("ref", F.col(text_col))
    if not writer:
        pairs, writer = pairs.withColumn("writer_id", F.lit("all")), "writer_id"
    return aggregates.per_writer(pairs, writer)
