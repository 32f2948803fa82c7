"""Roll-ups of scores, runs and corpora, average precision, bootstrap and permutation statistics."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions import scores
from folioscope.operators import selection
from folioscope.operators.matching import best_boxes, tp_fp_assign
from folioscope.sources.scratch import stored


def batch_metrics(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.avg(scores.cer(F.col("hyp"), F.col("ref"))).alias("cer"), F.avg(scores.wer(F.col("hyp"), F.col("ref"))).alias("wer"), F.count(F.lit(1)).alias("n"))


#: Cells of score in which running counts are taken; only their totals meet in one window a class.
CELLS = 1 << 16


def _curve(totals: DataFrame, by: list[str]) -> DataFrame:
    """Running counts by falling score of totals (by, score, tp, n), one row for each distinct score: equal scores count together."""
    df = totals.withColumn("_cell", F.floor(F.col("score") * CELLS))
    cells = df.groupBy(*by, "_cell").agg(F.sum("tp").alias("_tp"), F.sum("n").alias("_n"))
    before = Window.partitionBy(*by).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select(*by, "_cell", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_tp", "_n")))
    own = Window.partitionBy(*by, "_cell").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"_tp_own": F.sum("tp").over(own), "_n_own": F.sum("n").over(own)}).join(cells, [*by, "_cell"])
    return df.withColumns({"cum_tp": F.col("_tp_before") + F.col("_tp_own"), "cum_n": F.col("_n_before") + F.col("_n_own")})


def _eleven_points(curve: DataFrame, n_gt: DataFrame, by: list[str]) -> DataFrame:
    recall, precision = F.col("cum_tp") / F.col("n_gt"), F.col("cum_tp") / (F.col("cum_n") + 1e-9)
    at = [F.max(F.when(recall >= i * 0.1, precision)).alias(f"p{i}") for i in range(11)]
    points = curve.join(n_gt, "cls").groupBy(*by).agg(*at)
    return points.select(*by, (sum((F.coalesce(F.col(f"p{i}"), F.lit(0.0)) for i in range(11)), F.lit(0.0)) / 11).alias("ap"))


def average_precision(pred: DataFrame, gt: DataFrame, t: float = 0.5, classes: tuple = (0, 1)) -> DataFrame:
    """cls, ap, n_gt of each class (11 points; 0 without ground truth) at an IoU threshold."""
    totals = tp_fp_assign(pred, gt, t).groupBy("cls", "score").agg(F.sum(F.col("tp").cast("long")).alias("tp"), F.count(F.lit(1)).alias("n"))
    n_gt = gt.groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt"))
    ap = _eleven_points(_curve(totals, ["cls"]), n_gt, ["cls"])
    every = gt.sparkSession.createDataFrame([(c,) for c in classes], "cls int")
    return every.join(n_gt, "cls", "left").join(ap, "cls", "left").select("cls", F.coalesce("ap", F.lit(0.0)).alias("ap"), F.coalesce("n_gt", F.lit(0)).alias("n_gt"))


THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def map_sweep(pred: DataFrame, gt: DataFrame, thresholds: tuple = THRESHOLDS) -> DataFrame:
    """t, cls, ap, precision, recall at each threshold (above 0).

    The assignment is made once: a prediction is right at t if its IoU reaches t and no better-scored one with the same best box does,
    which holds for t above the best IoU of those and up to its own. So counts by class and score have a column a threshold, and only
    these totals become a row a threshold.
    """
    earlier = Window.partitionBy("image_id", "cls", "gt_id").orderBy(F.desc("score"), "pred_id").rowsBetween(Window.unboundedPreceding, -1)
    best = best_boxes(pred, gt).withColumn("_from", F.coalesce(F.max("iou").over(earlier), F.lit(0.0)))
    right = [F.count_if((F.col("iou") >= t) & (F.col("_from") < t)).alias(f"tp{i}") for i, t in enumerate(thresholds)]
    wide = best.groupBy("cls", "score").agg(*right, F.count(F.lit(1)).alias("n"))
    each = F.explode(F.array(*(F.struct(F.lit(t).alias("t"), F.col(f"tp{i}").alias("tp")) for i, t in enumerate(thresholds))))
    totals = wide.select("cls", "score", "n", each.alias("x")).select("x.t", "cls", "score", "x.tp", "n")
    n_gt, by = gt.groupBy("cls").agg(F.count(F.lit(1)).alias("n_gt")), ["t", "cls"]
    curve = _curve(totals, by)
    ap = _eleven_points(curve, n_gt, by)
    whole = curve.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("n").alias("n"))
    return ap.join(whole, by).join(n_gt, "cls").select(*by, "ap", (F.col("tp") / F.col("n")).alias("precision"), (F.col("tp") / F.col("n_gt")).alias("recall"))


def aggregate_track(df: DataFrame) -> DataFrame:
    """Means by backend and track; zeros where there are none."""
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("exp_rate", "cer", "bleu")]
    return df.groupBy("backend", "track").agg(*means, F.count(F.lit(1)).alias("n"))


def per_tag(df: DataFrame) -> DataFrame:
    return df.withColumn("tag", F.explode(F.array_distinct("tags"))).groupBy("backend", "track", "tag").agg(*(F.avg(c).alias(c) for c in ("exp_rate", "cer", "bleu")), F.count(F.lit(1)).alias("n"))


def per_writer(pairs: DataFrame, writer: str = "writer_id") -> DataFrame:
    """writer_id, n, cer of each writer and, with a null writer, overall; blank references are left out."""
    df = pairs.where(F.trim("ref") != "").withColumn("cer", scores.cer(F.col("hyp"), F.col("ref")))
    return df.rollup(writer).agg(F.count(F.lit(1)).alias("n"), F.avg("cer").alias("cer"))


def few_shot_summary(df: DataFrame, writer: str = "writer_id") -> DataFrame:
    """One row: means over writers of the mean CER before and after, the improvement and its percentage."""
    per = df.groupBy(writer).agg(F.avg("before").alias("b"), F.avg("after").alias("a"))
    one = per.agg(F.avg("b").alias("before"), F.avg("a").alias("after"), F.count(F.lit(1)).alias("n_writers"))
    gain = F.col("before") - F.col("after")
    return one.select("before", "after", gain.alias("improvement"), (gain / F.greatest("before", F.lit(1e-6)) * 100).alias("improvement_pct"), "n_writers")


def class_counts_by_threshold(det: DataFrame, thresholds: list[float], by: list[str]) -> DataFrame:
    """Text, maths and total counts and the mean score above each threshold, for every group of the detections, empty ones too."""
    df = det.withColumn("t", F.explode(F.array(*map(F.lit, thresholds))))
    on = F.col("score") >= F.col("t")
    return df.groupBy(*by, "t").agg(
        F.count_if(on & (F.col("cls") == 0)).alias("n_text"), F.count_if(on & (F.col("cls") == 1)).alias("n_math"), F.count_if(on).alias("n_total"),
        F.coalesce(F.avg(F.when(on, F.col("score"))), F.lit(0.0)).alias("mean_score"),
    )


def box_counts(labels: DataFrame) -> DataFrame:
    """Boxes by split and class, by split, and in all (nulls)."""
    return labels.rollup("split", "cls").agg(F.count(F.lit(1)).alias("n"))


def run_summary(results: DataFrame, log: DataFrame, key: str = "lecture") -> DataFrame:
    """One row a lecture: slides, region counts, render rate (null without maths), drops, and timing (null without slides timed)."""
    kind = F.coalesce(F.nullif(F.col("type"), F.lit("")), F.col("cls_name")) if "cls_name" in results.columns else F.col("type")
    r = results.withColumn("_k", kind)
    math = F.col("_k") == "math"
    counts = r.groupBy(key).agg(
        F.countDistinct("slide").alias("n_slides"), F.count_if(F.col("_k") == "text").alias("n_text"), F.count_if(math).alias("n_math"), F.count_if(math & F.col("rendered")).alias("n_rendered"),
    )
    counts = counts.withColumn("render_rate", F.when(F.col("n_math") > 0, F.col("n_rendered") / F.col("n_math")))
    return counts.join(log, key, "left")


def corpus_summary(runs: DataFrame, limit: int = selection.LIMIT) -> DataFrame:
    """One row over run summaries: totals, weighted, mean, spread and extreme render rates, drops and pooled timing."""
    rate, c = F.col("render_rate"), F.col
    some = rate.isNotNull()
    order = lambda sign: F.struct(rate * sign, c("lecture"))
    out = runs.agg(
        F.count(F.lit(1)).alias("n_lectures"), *(F.sum(x).alias(x) for x in ("n_slides", "n_text", "n_math", "n_rendered")),
        (F.sum("n_rendered") / F.sum("n_math")).alias("weighted_rate"), F.avg(rate).alias("mean_rate"), F.stddev_samp(rate).alias("std_rate"),
        F.min(F.when(some, order(1)))["lecture"].alias("min_lecture"), F.min(F.when(some, order(-1)))["lecture"].alias("max_lecture"), F.count_if(rate == 1.0).alias("n_full"),
    )
    return out.join(selection.medians(runs, "render_rate", [], limit).withColumnRenamed("median", "median_rate"))  # one row each


def distribution(df: DataFrame, col: str, by: list[str], limit: int = selection.LIMIT) -> DataFrame:
    """mean, sample std (0 for one value), median, min, max, n; groups without values have nulls and n = 0. Medians are exact and of any group size."""
    c = F.col(col)
    std = F.when(F.count(c) == 1, 0.0).otherwise(F.stddev_samp(c))
    out = df.groupBy(*by).agg(F.avg(c).alias("mean"), std.alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"))
    return selection.same_keys(out, selection.medians(df, col, by, limit), by).select(*by, "mean", "std", "median", "min", "max", "n")


def mixed(x: np.ndarray) -> np.ndarray:
    """A finaliser of 32-bit integers, in place."""
    for shift, factor in ((16, 2246822507), (13, 3266489909), (16, 0)):
        x ^= x >> np.uint32(shift)
        if factor:
            x *= np.uint32(factor)
    return x


def poisson_steps() -> list[int]:
    """A uniform 32-bit number that reaches k of these is a draw of k from the Poisson distribution of mean 1."""
    p, total, out, k = math.exp(-1), 0.0, [], 0
    while (step := int((total := total + p) * 2**32)) < 2**32 - 1:
        out.append(step)
        k += 1
        p /= k
    return out


def _resampled(df: DataFrame, value: str, key: str, n_boot: int, seed: int, flips: bool) -> DataFrame:
    """b, m: the mean of each of n_boot resamples by Poisson weights, or of the values with signs flipped.

    A row's weight in resample b is a hash of seed, key and b, so rows need no numbers and it doesn't matter where they are: tasks
    sum weighted values for all resamples, and only these sums are shuffled. Rows of equal key get equal weights.
    """
    own = F.col(key).cast("long") if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(key)
    rows = df.where(F.col(value).isNotNull()).select(own.alias("k"), F.col(value).cast("double").alias("v"))
    steps, start = np.array(poisson_steps(), np.uint32), np.uint32(seed * 2654435761 % 2**32)

    def weights(x: np.ndarray) -> np.ndarray:
        w = sum((x >= step).view(np.int8) for step in steps[:4])
        far = np.flatnonzero(x >= steps[4])  # few draws are above 4
        w.ravel()[far] += sum((x.ravel()[far] >= step).view(np.int8) for step in steps[4:])
        return w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, some = np.zeros((2, n_boot)), False  # of weighted values, and of weights
        draws = np.arange(n_boot, dtype=np.uint32) * np.uint32(2246822519)
        for batch in batches:
            keys, values = batch.column("k").to_numpy(), batch.column("v").to_numpy()
            own = mixed(((keys ^ keys >> 32) & 0xFFFFFFFF).astype(np.uint32) ^ start)
            some = some or len(own) > 0
            for at in range(0, len(own), 128):
                both = np.stack([values[at : at + 128], np.ones(len(own[at : at + 128]))])
                for lo in range(0, n_boot, 1000):  # blocks that stay in the cache
                    x = mixed(own[at : at + 128, None] + draws[None, lo : lo + 1000])
                    if flips:
                        sums[0, lo : lo + 1000] += both[0] @ (1 - 2 * (x >> np.uint32(31)).astype(np.int8))
                    else:
                        sums[:, lo : lo + 1000] += both @ weights(x)
            if flips:
                sums[1] += len(own)
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n_boot)), pa.array(sums[0]), pa.array(sums[1])], ["b", "s", "w"])

    # A row is 16 bytes and n_boot draws, so few files mustn't mean few tasks.
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sums = rows.mapInArrow(run, "b long, s double, w double").groupBy("b").agg(F.sum("s").alias("s"), F.sum("w").alias("w"))
    return sums.where("w > 0").select("b", (F.col("s") / F.col("w")).alias("m"))


def bootstrap_ci(df: DataFrame, value: str, key: str, n_boot: int, seed: int = 42, alpha: float = 0.05) -> DataFrame:
    """mean, n, lo, hi: order statistics of resample means, without interpolation. Null values don't count."""
    lo, hi = int(alpha / 2 * n_boot), min(n_boot - 1, -int(-(1 - alpha / 2) * n_boot // 1) - 1)
    means = _resampled(df, value, key, n_boot, seed, False).agg(F.array_sort(F.collect_list("m")).alias("ms"))  # n_boot numbers
    ends = means.select(F.get("ms", F.lit(lo)).alias("lo"), F.get("ms", F.least(F.lit(hi), F.size("ms") - 1)).alias("hi"))
    return df.agg(F.avg(value).alias("mean"), F.count(value).alias("n")).join(F.broadcast(ends))


def paired_test(df: DataFrame, a: str, b: str, key: str, n_boot: int, seed: int = 42) -> DataFrame:
    """Mean difference, its bootstrap interval, and the sign-flip p-value (hits + 1) / (n_boot + 1)."""
    diffs = df.select(key, (F.col(a) - F.col(b)).alias("d"))
    ci = bootstrap_ci(diffs, "d", key, n_boot, seed)
    observed = diffs.agg(F.abs(F.avg("d")).alias("o"))
    flipped = _resampled(diffs, "d", key, n_boot, seed + 1, True)
    hits = flipped.join(F.broadcast(observed)).agg(F.count_if(F.abs("m") >= F.col("o") - 1e-12).alias("hits"))
    return ci.join(F.broadcast(hits)).select(F.col("mean").alias("mean_diff"), "lo", "hi", ((F.col("hits") + 1) / (n_boot + 1)).alias("p"), "n")


def compare_systems(df: DataFrame, baseline) -> DataFrame:
    """system, mean CER, difference to the baseline in percentage points, and whether the system wins.

    Means are taken once: sums of floats go by the order of rows, so a baseline that is added up again may differ from its own row.
    """
    means = stored(df.groupBy("system").agg(F.avg("cer").alias("mean_cer")), "means")
    base = means.where(F.col("system") == baseline).select(F.col("mean_cer").alias("_b"))
    out = means.join(F.broadcast(base)).withColumn("delta_pp", (F.col("mean_cer") - F.col("_b")) * 100)
    return out.select("system", "mean_cer", "delta_pp", F.when(F.col("delta_pp") < 0, "win").when(F.col("delta_pp") > 0, "loss").otherwise("tie").alias("result"))


def check_reported_means(df: DataFrame, reported: DataFrame) -> DataFrame:
    """system, mean, reported, ok: whether means differ by less than 1e-9."""
    means = df.groupBy("system").agg(F.avg("cer").alias("mean"))
    return means.join(reported, "system").withColumn("ok", F.abs(F.col("mean") - F.col("reported")) < 1e-9)


def training_verdict(df: DataFrame, baseline: float = 0.54) -> DataFrame:
    m = F.col("map50")
    verdict = F.when(m.isNull(), None).when(m > baseline, "beat").when(m > 0.45, "close").otherwise("under")
    return df.withColumns({"delta": m - baseline, "verdict": verdict})


def example_rows(pairs: DataFrame, n: int, key: str) -> DataFrame:
    return pairs.withColumn("cer", scores.cer(F.col("hyp"), F.col("ref"))).orderBy(key).limit(n)


def metric_rows(df: DataFrame, block: str, metrics: list[str]) -> DataFrame:
    """block, metric, value rows of a one-row table; none for null metrics."""
    pairs = F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))
    return df.select(pairs.alias("x")).select(F.lit(block).alias("block"), "x.metric", "x.value").where("value IS NOT NULL")


def pipeline_report(detection: DataFrame | None, text: DataFrame | None, math: DataFrame | None) -> DataFrame:
    """The given blocks as long rows; a missing part gives none."""
    parts = [x for x in (detection, text, math) if x is not None]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def eval_annotated_regions(pairs: DataFrame, ap: DataFrame) -> DataFrame:
    """block, metric, value over matched regions (type, hyp, ref): CER and WER of text, BLEU of maths, and mAP."""
    hyp, ref, text = F.col("hyp"), F.col("ref"), F.col("type") == "text"
    one = pairs.agg(F.avg(F.when(text, scores.cer(hyp, ref))).alias("cer"), F.avg(F.when(text, scores.wer(hyp, ref))).alias("wer"), F.avg(F.when(~text, scores.bleu(hyp, ref))).alias("bleu"))
    parts = metric_rows(one, "text", ["cer", "wer"]).unionByName(metric_rows(one, "math", ["bleu"]))
    return parts.unionByName(metric_rows(ap.agg(F.avg("ap").alias("map")), "detection", ["map"]))
