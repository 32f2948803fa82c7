"""Queries of user functions, streams and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import aggregates, matching, recognise
from folioscope.plans import flows
from folioscope.plans.box_queries import _TYPESET, _pred, candidates, features
from folioscope.plans.file_queries import scratch
from folioscope.plans.match_queries import _BEST, _RESULTS, results
from folioscope.plans.registry import ORACLES, edits, fixture, query, rounded, table
from folioscope.plans.text_queries import _BY_N, _CER, _SPLIT, _bleu_sql, _domain_sql, _edits, _umlauts_sql
from folioscope.streaming import incremental


def upper_model():
    """A stand-in for a recogniser: upper-cases, fails on lines that end with an s, reads nothing from short lines."""

    def predict(value: str) -> str | None:
        if value.endswith("s"):
            raise ValueError("unreadable")
        return value.upper() if len(value) > 10 else None

    return predict


def broken_model():
    raise RuntimeError("no such model")


#: Python and Spark upper-case ß as two letters.
_READ = "CASE WHEN ends_with({0}, 's') OR length({0}) <= 10 THEN '' ELSE replace(upper({0}), 'ẞ', 'SS') END"


@query(f"SELECT pair_id, {_READ.format('ref')} AS pred FROM fx_pairs")
def recognize(spark, d):
    return recognise.recognize(fixture(spark, d, "fx_pairs").select("pair_id", "ref"), upper_model, "ref").select("pair_id", "pred")


@query("""SELECT 'good' AS backend, count(*) AS n, count(*) FILTER (WHERE NOT ends_with(ref, 's') AND length(ref) > 10) AS n_read, 0 AS n_errors FROM fx_pairs UNION ALL SELECT 'broken', 1, 0, 1""")
def run_backends(spark, d):
    out = recognise.run_backends(fixture(spark, d, "fx_pairs").select("pair_id", "ref"), {"good": upper_model, "broken": broken_model}, "ref")
    return out.groupBy("backend").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") != "").alias("n_read"), F.count_if(F.col("error").isNotNull()).alias("n_errors"))


def dot_corrector():
    """A stand-in for a corrector: ends every second line with a full stop, rewrites every fifth, leaves out every seventh."""

    def correct(lines: list[dict]) -> list[dict]:
        out = []
        for x in lines:
            n = len(x["text"])
            if n % 7:
                out.append({"idx": x["idx"], "text": "something else altogether" if n % 5 == 0 else x["text"] + "." if n % 2 == 0 else x["text"]})
        return out

    return correct


@query(f"""SELECT conv_id, region, CASE WHEN trim(t) = '' OR length(t) % 7 = 0 THEN t
    ELSE CASE WHEN {edits('t', 'n')} / CAST(length(t) AS DOUBLE) > 0.30 THEN t ELSE n END END AS text
  FROM (SELECT *, CASE WHEN length(t) % 5 = 0 THEN 'something else altogether' WHEN length(t) % 2 = 0 THEN concat(t, '.') ELSE t END AS n FROM (
    SELECT conv_id, CAST(turn AS BIGINT) AS region, replace(text, chr(10), ' ') AS t FROM conversations) a) b""")
def correct_fragments(spark, d):
    line = F.replace("text", F.lit("\n"), F.lit(" "))
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").cast("long").alias("region"), F.lit("text").alias("type"), line.alias("text"), F.array(line).alias("line_texts"))
    return recognise.correct_fragments(c, dot_corrector, "conv_id").select("conv_id", "region", "text")


@query()
def region_pipeline(spark, d):
    det = _pred(spark, d).select("image_id", F.concat_ws("/", "image_id", "det_id").alias("det_id"), "cls", "score", "x1", "y1", "x2", "y2", "img_w", "img_h")
    keyed = lambda df, c: df.withColumn(c, F.concat_ws("/", "image_id", c))
    texts = keyed(read_texts(spark, d), "det_id").drop("image_id")
    return flows.region_pipeline(det, fixture(spark, d, "fx_points"), keyed(candidates(spark, d), "cand_id"), keyed(features(spark, d), "det_id").drop("image_id"), texts)


def read_texts(spark, d):
    """What a recogniser is taken to have read from each detection."""
    j = F.crc32("pred_id") % 6
    c = F.when(j == 0, "$\\alpha$ ist der Winkel").when(j == 1, "x = 3 + y^2").when(j == 2, "f_x und f_y und f_xy").when(j == 3, "").when(j == 4, "Dies ist der Fall\ny = 2").otherwise("die Ableitung der Funktion")
    return fixture(spark, d, "fx_pred").select("image_id", F.col("pred_id").alias("det_id"), c.alias("text"))


@query(rf"""SELECT r.image_id, concat(r.image_id, '/', r.det_id) AS det_id, type, text, CASE WHEN type = 'math' THEN 'a = 1 \\ b = 2' ELSE '' END AS latex, CASE WHEN type = 'math' THEN 2 ELSE 0 END AS n_rows
  FROM ({_RESULTS}) r LEFT JOIN ({_TYPESET}) t ON r.image_id = t.image_id AND r.det_id = t.det_id
  WHERE t.det_id IS NULL AND NOT (x2 - x1 >= 1000 * CAST(0.20 AS DOUBLE) AND (y1 <= 600 * CAST(0.045 AS DOUBLE) OR y2 >= 600 * CAST(0.96 AS DOUBLE))) AND (type = 'math' OR trim(text) <> '')""")
def replay_filters(spark, d):
    r = results(spark, d).withColumns({"img_w": F.lit(1000), "img_h": F.lit(600), "latex": F.when(F.col("type") == "math", F.lit("a = 1\nb = 2")).otherwise("")})
    r = r.withColumn("det_id", F.concat_ws("/", "image_id", "det_id"))
    f = features(spark, d).withColumn("det_id", F.concat_ws("/", "image_id", "det_id"))
    return flows.replay_filters(r, f).select("image_id", "det_id", "type", "text", "latex", "n_rows")


@query("""WITH i AS (SELECT image_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', concat('img/', image_id, '.png'))), image_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM fx_gt) d),
  s AS (SELECT image_id, CASE WHEN r <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN r <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM i)
  SELECT split, count(*) AS n_annotations, count(DISTINCT s.image_id) AS n_images FROM s JOIN fx_gt g ON s.image_id = g.image_id GROUP BY split""")
def build_dataset(spark, d):
    gt = fixture(spark, d, "fx_gt")
    images = gt.select("image_id").distinct().withColumn("file_name", F.concat(F.lit("img/"), F.col("image_id"), F.lit(".png")))
    texts = images.select(F.col("file_name").alias("image"), F.col("image_id").cast("string").alias("sample_id"), F.lit("text").alias("cls"), F.lit("a").alias("text"))
    out = flows.build_dataset(images, gt, texts, "slides", "lineitem", "2026-01-01")
    counts = [out[f"annotations_{s}"].agg(F.lit(s).alias("split"), F.count(F.lit(1)).alias("n_annotations")) for s in ("train", "val", "test")]
    return counts[0].union(counts[1]).union(counts[2]).join(out["images"].groupBy("split").agg(F.count(F.lit(1)).alias("n_images")), "split")


_CORRECTED = _domain_sql(_umlauts_sql("h"))
_EVALUATED = f"SELECT pair_id, CASE WHEN trim(h) = '' THEN h ELSE {_CORRECTED} END AS hyp, replace(upper(ref), 'ẞ', 'SS') AS ref FROM (SELECT pair_id, {_READ.format('hyp')} AS h, ref FROM fx_pairs) q"


@query(f"""WITH ev AS ({_EVALUATED}), w AS (SELECT avg({_BY_N}) AS w FROM ({_edits(_SPLIT.format(c="hyp"), _SPLIT.format(c="ref"), "pair_id", "ev")}) e), c AS (SELECT avg({_CER}) AS c, count(*) AS n, count(*) FILTER (WHERE hyp <> ref) AS n_errors FROM ev)
  SELECT round(c, 6) AS cer, round(w, 6) AS wer, n AS n_samples, n_errors, round(c * 100, 6) AS cer_pct, round(w * 100, 6) AS wer_pct FROM c CROSS JOIN w""")
def evaluate_text(spark, d):
    samples = fixture(spark, d, "fx_pairs").select("pair_id", F.col("hyp").alias("input"), F.upper("ref").alias("ref"))
    return rounded(flows.evaluate_text(samples, upper_model)[0], "cer", "wer", "cer_pct", "wer_pct")


@query(f"""WITH s AS (SELECT pair_id, writer_id, ref, row_number() OVER (PARTITION BY writer_id ORDER BY md5(concat_ws(':', '42', pair_id)), pair_id) AS k FROM fx_pairs),
  p AS (SELECT writer_id, {_READ.format("ref")} AS hyp, ref FROM (SELECT * FROM s ORDER BY k, writer_id LIMIT 200) t WHERE trim(ref) <> '')
  SELECT writer_id, count(*) AS n, round(avg({_CER}), 6) AS cer FROM p GROUP BY ROLLUP (writer_id)""")
def evaluate_cross_writer(spark, d):
    rows = fixture(spark, d, "fx_pairs").select("pair_id", "writer_id", F.col("ref").alias("text"))
    return rounded(flows.evaluate_cross_writer(rows, upper_model, 200, "pair_id"), "cer")


_REGIONS = f"""SELECT CAST(k.image_id AS VARCHAR) || k.pred_id AS pair_id, k.cls, concat('region ', array_to_string(string_split(pred_id, '-')[1:2], '-')) AS hyp,
  concat('region ', array_to_string(string_split(gt_id, '-')[1:2], '-')) AS ref FROM ({_BEST}) k WHERE k = 1 AND iou > 0.5"""


@query(f"""WITH RECURSIVE ap AS ({ORACLES["average_precision"]}), m AS ({_REGIONS}), w AS ({_edits(_SPLIT.format(c="hyp"), _SPLIT.format(c="ref"), "pair_id", "m WHERE cls = 0")})
  SELECT 'text' AS block, 'cer' AS metric, round(avg({_CER}), 6) AS value FROM m WHERE cls = 0 UNION ALL SELECT 'text', 'wer', round(avg({_BY_N}), 6) FROM w
  UNION ALL SELECT 'math', 'bleu', round(avg(x), 6) FROM (SELECT {_bleu_sql()} AS x FROM (SELECT {_SPLIT.format(c='hyp')} AS a, {_SPLIT.format(c='ref')} AS b FROM m WHERE cls = 1) q) z
  UNION ALL SELECT 'detection', 'map', round(avg(ap), 6) FROM ap""")
def eval_annotated_regions(spark, d):
    pred, gt = fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt")
    word = lambda c: F.concat(F.lit("region "), F.substring_index(c, "-", 2))
    pairs = matching.best_gt_match(pred, gt).select(F.when(F.col("cls") == 0, "text").otherwise("math").alias("type"), word("pred_id").alias("hyp"), word("gt_id").alias("ref"))
    return rounded(aggregates.eval_annotated_regions(pairs, aggregates.average_precision(pred, gt)), "value")


def _arrivals(spark, d) -> str:
    path = scratch(spark, "arrivals")
    fixture(spark, d, "fx_pairs").select("pair_id", "writer_id", "hyp", "ref").where("pair_id % 2 = 0").write.parquet(path)
    return path


def _rest_arrives(spark, d, path: str) -> None:
    fixture(spark, d, "fx_pairs").select("pair_id", "writer_id", "hyp", "ref").where("pair_id % 2 = 1").write.mode("append").parquet(path)


_WER_FREE = f"SELECT pair_id, writer_id, round(CASE WHEN length(ref) = 0 THEN CASE WHEN length(hyp) = 0 THEN 0 ELSE 1 END ELSE {edits('hyp', 'ref')} / CAST(length(ref) AS DOUBLE) END, 6) AS cer FROM fx_pairs"


@query(_WER_FREE)
def incremental_scores(spark, d):
    """Half of the pairs arrive, are scored, then the other half: the second call scores only what is new."""
    path, out, ckpt = _arrivals(spark, d), scratch(spark, "scores"), scratch(spark, "stream")
    incremental.incremental_scores(spark, path, out, ckpt)
    _rest_arrives(spark, d, path)
    return rounded(incremental.incremental_scores(spark, path, out, ckpt).select("pair_id", "writer_id", "cer"), "cer")


@query(f"SELECT writer_id, count(*) AS n, round(avg(cer), 6) AS cer FROM ({_WER_FREE}) q GROUP BY writer_id")
def running_metrics(spark, d):
    """Half of the pairs arrive, then the other half: the running means after the second call count all of them."""
    path, out, ckpt = _arrivals(spark, d), scratch(spark, "running"), scratch(spark, "stream")
    keep = lambda df, epoch: df.write.mode("overwrite").parquet(out)
    incremental.running_metrics(spark, path, ckpt, keep, 600)
    _rest_arrives(spark, d, path)
    incremental.running_metrics(spark, path, ckpt, keep, 600)
    return rounded(spark.read.parquet(out).select("writer_id", "n", "cer"), "cer")
