"""Queries of corpus roll-ups, systems, statistics, splits and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions import scores
from folioscope.operators import aggregates, joins, sampling
from folioscope.plans.registry import fixture, query, rounded, table
from folioscope.plans.text_queries import _CER
from folioscope.sources.readers import parse_log

_TRACKS = f"""SELECT writer_id AS backend, CASE WHEN pair_id % 2 = 0 THEN 'raw' ELSE 'post' END AS track, {_CER} AS cer, CASE WHEN hyp = ref THEN 1 ELSE 0 END AS exp_rate,
  length(hyp) / CAST(200 AS DOUBLE) AS bleu, CASE WHEN pair_id % 3 = 0 THEN ['a', 'b'] WHEN pair_id % 3 = 1 THEN ['b'] ELSE [] END AS tags FROM fx_pairs"""


def tracks(spark, d):
    p, k = fixture(spark, d, "fx_pairs"), F.col("pair_id")
    tags = F.when(k % 3 == 0, F.array(F.lit("a"), F.lit("b"))).when(k % 3 == 1, F.array(F.lit("b"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        F.col("writer_id").alias("backend"), F.when(k % 2 == 0, "raw").otherwise("post").alias("track"), scores.cer(F.col("hyp"), F.col("ref")).alias("cer"),
        (F.col("hyp") == F.col("ref")).cast("int").alias("exp_rate"), (F.length("hyp") / 200).alias("bleu"), tags.alias("tags"),
    )


_MEANS = "round(avg(exp_rate), 6) AS exp_rate, round(avg(cer), 6) AS cer, round(avg(bleu), 6) AS bleu, count(*) AS n"


@query(f"SELECT backend, track, {_MEANS} FROM ({_TRACKS}) t GROUP BY backend, track")
def aggregate_track(spark, d):
    return rounded(aggregates.aggregate_track(tracks(spark, d)), "exp_rate", "cer", "bleu")


@query(f"SELECT backend, track, tag, {_MEANS} FROM (SELECT *, unnest(tags) AS tag FROM ({_TRACKS}) t) u GROUP BY backend, track, tag")
def per_tag(spark, d):
    return rounded(aggregates.per_tag(tracks(spark, d)), "exp_rate", "cer", "bleu")


@query("""WITH p AS (SELECT item % 10 AS writer_id, avg(CASE WHEN system = 0 THEN cer END) AS b, avg(CASE WHEN system = 1 THEN cer END) AS a FROM fx_scores GROUP BY item % 10)
  SELECT round(avg(b), 6) AS before, round(avg(a), 6) AS after, round(avg(b) - avg(a), 6) AS improvement, round((avg(b) - avg(a)) / greatest(avg(b), CAST(1e-6 AS DOUBLE)) * 100, 6) AS improvement_pct, count(*) AS n_writers FROM p""")
def few_shot_summary(spark, d):
    wide = joins.align_systems(fixture(spark, d, "fx_scores"), [0, 1, 2, 3, 4])
    df = wide.select((F.col("item") % 10).alias("writer_id"), F.col("0").alias("before"), F.col("1").alias("after"))
    return rounded(aggregates.few_shot_summary(df), "before", "after", "improvement", "improvement_pct")


_LOG = r"""SELECT lecture, coalesce(sum(TRY_CAST(regexp_extract(line, 'Typeset filter dropped (\d+) region', 1) AS BIGINT)), 0) AS typeset_drops,
  coalesce(sum(TRY_CAST(regexp_extract(line, 'Post-OCR dedupe: dropped (\d+) near-duplicate', 1) AS BIGINT)), 0) AS dedupe_drops,
  count(*) FILTER (WHERE contains(line, 'Dropped text overlay covered by typeset math')) AS covered_drops, count(*) FILTER (WHERE contains(line, 'Math OCR rejected garbage:')) AS garbage_rejects,
  count(s) AS n_timed, round(avg(s), 6) AS mean_s, round(median(s), 6) AS median_s, min(s) AS min_s, max(s) AS max_s, round(sum(s), 6) AS total_s
  FROM (SELECT *, TRY_CAST(regexp_extract(line, 'Saved -> .+?\(([\d.]+)s\)', 1) AS DOUBLE) AS s FROM fx_log) l GROUP BY lecture"""
_TIMES = ("mean_s", "median_s", "total_s")


@query(_LOG.replace("AS typeset_drops", "AS typeset_drops").replace("coalesce(sum(", "CAST(coalesce(sum(").replace(", 0) AS", ", 0) AS BIGINT) AS"))
def read_run_log(spark, d):
    return rounded(parse_log(fixture(spark, d, "fx_log")), *_TIMES)


_RUNS = """SELECT lecture, count(DISTINCT slide) AS n_slides, count(*) FILTER (WHERE type = 'text') AS n_text, count(*) FILTER (WHERE type = 'math') AS n_math,
  count(*) FILTER (WHERE type = 'math' AND rendered) AS n_rendered, count(*) FILTER (WHERE type = 'math' AND rendered) / CAST(nullif(count(*) FILTER (WHERE type = 'math'), 0) AS DOUBLE) AS render_rate FROM fx_results GROUP BY lecture"""


@query(f"SELECT r.lecture, n_slides, n_text, n_math, n_rendered, round(render_rate, 6) AS render_rate, CAST(typeset_drops AS BIGINT) AS typeset_drops, n_timed, mean_s FROM ({_RUNS}) r LEFT JOIN ({_LOG}) l ON r.lecture = l.lecture")
def run_summary(spark, d):
    out = aggregates.run_summary(fixture(spark, d, "fx_results"), parse_log(fixture(spark, d, "fx_log")))
    return rounded(out.select("lecture", "n_slides", "n_text", "n_math", "n_rendered", "render_rate", "typeset_drops", "n_timed", "mean_s"), "render_rate", "mean_s")


@query(f"""SELECT count(*) AS n_lectures, CAST(sum(n_slides) AS BIGINT) AS n_slides, CAST(sum(n_text) AS BIGINT) AS n_text, CAST(sum(n_math) AS BIGINT) AS n_math, CAST(sum(n_rendered) AS BIGINT) AS n_rendered,
  round(sum(n_rendered) / CAST(sum(n_math) AS DOUBLE), 6) AS weighted_rate, round(avg(render_rate), 6) AS mean_rate, round(stddev_samp(render_rate), 6) AS std_rate, round(median(render_rate), 6) AS median_rate,
  (SELECT lecture FROM ({_RUNS}) a WHERE render_rate IS NOT NULL ORDER BY render_rate, lecture LIMIT 1) AS min_lecture, (SELECT lecture FROM ({_RUNS}) b WHERE render_rate IS NOT NULL ORDER BY render_rate DESC, lecture LIMIT 1) AS max_lecture,
  count(*) FILTER (WHERE render_rate = 1) AS n_full FROM ({_RUNS}) r""")
def corpus_summary(spark, d):
    runs = aggregates.run_summary(fixture(spark, d, "fx_results"), parse_log(fixture(spark, d, "fx_log")))
    return rounded(aggregates.corpus_summary(runs), "weighted_rate", "mean_rate", "std_rate", "median_rate")


@query("""SELECT lecture, round(avg(seconds), 6) AS mean, round(CASE WHEN count(seconds) = 1 THEN 0 ELSE stddev_samp(seconds) END, 6) AS std, round(median(seconds), 6) AS median, round(min(seconds), 6) AS min,
  round(max(seconds), 6) AS max, count(seconds) AS n FROM fx_results GROUP BY lecture""")
def distribution(spark, d):
    return rounded(aggregates.distribution(fixture(spark, d, "fx_results"), "seconds", ["lecture"]), "mean", "std", "median", "min", "max")


_B = 10_000


def _mixed_sql(src: str, cols: str) -> str:
    for step in ("xor(x, x >> 16)", "x * 2246822507 % 4294967296", "xor(x, x >> 13)", "x * 3266489909 % 4294967296", "xor(x, x >> 16)"):
        src = f"SELECT {cols}, {step} AS x FROM ({src}) q"
    return src


def _draws(seed: int) -> str:
    """v, b, x: 32 hashed bits of each value (own: k, v) and resample."""
    own = _mixed_sql(f"SELECT v, xor(CAST(k AS UBIGINT), {seed * 2654435761 % 2**32}::UBIGINT) AS x FROM own", "v")
    each = f"SELECT v, b, (x + b * 2246822519 % 4294967296) % 4294967296 AS x FROM ({own}) o CROSS JOIN (SELECT CAST(unnest(range({_B})) AS UBIGINT) AS b) bs"
    return _mixed_sql(each, "v, b")


_WEIGHT = "CASE " + " ".join(f"WHEN x < {step} THEN {k}" for k, step in enumerate(aggregates.poisson_steps())) + f" ELSE {len(aggregates.poisson_steps())} END"


def _boot(values: str) -> str:
    return f"""own AS ({values}), means AS (SELECT b, sum(w * v) / sum(w) AS m FROM (SELECT v, b, {_WEIGHT} AS w FROM ({_draws(42)}) d) e GROUP BY b),
  ranked AS (SELECT m, row_number() OVER (ORDER BY m, b) - 1 AS k FROM means)"""


_ENDS = "round(max(CASE WHEN k = 250 THEN m END), 6) AS lo, round(max(CASE WHEN k = 9749 THEN m END), 6) AS hi"


@query(f"""WITH {_boot("SELECT item AS k, cer AS v FROM fx_scores WHERE system = 0")} SELECT (SELECT round(avg(v), 6) FROM own) AS mean, (SELECT count(*) FROM own) AS n, {_ENDS} FROM ranked""")
def bootstrap_ci(spark, d):
    own = fixture(spark, d, "fx_scores").where("system = 0")
    return rounded(aggregates.bootstrap_ci(own, "cer", "item", _B), "mean", "lo", "hi")


@query(f"""WITH {_boot("SELECT a.item AS k, a.cer - b.cer AS v FROM fx_scores a JOIN fx_scores b ON a.item = b.item WHERE a.system = 0 AND b.system = 1")},
  flips AS (SELECT b, avg(CASE WHEN x >= 2147483648 THEN -v ELSE v END) AS m FROM ({_draws(43)}) d GROUP BY b)
  SELECT (SELECT round(avg(v), 6) FROM own) AS mean_diff, (SELECT count(*) FROM own) AS n, {_ENDS},
  (SELECT round((count(*) FILTER (WHERE abs(m) >= (SELECT abs(avg(v)) FROM own) - CAST(1e-12 AS DOUBLE)) + 1) / CAST({_B + 1} AS DOUBLE), 6) FROM flips) AS p FROM ranked""")
def paired_test(spark, d):
    wide = joins.align_systems(fixture(spark, d, "fx_scores"), [0, 1, 2, 3, 4])
    return rounded(aggregates.paired_test(wide, "0", "1", "item", _B), "mean_diff", "lo", "hi", "p")


@query("""WITH m AS (SELECT system, avg(cer) AS c FROM fx_scores GROUP BY system) SELECT system, round(c, 6) AS mean_cer, round((c - b) * 100, 6) AS delta_pp,
  CASE WHEN c < b THEN 'win' WHEN c > b THEN 'loss' ELSE 'tie' END AS result FROM m, (SELECT c AS b FROM m WHERE system = 2) z""")
def compare_systems(spark, d):
    return rounded(aggregates.compare_systems(fixture(spark, d, "fx_scores"), 2), "mean_cer", "delta_pp")


@query("""WITH m AS (SELECT system, avg(cer) AS c FROM fx_scores GROUP BY system) SELECT system, round(c, 6) AS mean, round(r, 6) AS reported, abs(c - r) < 1e-9 AS ok
  FROM (SELECT system, c, CASE WHEN system = 3 THEN c + CAST(0.001 AS DOUBLE) ELSE c END AS r FROM m) q""")
def check_reported_means(spark, d):
    s = fixture(spark, d, "fx_scores")
    reported = s.groupBy("system").agg(F.avg("cer").alias("c")).select("system", F.when(F.col("system") == 3, F.col("c") + 0.001).otherwise(F.col("c")).alias("reported"))
    return rounded(aggregates.check_reported_means(s, reported), "mean", "reported")


@query("""SELECT p_partkey AS run, map50, round(map50 - CAST(0.54 AS DOUBLE), 6) AS delta, CASE WHEN map50 IS NULL THEN NULL WHEN map50 > 0.54 THEN 'beat' WHEN map50 > 0.45 THEN 'close' ELSE 'under' END AS verdict
  FROM (SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE (p_partkey % 97) / CAST(100 AS DOUBLE) END AS map50 FROM part) q""")
def training_verdict(spark, d):
    k = F.col("p_partkey")
    runs = table(spark, d, "part").select(k.alias("run"), F.when(k % 10 != 0, (k % 97) / F.lit(100.0)).alias("map50"))
    return rounded(aggregates.training_verdict(runs), "delta")


@query(f"""SELECT 'text' AS block, 'cer' AS metric, round(avg({_CER}), 6) AS value FROM fx_pairs UNION ALL SELECT 'text', 'n', CAST(count(*) AS DOUBLE) FROM fx_pairs
  UNION ALL SELECT 'detection', 'boxes', CAST(count(*) AS DOUBLE) FROM fx_pred""")
def pipeline_report(spark, d):
    p = fixture(spark, d, "fx_pairs").agg(F.avg(scores.cer(F.col("hyp"), F.col("ref"))).alias("cer"), F.count(F.lit(1)).alias("n"))
    boxes = fixture(spark, d, "fx_pred").agg(F.count(F.lit(1)).alias("boxes"))
    return rounded(aggregates.pipeline_report(aggregates.metric_rows(boxes, "detection", ["boxes"]), aggregates.metric_rows(p, "text", ["cer", "n"]), None), "value")


_WIDE = ", ".join(f'round(max(CASE WHEN system = {s} THEN cer END), 6) AS "{s}"' for s in range(5))


@query(f"SELECT item, {_WIDE} FROM fx_scores GROUP BY item")
def align_systems(spark, d):
    return rounded(joins.align_systems(fixture(spark, d, "fx_scores"), [0, 1, 2, 3, 4]), *"01234")


@query(f"SELECT item, {_WIDE} FROM fx_scores WHERE NOT (system = 4 AND item % 3 = 0) GROUP BY item")
def side_by_side(spark, d):
    s = fixture(spark, d, "fx_scores").where("NOT (system = 4 AND item % 3 = 0)")
    return rounded(joins.side_by_side(s, [0, 1, 2, 3, 4]), *"01234")


@query("""SELECT coalesce(h.pair_id, r.pair_id) AS pair_id, h.hyp, r.ref, h.pair_id IS NOT NULL AND r.pair_id IS NOT NULL AS matched FROM (SELECT pair_id, hyp FROM fx_pairs WHERE pair_id % 5 <> 0) h
  FULL OUTER JOIN (SELECT pair_id, ref FROM fx_pairs WHERE pair_id % 7 <> 0) r ON h.pair_id = r.pair_id""")
def pair_hyp_ref(spark, d):
    p = fixture(spark, d, "fx_pairs")
    return joins.pair_hyp_ref(p.where("pair_id % 5 <> 0"), p.where("pair_id % 7 <> 0"), "pair_id")


@query("""SELECT l.lecture, CASE WHEN r.lecture IS NULL THEN 'no results' WHEN g.lecture IS NULL THEN 'no log' END AS reason FROM (SELECT DISTINCT user_id % 40 AS lecture FROM events) l
  LEFT JOIN (SELECT DISTINCT lecture FROM fx_results WHERE lecture % 9 <> 0) r ON l.lecture = r.lecture LEFT JOIN (SELECT DISTINCT lecture FROM fx_log WHERE lecture % 6 <> 0) g ON l.lecture = g.lecture""")
def pair_runs_with_logs(spark, d):
    lectures = fixture(spark, d, "fx_results").select("lecture").distinct()
    return joins.pair_runs_with_logs(lectures, fixture(spark, d, "fx_results").where("lecture % 9 <> 0"), fixture(spark, d, "fx_log").where("lecture % 6 <> 0"))


@query("""SELECT o_orderkey, concat('line-', o_orderkey) AS line_id, concat('img/', o_orderkey, '.png') AS image, concat('t', o_totalprice) AS text, c_custkey AS writer_id FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderkey % 4 <> 0 AND c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 3)""")
def build_text_manifest(spark, d):
    o = table(spark, d, "orders")
    line = F.concat(F.lit("line-"), F.col("o_orderkey"))
    images = o.select("o_orderkey", line.alias("line_id"), F.concat(F.lit("img/"), F.col("o_orderkey"), F.lit(".png")).alias("image"))
    texts = o.where("o_orderkey % 4 <> 0").select(line.alias("line_id"), F.concat(F.lit("t"), F.col("o_totalprice")).alias("text"))
    forms = o.select(line.alias("form"), F.col("o_custkey").alias("writer_id"))
    german = table(spark, d, "customer").join(F.broadcast(table(spark, d, "nation").where("n_regionkey = 3")), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("writer_id"))
    found, _ = joins.build_text_manifest(images, texts, forms, german)
    return found.join(images.select("line_id", "o_orderkey"), "line_id").select("o_orderkey", "line_id", "image", "text", "writer_id")


@query("""WITH a AS (SELECT image_id, greatest(0, least((x1 + (x2 - x1) / 2) / 900, 1)) AS cx, greatest(0, least((x2 - x1) / 900, 1)) AS bw, greatest(0, least((y2 - y1) / 500, 1)) AS bh FROM fx_gt WHERE cls = 1),
  k AS (SELECT image_id, count(*) AS n FROM a WHERE bw >= 0.001 AND bh >= 0.001 GROUP BY image_id)
  SELECT count(k.n) AS n_processed, count(*) FILTER (WHERE k.n IS NULL) AS n_skipped, CAST(coalesce(sum(k.n), 0) AS BIGINT) AS n_boxes FROM (SELECT DISTINCT o_orderkey FROM orders) i LEFT JOIN k ON i.o_orderkey = k.image_id""")
def coco_join(spark, d):
    gt = fixture(spark, d, "fx_gt")
    images = table(spark, d, "orders").select(F.col("o_orderkey").alias("image_id"), F.lit(900).alias("img_w"), F.lit(500).alias("img_h")).distinct()
    anns = gt.select("image_id", F.col("cls").alias("category_id"), F.col("x1").alias("x"), F.col("y1").alias("y"), (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    cats = gt.select(F.col("cls").alias("category_id")).distinct().where("category_id = 1")
    return joins.coco_join(images, anns, cats)[1]


@query("""SELECT g.image_id, g.gt_id FROM fx_gt g WHERE g.image_id % 5 = 0""")
def restrict_to_split(spark, d):
    gt = fixture(spark, d, "fx_gt")
    name = F.concat(F.lit("img/"), F.col("image_id"), F.lit(".png"))
    images = gt.select("image_id").distinct().withColumn("file_name", name)
    texts = images.select(F.concat(F.lit("other/"), F.col("image_id"), F.lit(".png")).alias("image"))
    _, anns, _ = joins.restrict_to_split(images, gt, texts, images.where("image_id % 5 = 0"))
    return anns.select("image_id", "gt_id")


@query("SELECT sample_id, writer_id FROM fx_samples WHERE CAST(substr(writer_id, 2) AS INT) % 3 = 0")
def german_writers_only(spark, d):
    s = fixture(spark, d, "fx_samples")
    from folioscope.operators import filters

    writers = s.select("writer_id").distinct().where(F.substring("writer_id", 2, 10).cast("int") % 3 == 0)
    return filters.german_writers_only(s, writers).select("sample_id", "writer_id")


def _hash(seed: int, c: str) -> str:
    return f"md5(concat_ws(':', '{seed}', {c}))"


_RANK = f"row_number() OVER (ORDER BY {_hash(42, 'sample_id')}, sample_id)"
_N = "(SELECT count(*) FROM fx_samples)"


@query(f"""SELECT sample_id, CASE WHEN r <= floor({_N} * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN r <= floor({_N} * CAST(0.7 AS DOUBLE)) + floor({_N} * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT sample_id, {_RANK} AS r FROM fx_samples) q""")
def three_way_split(spark, d):
    return sampling.three_way_split(fixture(spark, d, "fx_samples"), "sample_id").select("sample_id", "split")


@query(f"SELECT sample_id, CASE WHEN r <= greatest(1, round_even({_N} * CAST(0.1 AS DOUBLE), 0)) THEN 'val' ELSE 'train' END AS split FROM (SELECT sample_id, {_RANK} AS r FROM fx_samples) q")
def train_val_split(spark, d):
    return sampling.train_val_split(fixture(spark, d, "fx_samples"), "sample_id", 0.1, "round").select("sample_id", "split")


@query("""WITH s AS (SELECT stem, regexp_extract(stem, 'lecture_(\\d+)', 1) AS lecture FROM fx_slides), g AS (SELECT lecture, count(*) AS n FROM s GROUP BY lecture),
  b AS (SELECT lecture, coalesce(sum(n) OVER (ORDER BY n, lecture ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g)
  SELECT stem, s.lecture, CASE WHEN before < round_even((SELECT count(*) FROM s) * CAST(0.2 AS DOUBLE), 0) THEN 'val' ELSE 'train' END AS split FROM s JOIN b ON s.lecture = b.lecture""")
def group_strict_split(spark, d):
    s = fixture(spark, d, "fx_slides").withColumn("lecture", F.regexp_extract("stem", r"lecture_(\d+)", 1))
    return sampling.group_strict_split(s, "lecture")


_IN_WRITER = f"row_number() OVER (PARTITION BY writer_id ORDER BY {_hash(42, 'sample_id')}, sample_id)"


@query(f"""SELECT sample_id, writer_id, CASE WHEN k <= 5 THEN 'support' ELSE 'query' END AS role FROM (SELECT sample_id, writer_id, {_IN_WRITER} AS k, count(*) OVER (PARTITION BY writer_id) AS n FROM fx_samples) q
  WHERE n >= 8 AND least(n - 5, 6) >= 3 AND k <= 11""")
def writer_episodes(spark, d):
    return sampling.writer_episodes(fixture(spark, d, "fx_samples"), 5, 6, 8).select("sample_id", "writer_id", "role")


@query(f"SELECT sample_id, CASE WHEN row_number() OVER (ORDER BY {_hash(42, 'sample_id')}, sample_id) <= 50 THEN 'support' ELSE 'query' END AS role FROM fx_samples WHERE cls IN ('click', 'view') AND text <> ''")
def support_query_split(spark, d):
    s = fixture(spark, d, "fx_samples").withColumn("cls", F.when(F.col("cls").isin("click", "view"), "text").otherwise("math"))
    return sampling.support_query_split(s).select("sample_id", "role")


@query(f"SELECT sample_id, writer_id, round FROM (SELECT sample_id, writer_id, {_IN_WRITER} AS round FROM fx_samples) q ORDER BY round, writer_id LIMIT 300")
def round_robin_sample(spark, d):
    return sampling.round_robin_sample(fixture(spark, d, "fx_samples"), "writer_id", 300).select("sample_id", "writer_id", "round")


@query(f"SELECT lecture, slide, region FROM (SELECT lecture, slide, region FROM fx_results WHERE type = 'math' ORDER BY {_hash(42, 'lecture, slide, region')}, lecture, slide, region LIMIT 100) q")
def fixed_sample(spark, d):
    key = ["lecture", "slide", "region"]
    return sampling.fixed_sample(fixture(spark, d, "fx_results").where("type = 'math'").select(*key), 100, key, key)


@query(f"SELECT sample_id, cls FROM (SELECT sample_id, cls, row_number() OVER (PARTITION BY cls ORDER BY {_hash(42, 'sample_id')}, sample_id) AS k FROM fx_samples) q WHERE k <= 40")
def cap_per_group(spark, d):
    return sampling.cap_per_group(fixture(spark, d, "fx_samples"), 40, "cls", "sample_id").select("sample_id", "cls")


@query(f"SELECT sample_id FROM (SELECT sample_id, {_RANK} AS r FROM fx_samples) q WHERE r <= 250")
def uniform_sample(spark, d):
    return sampling.uniform_sample(fixture(spark, d, "fx_samples"), 250, "sample_id").select("sample_id")


_FLIPPED = """SELECT image_id, gt_id, CASE WHEN image_id % 3 = 0 THEN CASE WHEN cls = 0 THEN '1' ELSE '0' END ELSE concat('', cls) END AS cls, CASE WHEN image_id % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM fx_gt"""


@query(f"""WITH i AS (SELECT image_id, row_number() OVER (ORDER BY {_hash(42, 'image_id')}, image_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT image_id FROM fx_gt) d)
  SELECT f.image_id, gt_id, cls, source, CASE WHEN r <= greatest(1, floor(n * CAST(0.2 AS DOUBLE))) THEN 'val' ELSE 'train' END AS split FROM ({_FLIPPED}) f JOIN i ON f.image_id = i.image_id""")
def merge_annotation_sets(spark, d):
    gt = fixture(spark, d, "fx_gt").select("image_id", "gt_id", F.col("cls").cast("string").alias("cls"))
    return sampling.merge_annotation_sets(gt.where("image_id % 3 <> 0"), gt.where("image_id % 3 = 0"), 0.2, "image_id")
