"""Queries of per-image matching and merging, and of average precision."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import aggregates, matching
from folioscope.plans.box_queries import _AP, _INTER, _IOU, _SAME, _pred
from folioscope.plans.registry import fixture, query, rounded


def _iou_of(a: str, b: str) -> str:
    inter = f"greatest(0, least({a}.x2, {b}.x2) - greatest({a}.x1, {b}.x1)) * greatest(0, least({a}.y2, {b}.y2) - greatest({a}.y1, {b}.y1))"
    size = lambda x: f"({x}.x2 - {x}.x1) * ({x}.y2 - {x}.y1)"
    return f"{inter} / ({size(a)} + {size(b)} - {inter})"


@query(f"""WITH RECURSIVE ranked AS (SELECT image_id, {{'id': pred_id, 'cls': cls, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} AS b, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, pred_id) AS k FROM fx_pred),
  step AS (SELECT image_id, k, [b] AS kept FROM ranked WHERE k = 1 UNION ALL
    SELECT s.image_id, r.k, CASE WHEN len(list_filter(s.kept, z -> {_iou_of("z", "r.b")} > 0.45)) > 0 THEN s.kept ELSE list_append(s.kept, r.b) END FROM step s JOIN ranked r ON r.image_id = s.image_id AND r.k = s.k + 1)
  SELECT image_id, z.id AS det_id, z.cls, z.score, z.x1, z.y1, z.x2, z.y2 FROM (SELECT image_id, unnest(kept) AS z FROM (SELECT image_id, max_by(kept, k) AS kept FROM step GROUP BY image_id) m) u""")
def nms(spark, d):
    return matching.nms(_pred(spark, d).select("image_id", "det_id", "cls", "score", "x1", "y1", "x2", "y2"), 0.45)


_BOX = "{'id': pred_id, 'cls': cls, 'score': score, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}"
_FIELDS = "b.id AS det_id, b.cls, b.score, b.x1, b.y1, b.x2, b.y2"
_GROWN = "{'id': a.b.id, 'cls': a.b.cls, 'score': a.b.score, 'x1': least(a.b.x1, x.b.x1), 'y1': least(a.b.y1, x.b.y1), 'x2': greatest(a.b.x2, x.b.x2), 'y2': greatest(a.b.y2, x.b.y2)}"
#: One seed after another: the others go by in order, those that fit are swallowed, the rest is left for the next seeds. {0}: whether x fits a.
_SWALLOW = f"""list_reduce(list_transform(todo[2:], lambda x: {{'b': x, 'rest': todo[1:0], 'n': 0}}), lambda a, x: CASE WHEN {{0}} THEN {{'b': {_GROWN}, 'rest': a.rest, 'n': a.n + 1}}
    ELSE {{'b': a.b, 'rest': list_append(a.rest, x.b), 'n': a.n}} END, {{'b': todo[1], 'rest': todo[1:0], 'n': 0}})"""


def _swallow(fits: str) -> str:
    return _SWALLOW.replace("{0}", fits)


@query(f"""WITH RECURSIVE g AS (SELECT image_id, list({_BOX} ORDER BY score DESC, pred_id) AS todo FROM fx_pred GROUP BY image_id),
  step AS (SELECT image_id, todo, todo[1] AS b, 0 AS k FROM g UNION ALL
    SELECT image_id, r.rest, r.b, k + 1 FROM (SELECT image_id, k, {_swallow(f"x.b.cls = a.b.cls AND {_iou_of('a.b', 'x.b')} >= 0.45")} AS r FROM step WHERE len(todo) > 0) q)
  SELECT image_id, {_FIELDS} FROM step WHERE k > 0""")
def merge_detections(spark, d):
    return matching.merge_detections(_pred(spark, d).select("image_id", "det_id", "cls", "score", "x1", "y1", "x2", "y2"))


_HEIGHTS = "(a.b.y2 - a.b.y1), (x.b.y2 - x.b.y1)"
_IN_ROW = f"""least({_HEIGHTS}) > 0 AND (least(a.b.y2, x.b.y2) - greatest(a.b.y1, x.b.y1)) / least({_HEIGHTS}) >= 0.5
    AND greatest(0, greatest(a.b.x1, x.b.x1) - least(a.b.x2, x.b.x2)) <= CAST(0.7 AS DOUBLE) * ({_HEIGHTS.replace(',', ' +')}) / 2"""


@query(f"""WITH RECURSIVE g AS (SELECT image_id, list({_BOX} ORDER BY x1, pred_id) AS todo FROM fx_pred WHERE cls = 1 GROUP BY image_id),
  step AS (SELECT image_id, todo, todo[1:0] AS outs, false AS changed, false AS done FROM g UNION ALL
    SELECT image_id, CASE WHEN len(rest) > 0 THEN rest WHEN changed THEN list_transform(list_sort(list_transform(outs, lambda x, i: {{'x1': x.x1, 'i': i, 'b': x}})), lambda x: x.b) ELSE rest END,
      CASE WHEN len(rest) = 0 AND changed THEN rest ELSE outs END, len(rest) > 0 AND changed, len(rest) = 0 AND NOT changed
    FROM (SELECT image_id, r.rest AS rest, list_append(outs, r.b) AS outs, changed OR r.n > 0 AS changed FROM (SELECT *, {_swallow(_IN_ROW)} AS r FROM step WHERE len(todo) > 0) q) p)
  SELECT image_id, {_FIELDS} FROM (SELECT image_id, unnest(outs) AS b FROM step WHERE done) u UNION ALL SELECT image_id, pred_id, cls, score, x1, y1, x2, y2 FROM fx_pred WHERE cls <> 1""")
def merge_row_fragments(spark, d):
    return matching.merge_row_fragments(_pred(spark, d).select("image_id", "det_id", "cls", "score", "x1", "y1", "x2", "y2"))


def results(spark, d):
    """Regions with texts: predictions, every second one of maths, texts of few kinds."""
    p = _pred(spark, d)
    part = F.split("pred_id", "-")
    j = (part[0].cast("long") * 31 + part[1].cast("long") * 17 + part[2].cast("long") * 7) % 7
    text = F.concat(F.lit("die Ableitung der Funktion "), F.when(j < 4, F.lit("nach x")).otherwise(F.lit("nach xy")), F.when(j % 2 == 0, F.lit(" ist stetig")).otherwise(F.lit("")))
    math = F.col("cls") == 1
    return p.select("image_id", "det_id", F.when(math, "math").otherwise("text").alias("type"), "score", "x1", "y1", "x2", "y2", F.when(math, "").otherwise(text).alias("text"), (math & (j != 3)).alias("rendered"))


_SIZE = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
_SHARED = "greatest(0, least(p.x2, q.x2) - greatest(p.x1, q.x1)) * greatest(0, least(p.y2, q.y2) - greatest(p.y1, q.y1))"
_RESULTS = """SELECT image_id, pred_id AS det_id, CASE WHEN cls = 1 THEN 'math' ELSE 'text' END AS type, score, x1, y1, x2, y2,
    CASE WHEN cls = 1 THEN '' ELSE concat('die Ableitung der Funktion ', CASE WHEN j < 4 THEN 'nach x' ELSE 'nach xy' END, CASE WHEN j % 2 = 0 THEN ' ist stetig' ELSE '' END) END AS text,
    cls = 1 AND j <> 3 AS rendered FROM (SELECT *, (l1 * 31 + l2 * 17 + l3 * 7) % 7 AS j FROM (SELECT *, CAST(split_part(pred_id, '-', 1) AS BIGINT) AS l1, CAST(split_part(pred_id, '-', 2) AS BIGINT) AS l2,
    CAST(split_part(pred_id, '-', 3) AS BIGINT) AS l3 FROM fx_pred) i) o"""
#: Texts are lower-cased without double spaces; all are longer than 8, so a truncation is what the longer one holds, or a shared head of 0.6.
_SAME_TEXT = """(1 - levenshtein(p.text, q.text) / CAST(greatest(length(p.text), length(q.text)) AS DOUBLE) >= 0.8 OR (length(p.text) <> length(q.text) AND (contains(p.text, q.text) OR contains(q.text, p.text)
    OR left(p.text, CAST(ceil(0.6 * least(length(p.text), length(q.text))) AS INT)) = left(q.text, CAST(ceil(0.6 * least(length(p.text), length(q.text))) AS INT)))))"""


@query(f"""WITH RECURSIVE r AS ({_RESULTS}), t AS (SELECT image_id, det_id, score, x1, y1, x2, y2, lower(text) AS text FROM r WHERE type = 'text'),
  links AS (SELECT p.image_id, p.det_id AS a, q.det_id AS b, (length(q.text), q.score, {_SIZE.format("q")}) > (length(p.text), p.score, {_SIZE.format("p")}) AS b_wins,
      row_number() OVER (PARTITION BY p.image_id ORDER BY p.det_id, q.det_id) AS k FROM t p JOIN t q ON p.image_id = q.image_id AND p.det_id < q.det_id
    WHERE {_SHARED} / least(greatest({_SIZE.format("p")}, 1), greatest({_SIZE.format("q")}, 1)) >= 0.05 AND {_SAME_TEXT}),
  step AS (SELECT image_id, 0 AS k, CAST([] AS VARCHAR[]) AS gone FROM (SELECT DISTINCT image_id FROM links) i UNION ALL
    SELECT s.image_id, l.k, CASE WHEN list_contains(s.gone, l.a) OR list_contains(s.gone, l.b) THEN s.gone WHEN l.b_wins THEN list_append(s.gone, l.a) ELSE list_append(s.gone, l.b) END
    FROM step s JOIN links l ON l.image_id = s.image_id AND l.k = s.k + 1),
  out AS (SELECT image_id, unnest(gone) AS det_id FROM (SELECT image_id, max_by(gone, k) AS gone FROM step GROUP BY image_id) m)
  SELECT r.* FROM r LEFT JOIN out ON r.image_id = out.image_id AND r.det_id = out.det_id WHERE out.det_id IS NULL""")
def dedupe_text(spark, d):
    return matching.dedupe_text(results(spark, d))


@query(f"""SELECT image_id, pred_id FROM fx_pred p WHERE cls = 1 OR coalesce((SELECT sum(CASE WHEN {_AP} > 0 THEN {_INTER} / {_AP} ELSE 0 END) FROM fx_pred g
  WHERE g.image_id = p.image_id AND g.cls = 1), 0) <= 0.5""")
def drop_text_covered_by_math(spark, d):
    r = results(spark, d).withColumn("rendered", F.col("type") == "math")
    return matching.drop_text_covered_by_math(r).select("image_id", F.col("det_id").alias("pred_id"))


_BEST = f"SELECT p.image_id, p.cls, p.pred_id, g.gt_id, {_IOU} AS iou, row_number() OVER (PARTITION BY p.image_id, p.pred_id ORDER BY {_IOU} DESC, g.gt_id) AS k {_SAME}"


@query(f"SELECT image_id, cls, pred_id, gt_id, round(iou, 6) AS iou FROM ({_BEST}) q WHERE k = 1 AND iou > 0.5")
def best_gt_match(spark, d):
    return rounded(matching.best_gt_match(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt")), "iou")


_ASSIGNED = f"""WITH pairs AS (SELECT p.image_id, p.cls, p.pred_id, p.score, g.gt_id, CASE WHEN g.gt_id IS NULL THEN 0 ELSE {_IOU} END AS iou
    FROM fx_pred p LEFT JOIN fx_gt g ON p.image_id = g.image_id AND p.cls = g.cls),
  best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, pred_id ORDER BY iou DESC, gt_id NULLS FIRST) AS k FROM pairs) q WHERE k = 1)"""
_TP = "iou >= {t} AND row_number() OVER (PARTITION BY image_id, cls, gt_id, iou >= {t}{x} ORDER BY score DESC, pred_id) = 1"


@query(f"{_ASSIGNED} SELECT image_id, cls, pred_id, round(iou, 6) AS iou, {_TP.format(t='0.5', x='')} AS tp FROM best")
def tp_fp_assign(spark, d):
    out = matching.tp_fp_assign(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt"), 0.5)
    return rounded(out.select("image_id", "cls", "pred_id", "iou", "tp"), "iou")


@query(f"""WITH RECURSIVE p AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY pred_id) AS i FROM fx_pred), g AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY gt_id) AS j FROM fx_gt),
  pairs AS (SELECT image_id, i, j, row_number() OVER (PARTITION BY image_id ORDER BY iou DESC, i DESC, j DESC) AS k FROM (SELECT p.image_id, i, j, {_iou_of("p", "g")} AS iou FROM p JOIN g ON p.image_id = g.image_id AND p.cls = g.cls) q WHERE iou >= 0.5),
  step AS (SELECT image_id, 0 AS k, CAST([] AS BIGINT[]) AS us, CAST([] AS BIGINT[]) AS vs FROM (SELECT DISTINCT image_id FROM pairs) z UNION ALL
    SELECT s.image_id, l.k, CASE WHEN list_contains(us, i) OR list_contains(vs, j) THEN us ELSE list_append(us, i) END, CASE WHEN list_contains(us, i) OR list_contains(vs, j) THEN vs ELSE list_append(vs, j) END
    FROM step s JOIN pairs l ON l.image_id = s.image_id AND l.k = s.k + 1),
  hits AS (SELECT image_id, max(len(us)) AS tp FROM step GROUP BY image_id), n AS (SELECT image_id, sum(p) AS n_p, sum(g) AS n_g FROM (SELECT image_id, 1 AS p, 0 AS g FROM fx_pred UNION ALL SELECT image_id, 0, 1 FROM fx_gt) b GROUP BY image_id)
  SELECT n.image_id, CAST(n_g AS BIGINT) AS n_gt, coalesce(tp, 0) AS tp, CAST(n_g - coalesce(tp, 0) AS BIGINT) AS fn, CAST(n_p - coalesce(tp, 0) AS BIGINT) AS fp FROM n LEFT JOIN hits ON n.image_id = hits.image_id""")
def greedy_match_counts(spark, d):
    return matching.greedy_match_counts(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt"))


@query("SELECT image_id, pred_id, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, pred_id) AS position FROM fx_pred")
def reading_order(spark, d):
    return matching.reading_order(_pred(spark, d)).select("image_id", "pred_id", "position")


@query("""WITH w AS (SELECT user_id AS region_id, 400 + user_id % 9 * 100 AS width FROM (SELECT DISTINCT user_id FROM events) u),
  a AS (SELECT p.region_id, p.row_no, CASE WHEN sum(ink) OVER (PARTITION BY p.region_id ORDER BY row_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
    >= greatest(width * CAST(0.005 AS DOUBLE), 3) * 7 THEN 1 ELSE 0 END AS inside FROM fx_profile p JOIN w ON p.region_id = w.region_id),
  b AS (SELECT *, max(row_no) OVER (PARTITION BY region_id) AS n, row_no - row_number() OVER (PARTITION BY region_id, inside ORDER BY row_no) AS island FROM a),
  c AS (SELECT region_id, island, min(row_no) AS s, max(row_no) + 1 AS e, max(n) AS n FROM b WHERE inside = 1 GROUP BY 1, 2)
  SELECT region_id, greatest(1, s - greatest(4, CAST(trunc((e - s) * CAST(0.1 AS DOUBLE)) AS INT))) AS start,
    CASE WHEN e = n + 1 THEN e ELSE least(n + 1, e + greatest(4, CAST(trunc((e - s) * CAST(0.1 AS DOUBLE)) AS INT))) END AS "end" FROM c WHERE e - s >= 5""")
def segment_profile(spark, d):
    widths = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("region_id")).distinct().withColumn("width", 400 + F.col("region_id") % 9 * 100)
    return matching.segment_profile(fixture(spark, d, "fx_profile"), widths, least=5)


_POINTS = ", ".join(f"max(CASE WHEN ct / CAST(n_gt AS DOUBLE) >= {i} * CAST(0.1 AS DOUBLE) THEN ct / (ct + cf + CAST(1e-9 AS DOUBLE)) END) AS p{i}" for i in range(11))
_SUM = " + ".join(f"coalesce(p{i}, 0)" for i in range(11))


@query(f"""{_ASSIGNED}, a AS (SELECT *, {_TP.format(t='0.5', x='')} AS tp FROM best), n AS (SELECT cls, count(*) AS n_gt FROM fx_gt GROUP BY cls),
  s AS (SELECT cls, score, count(*) FILTER (WHERE tp) AS t, count(*) FILTER (WHERE NOT tp) AS f FROM a GROUP BY cls, score),
  r AS (SELECT cls, CAST(sum(t) OVER w AS DOUBLE) AS ct, CAST(sum(f) OVER w AS DOUBLE) AS cf FROM s WINDOW w AS (PARTITION BY cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT r.cls, {_POINTS} FROM r JOIN n ON r.cls = n.cls GROUP BY r.cls)
  SELECT n.cls, round(({_SUM}) / 11, 6) AS ap, n_gt FROM n JOIN c ON n.cls = c.cls""")
def average_precision(spark, d):
    return rounded(aggregates.average_precision(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt")), "ap")


@query(f"""{_ASSIGNED}, ts AS (SELECT round(0.5 + 0.05 * i, 2) AS t FROM (SELECT unnest(range(10)) AS i) z),
  a AS (SELECT b.*, ts.t, iou >= ts.t AND row_number() OVER (PARTITION BY image_id, cls, gt_id, ts.t, iou >= ts.t ORDER BY score DESC, pred_id) = 1 AS tp FROM best b CROSS JOIN ts),
  n AS (SELECT cls, count(*) AS n_gt FROM fx_gt GROUP BY cls),
  s AS (SELECT t, cls, score, count(*) FILTER (WHERE tp) AS n_right, count(*) FILTER (WHERE NOT tp) AS n_wrong FROM a GROUP BY t, cls, score),
  r AS (SELECT t, cls, CAST(sum(n_right) OVER w AS DOUBLE) AS ct, CAST(sum(n_wrong) OVER w AS DOUBLE) AS cf FROM s WINDOW w AS (PARTITION BY t, cls ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
  c AS (SELECT r.t, r.cls, max(ct) AS ct, max(ct + cf) AS cn, {_POINTS} FROM r JOIN n ON r.cls = n.cls GROUP BY r.t, r.cls)
  SELECT CAST(t AS DOUBLE) AS t, c.cls, round(({_SUM}) / 11, 6) AS ap, round(ct / cn, 6) AS precision, round(ct / n_gt, 6) AS recall FROM c JOIN n ON c.cls = n.cls""")
def map_sweep(spark, d):
    return rounded(aggregates.map_sweep(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt")), "ap", "precision", "recall")


@query("""SELECT image_id, t, count(*) FILTER (WHERE score >= t AND cls = 0) AS n_text, count(*) FILTER (WHERE score >= t AND cls = 1) AS n_math,
  count(*) FILTER (WHERE score >= t) AS n_total, round(coalesce(avg(CASE WHEN score >= t THEN score END), 0), 6) AS mean_score
  FROM fx_pred CROSS JOIN (SELECT CAST(unnest([0.25, 0.5, 0.75]) AS DOUBLE) AS t) ts GROUP BY image_id, t""")
def class_counts_by_threshold(spark, d):
    return rounded(aggregates.class_counts_by_threshold(_pred(spark, d), [0.25, 0.5, 0.75], ["image_id"]), "mean_score")


@query("""SELECT split, cls, count(*) AS n FROM (SELECT CASE WHEN image_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, cls FROM fx_gt) q GROUP BY ROLLUP (split, cls)""")
def box_counts(spark, d):
    return aggregates.box_counts(fixture(spark, d, "fx_gt").select(F.when(F.col("image_id") % 5 == 0, "val").otherwise("train").alias("split"), "cls"))


