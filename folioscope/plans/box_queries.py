"""Queries of box algebra, box filters and spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.functions import boxes
from folioscope.functions.ranks import global_rank
from folioscope.operators import filters, joins
from folioscope.plans.registry import fixture, query, rounded

W, H = 1000, 600


def _gt(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_gt").withColumns({"img_w": F.lit(W), "img_h": F.lit(H)})


def _pred(spark: SparkSession, d: str) -> DataFrame:
    return fixture(spark, d, "fx_pred").withColumns({"img_w": F.lit(W), "img_h": F.lit(H), "det_id": F.col("pred_id")})


def _xywh(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": F.col("x1"), "y": F.col("y1"), "w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})


_YOLO = f"""greatest(0, least((x1 + (x2 - x1) / 2) / {W}, 1)) AS cx, greatest(0, least((y1 + (y2 - y1) / 2) / {H}, 1)) AS cy,
  greatest(0, least((x2 - x1) / {W}, 1)) AS bw, greatest(0, least((y2 - y1) / {H}, 1)) AS bh"""


@query(f"SELECT image_id, gt_id, round(cx, 6) AS cx, round(cy, 6) AS cy, round(bw, 6) AS bw, round(bh, 6) AS bh FROM (SELECT *, {_YOLO} FROM fx_gt) q WHERE bw >= 0.001 AND bh >= 0.001")
def coco_to_yolo(spark, d):
    return rounded(boxes.coco_to_yolo(_xywh(_gt(spark, d))).select("image_id", "gt_id", "cx", "cy", "bw", "bh"), "cx", "cy", "bw", "bh")


@query(f"""SELECT image_id, gt_id, round((cx - bw / 2) * {W}, 6) AS x1, round((cy - bh / 2) * {H}, 6) AS y1, round((cx + bw / 2) * {W}, 6) AS x2, round((cy + bh / 2) * {H}, 6) AS y2
  FROM (SELECT image_id, gt_id, {_YOLO} FROM fx_gt) q WHERE bw >= 0.001 AND bh >= 0.001""")
def yolo_to_xyxy(spark, d):
    yolo = boxes.coco_to_yolo(_xywh(_gt(spark, d))).select("image_id", "gt_id", "cx", "cy", "bw", "bh", "img_w", "img_h")
    return rounded(boxes.yolo_to_xyxy(yolo).select("image_id", "gt_id", "x1", "y1", "x2", "y2"), "x1", "y1", "x2", "y2")


@query(f"""SELECT image_id, pred_id, greatest(0, CAST(trunc(x1) AS INT) - 8) AS cx1, greatest(0, CAST(trunc(y1) AS INT) - 8) AS cy1,
  least({W}, CAST(trunc(x2) AS INT) + 8) AS cx2, least({H}, CAST(trunc(y2) AS INT) + 8) AS cy2 FROM fx_pred""")
def clip_box(spark, d):
    return boxes.clip_box(_pred(spark, d), 8).select("image_id", "pred_id", "cx1", "cy1", "cx2", "cy2")


@query(f"""SELECT image_id, gt_id, round((x2 - x1) * (y2 - y1), 6) AS area, round((y2 - y1) / greatest(x2 - x1, 1), 6) AS aspect,
  round((x2 - x1) * (y2 - y1) / ({W} * {H}), 6) AS area_frac, (y2 - y1) > {H} * CAST(0.05 AS DOUBLE) AND (y2 - y1) / greatest(x2 - x1, 1) > 0.15 AS is_multiline FROM fx_gt""")
def box_features(spark, d):
    return rounded(boxes.box_features(_gt(spark, d)).select("image_id", "gt_id", "area", "aspect", "area_frac", "is_multiline"), "area", "aspect", "area_frac")


_INTER = "greatest(0, least(p.x2, g.x2) - greatest(p.x1, g.x1)) * greatest(0, least(p.y2, g.y2) - greatest(p.y1, g.y1))"
_AP, _AG = "((p.x2 - p.x1) * (p.y2 - p.y1))", "((g.x2 - g.x1) * (g.y2 - g.y1))"
_IOU = f"CASE WHEN {_AP} + {_AG} - {_INTER} > 0 THEN {_INTER} / ({_AP} + {_AG} - {_INTER}) ELSE 0 END"
_SAME = "FROM fx_pred p JOIN fx_gt g ON p.image_id = g.image_id AND p.cls = g.cls"


@query(f"SELECT p.image_id, p.pred_id, g.gt_id, round({_IOU}, 6) AS iou {_SAME}")
def iou(spark, d):
    pairs = joins.iou_join(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt"))
    return pairs.select("image_id", F.col("a_pred_id").alias("pred_id"), F.col("b_gt_id").alias("gt_id"), F.round("iou", 6).alias("iou"))


@query(f"SELECT p.image_id, p.pred_id, g.gt_id, round({_INTER} / least(greatest({_AP}, 1), greatest({_AG}, 1)), 6) AS overlap_min {_SAME}")
def overlap_min(spark, d):
    pairs = joins.iou_join(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt"))
    return pairs.select("image_id", F.col("a_pred_id").alias("pred_id"), F.col("b_gt_id").alias("gt_id"), F.round(boxes.overlap_min(), 6).alias("overlap_min"))


@query(f"SELECT p.image_id, p.pred_id, g.gt_id, round(CASE WHEN {_AP} > 0 THEN {_INTER} / {_AP} ELSE 0 END, 6) AS coverage {_SAME}")
def coverage(spark, d):
    pairs = joins.iou_join(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt"))
    return pairs.select("image_id", F.col("a_pred_id").alias("pred_id"), F.col("b_gt_id").alias("gt_id"), F.round(boxes.coverage(), 6).alias("coverage"))


@query(f"""SELECT image_id, gt_id, pad_x, pad_y, round(x1 * s + pad_x, 6) AS lx1, round(y1 * s + pad_y, 6) AS ly1, round(x1, 6) AS ux1 FROM (
  SELECT *, CAST(floor((640 - CAST(trunc({W} * s) AS INT)) / 2.0) AS INT) AS pad_x, CAST(floor((640 - CAST(trunc({H} * s) AS INT)) / 2.0) AS INT) AS pad_y
  FROM (SELECT *, least(640 / CAST({W} AS DOUBLE), 640 / CAST({H} AS DOUBLE)) AS s FROM fx_gt) a) q""")
def letterbox_boxes(spark, d):
    out = boxes.unletterbox_boxes(boxes.letterbox_boxes(_gt(spark, d), 640, 640))
    return rounded(out.select("image_id", "gt_id", "pad_x", "pad_y", "lx1", "ly1", "ux1"), "lx1", "ly1", "ux1")


@query("""SELECT image_id, 640 AS new_w, CAST(trunc(h * (640 / CAST(w AS DOUBLE))) AS INT) AS new_h FROM fx_images""")
def resize_dims(spark, d):
    images = fixture(spark, d, "fx_images").select("image_id", F.col("w").alias("img_w"), F.col("h").alias("img_h"))
    return boxes.resize_dims(images, 640, None).select("image_id", "new_w", "new_h")


@query("""SELECT image_id, CAST(ty1 AS INT) AS ty1, CAST(tx1 AS INT) AS tx1, CAST(least(tx1 + 400, w) AS INT) AS tx2, CAST(least(ty1 + 300, h) AS INT) AS ty2
  FROM (SELECT *, unnest(generate_series(0, w - 1, 300)) AS tx1 FROM (SELECT *, unnest(generate_series(0, h - 1, 225)) AS ty1 FROM fx_images) a) b""")
def tile_grid(spark, d):
    images = fixture(spark, d, "fx_images").select("image_id", F.col("w").alias("img_w"), F.col("h").alias("img_h"))
    return boxes.tile_grid(images, 300, 400, 0.25).select("image_id", "ty1", "tx1", "tx2", "ty2")


_CLASSES = {"click": 0, "view": 0, "purchase": 1, "error": None}


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 1 ELSE 0 END AS cls FROM events WHERE event_type IN ('click', 'view', 'purchase')")
def map_classes(spark, d):
    events = spark.read.parquet(f"{d}/events.parquet")
    return boxes.map_classes(events, _CLASSES, "event_type").select("event_id", "cls")


@query("""SELECT sample_id, CASE WHEN source = 'new' THEN CASE WHEN cls = '0' THEN '1' ELSE '0' END ELSE cls END AS cls, source
  FROM (SELECT sample_id, CASE cls WHEN 'click' THEN '0' WHEN 'view' THEN '1' ELSE 'x' END AS cls, CASE WHEN length(sample_id) % 2 = 0 THEN 'new' ELSE 'old' END AS source FROM fx_samples) q""")
def flip_classes(spark, d):
    s = fixture(spark, d, "fx_samples")
    cls = F.when(F.col("cls") == "click", "0").when(F.col("cls") == "view", "1").otherwise("x")
    return boxes.flip_classes(s.select("sample_id", cls.alias("cls"), F.when(F.length("sample_id") % 2 == 0, "new").otherwise("old").alias("source")))


@query("SELECT stem, regexp_replace(regexp_replace(stem, '^[0-9a-fA-F]{8}-', ''), '(_[pP]\\d+|_page[-_]?\\d+|page-\\d+)$', '') AS lecture FROM fx_slides".replace("\\\\", "\\"))
def lecture_key(spark, d):
    return fixture(spark, d, "fx_slides").select("stem", boxes.lecture_key(F.col("stem")).alias("lecture"))


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"))


@query("SELECT o_orderkey, concat_ws('-', 'a01', o_orderkey % 100) AS form FROM orders")
def form_id(spark, d):
    return _orders(spark, d).select("o_orderkey", boxes.form_id(F.concat_ws("-", F.lit("a01"), F.col("k") % 100, F.col("c") % 7)).alias("form"))


@query("SELECT o_orderkey, concat('', 10000 + o_custkey) AS writer FROM orders")
def writer_xml_id(spark, d):
    return _orders(spark, d).select("o_orderkey", boxes.writer_xml_id(F.col("c").cast("string")).alias("writer"))


@query("SELECT o_orderkey, concat('deck_', o_orderkey) AS slug FROM orders")
def slug(spark, d):
    return _orders(spark, d).select("o_orderkey", boxes.slug(F.concat(F.lit("in/deck "), F.col("k"), F.lit("_kommentiert.pdf"))).alias("slug"))


@query("SELECT o_orderkey, concat('p', o_orderkey, '.png') AS base FROM orders")
def basename(spark, d):
    return _orders(spark, d).select("o_orderkey", boxes.basename(F.concat(F.lit("x/y/p"), F.col("k"), F.lit(".png"))).alias("base"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN concat('Topic ', o_custkey) ELSE concat('dir', o_orderkey) END AS title FROM orders")
def note_title(spark, d):
    note = F.when(F.col("k") % 2 == 0, F.concat(F.lit("intro\n# 03 — Topic "), F.col("c"), F.lit("\nmore"))).otherwise(F.lit("no heading"))
    return _orders(spark, d).select("o_orderkey", boxes.note_title(note, F.concat(F.lit("dir"), F.col("k"))).alias("title"))


@query(f"""SELECT image_id, pred_id, label AS cls, round(score, 6) AS score, round((cx - w / 2) * {W}, 6) AS x1, round((cy - h / 2) * {H}, 6) AS y1 FROM (
  SELECT *, 1 / (exp(a - m) + exp(b - m) + exp(c - m)) AS score, CASE WHEN a = m THEN 0 WHEN b = m THEN 1 ELSE 2 END AS label FROM (
    SELECT *, greatest(a, b, c) AS m FROM (
      SELECT image_id, pred_id, score * 3 AS a, x1 / 300 AS b, y1 / 200 AS c, x1 / {W} AS cx, y1 / {H} AS cy, (x2 - x1) / {W} AS w, (y2 - y1) / {H} AS h FROM fx_pred) r) s) t
  WHERE score >= 0.5 AND label < 2""")
def decode_detections(spark, d):
    p = _pred(spark, d)
    logits = F.array(F.col("score") * 3, F.col("x1") / 300, F.col("y1") / 200)
    raw = p.select(
        "image_id", "pred_id", logits.alias("logits"), (F.col("x1") / W).alias("cx"), (F.col("y1") / H).alias("cy"), ((F.col("x2") - F.col("x1")) / W).alias("bw"),
        ((F.col("y2") - F.col("y1")) / H).alias("bh"), "img_w", "img_h",
    )
    out = boxes.decode_detections(raw, ["Text", "Formula", "Table"], {"Text": 0, "Formula": 1}, 0.5)
    return rounded(out.select("image_id", "pred_id", "cls", "score", "x1", "y1"), "score", "x1", "y1")


@query("""SELECT row_number() OVER (ORDER BY image_id, pred_id) AS ann_id, image_id, CASE WHEN cls = 0 THEN 0 ELSE 1 END AS category_id, x1 AS x, y1 AS y, x2 - x1 AS w, y2 - y1 AS h,
  round((x2 - x1) * (y2 - y1), 6) AS area, 0 AS iscrowd, false AS verified FROM fx_pred""")
def detections_to_coco(spark, d):
    ranked = global_rank(fixture(spark, d, "fx_pred"), F.floor(F.col("image_id") / 256), ["image_id", "pred_id"], "ann_id")
    return rounded(boxes.detections_to_coco(ranked), "area")


@query("SELECT image_id, gt_id FROM fx_gt WHERE (x2 - x1) * (y2 - y1) >= 4000")
def min_area(spark, d):
    return filters.min_area(_gt(spark, d), 4000).select("image_id", "gt_id")


@query("SELECT image_id, pred_id, round(score, 6) AS score FROM fx_pred WHERE score >= 0.25")
def min_score(spark, d):
    return rounded(filters.min_score(_pred(spark, d), 0.25).select("image_id", "pred_id", "score"), "score")


@query("""SELECT image_id, gt_id FROM fx_gt WHERE NOT (((x2 - x1) * (y2 - y1) / (300 * 100) > 0.5 AND (y2 - y1) / greatest(x2 - x1, 1) > 0.4)
  OR (x2 - x1 > 300 * CAST(0.95 AS DOUBLE) AND y2 - y1 > 100 * CAST(0.4 AS DOUBLE)))""")
def prune_oversized(spark, d):
    small = _gt(spark, d).withColumns({"img_w": F.lit(300), "img_h": F.lit(100)})
    return filters.prune_oversized(boxes.box_features(small)).select("image_id", "gt_id")


@query(f"SELECT image_id, gt_id FROM fx_gt WHERE NOT (x2 - x1 >= {W} * CAST(0.20 AS DOUBLE) AND (y1 <= {H} * CAST(0.045 AS DOUBLE) OR y2 >= {H} * CAST(0.96 AS DOUBLE)))")
def drop_header_band(spark, d):
    return filters.drop_header_band(_gt(spark, d)).select("image_id", "gt_id")


_FEATURES = """SELECT concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS det_id, l_orderkey AS image_id, l_partkey % 40 AS h, l_suppkey % 90 AS w, l_partkey % 900 AS n_fg, 1000 AS total,
  l_quantity * 3 AS n_stroke, l_discount * 8 AS cv, l_extendedprice / 10 AS lap, CAST(0.9 AS DOUBLE) + l_tax AS bg, l_discount AS area_frac, l_tax * 30 AS aspect, l_discount * 5 AS black_frac FROM lineitem"""


def features(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_FEATURES.replace("FROM lineitem", "FROM {lineitem}"), lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))


_TYPESET = f"""SELECT image_id, det_id FROM ({_FEATURES}) f WHERE h >= 12 AND w >= 12 AND n_fg >= 80 AND n_fg <= total * CAST(0.6 AS DOUBLE) AND n_stroke >= 50
  AND ((cv < 0.45 AND lap > 1500) OR lap > 2000 OR (bg > 0.99 AND cv < 0.43))"""


@query(_TYPESET)
def is_typeset(spark, d):
    return features(spark, d).where(filters.is_typeset()).select("image_id", "det_id")


@query(f"SELECT image_id, det_id FROM ({_FEATURES}) f WHERE NOT (area_frac > 0.08 AND aspect > 0.6 AND aspect < 1.7 AND black_frac > 0.25)")
def is_likely_handwriting(spark, d):
    return features(spark, d).where(filters.is_likely_handwriting()).select("image_id", "det_id")


_CANDS = f"""SELECT image_id, gt_id AS cand_id, x1 + 30 AS x1, y1 + 10 AS y1, x2 + 30 AS x2, y2 + 10 AS y2, {W} AS img_w, {H} AS img_h, CAST(cls + 1 AS DOUBLE) / 100 AS ink,
  (x1 / 100) / 80 AS grey, (y1 / 100) / 20 AS edge FROM fx_gt"""


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_CANDS.replace("FROM fx_gt", "FROM {gt}"), gt=fixture(spark, d, "fx_gt"))


@query(f"""WITH c AS ({_CANDS}), k AS (SELECT image_id, cand_id, greatest(0, x1 - 8) AS x1, greatest(0, y1 - 8) AS y1, least({W}, x2 + 8) AS x2, least({H}, y2 + 8) AS y2, ink, grey, edge FROM c
  WHERE (x2 - x1) * (y2 - y1) / ({W} * {H}) BETWEEN 0.0008 AND 0.55 AND (y2 - y1) / greatest(x2 - x1, 1) >= 0.02 AND x2 - x1 <= {W} * CAST(0.85 AS DOUBLE))
  SELECT image_id, cand_id, round(x1, 6) AS x1, round(y2, 6) AS y2, 0.5 AS score, 'ink_detector' AS source FROM k p WHERE ink >= 0.005 AND grey <= 0.10 AND NOT (edge > 0.12 AND ink > 0.18)
  AND NOT EXISTS (SELECT 1 FROM fx_pred g WHERE g.image_id = p.image_id AND {_AP} > 0 AND {_INTER} / {_AP} > 0.6)""".replace("0.5 AS score", "CAST(0.5 AS DOUBLE) AS score"))
def filter_ink_candidates(spark, d):
    out = filters.filter_ink_candidates(candidates(spark, d), _pred(spark, d))
    return rounded(out.select("image_id", "cand_id", "x1", "y2", "score", "source"), "x1", "y2")


@query("SELECT DISTINCT p.o_orderkey AS image_id FROM orders p WHERE EXISTS (SELECT 1 FROM fx_gt g WHERE g.image_id = p.o_orderkey AND g.cls = 1)")
def images_with_valid_annotation(spark, d):
    images = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("image_id"))
    return filters.images_with_valid_annotation(images, fixture(spark, d, "fx_gt").where("cls = 1")).distinct()


@query(f"SELECT p.image_id, p.cls, p.pred_id, g.gt_id, round({_IOU}, 6) AS iou {_SAME} WHERE {_IOU} > 0.5")
def iou_join(spark, d):
    pairs = joins.iou_join(fixture(spark, d, "fx_pred"), fixture(spark, d, "fx_gt")).where("iou > 0.5")
    return rounded(pairs.select("image_id", "cls", F.col("a_pred_id").alias("pred_id"), F.col("b_gt_id").alias("gt_id"), "iou"), "iou")


@query(f"""SELECT image_id, pred_id FROM fx_pred p WHERE coalesce((SELECT sum(CASE WHEN {_AP} > 0 THEN {_INTER} / {_AP} ELSE 0 END) FROM fx_gt g WHERE g.image_id = p.image_id), 0) <= 1.5""")
def coverage_anti_join(spark, d):
    return joins.coverage_anti_join(_pred(spark, d), fixture(spark, d, "fx_gt"), 1.5, "sum").select("image_id", "pred_id")


_BOUNDS = """SELECT p.image_id, p.pred_id, min(q.x) AS l, min(q.y) AS t, max(q.x) AS r, max(q.y) AS b FROM {src} p JOIN fx_points q ON p.image_id = q.image_id
  AND q.x >= p.x1 - {m} AND q.x <= p.x2 + {m} AND q.y >= p.y1 - {m} AND q.y <= p.y2 + {m} GROUP BY 1, 2"""


@query(f"""WITH k AS ({_BOUNDS.format(src="fx_pred", m=0)}) SELECT p.image_id, p.pred_id, round(CASE WHEN l IS NOT NULL THEN greatest(x1, l - 2) END, 6) AS ix1,
  round(CASE WHEN l IS NOT NULL THEN least(y2, b + 2) END, 6) AS iy2 FROM fx_pred p LEFT JOIN k ON p.image_id = k.image_id AND p.pred_id = k.pred_id""")
def ink_bounds(spark, d):
    return rounded(joins.ink_bounds(_pred(spark, d), fixture(spark, d, "fx_points")).select("image_id", "pred_id", "ix1", "iy2"), "ix1", "iy2")


@query(f"""WITH c AS (SELECT image_id, pred_id, trunc(x1) AS x1, trunc(y1) AS y1, trunc(x2) AS x2, trunc(y2) AS y2 FROM fx_pred), k AS ({_BOUNDS.format(src="c", m=14)})
  SELECT p.image_id, p.pred_id, CASE WHEN l IS NULL THEN p.x1 ELSE least(c.x1, l) END AS x1, CASE WHEN l IS NULL THEN p.y1 ELSE least(c.y1, t) END AS y1,
  CASE WHEN l IS NULL THEN p.x2 ELSE greatest(c.x2, r) END AS x2, CASE WHEN l IS NULL THEN p.y2 ELSE greatest(c.y2, b) END AS y2
  FROM fx_pred p JOIN c ON p.image_id = c.image_id AND p.pred_id = c.pred_id LEFT JOIN k ON p.image_id = k.image_id AND p.pred_id = k.pred_id""")
def refine_boxes(spark, d):
    return joins.refine_boxes(_pred(spark, d), fixture(spark, d, "fx_points")).select("image_id", "pred_id", "x1", "y1", "x2", "y2")


@query(f"""SELECT g.image_id, g.gt_id, CAST(t.ty1 AS INT) AS ty1, CAST(t.tx1 AS INT) AS tx1, round(g.x1 - t.tx1, 6) AS lx1, round(g.y2 - t.ty1, 6) AS ly2 FROM fx_gt g
  JOIN (SELECT a.ty1, b.tx1 FROM (SELECT unnest(generate_series(0, {H - 1}, 225)) AS ty1) a CROSS JOIN (SELECT unnest(generate_series(0, {W - 1}, 300)) AS tx1) b) t
  ON g.x1 < t.tx1 + 400 AND g.x2 > t.tx1 AND g.y1 < t.ty1 + 300 AND g.y2 > t.ty1""")
def tile_boxes(spark, d):
    return rounded(joins.tile_boxes(_gt(spark, d), 300, 400, 0.25).select("image_id", "gt_id", "ty1", "tx1", "lx1", "ly2"), "lx1", "ly2")
