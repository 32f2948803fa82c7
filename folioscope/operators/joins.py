"""Joins of manifests, boxes and systems. Spatial joins are equi joins on squares of the image with the box test as a local condition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions import boxes


def build_text_manifest(images: DataFrame, transcripts: DataFrame, forms: DataFrame, writers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(line_id, image, text, writer_id of lines by the given writers; one-row count of images without transcript)."""
    found = images.join(transcripts, "line_id").withColumn("form", boxes.form_id(F.col("line_id")))
    found = found.join(forms, "form").join(writers, "writer_id", "left_semi")
    missing = images.join(transcripts, "line_id", "left_anti").agg(F.count(F.lit(1)).alias("n_without_transcript"))
    return found.select("line_id", "image", "text", "writer_id"), missing


def coco_join(images: DataFrame, anns: DataFrame, cats: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept boxes with class and normalised box; n_processed, n_skipped images and n_boxes)."""
    kept = boxes.coco_to_yolo(anns.join(cats, "category_id").join(images, "image_id"))
    per = images.select("image_id").join(kept.groupBy("image_id").agg(F.count(F.lit(1)).alias("n")), "image_id", "left")
    stats = per.agg(F.count("n").alias("n_processed"), F.count_if(F.col("n").isNull()).alias("n_skipped"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_boxes"))
    return kept, stats


def _prefixed(df: DataFrame, p: str, key: list[str]) -> DataFrame:
    return df.select(*(F.col(c) if c in key else F.col(c).alias(p + c) for c in df.columns))


def iou_join(pred: DataFrame, gt: DataFrame, same_class: bool = True, key: str = "image_id") -> DataFrame:
    """All pairs of boxes of one image (and class) with iou; the columns have the prefixes a_ and b_."""
    on = [key, "cls"] if same_class else [key]
    return _prefixed(pred, "a_", on).join(_prefixed(gt, "b_", on), on).withColumn("iou", boxes.iou())


#: Side of the squares by which crowded images are cut for joins.
CELL = 512


def tiled(df: DataFrame, box: tuple, cell: int = CELL) -> DataFrame:
    """df once for every square (_tx, _ty) that a box (four columns: left, top, right, bottom) meets."""
    x1, y1, x2, y2 = (F.floor(c / cell).cast("int") for c in box)
    rows = df.withColumn("_tx", F.explode(F.sequence(x1, F.greatest(x1, x2))))
    return rows.withColumn("_ty", F.explode(F.sequence(y1, F.greatest(y1, y2))))


def overlapping(a: DataFrame, b: DataFrame, on: list[str], cell: int = CELL) -> DataFrame:
    """Pairs of boxes that share area, each once; columns have the prefixes a_ and b_ but for `on`.

    Boxes meet in the squares of the image that they touch, so an image with many boxes is cut; a pair counts in the square that
    holds the corner of what it shares.
    """
    sides = [tiled(_prefixed(df, p, on), tuple(F.col(p + c) for c in ("x1", "y1", "x2", "y2")), cell) for df, p in ((a, "a_"), (b, "b_"))]
    left, top = (F.greatest(f"a_{c}", f"b_{c}") for c in ("x1", "y1"))
    pairs = sides[0].join(sides[1], [*on, "_tx", "_ty"]).where((F.floor(left / cell) == F.col("_tx")) & (F.floor(top / cell) == F.col("_ty")))
    return pairs.where((left < F.least("a_x2", "b_x2")) & (top < F.least("a_y2", "b_y2"))).drop("_tx", "_ty")


def coverage_anti_join(a: DataFrame, b: DataFrame, t: float, mode: str = "any", key: str = "image_id") -> DataFrame:
    """Rows of a that boxes of b of the same image don't cover beyond t (0 or more): at most by any one, or by the sum over all.

    Shared areas are added up before the division: sums of whole pixels are exact in any order of rows. Rows with equal boxes share their result, so ids may repeat.
    """
    box = [key, "x1", "y1", "x2", "y2"]
    agg = F.max if mode == "any" else F.sum
    own = [f"a_{c}" for c in box[1:]]
    shared = overlapping(a.select(*box).distinct(), b.select(*box), [key]).groupBy(key, *own).agg(agg(boxes.intersection("a_", "b_")).alias("c"))
    gone = shared.where((boxes.area("a_") > 0) & (F.col("c") / boxes.area("a_") > t)).select(key, *(F.col(f"a_{c}").alias(c) for c in box[1:]))
    return a.join(gone, box, "left_anti").select(*a.columns)


def restrict_to_split(images: DataFrame, anns: DataFrame, transcripts: DataFrame, split: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The parts of a dataset that belong to the file names of a split."""
    own = images.join(split.select("file_name"), "file_name", "left_semi")
    name = split.select(boxes.basename(F.col("file_name")).alias("_name")).distinct()
    texts = transcripts.withColumn("_name", boxes.basename(F.col("image"))).join(name, "_name", "left_semi").drop("_name")
    return own, anns.join(own, "image_id", "left_semi"), texts


def align_systems(scores: DataFrame, systems: list, key: str = "item", value: str = "cer") -> DataFrame:
    """One row an item with one column a system; raises when run if a system lacks an item."""
    n = len(systems)
    wide = scores.where(F.col("system").isin(systems)).groupBy(key).pivot("system", systems).agg(F.first(value))
    complete = sum((F.col(str(s)).isNotNull().cast("int") for s in systems), F.lit(0)) == n
    checked = F.when(complete, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("systems differ at "), F.col(key).cast("string"))).cast("boolean"))
    return wide.withColumn("_ok", checked).where("_ok").drop("_ok")


def pair_hyp_ref(hyp: DataFrame, ref: DataFrame, key: str) -> DataFrame:
    """Full outer pairing by key, with matched telling whether both sides are there."""
    both = hyp.select(key, "hyp", F.lit(True).alias("_h")).join(ref.select(key, "ref", F.lit(True).alias("_r")), key, "full_outer")
    return both.select(key, "hyp", "ref", (F.col("_h").isNotNull() & F.col("_r").isNotNull()).alias("matched"))


def side_by_side(scores: DataFrame, systems: list, key: str = "item", value: str = "cer") -> DataFrame:
    return scores.groupBy(key).pivot("system", systems).agg(F.first(value))


def pair_runs_with_logs(lectures: DataFrame, results: DataFrame, logs: DataFrame, key: str = "lecture") -> DataFrame:
    """key, reason: null where both are there; missing results are named before missing logs."""
    have = lambda df, c: df.select(key).distinct().withColumn(c, F.lit(True))
    both = lectures.select(key).join(have(results, "_r"), key, "left").join(have(logs, "_l"), key, "left")
    return both.select(key, F.when(F.col("_r").isNull(), "no results").when(F.col("_l").isNull(), "no log").alias("reason"))


def _ink_inside(dets: DataFrame, points: DataFrame, box: tuple, key: str, did: str) -> DataFrame:
    """key, did, l, t, r, b: bounds of the points inside a box (four columns); points and boxes meet in squares of the image."""
    x1, y1, x2, y2 = box
    own = tiled(dets.select(key, did, x1.alias("_x1"), y1.alias("_y1"), x2.alias("_x2"), y2.alias("_y2")), tuple(F.col(c) for c in ("_x1", "_y1", "_x2", "_y2")))
    p = points.select(key, F.col("x").alias("px"), F.col("y").alias("py"), *(F.floor(F.col(c) / CELL).cast("int").alias(n) for c, n in (("x", "_tx"), ("y", "_ty"))))
    near = own.join(p, [key, "_tx", "_ty"]).where("px >= _x1 AND px <= _x2 AND py >= _y1 AND py <= _y2")
    return near.groupBy(key, did).agg(F.min("px").alias("l"), F.min("py").alias("t"), F.max("px").alias("r"), F.max("py").alias("b"))


def ink_bounds(dets: DataFrame, points: DataFrame, key: str = "image_id", did: str = "det_id") -> DataFrame:
    """Tight bounds of the ink points inside each box, padded by 2 and clipped to the box; null where there are none."""
    b = _ink_inside(dets, points, tuple(map(F.col, ("x1", "y1", "x2", "y2"))), key, did)
    out = dets.join(b, [key, did], "left")
    tight = {"ix1": F.greatest("x1", F.col("l") - 2), "iy1": F.greatest("y1", F.col("t") - 2), "ix2": F.least("x2", F.col("r") + 2), "iy2": F.least("y2", F.col("b") + 2)}
    return out.select(*dets.columns, *(F.when(F.col("l").isNotNull(), c).alias(n) for n, c in tight.items()))


def refine_boxes(dets: DataFrame, points: DataFrame, margin: float = 14, key: str = "image_id", did: str = "det_id") -> DataFrame:
    """Integer boxes grown to the ink within a margin; never smaller; unchanged without ink."""
    cut = dets.withColumns({f"i{c}": F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2")})
    b = _ink_inside(cut, points, (F.col("ix1") - margin, F.col("iy1") - margin, F.col("ix2") + margin, F.col("iy2") + margin), key, did)
    out = cut.join(b, [key, did], "left")
    grown = {"x1": F.least("ix1", "l"), "y1": F.least("iy1", "t"), "x2": F.greatest("ix2", "r"), "y2": F.greatest("iy2", "b")}
    return out.withColumns({c: F.when(F.col("l").isNull(), F.col(c)).otherwise(g.cast("double")) for c, g in grown.items()}).select(*dets.columns)


def tile_boxes(dets: DataFrame, th: int, tw: int, overlap: float) -> DataFrame:
    """Each box once for every tile that it overlaps (tiles as in tile_grid), with coordinates in the tile.

    The range of tile indexes follows from the box, so that boxes explode to their own tiles and no theta join is needed.
    """
    sy, sx = int(th * (1 - overlap)), int(tw * (1 - overlap))
    first = lambda lo, t, s: F.greatest(F.lit(0), F.floor((F.col(lo) - t) / s) + 1).cast("int")
    last = lambda hi, dim, s: F.least(F.ceil(F.col(hi) / s) - 1, F.floor((F.col(dim) - 1) / s)).cast("int")
    ty, tx = F.sequence("_y0", "_y1"), F.sequence("_x0", "_x1")
    rows = dets.withColumns({"_y0": first("y1", th, sy), "_y1": last("y2", "img_h", sy), "_x0": first("x1", tw, sx), "_x1": last("x2", "img_w", sx)})
    rows = rows.where("_y0 <= _y1 AND _x0 <= _x1").withColumn("tile_row", F.explode(ty)).withColumn("tile_col", F.explode(tx))
    rows = rows.withColumns({"ty1": F.col("tile_row") * sy, "tx1": F.col("tile_col") * sx})
    rows = rows.withColumns({"lx1": F.col("x1") - F.col("tx1"), "ly1": F.col("y1") - F.col("ty1"), "lx2": F.col("x2") - F.col("tx1"), "ly2": F.col("y2") - F.col("ty1")})
    return rows.drop("_y0", "_y1", "_x0", "_x1")
