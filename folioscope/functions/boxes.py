"""Box and key algebra as column expressions. Boxes are four double columns x1, y1, x2, y2 (or x, y, w, h)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TEXT, MATH = 0, 1


def _clamp(c: Column, low: float, high: Column | float) -> Column:
    return F.greatest(F.lit(low), F.least(c, high if isinstance(high, Column) else F.lit(high)))


def coco_to_yolo(df: DataFrame) -> DataFrame:
    """Adds cx, cy, bw, bh (normalised, clamped to [0, 1]) for x, y, w, h in an image of img_w, img_h; drops boxes below a thousandth."""
    x, y, w, h, iw, ih = (F.col(c) for c in ("x", "y", "w", "h", "img_w", "img_h"))
    parts = {"cx": (x + w / 2) / iw, "cy": (y + h / 2) / ih, "bw": w / iw, "bh": h / ih}
    return df.withColumns({n: _clamp(c, 0.0, 1.0) for n, c in parts.items()}).where("bw >= 0.001 AND bh >= 0.001")


def yolo_to_xyxy(df: DataFrame) -> DataFrame:
    cx, cy, w, h, iw, ih = (F.col(c) for c in ("cx", "cy", "bw", "bh", "img_w", "img_h"))
    return df.withColumns({"x1": (cx - w / 2) * iw, "y1": (cy - h / 2) * ih, "x2": (cx + w / 2) * iw, "y2": (cy + h / 2) * ih})


def clip_box(df: DataFrame, pad: int = 0, fmt: str = "xyxy") -> DataFrame:
    """Integer box: truncated toward zero first, then padded, then clipped to img_w, img_h."""
    if fmt == "xywh":
        x1, y1, w, h = (F.col(c).cast("int") for c in ("x", "y", "w", "h"))
        x2, y2 = x1 + w, y1 + h
    else:
        x1, y1, x2, y2 = (F.col(c).cast("int") for c in ("x1", "y1", "x2", "y2"))
    iw, ih = F.col("img_w"), F.col("img_h")
    low = lambda c: F.greatest(F.lit(0), c - pad).cast("int")
    return df.withColumns({"cx1": low(x1), "cy1": low(y1), "cx2": F.least(iw, x2 + pad).cast("int"), "cy2": F.least(ih, y2 + pad).cast("int")})


def _side(p: str | Column, c: str) -> Column:
    """A column of a box: by prefix, or of a struct."""
    return F.col(f"{p}{c}") if isinstance(p, str) else p[c]


def area(p: str | Column = "") -> Column:
    return (_side(p, "x2") - _side(p, "x1")) * (_side(p, "y2") - _side(p, "y1"))


def box_features(df: DataFrame) -> DataFrame:
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    aspect = h / F.greatest(w, F.lit(1.0))
    return df.withColumns({
        "area": w * h, "aspect": aspect, "area_frac": w * h / (F.col("img_w") * F.col("img_h")),
        "is_multiline": (h > F.col("img_h") * 0.05) & (aspect > 0.15),
    })


def intersection(a: str | Column, b: str | Column) -> Column:
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(_side(a, hi), _side(b, hi)) - F.greatest(_side(a, lo), _side(b, lo)))
    return side("x1", "x2") * side("y1", "y2")


def iou(a: str | Column = "a_", b: str | Column = "b_") -> Column:
    """Intersection over union of two boxes by column prefix, or given as structs; 0 where the union is not positive."""
    inter = intersection(a, b)
    union = area(a) + area(b) - inter
    return F.when(union > 0, inter / union).otherwise(0.0)


def overlap_min(a: str = "a_", b: str = "b_") -> Column:
    """Intersection over the smaller area, each taken as 1 at least."""
    return intersection(a, b) / F.least(F.greatest(area(a), F.lit(1.0)), F.greatest(area(b), F.lit(1.0)))


def coverage(a: str = "a_", b: str = "b_") -> Column:
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def letterbox_boxes(df: DataFrame, tw: int, th: int) -> DataFrame:
    """Boxes in a letterboxed image: scale, integer padding, x * scale + pad."""
    iw, ih = F.col("img_w"), F.col("img_h")
    scale = F.least(F.lit(float(tw)) / iw, F.lit(float(th)) / ih)
    pad = lambda t, dim: F.floor((F.lit(t) - (dim * scale).cast("int")) / 2).cast("int")
    df = df.withColumns({"scale": scale, "pad_x": pad(tw, iw), "pad_y": pad(th, ih)})
    return df.withColumns({f"l{c}": F.col(c) * F.col("scale") + F.col(f"pad_{c[0]}") for c in ("x1", "y1", "x2", "y2")})


def unletterbox_boxes(df: DataFrame) -> DataFrame:
    return df.withColumns({f"u{c}": (F.col(f"l{c}") - F.col(f"pad_{c[0]}")) / F.col("scale") for c in ("x1", "y1", "x2", "y2")})


def resize_dims(df: DataFrame, width: int | None, height: int | None, keep_aspect: bool = True) -> DataFrame:
    iw, ih = F.col("img_w"), F.col("img_h")
    if width is None and height is None:
        w, h = iw, ih
    elif keep_aspect and width is not None and height is not None:
        scale = F.least(F.lit(float(width)) / iw, F.lit(float(height)) / ih)
        w, h = iw * scale, ih * scale
    elif keep_aspect and width is not None:
        w, h = F.lit(width), ih * (F.lit(float(width)) / iw)
    elif keep_aspect:
        w, h = iw * (F.lit(float(height)) / ih), F.lit(height)
    else:
        w, h = F.lit(width) if width is not None else iw, F.lit(height) if height is not None else ih
    return df.withColumns({"new_w": w.cast("int"), "new_h": h.cast("int")})


def tile_grid(images: DataFrame, th: int, tw: int, overlap: float) -> DataFrame:
    """One row a tile: row, col and the clipped tile box. Strides are int(t * (1 - overlap)); origins run while inside the image."""
    sy, sx = int(th * (1 - overlap)), int(tw * (1 - overlap))
    rows = images.withColumn("ty1", F.explode(F.sequence(F.lit(0), (F.col("img_h") - 1).cast("int"), F.lit(sy))))
    rows = rows.withColumn("tx1", F.explode(F.sequence(F.lit(0), (F.col("img_w") - 1).cast("int"), F.lit(sx))))
    return rows.withColumns({"tx2": F.least(F.col("tx1") + tw, F.col("img_w")).cast("int"), "ty2": F.least(F.col("ty1") + th, F.col("img_h")).cast("int")})


def map_classes(df: DataFrame, mapping: dict[str, int | None], col: str = "layout_class") -> DataFrame:
    """cls for a layout class name; names that map to nothing or aren't known are dropped. The mapping is a literal of fixed size."""
    known = {k: v for k, v in mapping.items() if v is not None}
    table = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return df.withColumn("cls", F.element_at(table, F.col(col))).where("cls IS NOT NULL")


def flip_classes(df: DataFrame) -> DataFrame:
    """Class of rows with source 'new': '0' becomes '1', anything else '0'."""
    flipped = F.when(F.col("cls") == "0", "1").otherwise("0")
    return df.withColumn("cls", F.when(F.col("source") == "new", flipped).otherwise(F.col("cls")))


def lecture_key(c: Column) -> Column:
    c = F.regexp_replace(c, r"(?i)^[0-9a-f]{8}-", "")
    return F.regexp_replace(c, r"(?i)(_p\d+|_page[-_]?\d+|page-\d+)$", "")


def form_id(c: Column) -> Column:
    return F.substring_index(c, "-", 2)


def writer_xml_id(c: Column) -> Column:
    return (c.cast("int") + 10000).cast("string")


def slug(path: Column) -> Column:
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    return F.replace(F.replace(stem, F.lit("_kommentiert"), F.lit("")), F.lit(" "), F.lit("_"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def note_title(note: Column, directory: Column) -> Column:
    """Title of the first heading `# NN — title` of a note, else the directory's name."""
    found = F.regexp_extract(note, r"(?m)^#\s*\d+\s*[—-]\s*(.+)$", 1)
    return F.when(found != "", F.trim(found)).otherwise(directory)


def decode_detections(raw: DataFrame, names: list[str], mapping: dict[str, int | None], threshold: float) -> DataFrame:
    """Rows of logits (array) and cx, cy, bw, bh: softmax, best class and score, mapped class, pixel box; the rest is dropped."""
    top = F.array_max("logits")
    exps = F.transform("logits", lambda v: F.exp(v - top))
    total = F.aggregate(exps, F.lit(0.0), lambda acc, v: acc + v)
    label = F.array_position("logits", top)
    df = raw.withColumns({"score": F.lit(1.0) / total, "label": label.cast("int") - 1}).where(F.col("score") >= threshold).where(F.col("label") < len(names))
    df = df.withColumn("layout_class", F.element_at(F.array(*map(F.lit, names)), F.col("label") + 1))
    return yolo_to_xyxy(map_classes(df, mapping))


def detections_to_coco(ranked: DataFrame) -> DataFrame:
    """Annotation rows of ranked detections (ann_id given): xywh, area, iscrowd, verified, category."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return ranked.select(
        "ann_id", "image_id", F.when(F.col("cls") == TEXT, 0).otherwise(1).alias("category_id"), F.col("x1").alias("x"), F.col("y1").alias("y"),
        w.alias("w"), h.alias("h"), (w * h).alias("area"), F.lit(0).alias("iscrowd"), F.lit(False).alias("verified"),
    )
