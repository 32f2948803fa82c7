"""Predicates over detections, features and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions import boxes


def min_area(det: DataFrame, least: float = 100) -> DataFrame:
    return det.where(boxes.area() >= least)


def min_score(det: DataFrame, least: float) -> DataFrame:
    return det.where(F.col("score") >= least)


def prune_oversized(det: DataFrame) -> DataFrame:
    """Drops boxes over half the image unless flat, and those nearly as wide as it and over 0.4 of its height. Needs box_features."""
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    big = (F.col("area_frac") > 0.5) & (F.col("aspect") > 0.4)
    wide = (w > F.col("img_w") * 0.95) & (h > F.col("img_h") * 0.4)
    return det.where(~(big | wide))


def drop_header_band(det: DataFrame) -> DataFrame:
    wide = F.col("x2") - F.col("x1") >= F.col("img_w") * 0.20
    return det.where(~(wide & ((F.col("y1") <= F.col("img_h") * 0.045) | (F.col("y2") >= F.col("img_h") * 0.96))))


def is_typeset() -> Column:
    """Rule over h, w, n_fg, total, n_stroke, cv, lap, bg."""
    c = F.col
    sized = (c("h") >= 12) & (c("w") >= 12) & (c("n_fg") >= 80) & (c("n_fg") <= c("total") * 0.6) & (c("n_stroke") >= 50)
    even = ((c("cv") < 0.45) & (c("lap") > 1500)) | (c("lap") > 2000) | ((c("bg") > 0.99) & (c("cv") < 0.43))
    return sized & even


def is_likely_handwriting() -> Column:
    c = F.col
    return ~((c("area_frac") > 0.08) & (c("aspect") > 0.6) & (c("aspect") < 1.7) & (c("black_frac") > 0.25))


def filter_ink_candidates(cand: DataFrame, det: DataFrame, key: str = "image_id", cid: str = "cand_id") -> DataFrame:
    """Ink candidates of handwriting's size and texture, with a margin of 8 px, that no single detection covers by more than 0.6.

    cand: key, cid, x1..y2, img_w, img_h, ink, grey, edge. Result columns as detections: score 0.5, class text, source ink_detector.
    """
    c = F.col
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    frac = w * h / (c("img_w") * c("img_h"))
    own = cand.where((frac >= 0.0008) & (frac <= 0.55) & (h / F.greatest(w, F.lit(1.0)) >= 0.02) & (w <= c("img_w") * 0.85))
    own = own.withColumns({
        "x1": F.greatest(F.lit(0.0), c("x1") - 8), "y1": F.greatest(F.lit(0.0), c("y1") - 8),
        "x2": F.least(c("img_w").cast("double"), c("x2") + 8), "y2": F.least(c("img_h").cast("double"), c("y2") + 8),
    })
    from folioscope.operators.joins import coverage_anti_join

    own = coverage_anti_join(own, det, 0.6, "any", key)
    own = own.where((c("ink") >= 0.005) & (c("grey") <= 0.10) & ~((c("edge") > 0.12) & (c("ink") > 0.18)))
    return own.select(key, cid, "x1", "y1", "x2", "y2", F.lit(0.5).alias("score"), F.lit(boxes.TEXT).alias("cls"), F.lit("ink_detector").alias("source"))


#: Markers of nesting that recognisers hallucinate.
NEST_MARKERS = [r"\stackrel{", r"\overrightarrow{", r"\substack{", r"\not"]

#: Fixed value: the pattern of one token, for the share of the most frequent one.
GARBAGE_TOKEN = r"\\[A-Za-z]+|[A-Za-z0-9]+|[^\s]"


def is_garbage_latex(c: Column) -> Column:
    """Blank; CJK or Hangul; over 100 characters inside \\text{}; three nest markers; or one token above 0.45 of at least six."""
    cjk = c.rlike("[\u3000-\u9fff\uac00-\ud7af]")
    texts = F.aggregate(F.regexp_extract_all(c, F.lit(r"\\text\{([^}]*)\}"), F.lit(1)), F.lit(0), lambda n, t: n + F.length(t))
    size = F.length(c)
    nests = sum(((size - F.length(F.replace(c, F.lit(m), F.lit("")))) / len(m) for m in NEST_MARKERS), F.lit(0))
    tokens = F.regexp_extract_all(c, F.lit(GARBAGE_TOKEN), F.lit(0))
    top = F.array_max(F.transform(F.array_distinct(tokens), lambda t: F.size(F.filter(tokens, lambda u: u == t))))
    repeated = (F.size(tokens) >= 6) & (top / F.size(tokens) > 0.45)
    return (F.trim(F.coalesce(c, F.lit(""))) == "") | cjk | (texts > 100) | (nests >= 3) | repeated


def words_of(df: DataFrame, key: str, col: str) -> DataFrame:
    """key, pos, word: lower-cased words of two letters at least (German letters included)."""
    words = F.regexp_extract_all(F.col(col), F.lit("[A-Za-zäöüÄÖÜß]{2,}"), F.lit(0))
    return df.select(key, F.posexplode(F.transform(words, F.lower)).alias("pos", "word"))


def is_sensible_german(df: DataFrame, vocab: DataFrame, short: list[str], domain: DataFrame, key: str, col: str = "text") -> DataFrame:
    """key, sensible: enough known words. Short words count at each place, long ones (5 letters, in the vocabulary or the domain's words) once; no words: kept."""
    known = vocab.select("word").union(domain.select("word")).distinct().withColumn("known", F.lit(True))
    words = words_of(df, key, col).join(known, "word", "left")
    is_long = (F.length("word") >= 5) & F.coalesce("known", F.lit(False))
    per = words.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("word").isin(short).cast("int")).alias("n_short"), F.countDistinct(F.when(is_long, F.col("word"))).alias("n_long"))
    good = ((F.col("n_short") + F.col("n_long")) / F.col("n") >= 0.25) & (F.col("n_long") >= 1)
    return df.select(key).join(per, key, "left").select(key, F.when(F.col("n").isNull(), True).otherwise(good).alias("sensible"))


def german_word_ratio(df: DataFrame, vocab: DataFrame, key: str, col: str = "text") -> DataFrame:
    """key, ratio: share of words in the vocabulary; -1 without words."""
    words = words_of(df, key, col).join(vocab.select("word", F.lit(1).alias("known")), "word", "left")
    per = words.groupBy(key).agg((F.sum(F.coalesce("known", F.lit(0))) / F.count(F.lit(1))).alias("ratio"))
    return df.select(key).join(per, key, "left").select(key, F.coalesce("ratio", F.lit(-1.0)).alias("ratio"))


def has_raw_latex(c: Column) -> Column:
    return c.rlike(r"\\[A-Za-z]+") | c.rlike(r"[_^]\{") | (F.regexp_count(c, F.lit(r"[A-Za-z]_[A-Za-z]{1,4}")) >= 2)


#: What counts as a mathematical character for the two rules.
HEAVY_CHARS, LOOKS_CHARS = r"[+\-=<>^_{}\[\]/\\|·×÷≤≥≠≈∞∂∇∑∏∫√]", r"[+\-=/<>^_{}\[\]()\\|∫∑∏√·×÷]"


def _share(c: Column, chars: str) -> Column:
    return F.regexp_count(c, F.lit(chars)) / F.greatest(F.length(c), F.lit(1))


def is_math_heavy(c: Column) -> Column:
    """Mathematical characters above a fifth and at most one word of four letters."""
    c = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return (_share(c, HEAVY_CHARS) > 0.20) & (F.regexp_count(c, F.lit(r"[A-Za-zäöüÄÖÜß]{4,}")) <= 1)


def looks_like_math(c: Column) -> Column:
    return (_share(c, LOOKS_CHARS) > 0.25) | ((F.length(c) < 20) & (_share(c, "[0-9]") > 0.3))


def filter_oov(df: DataFrame, vocab: DataFrame, tokens: str = "tokens", markers: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose tokens are all known and hold no marker; distinct unknown tokens). The vocabulary is joined, not collected."""
    rows = df.withColumn("_row", F.xxhash64(*df.columns))
    each = rows.select("_row", F.explode(tokens).alias("token")).distinct()
    bad = F.lit(False)
    for m in markers or []:
        bad = bad | F.col("token").contains(m)
    unknown = each.join(vocab.select("token").distinct(), "token", "left_anti")
    hard = each.where(bad)
    gone = unknown.select("_row").union(hard.select("_row")).distinct()
    return rows.join(gone, "_row", "left_anti").drop("_row"), unknown.select("token").union(hard.select("token")).distinct()


def images_with_valid_annotation(images: DataFrame, anns: DataFrame, key: str = "image_id") -> DataFrame:
    return images.join(anns, key, "left_semi")


def german_writers_only(samples: DataFrame, writers: DataFrame, key: str = "writer_id") -> DataFrame:
    return samples.join(writers, key, "left_semi")
