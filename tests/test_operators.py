"""Operators that SQL doesn't express, against brute force; golden values; properties."""

import os
import random
import re
import unicodedata

import numpy as np

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope.functions import boxes, scores, text
from folioscope.operators import aggregates, joins, matching, recognise, sampling
from folioscope.plans import flows
from folioscope.sources import readers, writers

BOX = "image_id long, det_id string, cls int, score double, x1 double, y1 double, x2 double, y2 double"


def random_boxes(seed, n=120, images=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x, y = rng.randrange(0, 100, 5), rng.randrange(0, 60, 5)
        rows.append((rng.randrange(images), f"d{i:03d}", rng.randrange(2), rng.randrange(20) / 20, float(x), float(y), float(x + rng.randrange(5, 60, 5)), float(y + rng.randrange(5, 40, 5))))
    return rows


def iou(a, b):
    w, h = min(a[6], b[6]) - max(a[4], b[4]), min(a[7], b[7]) - max(a[5], b[5])
    inter = max(0, w) * max(0, h)
    union = (a[6] - a[4]) * (a[7] - a[5]) + (b[6] - b[4]) * (b[7] - b[5]) - inter
    return inter / union if union > 0 else 0


def by_image(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return out


def brute_nms(rows, t):
    kept = set()
    for group in by_image(rows).values():
        own = []
        for r in sorted(group, key=lambda r: (-r[3], r[1])):
            if all(iou(r, k) <= t for k in own):
                own.append(r)
        kept |= set(own)
    return kept


@pytest.mark.parametrize("seed", [1, 2, 3])
@pytest.mark.parametrize("parts", [1, 16])
def test_nms(spark, seed, parts):
    rows = random_boxes(seed)
    df = spark.createDataFrame(rows, BOX).repartition(parts)
    out = matching.nms(df, 0.3)
    assert {tuple(r) for r in out.collect()} == brute_nms(rows, 0.3)
    assert matching.nms(out, 0.3).count() == out.count()


def brute_merge(rows, t):
    out = []
    for group in by_image(rows).values():
        left = sorted(group, key=lambda r: (-r[3], r[1]))
        used = [False] * len(left)
        for i, seed in enumerate(left):
            if used[i]:
                continue
            box = list(seed)
            for j in range(i + 1, len(left)):
                if not used[j] and left[j][2] == seed[2] and iou(box, left[j]) >= t:
                    used[j] = True
                    box[4:] = [min(box[4], left[j][4]), min(box[5], left[j][5]), max(box[6], left[j][6]), max(box[7], left[j][7])]
            out.append(tuple(box))
    return sorted(out)


@pytest.mark.parametrize("seed", [4, 5])
@pytest.mark.parametrize("parts", [1, 16])
def test_merge(spark, seed, parts):
    rows = random_boxes(seed)
    out = sorted(tuple(r) for r in matching.merge_detections(spark.createDataFrame(rows, BOX).repartition(parts), 0.3).collect())
    assert out == brute_merge(rows, 0.3) and len(out) <= len(rows)


def test_row_fragments_chain_and_only_listed_classes(spark):
    rows = [(1, "a", 1, 0.9, 0.0, 0.0, 10.0, 10.0), (1, "b", 1, 0.8, 15.0, 1.0, 25.0, 11.0), (1, "c", 1, 0.7, 30.0, 0.0, 40.0, 10.0), (1, "d", 0, 0.7, 12.0, 0.0, 14.0, 10.0), (1, "e", 1, 0.6, 0.0, 30.0, 10.0, 40.0)]
    out = {r["det_id"]: (r["x1"], r["x2"]) for r in matching.merge_row_fragments(spark.createDataFrame(rows, BOX)).collect()}
    assert out == {"a": (0.0, 40.0), "d": (12.0, 14.0), "e": (0.0, 10.0)}


def test_greedy_counts(spark):
    pred = [(1, f"p{i}", i % 2, 0.5, float(i * 3), 0.0, float(i * 3 + 10), 10.0) for i in range(6)]
    gt = [(1, f"g{i}", i % 2, 0.0, float(i * 3 + 1), 0.0, float(i * 3 + 11), 10.0) for i in range(5)]
    p = spark.createDataFrame(pred, BOX).withColumnRenamed("det_id", "pred_id")
    g = spark.createDataFrame(gt, BOX).withColumnRenamed("det_id", "gt_id")
    r = matching.greedy_match_counts(p, g).first()
    assert (r["n_gt"], r["tp"], r["fn"], r["fp"]) == (5, 5, 0, 1)


def same_text(a, b):
    """The rule in Python: near equal by edits, or the shorter cut from the longer."""
    if not a or not b:
        return False
    if 1 - distance(a, b) / max(len(a), len(b)) >= 0.8:
        return True
    short, longer = (a, b) if len(a) <= len(b) else (b, a)
    shared = len(os.path.commonprefix([a, b]))
    return len(short) >= 8 and len(short) < len(longer) and (short in longer or shared >= 10 and shared >= 0.6 * len(short))


def test_same_text_rules(spark):
    rng = random.Random(2)
    words = ["die", "ableitung", "der", "funktion", "hinreichende", "bed", "x", ""]
    pairs = [("hinreichende bed", "hinreichende bedingung der ordnung"), ("", ""), ("abc", "abcdefgh"), ("abcdefgh", "abcdefghijklmnop"), ("ganz anders hier", "etwas neues dort")]
    pairs += [tuple(" ".join(rng.choices(words, k=rng.randrange(0, 6))).strip() for _ in "ab") for _ in range(300)]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", matching.same_text(F.col("a"), F.col("b")).alias("same"))
    rows = df.collect()
    assert {bool(r["same"]) for r in rows} == {True, False}
    assert all(bool(r["same"]) == same_text(r["a"], r["b"]) for r in rows)


@pytest.mark.parametrize("seed", [6, 7])
def test_dedupe_text_by_brute_force(spark, seed):
    rng = random.Random(seed)
    texts = ["die Ableitung der Funktion", "die  ableitung der Funktionen", "die Ableitung", "ganz anders", "", None]
    rows = [(*r[:2], rng.choice(["text", "text", "math"]), rng.choice(texts), *r[3:], False) for r in random_boxes(seed, 90, 5)]
    gone = set()
    plain = lambda r: " ".join((r[3] or "").lower().split())
    size = lambda r: (r[7] - r[5]) * (r[8] - r[6])
    for group in by_image(rows).values():
        own = sorted((r for r in group if r[2] == "text"), key=lambda r: r[1])
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if a[1] in gone or b[1] in gone:
                    continue
                inter = max(0, min(a[7], b[7]) - max(a[5], b[5])) * max(0, min(a[8], b[8]) - max(a[6], b[6]))
                if inter / min(max(1, size(a)), max(1, size(b))) >= 0.05 and same_text(plain(a), plain(b)):
                    gone.add(a[1] if (len(plain(b)), b[4], size(b)) > (len(plain(a)), a[4], size(a)) else b[1])
    df = spark.createDataFrame(rows, "image_id long, det_id string, type string, text string, score double, x1 double, y1 double, x2 double, y2 double, rendered boolean")
    assert gone and {r["det_id"] for r in matching.dedupe_text(df).collect()} == {r[1] for r in rows} - gone


def test_crowded_images_are_cut_into_squares(spark):
    """One image, boxes and points over many squares: as many pairs as all pairs give, in more than one task."""
    rng = random.Random(8)
    rows = [(1, f"d{i:04d}", 0, 0.5, x := rng.uniform(-300, 6000), y := rng.uniform(-300, 6000), x + rng.uniform(0, 900), y + rng.uniform(0, 900)) for i in range(300)]
    df = spark.createDataFrame(rows, BOX)
    pairs = joins.overlapping(df, df, ["image_id"])
    got = {(r["a_det_id"], r["b_det_id"]) for r in pairs.collect()}
    assert got == {(a[1], b[1]) for a in rows for b in rows if iou(a, b) > 0} and pairs.count() == len(got)
    assert joins.tiled(df, tuple(map(F.col, ("x1", "y1", "x2", "y2")))).select("_tx", "_ty").distinct().count() > 50
    points = [(1, rng.uniform(-300, 6000), rng.uniform(-300, 6000)) for _ in range(400)]
    bounds = {r["det_id"]: r["ix1"] for r in joins.ink_bounds(df, spark.createDataFrame(points, "image_id long, x double, y double")).collect()}
    for _, name, _, _, x1, y1, x2, y2 in rows:
        inside = [p[1] for p in points if x1 <= p[1] <= x2 and y1 <= p[2] <= y2]
        assert bounds[name] == (max(x1, min(inside) - 2) if inside else None)


def test_dedupe_text(spark):
    cols = "image_id long, det_id string, type string, text string, score double, x1 double, y1 double, x2 double, y2 double, rendered boolean"
    rows = [
        (1, "a", "text", "die Ableitung", 0.5, 0.0, 0.0, 10.0, 10.0, False), (1, "b", "text", "die Ableitung der", 0.4, 1.0, 0.0, 11.0, 10.0, False), (1, "c", "math", "", 0.9, 0.0, 0.0, 10.0, 10.0, True),
        (1, "d", "text", "die Ableitung", 0.9, 50.0, 0.0, 60.0, 10.0, False), (2, "e", "text", "x", 0.1, 0.0, 0.0, 1.0, 1.0, False),
    ]
    df = spark.createDataFrame(rows, cols)
    assert sorted(r["det_id"] for r in matching.dedupe_text(df).collect()) == ["b", "c", "d", "e"]
    assert sorted(r["det_id"] for r in matching.drop_text_covered_by_math(df).collect()) == ["c", "d", "e"]


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column.alias("out")).first()["out"]


def test_golden_scores(spark):
    h, r = F.col("h"), F.col("r")
    assert one(spark, scores.cer(h, r), h="Hallo Welt", r="Hallo Welt") == 0 and one(spark, scores.cer(h, r), h="Halo Welt", r="Hallo Welt") == 0.1
    assert one(spark, scores.cer(h, r), h="fur", r="für") == pytest.approx(1 / 3) and one(spark, scores.cer(h, r), h="x", r="") == 1 and one(spark, scores.cer(h, r), h="", r="") == 0
    assert one(spark, scores.wer(h, r), h="ein Tést\u00a0hier", r="ein Tést dort") == pytest.approx(1 / 3)
    assert one(spark, scores.bleu(h, r), h="", r="a b") == 0 and one(spark, scores.bleu(h, r), h="a b c d e", r="a b c d e") == pytest.approx(1, abs=1e-6)
    lo, hi = scores.wilson_ci(F.lit(23.0), F.lit(134.0))
    assert one(spark, lo) == pytest.approx(0.117183, abs=1e-6) and one(spark, hi) == pytest.approx(0.244403, abs=1e-6)


def test_golden_boxes(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 15.0, 15.0, 200, 100)], ", ".join(f"{p}{c} double" for p in ("a_", "b_") for c in ("x1", "y1", "x2", "y2")) + ", img_w int, img_h int")
    assert df.select(boxes.iou().alias("i")).first()["i"] == pytest.approx(25 / 175)
    assert tuple(boxes.resize_dims(df, 100, None).select("new_w", "new_h").first()) == (100, 50)
    assert tuple(boxes.resize_dims(df, None, None).select("new_w", "new_h").first()) == (200, 100)
    assert tuple(boxes.resize_dims(df, 50, 50).select("new_w", "new_h").first()) == (50, 25)
    assert tuple(boxes.resize_dims(df, 50, 50, False).select("new_w", "new_h").first()) == (50, 50)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def wrapped(latex):
    """Prose runs by a walk over the characters: what is guarded is found first, then words are gathered."""
    guarded = [False] * len(latex)
    for pattern in (r"\\text\{[^{}]*\}", r"\\\\", r"\\[a-zA-Z]+"):
        for m in re.finditer(pattern, "".join("\0" if g else c for c, g in zip(latex, guarded))):
            guarded[m.start() : m.end()] = [True] * len(m.group())
    letter = lambda c: bool(re.match("[A-Za-zÄÖÜäöüß]", c))
    seen = "".join("\0" if g else c for c, g in zip(latex, guarded))
    out, i = [], 0
    while i < len(seen):
        ends, at = [], i
        while not (i and seen[i - 1] in "_^\\") or at > i:
            end = at
            while end < len(seen) and letter(seen[end]):
                end += 1
            if end - at < 2 or seen[end : end + 1] in set("0123456789_^({"):
                break
            ends.append(end)
            at = end
            while at < len(seen) and seen[at] in " \t":
                at += 1
            if at == end:
                break
        if len(ends) > 1:
            out.append(r"\text{" + latex[i : ends[-1]] + "}")
            i = ends[-1]
        else:
            out.append(latex[i])
            i += 1
    return "".join(out)


def test_wrap_prose_by_brute_force(spark):
    rng = random.Random(11)
    parts = ["\\", "\\\\", "\\text{", "}", "{", "text{ab cd}", "\\text{so ist}", "\\alpha", "ab", "cde", "für", "x", " ", " ", "  ", "\t", "_", "^", "(", "1", "\n", "ä"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 14))) for _ in range(3000)] + [r"\\ab cd", r"\\text{ab} cd ef", r"\äbc de", r"_abc de"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", text.wrap_prose(F.col("t")).alias("w")).collect()
    assert [r["t"] for r in rows if r["w"] != wrapped(r["t"])] == [] and sum(r["t"] != r["w"] for r in rows) > 100


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("abü ", max_size=12), st.text("abü ", max_size=12)), min_size=1, max_size=20))
def test_word_error_rate_by_brute_force(spark, pairs):
    df = spark.createDataFrame(list(enumerate(pairs)), "i long, p struct<h:string,r:string>").select("i", scores.wer(F.col("p.h"), F.col("p.r")).alias("w"), scores.cer(F.col("p.h"), F.col("p.r")).alias("c"))
    got = {r["i"]: (r["w"], r["c"]) for r in df.collect()}
    for i, (h, r) in enumerate(pairs):
        a, b = h.split(), r.split()
        want = (distance(a, b) / len(b) if b else float(bool(a)), distance(h, r) / len(r) if r else float(bool(h)))
        assert got[i] == pytest.approx(want)


def test_german_text(spark):
    c = F.col("t")
    assert one(spark, text.correct_german(c), t="oe und ae") == "ö und ä"
    assert one(spark, text.fix_umlauts(c), t="Wasser äae Ue_x Masse") == "Waßer äae Ue_x Maße"
    assert one(spark, text.fix_domain_words(c), t="(fuer)  ueber, nichts") == "(für) über, nichts"
    assert one(spark, text.normalize_nfc(c), t=unicodedata.normalize("NFD", "äöüß")) == "äöüß"
    assert one(spark, text.correct_german(c), t="  ") == "  "


def test_latex_text(spark):
    c = F.col("t")
    assert one(spark, text.canonicalize_latex(c), t="$$ { x }\\,y ~ z $$") == "{x} y z"
    assert one(spark, text.canonicalize_latex(c), t="$$") == ""
    assert one(spark, text.wrap_prose(c), t=r"x = 1 \\ Dies ist der Fall für \alpha") == r"x = 1 \\ \text{Dies ist der Fall für} \alpha"
    assert one(spark, text.wrap_prose(c), t=r"\text{so ist es} f_x dx dy_2") == r"\text{so ist es} f_x dx dy_2"
    assert one(spark, text.normalize_math_latex(c), t="$a = 1$\nb = 2 \\\\\n\nc") == r"a = 1 \\ b = 2 \\ c"
    assert one(spark, text.normalize_math_latex(c), t="\\begin{cases} a \\\\\n b \\end{cases}") == "\\begin{cases} a \\\\\n b \\end{cases}"
    assert one(spark, text.wrap_latex_expr(c), t=r"a \\ b") == "$\\displaystyle \\begin{aligned}\n& a \\\\\n& b\n\\end{aligned}$"
    assert one(spark, text.clean_vlm_text(c), t=r"$\Delta$ ist \leq 5") == "Δ ist ≤ 5"
    assert one(spark, text.strip_fences(c), t="```latex\nx^2\n```") == "x^2" and one(spark, text.strip_fences(c), t='"x"') == "x"
    assert one(spark, text.sanitize_latex(c), t=r"\left( \text{a} \ldots f'") == r"( a \cdots f \prime"
    assert one(spark, text.tag_expr(c), t=r"\begin{pmatrix} a \\ b \end{pmatrix}") == ["with-matrix", "medium"]
    assert one(spark, text.tag_expr(c), t="") == []
    parts = one(spark, text.split_text_math(c), t="Sei $x$ und 3+4 da")
    assert [(p["type"], p["content"]) for p in parts] == [("text", "Sei "), ("math", "$x$"), ("text", " und "), ("math", "3+4"), ("text", " da")]


def test_replies(spark):
    df = spark.createDataFrame([(1, 'ok ```json\n[{"bbox":[1,2,3,4],"type":"text","content":"a"}]\n```'), (2, "nothing"), (3, "[oops")], "k long, reply string")
    got = {r["k"]: (r["parse_ok"], r["n_regions"], r["content"]) for r in text.parse_region_output(df, "k").collect()}
    assert got == {1: (True, 1, "a"), 2: (False, 0, None), 3: (False, 0, None)}


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"image": "1", "gt_latex": "", "latex": "x"}]')
    (tmp_path / "b.json").write_text('{"samples": [{"image": "2", "text": "t"}, {"image": "3"}]}')
    assert sorted((r["image"], r["truth"]) for r in readers.read_manifest(spark, [f"{tmp_path}/a.json", f"{tmp_path}/b.json"]).collect()) == [("1", "x"), ("2", "t"), ("3", "")]
    (tmp_path / "l.txt").write_text("0 0.5 0.5 0.1 0.1\n\nmath 1 1 1 1\n1 0.5\n")
    assert [r["cls"] for r in readers.read_yolo_labels(spark, f"{tmp_path}/l.txt").collect()] == ["0"]
    with pytest.raises(ValueError):
        readers.detect_column(spark.range(1), ("text",))
    assert readers.detect_column(spark.range(1), ("text",), required=False) is None
    df = spark.createDataFrame([("a", "x"), ("b", "y")], "name string, latex string")
    writers.write_tsv_labels(df, df.where("name = 'b'").select("name"), f"{tmp_path}/tsv")
    assert spark.read.text(f"{tmp_path}/tsv").first()["value"] == "b\ty"


def test_splits_are_partitions(spark):
    df = spark.range(1003).select(F.col("id").cast("string").alias("k"))
    counts = {r["split"]: r["count"] for r in sampling.three_way_split(df, "k").groupBy("split").count().collect()}
    assert counts == {"train": 702, "val": 150, "test": 151}
    assert {r["split"]: r["count"] for r in sampling.train_val_split(df.limit(3), "k", 0.1).groupBy("split").count().collect()} == {"train": 2, "val": 1}
    groups = sampling.group_strict_split(df.withColumn("g", F.col("k").cast("int") % 17), "g")
    assert groups.groupBy("g").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    with pytest.raises(Exception, match="larger than population"):
        sampling.fixed_sample(df.limit(5), 6, ["k"], ["k"]).collect()


def test_systems_that_differ_raise(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.5), (2, 0, 0.1)], "item long, system int, cer double")
    with pytest.raises(Exception, match="systems differ"):
        joins.align_systems(df, [0, 1]).collect()


def test_recognisers_never_end_a_run(spark):
    def make():
        return lambda v: {"ok": "yes", "none": None}[v]

    out = recognise.recognize(spark.createDataFrame([("ok",), ("none",), ("bad",)], "v string"), make, "v")
    assert sorted((r["v"], r["pred"]) for r in out.collect()) == [("bad", ""), ("none", ""), ("ok", "yes")]


def test_average_precision_edges(spark):
    none = spark.createDataFrame([], "image_id long, pred_id string, cls int, score double, x1 double, y1 double, x2 double, y2 double")
    gt = spark.createDataFrame([(1, "g", 0, 0.0, 0.0, 10.0, 10.0)], "image_id long, gt_id string, cls int, x1 double, y1 double, x2 double, y2 double")
    assert sorted((r["cls"], r["ap"], r["n_gt"]) for r in aggregates.average_precision(none, gt).collect()) == [(0, 0.0, 1), (1, 0.0, 0)]
    hit = spark.createDataFrame([(1, "p", 0, 0.9, 0.0, 0.0, 10.0, 10.0)], none.schema)
    assert {r["cls"]: r["ap"] for r in aggregates.average_precision(hit, gt).collect()}[0] == pytest.approx(1, abs=1e-6)


def test_cross_writer_without_writers(spark):
    def make():
        return lambda v: v

    rows = spark.createDataFrame([(i, f"line {i}") for i in range(20)], "k long, text string")
    out = {r["writer_id"]: (r["n"], r["cer"]) for r in flows.evaluate_cross_writer(rows, make, 5, "k").collect()}
    assert out == {"all": (5, 0.0), None: (5, 0.0)}


def test_resample_weights_and_intervals(spark):
    """Weights have mean and variance of about 1, don't depend on the partitioning, and give the interval that plain resampling gives."""
    rng = np.random.default_rng(0)
    values = rng.exponential(size=400)
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)] + [(400, None)], "i long, v double")
    got = [aggregates.bootstrap_ci(df.repartition(n), "v", "i", 2000).first() for n in (1, 7)]
    assert got[0]["n"] == 400 and [got[0][c] for c in ("mean", "lo", "hi")] == pytest.approx([got[1][c] for c in ("mean", "lo", "hi")])
    plain = np.sort(rng.choice(values, (2000, 400)).mean(1))
    assert got[0]["lo"] == pytest.approx(plain[50], abs=0.03) and got[0]["hi"] == pytest.approx(plain[1949], abs=0.03)
    x = aggregates.mixed(np.arange(200_000, dtype=np.uint32))
    w = sum((x >= np.uint32(s)).astype(int) for s in aggregates.poisson_steps())
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    none = aggregates.bootstrap_ci(df.where("i = 400"), "v", "i", 10).first()
    assert none["n"] == 0 and none["mean"] is none["lo"] is None
    pairs = df.where("v IS NOT NULL").select("i", "v", (F.col("v") + 0.5).alias("u"))
    assert aggregates.paired_test(pairs, "u", "v", "i", 999).first()["p"] == pytest.approx(1 / 1000)
    assert aggregates.paired_test(pairs, "v", "v", "i", 999).first()["p"] == 1


def test_spell_correct_by_brute_force(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choices("abc", k=n))
    known = sorted({word(rng.randrange(3, 9)) for _ in range(60)} | {word(n) for n in (22, 23, 24, 25, 26, 27, 40, 41)})
    vocab = [(w, rng.randrange(1, 5)) for w in known]

    def edited(w):
        for _ in range(rng.randrange(0, 4)):
            i = rng.randrange(len(w))
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + "d" + w[i:], w[:i] + "d" + w[i + 1 :]])
        return w

    words = [edited(rng.choice(known)) for _ in range(300)]

    def best(w):
        near = [(distance(w, v), -f, v) for v, f in vocab]
        d, _, v = min(near)
        return v if len(w) >= 3 and d <= 2 else w

    docs = spark.createDataFrame([(i, " ".join(words[i * 10 : i * 10 + 10])) for i in range(30)], "k long, text string")
    got = {r["k"]: r["text"] for r in text.spell_correct(docs, spark.createDataFrame(vocab, "word string, freq long"), "k").collect()}
    assert got == {i: " ".join(map(best, words[i * 10 : i * 10 + 10])) for i in range(30)}


def test_map_sweep_by_assigning_at_each_threshold(spark):
    rows = random_boxes(9, 200, 8)
    pred = spark.createDataFrame(rows[:120], BOX).withColumnRenamed("det_id", "pred_id")
    gt = spark.createDataFrame(rows[120:] + [(r[0], f"x{r[1]}", *r[2:6], r[6] + 1, r[7]) for r in rows[:40]], BOX).withColumnRenamed("det_id", "gt_id").drop("score")
    got = {(r["t"], r["cls"]): (r["precision"], r["ap"]) for r in aggregates.map_sweep(pred, gt).collect()}
    for t in (0.5, 0.75, 0.95):
        tp = {r["cls"]: r["p"] for r in matching.tp_fp_assign(pred, gt, t).groupBy("cls").agg(F.avg(F.col("tp").cast("int")).alias("p")).collect()}
        ap = {r["cls"]: r["ap"] for r in aggregates.average_precision(pred, gt, t).collect()}
        assert {c: got[t, c] for c in tp} == {c: (pytest.approx(tp[c]), pytest.approx(ap[c])) for c in tp}
