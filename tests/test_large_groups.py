"""Statistics and profiles of groups that no task holds, token scores of long texts, and backends, against brute force."""

import math
import random
import statistics
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from folioscope.functions import scores
from folioscope.functions.ranks import sum_before
from folioscope.operators import aggregates, matching, recognise, sampling, selection
from folioscope.plans import flows
from folioscope.streaming import incremental


def same(a, b):
    return a == b or a is not None and b is not None and (math.isnan(a) and math.isnan(b) or a == pytest.approx(b, rel=1e-15))


@pytest.mark.parametrize("limit", [4, 30, 10**6])
def test_medians_of_any_group(spark, limit):
    rng = random.Random(1)
    draws = {
        "even": [rng.random() for _ in range(60)], "odd": [rng.gauss(0, 1) for _ in range(61)], "heavy": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(101)],
        "same": [4.0] * 40, "two": [1.0] * 20 + [2.0] * 20, "hot": [7.0] * 50 + [float(i) for i in range(50)], "tiny": [5e-324 * i for i in range(33)], "wide": [-1.7e308, 1.7e308, 3.0] * 15 + [1.0],
        "inf": [math.inf] * 20 + [-math.inf] * 3 + [1.0] * 18, "nan": [math.nan] * 5 + [1.0, 2.0] * 16, "one": [3.5], None: [float(i) for i in range(35)], "none": [],
    }
    rows = [(g, v) for g, vs in draws.items() for v in [*vs, None]]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, v double")
    whole = {r["g"]: r["m"] for r in df.groupBy("g").agg(F.median("v").alias("m")).collect()}
    got = {r["g"]: r["median"] for r in selection.medians(df, "v", ["g"], limit).collect()}
    assert got.keys() == draws.keys() and all(same(got[g], whole[g]) for g in draws)
    assert got["even"] == pytest.approx(statistics.median(draws["even"])) and got["hot"] == statistics.median(draws["hot"])
    if limit != 30:
        return
    one = selection.medians(df.where("g = 'odd'"), "v", [], limit).collect()
    assert [r["median"] for r in one] == [whole["odd"]]
    out = {r["g"]: r for r in aggregates.distribution(df, "v", ["g"], limit).collect()}
    assert out["even"]["median"] == got["even"] and out["none"]["n"] == 0 and out["none"]["median"] is None and out[None]["n"] == 35


def test_medians_of_empty_tables(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert selection.medians(none, "v", ["g"], 0).count() == 0
    assert [r["median"] for r in selection.medians(none, "v", []).collect()] == [None]


def test_sums_before(spark):
    rng = random.Random(2)
    rows = [(rng.choice("abcd") * rng.randrange(3), i, rng.randrange(9)) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, i long, n long").repartition(7)
    want, total = {}, 0
    for k, i, n in sorted(rows):
        want[i] = total
        total += n
    out = sum_before(df, F.col("n"), ["k", "i"])
    assert {r["i"]: r["before"] for r in out.collect()} == want and out.columns == ["k", "i", "n", "before"]
    assert sum_before(df.limit(0), F.col("n"), ["k", "i"]).count() == 0


def test_group_strict_split_by_brute_force(spark):
    rng = random.Random(3)
    rows = [(f"g{min(rng.randrange(40), rng.randrange(40)):02d}", i) for i in range(400)]
    sizes = Counter(g for g, _ in rows)
    want, total = {}, 0
    for g, n in sorted(sizes.items(), key=lambda x: (x[1], x[0])):
        want[g] = "val" if total < round(400 * 0.2) else "train"
        total += n
    got = sampling.group_strict_split(spark.createDataFrame(rows, "g string, i long"), "g").collect()
    assert len(got) == 400 and all(r["split"] == want[r["g"]] for r in got)


def runs_of(ink, width, gap, least):
    size, n = 2 * gap + 1, len(ink)
    inside = [sum(ink[max(0, i - gap) : i + gap + 1]) >= max(width * 0.005, 3.0) * size for i in range(n)]
    out, start = [], None
    for i, on in enumerate([*inside, False]):
        if on and start is None:
            start = i
        elif not on and start is not None:
            a, b = start + 1, i + 1
            if b - a >= least:
                pad = max(4, int((b - a) * 0.1))
                out.append((max(1, a - pad), b if b == n + 1 else min(n + 1, b + pad)))
            start = None
    return out


@pytest.mark.parametrize("block", [4, 16, 1 << 16])
def test_profiles_in_blocks(spark, block):
    rng = random.Random(block)
    regions = {k: [rng.choice([0, 0, 9, 9, 9]) if (i // rng.choice([7, 16, 30])) % 2 else rng.choice([0, 1, 7]) for i in range(rng.randrange(1, 150))] for k in range(12)}
    regions[20] = [9] * 64
    rows = [(k, i, v) for k, ink in regions.items() for i, v in enumerate(ink, 1)]
    widths = spark.createDataFrame([(k, 400 + 50 * k) for k in regions], "region_id long, width int")
    got = matching.segment_profile(spark.createDataFrame(rows, "region_id long, row_no int, ink int"), widths, least=5, block=block)
    assert sorted((r["region_id"], r["start"], r["end"]) for r in got.collect()) == sorted((k, *x) for k, ink in regions.items() for x in runs_of(ink, 400 + 50 * k, 3, 5))


def plain_bleu(hyp, ref, order=4):
    a, b = hyp.split(), ref.split()
    if not a:
        return 0.0
    total = 0.0
    for n in range(1, order + 1):
        x, y = (Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b))
        total += math.log(sum(min(c, y[g]) for g, c in x.items()) / max(len(a) - n + 1, 1) + 1e-10) / order
    return min(1.0, math.exp(1 - len(b) / len(a))) * math.exp(total)


def test_bleu_by_brute_force(spark):
    rng = random.Random(5)
    pairs = [tuple(" ".join(rng.choices("a b c ä the".split(), k=rng.randrange(0, 14))) for _ in "hr") for _ in range(200)]
    pairs += [(" ".join(rng.choices(["x", "y", "z"], k=900)), " ".join(rng.choices(["x", "y", "w"], k=700)))]
    rows = spark.createDataFrame(pairs, "h string, r string").select("h", "r", scores.bleu(F.col("h"), F.col("r")).alias("s")).collect()
    assert all(r["s"] == pytest.approx(plain_bleu(r["h"], r["r"]), abs=1e-12) for r in rows)


def test_word_errors_beyond_twenty_thousand_words(spark):
    words = [f"w{i}" for i in range(20_500)]
    hyp = [*words[:100], *words[20_100:20_300], "new", *words[20_300:20_400]]
    df = spark.createDataFrame([(" ".join(hyp), " ".join(words))], "h string, r string")
    assert df.select(scores.wer(F.col("h"), F.col("r")).alias("w")).first()["w"] == pytest.approx(20_101 / 20_500)


def recorder(folder):
    """Answers in batches; fails on batches with a bad row, and tells what happened in files."""

    class Recorder:
        def __init__(self):
            self.name = f"{random.random()}"
            (Path(folder) / f"made-{self.name}").touch()

        def predict(self, values):
            if "bad" in values:
                raise ValueError("bad")
            return [None if v == "none" else v.upper() for v in values] + (["more"] if "long" in values and len(values) > 1 else [])

        def unload(self):
            (Path(folder) / f"unloaded-{self.name}").touch()

    return Recorder


def test_backends_are_batched_and_unloaded(spark, tmp_path):
    rows = [(i, v) for i, v in enumerate(["a", "b", "bad", "none", "c", "long", "d"] * 5)]
    df = spark.createDataFrame(rows, "i long, v string").repartition(2)
    at = str(tmp_path)
    got = {r["i"]: r["pred"] for r in recognise.recognize(df, recorder(at), "v", size=3).collect()}
    assert got == {i: "" if v in ("bad", "none") else v.upper() for i, v in rows}
    made = {p.name.split("-", 1)[1] for p in tmp_path.glob("made-*")}
    assert made and made == {p.name.split("-", 1)[1] for p in tmp_path.glob("unloaded-*")}


def test_backends_fail_on_executors_only(spark, tmp_path):
    at = str(tmp_path)

    def on_driver_only():
        from pyspark import TaskContext

        if TaskContext.get() is None:
            raise AssertionError("made on the driver")
        raise RuntimeError("no device")

    def in_every_fourth_task():
        from pyspark import TaskContext

        if TaskContext.get().partitionId() % 4 == 0:
            raise RuntimeError("device lost")
        return lambda v: v

    df = spark.range(40).select(F.concat(F.lit("v"), "id").alias("v")).repartition(4)
    out = recognise.run_backends(df, {"good": recorder(at), "broken": on_driver_only, "half": in_every_fourth_task}, "v").collect()
    by = {n: [r for r in out if r["backend"] == n] for n in ("good", "broken", "half")}
    assert len(by["good"]) == 40 and all(r["error"] is None and r["pred"] == r["v"].upper() for r in by["good"])
    assert [(r["v"], r["pred"], r["error"]) for r in by["broken"]] == [(None, "", "no device")]
    lost = [r for r in by["half"] if r["error"]]
    assert len(by["half"]) == 40 and 0 < len(lost) < 40 and all(r["pred"] == "" for r in lost)


def test_covered_texts_stay_in_images_with_one_text(spark):
    box = lambda x: (x, 0.0, x + 10.0, 10.0)
    rows = [(1, "a", "text", 0.9, *box(0.0), "abc", False), (1, "m", "math", 0.9, *box(0.0), "", True)]
    rows += [(2, "a", "text", 0.9, *box(0.0), "abc", False), (2, "b", "text", 0.9, *box(50.0), "def", False), (2, "m", "math", 0.9, *box(0.0), "", True)]
    df = spark.createDataFrame(rows, "image_id long, det_id string, type string, score double, x1 double, y1 double, x2 double, y2 double, text string, rendered boolean")
    assert sorted((r["image_id"], r["det_id"]) for r in flows.without_repeats(df).collect()) == [(1, "a"), (1, "m"), (2, "b"), (2, "m")]
    assert sorted((r["image_id"], r["det_id"]) for r in flows.without_repeats(df, covered_always=True).collect()) == [(1, "m"), (2, "b"), (2, "m")]


def test_a_file_that_cannot_be_read_does_not_end_the_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i, "w", f"text {i}", f"text {i}") for i in range(20)], incremental.PAIRS)
    at, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    rows.where("pair_id < 10").coalesce(1).write.parquet(at)
    (tmp_path / "in" / "broken.parquet").write_bytes(b"PAR1 not a file of pairs")
    assert incremental.incremental_scores(spark, at, out, ckpt).count() == 10
    rows.where("pair_id >= 10").coalesce(1).write.mode("append").parquet(at)
    assert incremental.incremental_scores(spark, at, out, ckpt).count() == 20
    assert [r["file"] for r in incremental.unread_files(spark, at, out).collect()] == ["broken.parquet"]
