"""Cases of the findings of round 4."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from folioscope.llm import common, simhash
from folioscope.operators import aggregates, matching
from folioscope.plans import flows
from folioscope.plans.catalogue import QUERIES
from folioscope.sources import scratch


def test_f2_the_baseline_ties_with_itself(spark):
    """Its mean was added up a second time, in whatever order rows then came: sums of floats differ by it."""

    def shuffled(batches):
        rows = [r for b in batches for r in b.to_pylist()]
        random.SystemRandom().shuffle(rows)
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("system", pa.int64()), ("cer", pa.float64())]))

    rng = random.Random(2)
    rows = [(s, rng.random() * 10.0 ** rng.randrange(-9, 9)) for s in range(3) for _ in range(2000)]
    df = spark.createDataFrame(rows, "system long, cer double").coalesce(1).mapInArrow(shuffled, "system long, cer double")
    for s in range(3):
        got = {r["system"]: r for r in aggregates.compare_systems(df, s).collect()}
        assert len(got) == 3 and got[s]["result"] == "tie" and got[s]["delta_pp"] == 0
        assert all(r["result"] == ("win" if r["mean_cer"] < got[s]["mean_cer"] else "loss") for r in got.values() if r["system"] != s)


def shuffle_files(spark):
    return spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")


def test_shuffles_of_scratch_tables_leave_at_once(spark):
    """They stayed until the driver collected its garbage."""
    for keep in (scratch.stored, common.kept):
        before, left = shuffle_files(spark), 1
        out = keep(spark.range(20_000).groupBy((F.col("id") % 7919).alias("k")).count(), "t")
        for _ in range(50):  # they are deleted beside what goes on
            left = shuffle_files(spark) - before
            if left <= 0:
                break
            time.sleep(0.1)
        assert left <= 0 and out.count() == 7919
        assert spark.conf.get(scratch.CLEANUP, None) is None
    spark.conf.set(scratch.CLEANUP, "false")
    scratch.stored(spark.range(5), "t")
    assert spark.conf.get(scratch.CLEANUP) == "false"
    spark.conf.unset(scratch.CLEANUP)


def test_f1_bitmaps_of_long_sets():
    """Never more bits differ than elements, whatever the widths; sets that share little differ in more bits than similar ones may."""
    rng = np.random.default_rng(4)
    fresh = lambda n: np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for n, m, shared in ((1700, 1700, 0), (1600, 2100, 1500), (4000, 5000, 1000), (4096, 4097, 4000), (9000, 30_000, 8000), (16_000, 17_000, 3000)):
        both = fresh(shared)
        x, y = (np.union1d(both, fresh(k - shared)) for k in (n, m))
        bits = simhash.differing_bits(simhash.long_parity_bits(x), simhash.long_parity_bits(y))
        assert bits == simhash.differing_bits(simhash.long_parity_bits(y), simhash.long_parity_bits(x)) <= len(np.setxor1d(x, y))
        if 5 * shared <= n and 4 * m <= 5 * n:
            assert bits > (len(x) + len(y)) / 9
    assert simhash.long_parity_bits(fresh(simhash.LONG - 1)) is None


def test_f1_long_texts_with_a_common_passage_are_not_made_again(spark, monkeypatch):
    """1,024 bits can't tell sets of over 2,300 shingles apart: pairs of long texts that met for a passage were all made again as sets and shuffled, ever more of them the more texts there are."""
    rng = random.Random(1)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for i in range(12):
        passage = words(500)
        rows += [(2 * i + k, " ".join(words(1500) + passage + words(1500))) for k in range(2)]
    near = words(3000)
    rows += [(100, " ".join(near)), (101, " ".join(near[:2800] + words(200)))]
    seen, plain = {}, simhash.kept

    def kept(df, label, *a, **b):
        out = plain(df, label, *a, **b)
        seen.setdefault(label, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "kept", kept)
    left = simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(r["doc_id"] for r in left.collect()) == [*range(24), 100]
    assert seen["crossing"][0] >= 6 and sum(seen["needed"]) <= 2


def test_f1_the_sample_keeps_up_with_the_documents(spark, monkeypatch):
    """The sample was about as large whatever the number of documents, so shingles of ever more documents counted as rare, and all their pairs met."""
    rng = random.Random(3)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = words(30)
    rows = [(i, " ".join(words(60) + passage + words(60))) for i in range(400)]
    seen, plain = {}, simhash.kept

    def kept(df, label, *a, **b):
        out = plain(df, label, *a, **b)
        seen[label] = out.count()
        return out

    monkeypatch.setattr(simhash, "kept", kept)
    monkeypatch.setattr(simhash, "SAMPLED", 1)
    assert simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).count() == 400
    assert seen["crossing"] < 400


def test_f4_steps_of_the_region_pipeline_leave(spark, monkeypatch):
    """All scratch tables of all steps stayed, and with them the shuffles of all."""
    paths = []
    for module in (flows, matching):
        monkeypatch.setattr(module, "stored", lambda df, label: paths.append((out := scratch.stored(df, label)).stored_at) or out)
    got = QUERIES["region_pipeline"](spark, "/root/testdata/sf0.001")
    left = [p.split("/")[-1].rsplit("-", 1)[0] for p in paths if Path(p).exists()]
    assert {p.split("/")[-1].rsplit("-", 1)[0] for p in paths} >= {"refined", "boxes", "merged", "joined", "regions"}
    assert sorted(left) == ["distinct-texts", "images", "same-texts"] and got.count() > 1000


def test_f4_a_detection_comes_before_the_candidate_of_its_name(spark):
    """Of rows of equal score and id any came first, so `source` differed from run to run."""
    box = "image_id long, det_id string, cls int, score double, x1 double, y1 double, x2 double, y2 double, source string"
    rows = [(i, "a", 1, 0.5, 9.0 * k, 0.0, 100.0, 50.0, s) for i in range(20) for k, s in ((1, "ink_detector"), (2, "detector"))]
    for order in (rows, rows[::-1]):
        det = spark.createDataFrame(order, box)
        for out in (matching.merge_detections(det), matching.merge_row_fragments(det.withColumn("x1", F.lit(9.0)))):
            assert [r["source"] for r in out.collect()] == ["detector"] * 20
