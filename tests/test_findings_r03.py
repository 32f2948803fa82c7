"""Cases of the findings of round 3."""

import random
import unicodedata

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioscope.functions import scores, text
from folioscope.operators import joins, matching
from folioscope.plans import registry
from folioscope.plans.catalogue import ORACLES, QUERIES
from folioscope.sources import readers


def given(spark, path, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/{name}.parquet")


def both(spark, path, query, *tables):
    """Rows of the query, and of its SQL."""
    con = duckdb.connect()
    for t in tables:
        con.sql(f"create view {t} as select * from read_parquet('{path}/{t}.parquet/*.parquet')")
    there = con.sql(ORACLES[query])
    got = QUERIES[query](spark, str(path)).select(*there.columns).collect()
    return sorted(map(tuple, got), key=str), sorted(there.fetchall(), key=str)


DOCUMENTS = "doc_id long, text string, lang string, source string"


def test_german_words_beside_accents(spark, tmp_path):
    texts = ["ñue ueíos raóue. ae Ae_ ssa MASSE", "ill ueími oe in fuer er", "äae ue1 Ue", "", None]
    given(spark, tmp_path, "documents", [(i, t, "de", "s") for i, t in enumerate(texts)], DOCUMENTS)
    for name in ("fix_umlauts", "correct_german"):
        got, want = both(spark, tmp_path, name, "documents")
        assert got == want


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_edit_distance(monkeypatch):
    rng = random.Random(7)
    for most in (scores.MASKS, 0):
        monkeypatch.setattr(scores, "MASKS", most)
        for _ in range(300):
            a, b = ("".join(rng.choice("abß😀") for _ in range(rng.randrange(90))) for _ in range(2))
            assert scores.edit_distance(a, b) == plain_distance(a, b)
            assert scores.edit_distance(a.split("a"), b.split("a")) == plain_distance(a.split("a"), b.split("a"))


@pytest.mark.parametrize("short, held", [(512, 1 << 22), (100, 500)])
def test_edit_distances_together(monkeypatch, short, held):
    """Words of 64 rows and their borders, all widths of codes, empty texts, pairs too long for the batch."""
    monkeypatch.setattr(scores, "SHORT", short)
    monkeypatch.setattr(scores, "HELD", held)
    rng = random.Random(3)
    for letters in ("abc", "abß", "ab\u4e00", "ab😀"):
        lengths = [(rng.choice([0, 1, 3, 63, 64, 65, 100, 128, 129, 150]), rng.randrange(160)) for _ in range(60)]
        texts = [tuple("".join(rng.choice(letters) for _ in range(n)) for n in pair) for pair in lengths] + [("abc", "abc"), ("", "")]
        for rows in (texts, [(x.split("b"), y.split("b")) for x, y in texts]):
            a, b = zip(*rows)
            got = scores.edit_distances(scores._codes(pa.array(a), pa.array(b)))
            assert got.tolist() == [plain_distance(x, y) for x, y in rows]


def test_long_lines_are_scored(spark):
    """200,000 characters without a space are one line; the table of their distances has 4 * 10^10 cells."""
    a = "".join(random.Random(1).choices("abcdefgh", k=200_000))
    df = spark.createDataFrame([(a, a[:5] + a[6:] + "x", None)], "h string, r string, z string")
    row = df.select(scores.cer(F.col("h"), F.col("r")).alias("c"), scores.wer(F.col("h"), F.col("r")).alias("w"), scores.bleu(F.col("h"), F.col("z")).alias("b"), scores.cer(F.col("z"), F.col("r")).alias("n")).first()
    assert row["c"] == pytest.approx(2 / 200_000) and row["w"] == 1 and row["b"] is None and row["n"] is None


def test_lines_of_long_texts(spark, tmp_path):
    """Lines are cut in one pass over the text; empty words count, as in the SQL."""
    texts = ["", " ", "a", " a  b ", None, "\n" * 41, " ".join(map(str, range(20))), " ".join(map(str, range(40))) + " ", "ü " * 61, " ".join(["wort"] * 400_000)]
    given(spark, tmp_path, "documents", [(i, t, "de", "s") for i, t in enumerate(texts)], DOCUMENTS)
    got = registry.fixture(spark, str(tmp_path), "fx_pairs").select("pair_id", "ref").collect()
    want = []
    for i, t in enumerate(texts):
        words = None if t is None else t.replace("\n", " ").split(" ")
        want += [] if words is None else [(i * 1048576 + n, " ".join(words[20 * n : 20 * n + 20])) for n in range((len(words) - 1) // 20 + 1)]
    assert sorted(map(tuple, got)) == want


def test_images_are_listed_by_tasks(spark, tmp_path, monkeypatch):
    """The driver lists no folder, however many there are; hidden files and other extensions are left out, paths are as Spark names them."""
    for name in ("a.PNG", "x/b.jpg", "x/y/z/c d.jpeg", "x/y/_tmp/e.png", ".h/f.png", "x/g.txt", "w/.i.png"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(str(tmp_path)).select("path")
    want = sorted(r[0] for r in plain.collect() if not r[0].endswith("txt"))
    monkeypatch.setattr(type(spark.read), "format", lambda *_: pytest.fail("listed by the driver"))
    assert sorted(r[0] for r in readers.list_images(spark, str(tmp_path)).collect()) == want == [f"file:{tmp_path}/{n}" for n in ("a.PNG", "x/b.jpg", "x/y/z/c d.jpeg")]


def test_manifest_files_are_bounded(spark, tmp_path, monkeypatch):
    """One file held all samples of a writer before, and there was a file a writer: 40,000 samples of one writer are three files."""
    spark.range(40_000).selectExpr("id AS event_id", "CAST(7 AS BIGINT) AS user_id", "'click' AS event_type").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    seen, plain = [], readers.read_manifest
    monkeypatch.setattr(readers, "read_manifest", lambda *a: seen.append(plain(*a)) or seen[0])
    got, want = both(spark, tmp_path, "read_manifest", "events")
    assert got == want and seen[0].select("file").distinct().count() == 3


def test_covered_sums_are_exact_and_by_row(spark):
    """Sums of exactly t stay, in any order of rows (floats gave 1.5 and more by the order); rows that share an id are judged on their own, equal rows aren't added up."""
    parts = [(21, 1), (21, 6), (21, 8), (21, 14), (21, 2.5)]  # 31.5 of 21 rows of pixels
    box = "image_id long, det_id string, x1 double, y1 double, x2 double, y2 double"
    for turn in range(10):
        order = random.Random(turn).sample(parts, len(parts))
        b = spark.createDataFrame([(1, "b", 0.0, 0.0, float(w), float(h)) for w, h in order], box).coalesce(1)
        a = spark.createDataFrame([(1, "a", 0.0, 0.0, 21.0, 21.0)], box)
        assert joins.coverage_anti_join(a, b, 1.5, "sum").count() == 1
    twice = [(1, "a", 0.0, 0.0, 10.0, 10.0), (1, "a", 0.0, 0.0, 10.0, 10.0), (1, "a", 50.0, 0.0, 60.0, 10.0), (1, "c", 90.0, 0.0, 99.0, 9.0), (1, "c", 0.0, 20.0, 5.0, 25.0)]
    b = spark.createDataFrame([(1, "b", 0.0, 0.0, 10.0, 8.0), (1, "b", 90.0, 0.0, 99.0, 9.0), (1, "b", 90.0, 0.0, 99.0, 9.0)], box)
    got = joins.coverage_anti_join(spark.createDataFrame(twice, box), b, 1.5, "sum").select("det_id", "x1").collect()
    assert sorted(map(tuple, got)) == [("a", 0.0), ("a", 0.0), ("a", 50.0), ("c", 0.0)]


def test_nfc_of_few_texts_at_a_time(spark, monkeypatch):
    """A whole batch was pandas strings before, twice."""
    texts = [unicodedata.normalize("NFD", "äöüßé\u1e9b\u0323 가각"), "\u212b \u2126 \ufb01", "e\u0301\u0327", "", None, "plain"] * 40
    monkeypatch.setattr(F, "pandas_udf", lambda *_: pytest.fail("pandas"))
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").coalesce(1).select("i", text.normalize_nfc(F.col("t")).alias("n"))
    assert [r["n"] for r in df.orderBy("i").collect()] == [t and unicodedata.normalize("NFC", t) for t in texts]


def test_expressions_are_dealt_out(spark, tmp_path):
    """One file of parts was one task for all rules over expressions."""
    given(spark, tmp_path, "part", [(i, 1, "p") for i in range(40)], "p_partkey long, p_size int, p_name string")
    parts = registry.fixture(spark, str(tmp_path), "fx_latex").groupBy(F.spark_partition_id()).count().collect()
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions")) and sum(r["count"] for r in parts) == 40


def test_f16_few_boxes_are_matched_in_rows(spark, monkeypatch):
    """Only crowded images are numbered and stored; the counts are those of going through all pairs in order, whatever counts as crowded."""
    rng = random.Random(16)
    box = lambda: (x := rng.randrange(6) * 3.0, y := rng.randrange(3) * 3.0, x + rng.choice([10.0, 12.0]), y + 10.0)
    rows = [[(rng.choice([1, 2, 3, None]), f"{name}{i}", rng.choice([0, 1]), *box()) for i in range(60)] for name in "pg"]
    rows[0] += [(4, "p", 1, *box()), (1, "q", None, *box()), (1, "r", 0, None, 0.0, 9.0, 9.0)]
    rows[1] += [(5, "g", 0, *box())]
    p, g = (spark.createDataFrame(r, f"image_id long, {n}_id string, cls int, x1 double, y1 double, x2 double, y2 double") for r, n in zip(rows, ("pred", "gt")))

    def share(a, b):
        inter = max(0.0, min(a[5], b[5]) - max(a[3], b[3])) * max(0.0, min(a[6], b[6]) - max(a[4], b[4]))
        return inter / ((a[5] - a[3]) * (a[6] - a[4]) + (b[5] - b[3]) * (b[6] - b[4]) - inter)

    want = []
    for image in {r[0] for side in rows for r in side}:
        a, b = ([r for r in side if r[0] == image] for side in rows)
        ok = lambda r: None not in r
        pairs = sorted(((share(x, y), x[1], y[1]) for x in a for y in b if ok(x) and ok(y) and x[2] == y[2] and share(x, y) >= 0.5), reverse=True)
        used, tp = set(), 0
        for _, i, j in pairs:
            if not {i, j} & used:
                used |= {i, j}
                tp += 1
        want.append((image, len(b), tp, len(b) - tp, len(a) - tp))
    numbered, plain = [], matching.rounds.numbered
    monkeypatch.setattr(matching.rounds, "numbered", lambda df, label: numbered.append(label) or plain(df, label))
    for limit in (100_000, 9):
        assert sorted(map(tuple, matching.greedy_match_counts(p, g, limit=limit).collect()), key=str) == sorted(want, key=str)
        assert numbered == ([] if limit > 9 else ["pred", "gt"])


def test_f17_only_parts_of_the_wanted_field_are_read(spark, tmp_path, monkeypatch):
    images = ", ".join(f'{{"id": {i}, "file_name": "a\\\\\\"{{[{i}.png"}}' for i in range(400))
    anns = ", ".join(f'{{"id": {i}, "image_id": {i}, "category_id": 1, "bbox": [1.0, 2.0, 3.0, {i}.0]}}' for i in range(400))
    (tmp_path / "a.json").write_text(f'{{"images": [{images}], "annotations": [{anns}]}}')
    seen, plain = [], readers.ranges.json_texts
    monkeypatch.setattr(readers.ranges, "json_texts", lambda places: seen.append({r["field"] for r in places.select("field").collect()}) or plain(places))
    got = readers.read_coco(spark, str(tmp_path), 2000)
    assert sorted(seen, key=str) == sorted([{"images"}, {"annotations"}, set()], key=str)
    assert sorted((r["image_id"], r["file_name"]) for r in got[0].collect()) == [(i, f'a\\"{{[{i}.png') for i in range(400)]
    assert sorted((r["image_id"], r["h"]) for r in got[1].collect()) == [(i, float(i)) for i in range(400)]
