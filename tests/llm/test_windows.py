import hashlib
import os
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import windows
from folioscope.llm.substrings import WORDS, doubled, op3_substrings
from folioscope.llm.suffixes import BYTES, op6_suffixes, ordered, radix_sorted
from folioscope.llm.windows import Rule, digested, without_repeats

LONG = " ".join(f"w{i}" for i in range(60))
TEXTS = [
    LONG, "x " + LONG + " y", LONG, "", None, "short text", "a " * 100, "b " * 30 + LONG[:150], "z" * 1500, "z" * 401, "tail " + LONG[40:200] + " end",
    "ü " * 25 + "ö", "one\ntwo\tthree " + LONG[10:170],
]


def marked(rows, width, first_stays):
    """Brute force over lists of units, in order: which units to remove."""
    places: dict = {}
    for r, (_, units) in enumerate(rows):
        for i in range(len(units) - width + 1):
            places.setdefault(tuple(units[i : i + width]), []).append((r, i))
    gone = [np.zeros(len(u), bool) for _, u in rows]
    for at in places.values():
        if len(at) > 1:
            for r, i in at[1:] if first_stays else at:
                gone[r][i : i + width] = True
    return gone


def expect(texts, rule):
    order = sorted(range(len(texts)), key=lambda i: i)
    rows = [(i, (texts[i] or "").encode().split() if rule.words else list((texts[i] or "").encode())) for i in order]
    out = {}
    for (i, units), gone in zip(rows, marked(rows, rule.width, rule.first_stays)):
        kept = [u for u, g in zip(units, gone) if not g]
        out[i] = (len(units), int(gone.sum()), b" ".join(kept) if rule.words else bytes(kept))
    return out


@pytest.mark.parametrize("rule", [WORDS, BYTES, Rule(6, (3, 6), doubled, True, True), Rule(9, (4, 7, 9), ordered, False, False)])
@pytest.mark.parametrize("limit", [1 << 20, 50])
def test_equals_brute_force(spark, monkeypatch, rule, limit):
    monkeypatch.setattr(windows, "LIMIT", limit)
    docs = spark.createDataFrame([(i, t, "extra") for i, t in enumerate(TEXTS)], "doc_id long, text string, key string")
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], bytes(r["kept"])) for r in without_repeats(docs, rule).collect()}
    assert got == expect(TEXTS, rule)


@pytest.mark.parametrize("rule", [WORDS, BYTES])
def test_without_the_method_nothing_is_removed(spark, rule):
    none = np.empty(0, np.int64)
    blind = Rule(rule.width, rule.levels, lambda texts, width, weights, alone: (none, none, none), rule.words, rule.first_stays)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert without_repeats(docs, rule).agg(F.sum("n_removed")).first()[0] > 10_000
    assert without_repeats(docs, blind).agg(F.sum("n_removed")).first()[0] == 0


@pytest.mark.parametrize("method", [doubled, ordered])
def test_copies_count_as_often_as_their_weight(method):
    texts = [b"a b c d e f", b"x b c d y", b"p q r s t"] if method is doubled else [b"abcdef", b"xbcdy", b"pqrst"]
    found = lambda weights: sorted(zip(*(x.tolist() for x in method(texts, 3, weights)[:2])))
    assert found(None) == found(np.array([1, 1, 1])) == [(0, 1), (1, 1)]
    assert found(np.array([1, 1, 2])) == [(0, 1), (1, 1), (2, 0), (2, 1), (2, 2)]
    row, off, name = method(texts, 3, np.array([2, 1, 3]))
    assert len(row) == 8 and len(set(name.tolist())) == 7
    for weights in ([1, 1, 2], [1, 1, 1], [3, 1, 2]):
        own = np.array(weights)
        want, got = method(texts, 3, own), method(texts, 3, own, np.array([False, False, True]))
        assert sorted(zip(*(x.tolist() for x in want[:2]))) == sorted(zip(*(x.tolist() for x in got[:2]))) and len(set(got[2].tolist())) == len(set(want[2].tolist()))


def test_random_small_alphabet(spark):
    rng = np.random.default_rng(3)
    texts = [" ".join(rng.choice(list("abc"), int(rng.integers(0, 60)))) for _ in range(60)]
    rule = Rule(8, (2, 4, 8), doubled, True, True)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_units"], r["n_removed"], bytes(r["kept"])) for r in without_repeats(docs, rule).collect()}
    assert got == expect(texts, rule)


def test_long_texts_are_cut_into_pieces_exactly(spark, monkeypatch):
    monkeypatch.setattr(windows, "SLAB", 64)
    texts = [LONG * 3, "q" * 700, LONG[5:300]]
    rule = Rule(30, (10, 20, 30), ordered, False, False)
    pieces = list(windows._pieces(texts[0].encode(), rule))
    assert sum(len(u) - rule.width + 1 for _, u in pieces) == len(texts[0]) - rule.width + 1
    words = Rule(7, (3, 7), doubled, True, True)
    pieces = list(windows._pieces((LONG * 9).encode(), words))
    assert sum(len(u) - 6 for _, u in pieces) == len((LONG * 9).split()) - 6


def test_null_ids_and_repeated_rows(spark):
    docs = spark.createDataFrame([(None, LONG), (5, LONG), (5, LONG), (None, None)], "doc_id long, text string")
    got = Counter((r["doc_id"], r["n_removed"]) for r in without_repeats(docs, WORDS).collect())
    assert got == Counter({(None, 0): 2, (5, 60): 2})  # nulls come first; both rows of 5 lose what the null row holds
    copies = spark.createDataFrame([(5, LONG * 3), (5, LONG * 3)], "doc_id long, text string")
    alone = expect([LONG * 3], WORDS)[0][1]
    assert alone > 0 and [r["n_removed"] for r in without_repeats(copies, WORDS).collect()] == [alone, alone]
    assert all(r["n_removed"] == r["n_units"] for r in without_repeats(copies, BYTES).collect())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert without_repeats(docs, WORDS).count() == 0 and without_repeats(docs, BYTES).count() == 0


def test_hash_of_kept_text(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert digested(without_repeats(docs, WORDS)).first()["kept_sha256"] == hashlib.sha256(b"a b").hexdigest()


@pytest.mark.parametrize("width", [1, 3, 8, 11, 16, 19])
def test_radix_passes_order_suffixes(width):
    rng = np.random.default_rng(width)
    data = rng.integers(97, 99 + width // 8, 3000).astype(np.uint8)
    starts = np.arange(len(data) - width + 1)
    order, group = radix_sorted(data, starts, width)
    parts = [data[s : s + width].tobytes() for s in order]
    assert parts == sorted(parts) and all((a == b) == (g == h) for a, b, g, h in zip(parts, parts[1:], group, group[1:]))
    count = Counter(data[s : s + width].tobytes() for s in starts)
    assert len(order) == sum(n for n in count.values() if n > 1)


def test_one_hot_passage_meets_in_many_tasks(spark, monkeypatch):
    """A passage in all documents, between texts of their own: below the limit one task compares a gram, above it its windows are split."""
    monkeypatch.setattr(windows, "LIMIT", 2000)
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"a{k}x{i}" for i in range(30)] + passage + [f"b{k}x{i}" for i in range(int(rng.integers(20, 40)))]) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    plain = windows.kept
    monkeypatch.setattr(windows, "kept", lambda df, label, *a: seen.append((label, out := plain(df, label, *a))) or out)
    got = {r["doc_id"]: r["n_removed"] for r in without_repeats(docs, WORDS).collect()}
    assert got == {k: 0 if k == 0 else 60 for k in range(150)}
    assert [x for x, _ in seen].count("runs-10") == 1  # the next level ran
    copies = next(df for x, df in seen if x == "wanted-5")
    units = copies.select(F.explode("wanted").alias("w")).where("NOT w.hot").groupBy("w.key").agg(F.sum(F.col("w.hi") - F.col("w.lo") + 20).alias("n"))
    assert (units.agg(F.max("n")).first()[0] or 0) <= 2000


def brute(folder, width, words, first_stays):
    """doc_id to (units, removed, spans): digests of all windows of a table, compared."""
    import pyarrow.parquet as pq

    table = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).sort_by("doc_id")
    docs = [(t or "").encode() for t in table["text"].to_pylist()]
    names = []
    for t in docs:
        if words:
            own = t.split()
            names.append([xxhash.xxh3_64_intdigest(b" ".join(own[i : i + width])) for i in range(len(own) - width + 1)])
        else:
            view = memoryview(t)
            names.append([xxhash.xxh3_64_intdigest(view[i : i + width]) for i in range(len(t) - width + 1)])
    sizes = np.array([len(x) for x in names])
    flat = np.concatenate([np.array(x, np.uint64) for x in names])
    order = np.argsort(flat, kind="stable")
    new = np.concatenate([[True], flat[order][1:] != flat[order][:-1]])
    repeated = ~new if first_stays else ~(new & np.append(new[1:], True))
    hit = np.zeros(len(flat), bool)
    hit[order] = repeated
    out = {}
    for i, t, own in zip(table["doc_id"].to_pylist(), docs, np.split(hit, np.cumsum(sizes)[:-1])):
        n = len(t.split()) if words else len(t)
        edge = np.zeros(n + 1, np.int64)
        at = np.flatnonzero(own)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + width, -1)
        gone = np.cumsum(edge[:n]) > 0
        out[i] = (n, int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()))
    return out


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01", *filter(None, os.environ.get("FOLIOSCOPE_BRUTE", "").split(","))])
def test_queries_equal_brute_force(spark, folder):
    """FOLIOSCOPE_BRUTE names more folders, such as the inputs of the check tool."""
    want = brute(folder, 400, False, False)
    rows = op6_suffixes(spark, folder).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in rows} == want and len(rows) == len(want)
    want = brute(folder, 20, True, True)
    rows = op3_substrings(spark, folder).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in rows} == {i: x[:2] for i, x in want.items()} and len(rows) == len(want)
