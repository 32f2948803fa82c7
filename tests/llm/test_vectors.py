"""Embedding near-duplicates, whitening and ranked search against brute force."""

import heapq
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import ranked, vectors, whitening
from folioscope.llm.queries import QUERIES

D = "/root/testdata/sf0.01"
ROW = "vec_id long, embedding array<float>, label int"


def links_of(rows):
    """vec_id -> (n_links, component_id) by all pairs; ids are distinct."""
    unit = {}
    for i, v, label in rows:
        a = np.array([float("nan") if x is None else x for x in v or []], float)
        if label is not None and len(a) and np.isfinite(a).all() and a.any():
            unit[i] = a / np.sqrt((a * a).sum()), label
    root = {r[0]: r[0] for r in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n, close = Counter(), set()
    ids = sorted(unit)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            (a, la), (b, lb) = unit[i], unit[j]
            if la == lb and len(a) == len(b) and a @ b >= 0.98:
                n.update((i, j))
                close.add((i, j))
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return {r[0]: (n[r[0]], find(r[0])) for r in rows}, close


def planted(seed, n=300, groups=12, d=16):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, d))
    rows = []
    for i in range(n):
        c = centres[int(rng.integers(groups)) if i % 3 else 0]
        v = c + rng.standard_normal(d) * np.linalg.norm(c) * rng.choice([0, 0.02, 0.03, 0.05]) if i % 4 else rng.standard_normal(d)
        rows.append((i * 7 + 3, [float(np.float32(x)) for x in v * rng.choice([1.0, 1e-20, 1e15])], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("block", [vectors.BLOCK, 16])
def test_links_by_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = planted(seed)
    want, close = links_of(rows)
    assert len(close) > 1000
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vectors.near_vectors(spark.createDataFrame(rows, ROW)).collect()}
    assert sum(n for n, _ in got.values()) >= 0.999 * sum(n for n, _ in want.values())
    assert all(got[i][0] <= want[i][0] for i in want) and {i: c for i, (_, c) in got.items()} == {i: c for i, (_, c) in want.items()}


def test_pairs_at_the_least_cosine_are_found_to_the_calibrated_recall(spark, monkeypatch):
    """400 pairs barely above 0.98 among 12,000 vectors, so cells have several projections."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((12_000, 32))
    base /= np.linalg.norm(base, axis=1)[:, None]
    side = rng.standard_normal((400, 32))
    side -= (side * base[:400]).sum(1)[:, None] * base[:400]
    side /= np.linalg.norm(side, axis=1)[:, None]
    near = 0.98001 * base[:400] + math.sqrt(1 - 0.98001**2) * side
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([base, near]))]
    p = vectors.plan(len(rows))
    assert p.width >= 4 and p.least >= 2
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert vectors.near_vectors(df).where("n_links > 0").count() >= 2 * 396


def test_unusable_vectors_labels_and_repeats(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0], 1), (4, [nan, 1.0], 1), (5, [inf, 1.0], 1), (6, [None, 1.0], 1), (7, [1.0, 0.0], None), (8, [1.0, 0.0], None)]
    good = [(20, [1.0, 0.0], 1), (21, [2.0, 0.0], 1), (22, [1.0, 0.0], 2), (23, [1.0, 0.0, 0.0], 1), (24, [1.0, 0.1], 1), (25, [-1.0, 0.0], 1)]
    rows = odd + good + [(20, [1.0, 0.0], 1), (None, [1.0, 0.0], 2), (None, [0.0, 5.0], 9)]
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], ROW + ", links int, H1 int")
    got = Counter(map(tuple, vectors.near_vectors(df).collect()))
    alone = {(i, 0, i): 1 for i in [1, 2, 3, 4, 5, 6, 7, 8, 23, 25]}
    assert got == Counter(alone | {(20, 2, 20): 2, (21, 2, 20): 1, (24, 2, 20): 1, (22, 1, None): 1, (None, 1, None): 1, (None, 0, None): 1})
    none = vectors.near_vectors(spark.createDataFrame([], ROW))
    assert none.columns == ["vec_id", "n_links", "component_id"] and none.count() == 0
    assert vectors.near_vectors(spark.createDataFrame(odd, ROW)).count() == len(odd)


def test_op13_on_whole_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    want, _ = links_of(rows)
    got = QUERIES["op13_near_vectors"](spark, D).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in got} == want and len(got) == len(rows)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_cross_products_are_exact():
    rng = random.Random(3)
    for spread in (1, 1000, 2**30, 2**41):
        x = np.array([[rng.randrange(-spread, spread) for _ in range(5)] for _ in range(130)], np.int64)
        x[:, 4] = 7
        sums, squares = whitening.cross_products(x)
        big = x.astype(object)
        assert sums.tolist() == big.sum(0).tolist() and squares.tolist() == (big.T @ big).tolist()


def test_op12_on_whole_tables(spark):
    df = spark.read.parquet(f"{D}/embeddings.parquet")
    v = {r["vec_id"]: r["embedding"] for r in df.collect()}
    ids = sorted(v)
    x = np.floor(1024 * np.array([v[i] for i in ids], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    deviation = ((n * x - s) ** 2).sum(1)
    values, columns = np.linalg.eigh(np.cov((x - s / n).T, bias=True))
    want = (x - s / n) @ columns[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    got = sorted(QUERIES["op12_whitening"](spark, D).collect(), key=lambda r: (r["vec_id"], r["component"]))
    assert [(r["vec_id"], r["component"]) for r in got] == [(i, k) for i in ids for k in range(1, 9)]
    assert [r["deviation"] for r in got[::8]] == deviation.tolist() and {r["n"] for r in got} == {n}
    w = np.array([r["whitened"] for r in got]).reshape(-1, 8)
    assert np.abs(w * np.sign((w * want).sum(0)) - want).max() < 1e-9
    assert np.allclose([r["explained"] for r in got[:8]], values[::-1][:8] / values.sum(), rtol=1e-10)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9


def test_whitening_of_odd_tables(spark, tmp_path):
    def run(rows):
        at = str(tmp_path / f"t{len(rows)}-{random.random()}")
        spark.createDataFrame(rows, ROW + ", N int").write.parquet(f"{at}/embeddings.parquet")
        return whitening.op12_whitening(spark, at).collect()

    nan = float("nan")
    assert run([]) == run([(1, None, 1, 0)]) == run([(1, [1.0, 2.0], 1, 0)]) == run([(1, [1.0, 2.0], 1, 0)] * 3) == []
    good = [(1, [0.0, 1.0], 1, 0), (2, [1.0, 1.0], None, 0), (None, [2.0, 1.0], 1, 0), (2, [1.0, 1.0], 1, 0)]
    bad = [(5, [nan, 1.0], 1, 0), (6, [None, 1.0], 1, 0), (7, None, 1, 0), (8, [], 1, 0), (9, [1.0, 2.0, 3.0], 1, 0)]
    got = run(good + bad)  # one dimension alone varies
    assert Counter((r["vec_id"], r["component"], r["n"]) for r in got) == Counter([(1, 1, 4), (2, 1, 4), (2, 1, 4), (None, 1, 4)])
    assert {r["explained"] for r in got} == {1.0} and all(r["deviation"] is not None for r in got)
    with pytest.raises(Exception, match="or more in size"):
        run([(1, [1e30, 1.0], 1, 0)])


WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute_search(docs, items, k=10):
    lists = [(i, words(t)) for i, t in docs]
    n, total = sum(bool(w) for _, w in lists), sum(len(w) for _, w in lists)
    df = Counter(t for _, w in lists for t in set(w))
    out = []
    for item, text in items:
        found = []
        for doc, w in lists:
            tf, score = Counter(w), 0
            for t in words(text):
                if tf[t]:
                    m = 100 - 75 + (75 * len(w) * n) // total
                    score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                found.append((-score, doc))
        out += [(item, rank, doc, -s) for rank, (s, doc) in enumerate(heapq.nsmallest(k, found), 1)]
    return out


def test_search_by_brute_force(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["Alpha", "BETA", "gamma", "Ärger", "ärger", "x1", "日本", "delta", "e", "f"]
    texts = [rng.choice(["", " ", "\n"]).join(f"{rng.choice(vocabulary)}{rng.choice([' ', ', ', '-', chr(0x7F)])}" for _ in range(rng.randrange(0, 30))) for _ in range(260)]
    docs = list(enumerate(texts * 3))  # equal scores beyond any k
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 9)))) for i in range(25)] + [(90, ""), (91, "unknown"), (92, None)]
    monkeypatch.setattr(ranked, "ITEMS", 7)
    monkeypatch.setattr(ranked, "DOCUMENTS", 50)
    monkeypatch.setattr(ranked, "EXACT", 2**35)  # many vocabulary tiles
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    want = sorted(brute_search(docs, items))
    assert sorted(map(tuple, ranked.search(d, q).collect())) == want
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 400)  # several passes
    assert sorted(map(tuple, ranked.search(d, q).collect())) == want


def test_search_of_odd_tables(spark):
    doc, item = "doc_id long, text string, N int, item int", "item_id long, text string, score int"
    d = spark.createDataFrame([(1, "a b", 0, 0), (1, "a b", 0, 0), (None, "a b", 0, 0), (2, None, 0, 0), (3, "", 0, 0), (4, "c " * 200_000 + "a", 0, 0)], doc)
    q = spark.createDataFrame([(7, "A a", 0), (7, "A a", 0), (7, "c", 0), (None, "a", 0)], item)
    got = ranked.search(d, q).collect()
    assert Counter((r["item_id"], r["rank"], r["doc_id"]) for r in got) == Counter(
        [(i, k, x) for i in (7, None) for k, x in ((1, None), (2, 1), (3, 1), (4, 4))] + [(7, 1, 4)]
    )
    assert ranked.search(spark.createDataFrame([], doc), q).count() == ranked.search(d, spark.createDataFrame([], item)).count() == 0
    assert ranked.search(d.where("text is null"), q).count() == 0


def test_op11_on_whole_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{D}/benchmark.parquet").select("item_id", "text").collect()][:8]
    got = QUERIES["op11_ranked_search"](spark, D)
    assert got.count() == 400
    own = got.where(F.col("item_id").isin([i for i, _ in items]))
    assert sorted(map(tuple, own.select("item_id", "rank", "doc_id", "score").collect())) == sorted(brute_search(docs, items))
