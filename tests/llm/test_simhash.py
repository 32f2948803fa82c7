import re
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from folioscope.llm import simhash
from folioscope.llm.common import identified
from folioscope.llm.components import components
from folioscope.llm.simhash import fingerprint, linked, near_groups, one_of_each, shingle_hashes, simhash_groups, tuples_of


def roots(pairs, nodes):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components_of_chains_and_stars(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (300, 200), (200, 250)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = {n: r for n, r in roots(pairs, {n for p in pairs for n in p}).items()}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_end_with_one_root_a_node(spark):
    rng = np.random.default_rng(3)
    graphs = [[(1, 4), (4, 2), (2, 3), (3, 0)]]
    for n in (6, 10):
        names = rng.permutation(n).tolist()
        graphs.append(list(zip(names, names[1:])))
        graphs.append([(names[i], names[int(rng.integers(0, i))]) for i in range(1, n)])
    for pairs in graphs:
        got = [(r["node"], r["root"]) for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()]
        assert sorted(got) == sorted(roots(pairs, {n for p in pairs for n in p}).items()), pairs


def brute_links(values, most=3):
    return {(min(a, b), max(a, b)) for i, a in enumerate(values) for b in values[:i] if int(np.bitwise_count(np.int64(a ^ b).view(np.uint64))) <= most}


def clusters():
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 12)
    values = {int(b) for b in base}
    for b in base[:4]:
        for _ in range(40):
            values.add(int(b ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(1, 4)), replace=False))))
    return sorted(values)


def test_links_against_all_pairs_with_blocks_and_forests(spark, monkeypatch):
    values = clusters()
    points = spark.createDataFrame([(v, v) for v in values], "node long, f0 long")
    want = roots(brute_links(values), values)
    for block, dense, counted in ((4096, 10**9, 0), (4096, 0, 0), (8, 10**9, 0), (8, 0, 0), (4096, 10**9, 5), (4096, 0, 5), (8, 0, 5)):
        # the worker sees the module's values through the closure's globals only if it is pickled by value, so lists are tried directly
        monkeypatch.setattr(simhash, "BLOCK", block)
        monkeypatch.setattr(simhash, "DENSE", dense)
        tuples = tuples_of(4, 8) if counted else tuples_of(4, 7)
        post, tally, across = simhash._postings(tuples, 1), simhash._tally(1, 5, 3, counted), simhash._across(1, 5, 3, counted)
        posted = points.toArrow().to_batches()
        rows = [r for b in post(iter(posted)) for r in b.to_pylist()]
        rows.sort(key=lambda r: (r["key"], r["node"]))
        batches = [pa.RecordBatch.from_pylist(rows[i : i + 37]) for i in range(0, len(rows), 37)]
        out = [r for b in tally(iter(batches)) for r in b.to_pylist()]
        count = Counter()
        for r in out:
            if r["block"] is None:
                count[r["a"], r["b"]] += r["n"]
        blocks = [(r["list"], r["block"]) for r in out if r["block"] is not None]
        for i, (k, x) in enumerate(blocks):
            for m, y in blocks[:i]:
                if k == m:
                    for o in across(iter([pa.RecordBatch.from_pylist([{"x": x, "y": y}])])):
                        for r in o.to_pylist():
                            count[r["a"], r["b"]] += r["n"]
        pairs = {p for p, n in count.items() if n >= max(1, counted)}
        if counted:  # counts leave few pairs to verify
            pairs &= brute_links(values)
            assert len({p for p, n in count.items() if n >= counted}) < 1.5 * len(pairs) + 10
        assert roots(pairs, values) == want
        assert pairs <= brute_links(values)
        if dense:
            assert pairs == brute_links(values)
    for tuples, counted in ((tuples_of(4, 7), 0), (tuples_of(4, 8), 5)):
        got = {(r["a"], r["b"]) for r in linked(points, tuples, 1, 5, 3, counted).collect()}
        assert roots(got, values) == want


def test_blocks_of_a_hot_list_go_to_many_tasks(spark):
    rng = np.random.default_rng(2)
    values = np.unique(rng.integers(0, 2**31, 8 * simhash.BLOCK))[: 7 * simhash.BLOCK]
    parts = [np.stack([x, x], 1) for x in np.split(values, 7)]
    blocks = spark.createDataFrame([(1, bytearray(x.astype(np.int64).tobytes())) for x in parts], "list long, block binary")
    for threshold in ("-1", "100m"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        pairs = simhash.block_pairs(blocks)
        assert pairs.count() == 21 and pairs.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    low = str.maketrans({c: c + 32 for c in range(65, 91)})
    bits = {}
    for i, t in docs.items():
        words = [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate(low)) if w]
        grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
        h = np.array([xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams], np.uint64)
        bits[i] = sum(1 << k for k in range(64) if 2 * int((h >> np.uint64(k) & np.uint64(1)).sum()) > len(h))
    ids, f = list(bits), np.array(list(bits.values()), np.uint64)
    pairs = [(ids[i], ids[j]) for i in range(len(ids)) for j in np.flatnonzero(np.bitwise_count(f[:i] ^ f[i]) <= 3).tolist()]
    want = roots(pairs, ids)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash(spark, d).collect()}
    assert got == {i: (f"{bits[i]:016x}", want[i]) for i in ids}


def test_near_groups_of_the_table_equal_all_pairs(spark):
    """Recall of the pipeline's stage: every pair of texts at 0.8 or more is in one group, and groups hold nothing else."""
    docs = identified(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    sets = {r["_th"]: np.unique(shingle_hashes(r["text"], 5)) for r in docs.collect()}
    nodes = sorted(sets, key=lambda n: len(sets[n]))
    pairs = []
    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if len(sets[a]) < 0.8 * len(sets[b]):
                break
            both = len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                pairs.append((a, b))
    assert pairs and {r["_th"]: r["root"] for r in near_groups(docs).collect()} == roots(pairs, {n for p in pairs for n in p})


def test_frequent_shingles_are_dealt_out_by_blocks(spark, monkeypatch):
    """Postings of one shingle in blocks give the same pairs as in one list, and cells of one group and a few others only pairs between them."""
    monkeypatch.setattr(simhash, "CELL", 16)
    rng = np.random.default_rng(4)
    passage, rows = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen", []
    shared = np.unique(shingle_hashes(passage, 5))
    for k in range(200):
        rows.append({"node": int(rng.integers(0, 2**62)), "comp": 7 if k % 20 else k, "text": passage if k % 2 else passage[: passage.rindex(" ")]})
    batch = pa.RecordBatch.from_pylist(rows)
    found = {}
    for n_hot in (np.ones(10, np.int64), np.full(10, 13)):
        posted, pairs = crossed(batch, shared, np.full(10, 200), np.sort(shared.view(np.int64)), n_hot)
        cells = Counter((r[0], r[5]) for r in posted if r[6])
        found[max(cells.values())] = pairs
    comp = {r["node"]: r["comp"] for r in rows}
    want = {(min(a, b), max(a, b)) for a in comp for b in comp if comp[a] != comp[b]}
    assert all(x == want for x in found.values()) and max(found) == 200 and min(found) < 60


def crossed(batch, common, counts, hot, n_hot):
    """Postings of a batch, and the pairs that they give."""
    posted = [tuple(r.values()) for b in simhash._prefixes(common, counts, hot, n_hot, 5, 0.8)(iter([batch])) for r in b.to_pylist()]
    posted.sort(key=lambda r: (r[0], r[5], r[1], r[2]))
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*posted)], simhash._POSTING)
    return posted, {(r["a"], r["b"]) for b in simhash._crossing(0.8)(iter([table])) for r in b.to_pylist()}


def test_sets_that_share_a_hot_passage_but_differ_do_not_meet():
    """20,000 sets of 20 shingles with 17 in common (a similarity of 0.74): rows and indexed postings grow with the sets, and no pair comes of them; a near copy is found."""
    passage = " ".join(f"p{i}" for i in range(21))
    shared = np.unique(shingle_hashes(passage, 5))
    seen = {}
    for n in (2000, 20_000):
        rows = [{"node": k * 7919 + 1, "comp": k * 7919 + 1, "text": f"{passage} a{k} b{k} c{k}"} for k in range(n)]
        rows.append({"node": 5, "comp": 5, "text": f"{passage} a7 b7 other"})
        batch = pa.RecordBatch.from_pylist(rows)
        indexed = pa.Table.from_batches(simhash._indexed(shared, np.full(17, n), 5, 0.8)(iter([batch])))["key"].to_numpy()
        assert not np.isin(indexed.view(np.uint64), shared).any()
        posted, pairs = crossed(batch, shared, np.full(17, n), np.empty(0, np.int64), np.empty(0, np.int64))
        assert pairs == {(5, 7 * 7919 + 1)}
        seen[n] = len(posted)
    assert seen[20_000] <= 10 * seen[2000]


def test_fingerprints_by_definition():
    for text in ("", "a", "A b", "a b c", "x y z x y z q", " \tÄ b\x0bc\n d"):
        h = shingle_hashes(text, 3)
        want = sum(1 << k for k in range(64) if 2 * sum(int(v) >> k & 1 for v in h) > len(h))
        assert int(fingerprint(h)[0]) == want
    assert int(fingerprint(shingle_hashes("", 3))[0]) == 0
    assert (shingle_hashes("A B c", 3) == shingle_hashes("a b  C", 3)).all()


def test_groups_with_nulls_and_repeats(spark):
    rows = [(3, "one two three four"), (1, "ONE two\tthree four"), (1, "ONE two\tthree four"), (None, ""), (9, None), (None, "lonely words here")]
    docs = identified(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash_groups(docs).collect()), key=str)
    assert got == sorted([(3, 1), (1, 1), (1, 1), (None, 9), (9, 9), (None, None)], key=str)
    assert simhash_groups(identified(spark.createDataFrame([], "doc_id long, text string"))).count() == 0


def text(seed, n=120):
    rng = np.random.default_rng(seed)
    return [f"w{int(k)}" for k in rng.integers(0, 5000, n)]


def test_near_copies_and_the_one_that_stays(spark):
    a, b = text(1), text(2)
    near = list(a)
    near[60] = "changed"
    half = a[:60] + text(5, 60)
    rows = [(10, " ".join(a)), (4, " ".join(near)), (7, " ".join(b)), (8, " ".join(half)), (7, " ".join(b)), (None, "x"), (2, ""), (3, None)]
    docs = spark.createDataFrame([(i, t, f"kept {i}", 1) for i, t in rows], "doc_id long, text string, _id string, _th int")
    groups = {r["_th"]: r["root"] for r in near_groups(identified(docs)).collect()}
    assert len(groups) == 2 and len(set(groups.values())) == 1
    out = one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == sorted([4, 7, 8, None, 2], key=str)
    assert all(r["_id"] == f"kept {r['doc_id']}" and r["_th"] == 1 for r in out.collect())
    clash = docs.select("doc_id", "text", *(F.lit(k).alias(n) for k, n in enumerate(("_n", "n", "row", "low", "root"))))
    assert {tuple(r)[2:] for r in one_of_each(clash).collect()} == {(0, 1, 2, 3, 4)}
    assert one_of_each(docs.limit(0)).count() == 0


def test_near_groups_against_all_pairs(spark):
    """Repeated passages, and short texts with changes at their ends: the groups of brute force over all pairs."""
    rng = np.random.default_rng(9)
    texts = []
    for k in range(120):
        own = text(1000 + k, int(rng.integers(8, 40)))
        texts += [own, own + [f"end{k}"], [f"start{k}", *own]]
    long = text(77, 204)
    texts += [long, long + text(78, 14) * 10]
    texts = [" ".join(t) for t in texts]
    docs = identified(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:5], " ", "\t"])], "doc_id long, text string"))
    th = {r["doc_id"]: r["_th"] for r in docs.collect()}
    sets = {th[i]: set(shingle_hashes(t, 5).tolist()) for i, t in enumerate([*texts, *texts[:5], " ", "\t"])}
    nodes = sorted(sets)
    pairs = [(a, b) for i, a in enumerate(nodes) for b in nodes[:i] if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(pairs, {n for p in pairs for n in p})
    assert {r["_th"]: r["root"] for r in near_groups(docs).collect()} == want


def test_bitmaps_never_rule_out_similar_sets():
    rng = np.random.default_rng(6)
    rows, close = [], []
    for _ in range(400):
        n = int(rng.integers(1, 3000))
        a = rng.integers(0, 2**63, n, dtype=np.uint64)
        b = np.concatenate([a[int(n * rng.uniform(0, 0.25)) :], rng.integers(0, 2**63, int(n * rng.uniform(0, 0.25)), dtype=np.uint64)])
        both = len(np.intersect1d(a, b))
        close.append(both >= 0.8 * (len(a) + len(b) - both))
        rows.append({"a": len(rows), "b": 0, "n": len(a), "m": len(b), "x": simhash.parity_bits(a), "y": simhash.parity_bits(b)})
    kept = {r["a"] for b in simhash._may_be_similar(0.8)(iter([pa.RecordBatch.from_pylist(rows)])) for r in b.to_pylist()}
    assert {k for k, c in enumerate(close) if c} <= kept and 0 < sum(close) <= len(kept) < 400
