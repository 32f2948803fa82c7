"""Lists of representatives as joins carry them."""

import numpy as np
from pyspark.sql import functions as F

from folioscope.llm import windows
from folioscope.llm.common import held_bytes
from folioscope.llm.substrings import WORDS
from folioscope.llm.windows import without_repeats


def test_lists_are_narrow_and_choose(spark):
    one = "array<struct<key:long,ctx:long,n:long,multi:long,lo:long,hi:long,hot:boolean>>"
    rows = [(1, 1, [(5, 6, 1, 0, 0, 4095, False), (7, 8, 2, 1, 3, 3, True), (9, 9, 1, 1, 1, 2, True)]), (2, 2, [(9, 9, 1, 0, 0, 0, True)])]
    wanted = spark.createDataFrame(rows, f"_id long, _th long, wanted {one}")
    own = windows._lists(wanted, lambda x: ~x["hot"] | (x["n"] > 1))
    assert [tuple(r) for r in own.collect()] == [(1, 1, [5, 7], [6, 8], [1, 2], [0, 3], [4095, 0], [0, 3])]
    hot = {r["_id"]: (r["key"], r["kind"]) for r in windows._lists(wanted, lambda x: x["hot"]).collect()}
    assert hot == {1: ([7, 9], [3, 3]), 2: ([9], [2])}
    many = spark.createDataFrame([(1, 1, rows[0][2][:1] * 1000)], wanted.schema)
    assert held_bytes(windows._lists(many, lambda x: ~x["hot"])) < held_bytes(many) / 1.9


def test_a_few_hot_grams_do_not_shuffle_the_documents(spark, monkeypatch):
    """The list of hot grams is judged on its own: only the long one passes the limit."""
    monkeypatch.setattr(windows, "LIMIT", 2000)
    rng = np.random.default_rng(5)
    passage = [f"p{i}" for i in range(60)]
    texts = [" ".join([f"a{k}x{i}" for i in range(30)] + passage + [f"b{k}x{i}" for i in range(int(rng.integers(20, 40)))]) for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    judged = []
    plain = windows.sided
    monkeypatch.setattr(windows, "sided", lambda side, *a, **k: judged.append(side) or plain(side, *a, **k))
    got = {r["doc_id"]: r["n_removed"] for r in without_repeats(docs, WORDS).collect()}
    assert got == {k: 0 if k == 0 else 60 for k in range(150)}
    lists = [df for df in judged if "kind" in df.columns]
    assert len(lists) >= 3
    flags = [{k & 2 for r in df.select(F.explode("kind").alias("k")).collect() for k in r} for df in lists[:2]]
    assert flags[1] == {2} and held_bytes(lists[1]) > 0
