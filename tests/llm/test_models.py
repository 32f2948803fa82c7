"""Quality classifier, decontamination, the pipeline and the registered queries."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from folioscope.llm import queries
from folioscope.llm.decontaminate import _PUNCTUATION, leaks, slots_agree, without_leaks, word_kind
from folioscope.llm.quality import BUCKETS, Model, WordSums, document_features, fitted, good_documents, op7_quality, scored, train

D = "/root/testdata/sf0.001"


def test_features_and_folded_scores():
    ids, n = document_features("the the cat")
    assert n.sum() > 0 and len(document_features("")[0]) == 0
    rows = [(*document_features(f"good words number {i} here"), 1) for i in range(60)] + [(*document_features(f"bad!!! bad!!! {i}*** spam"), 0) for i in range(60)]
    model = train(rows)
    words = WordSums(model)
    good, bad, none = words.score(["good words number 99 here", "bad!!! 7*** spam", ""])
    assert good > 0.9 and bad < 0.1 and 0 <= none <= 1
    direct = model.scores(np.array([(model.weights[ids] * n).sum()]), np.array([n.sum()]))[0]
    assert abs(words.score(["the the cat"])[0] - direct) < 1e-6
    again = train(rows)
    assert (again.weights == model.weights).all()


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = op7_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    good = sum(r["predicted"] == r["quality"] for r in rows) / len(rows)
    assert good >= 0.97, good


def test_scores_with_nulls_and_no_labels(spark):
    docs = spark.createDataFrame([(None, None), (1, ""), (1, ""), (2, "some text")], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fitted(docs, labels)
    assert [r["_score"] for r in scored(docs, model).collect()] == [0.5] * 4
    assert scored(docs.limit(0), Model(model.weights, 0.0)).count() == 0
    some = spark.createDataFrame([(2, 1, 0), (2, None, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert scored(docs, fitted(docs, some)).count() == 4


ITEM = "A train leaves Berlin at 9 and covers 120 km in two hours before it reaches the station near Anna Schmidt who waits"


def test_leaks_exact_reparameterised_and_inconsistent(spark):
    swapped = ITEM.replace("Berlin", "Munich").replace("120", "350").replace("9", "7").replace("Anna Schmidt", "Karl Otto Maier")
    twice = "The farmer sells 5 apples and then 5 pears and later 5 plums to the shop on the corner today"
    rows = [
        (1, f"filler words first. {ITEM} and more text after it"), (2, f"so then {swapped} okay"), (3, "clean text about a train and a station " * 5), (4, None), (5, ""),
        (6, twice.replace("5", "8")), (7, twice.replace("5 pears", "6 pears")), (1, f"filler words first. {ITEM} and more text after it"), (None, ITEM), (8, ITEM[: len(ITEM) // 4]),
        (9, "tiny item of just seven known tokens"),
    ]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item string")
    items = spark.createDataFrame([(100, ITEM), (101, twice), (102, None), (103, "one two 3 4"), (104, "tiny item of just seven known tokens")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["kind"] for r in leaks(docs, items).collect()}
    assert got == {(1, 100): "exact", (2, 100): "reparameterised", (6, 101): "reparameterised", (None, 100): "exact", (9, 104): "exact"}
    out = without_leaks(docs, items)
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()) == [3, 4, 5, 7, 8]
    assert leaks(docs.limit(0), items).count() == 0 and leaks(docs, items.limit(0)).count() == 0


def kinds(spark, rows, items):
    docs = spark.createDataFrame([(i, f"some words before it {t} and after it") for i, t in rows], "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]): r["kind"] for r in leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_slots_are_compared_around_changed_tokens(spark):
    item = "the farmer sells 5 apples and then 5 pears to the shop on the corner while later the brother brings 5 plums to the market today"
    reworded = item.replace("while later", "while soon")
    inserted = item.replace("on the corner while later", "on the very old corner while sometimes later")
    rows = [(1, item), (2, reworded), (3, reworded.replace("5", "8")), (4, reworded.replace("5 pears", "6 pears")), (5, inserted), (6, inserted.replace("5", "twenty five")), (7, item.replace("5 apples", "6 apples")), (8, item.replace(" then", ""))]
    assert kinds(spark, rows, [(100, item)]) == {(k, 100): x for k, x in {1: "exact", 2: "partial", 3: "reparameterised", 5: "partial", 6: "reparameterised", 8: "partial"}.items()}


def test_items_full_of_numbers_and_number_words(spark):
    sums = "12 + 7 = 19 and 3 km 40 m 9 s 11 kg 8 cm are 30 31 32 33"
    rows = [(1, sums), (2, sums.replace("12", "13")), (3, "a train needs twenty five minutes for the way from the old town to the new one"), (4, "a train needs 30 minutes for the way from the old town to the new one")]
    items = [(100, sums), (101, "a train needs thirty minutes for the way from the old town to the new one")]
    assert kinds(spark, rows, items) == {(1, 100): "exact", (2, 100): "partial", (3, 101): "reparameterised", (4, 101): "reparameterised"}


def lower_of(texts):
    words = Counter(w for t in texts for x in (t or "").split() if (w := x.strip(_PUNCTUATION)).isalpha())
    return {w for w in words if w == w.lower() and 10 * words[w] >= words[w.capitalize()]}


@pytest.mark.parametrize("changed", [True, False])
def test_short_questions_sums_and_names_at_sentence_starts(spark, changed):
    items = [
        (1, "What is 7 times 8?"), (2, "Compute 12 + 5 - 3 * 4 + 20 - 6 = 19 now"), (3, "Anna has 3 apples and Ben has 5 pears , so how many more pears are there in all ?"),
        (4, "Paul buys 4 pens. Anna buys 4 books. How many items does Paul have after Anna gives him 2 of them?"), (5, "3 4"), (6, "yes"), (7, "12 km"), (8, "It is so that what 7x8=56 means is clear"),
    ]
    rows = {
        True: [(1, "What is 9 times 3?"), (2, "Compute 11 + 7 - 2 * 5 + 30 - 8 = 32 now"), (3, "Lara has 4 apples and Tom has 9 pears , so how many more pears are there in all ?"),
               (4, "Lisa buys 6 pens. Tom buys 6 books. How many items does Lisa have after Tom gives him 3 of them?")],
        False: [(1, "What is a times table?"), (2, "Compute 11 * 7 / 2 + 5 / 30 = 8 soon"), (3, "Lara has 4 apples and Lara has 9 pears , so how many more pears are there in all ?"),
                (4, "Lisa buys 6 pens. Lisa buys 7 books. How many items does Tom have after Lisa gives him 3 of them?"), (5, "3 4 yes 12 km")],
    }
    exact = [(i + 100, t) for i, t in items[:4]] + [(108, items[7][1])]
    want = {(i + 100, i): "exact" for i in (1, 2, 3, 4, 8)} | ({(i, i): "reparameterised" for i in (1, 2, 3, 4)} if changed else {})
    assert kinds(spark, rows[changed] + exact, items) == want


def test_recall_of_reparameterised_items_by_number_of_literals(spark):
    """Every value of an item is changed to another, consistently; items have 3 literal tokens (of 5 to 7) to 20."""
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ba", "do", "ke", "li", "mu", "ta", "so") for b in ("rn", "st", "lk", "mp", "nd", "gel")]
    names, items, docs = ["Anna", "Ben", "Carla", "Dora", "Emil", "Fritz"], [], []
    for k in range(160):
        n = 3 + k % 18
        values = [*rng.sample(names, 2), *map(str, rng.sample(range(2, 90), 2))]
        slots = [rng.choice(values) for _ in range(max(2, n // 3))]
        own = rng.choices(words, k=n)
        for v in slots:
            own.insert(rng.randrange(len(own) + 1), v)
        items.append((k, " ".join(own)))
        new = dict(zip(values, [*rng.sample(sorted({"Gina", "Hans", "Ida", "Jan"}), 2), *map(str, rng.sample(range(100, 900), 2))]))
        docs.append((k, "filler " * rng.randrange(1, 30) + " ".join(new.get(w, w) for w in own) + " and more filler"))
    rows = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {r["doc_id"] for r in rows if r["doc_id"] == r["item_id"] and r["kind"] == "reparameterised"}
    by = {n: np.mean([k in found for k in range(160) if 3 + k % 18 == n]) for n in range(3, 21)}
    print("recall by literals", {n: round(float(x), 2) for n, x in by.items()})
    assert len(found) >= 0.9 * 160 and len(rows) == len({(r["doc_id"], r["item_id"]) for r in rows})


def plain_tokens(text, lower):
    """(template, value, core) of each token, one word after another."""
    out, before = [], None
    for word in re.sub(r"(?<=\d)(?=[A-Za-z%°€£$+*=×÷^])|(?<=\d[+*=×÷^])(?=\d)", " ", text).split():
        core, kind, capital = word_kind(word)
        kind = 3 if kind == 0 and capital and core not in lower else kind
        spelled = kind == 1 and core.isalpha()
        if word in ("-", "–", "−") and not (before and before[0] == 1):
            core = ""
        if core:
            value = word.strip(_PUNCTUATION).lower()
            if before and (kind == 3 and before[0] == 3 or spelled and before[1]):
                out[-1][1] += " " + value
            else:
                out.append([core if kind == 0 else kind, value, core])
        before = (kind, spelled)
    return [tuple(x) for x in out]


def brute_leak(doc, item, lower):
    """kind by the docstring's rules, over all windows and all diagonals."""
    own, its = plain_tokens(doc, lower), plain_tokens(item, lower)
    n = min(8, len(its)) if len(its) >= 3 else 0

    def key(tokens, at):
        part = tokens[at : at + n]
        if sum(isinstance(t[0], str) for t in part) >= (4 if n == 8 else 3):
            return tuple(t[0] for t in part)
        return ("values", *(t[2] for t in part))

    if not n:
        return None
    runs = {}
    for i in range(len(own) - n + 1):
        for j in range(len(its) - n + 1):
            if (k := key(own, i)) is not None and k == key(its, j):
                lo, hi = runs.get(i - j, (j, j))
                runs[i - j] = (min(lo, j), max(hi, j))
    groups = []
    for d in sorted(runs):
        if groups and d - groups[-1][-1] <= max(2, len(its) // 4):
            groups[-1].append(d)
        else:
            groups.append([d])
    found = []
    for g in groups:
        if sum(runs[d][1] + n - runs[d][0] for d in g) < 0.5 * len(its):
            continue
        place = {}
        for d in sorted(g, key=lambda d: (runs[d][0] - runs[d][1], d)):
            for j in range(runs[d][0], runs[d][1] + n):
                if j not in place and j + d not in place.values() and its[j][0] == own[j + d][0]:
                    place[j] = j + d
        slots = [(its[j][1], own[i][1]) for j, i in sorted(place.items()) if not isinstance(its[j][0], str)]
        if len(place) >= 0.5 * len(its) and len({a for a, _ in slots}) == len({b for _, b in slots}) == len(set(slots)):
            straight = len(place) == len(its) and len({i - j for j, i in place.items()}) == 1
            found.append((round(len(place) / len(its), 6), "reparameterised" if any(a != b for a, b in slots) else "exact" if straight else "partial"))
    return max(found)[1] if found else None


def test_leaks_by_brute_force_over_all_alignments(spark):
    rng = random.Random(5)
    words = "the a of shop farmer sells train leaves apples pears and then to with corner market. Then + - =".split()
    slot = lambda: rng.choice(["5", "6", "7", "twenty", "five", "km", "Berlin", "Anna", "10kg", "3+4", "Ben."])
    items = [(k, " ".join(slot() if rng.random() < 0.25 + 0.4 * (k % 4 == 0) else rng.choice(words) for _ in range(rng.randrange(3, 30)))) for k in range(25)]
    docs = [(0, ""), (1, None)]
    for k in range(2, 150):
        own = rng.choice(items)[1].split()
        for _ in range(rng.randrange(0, 4)):
            at = rng.randrange(len(own) + 1)
            change = rng.randrange(4)
            own = own[:at] + [slot()] + own[at + 1 :] if change == 0 else own[:at] + own[at + 1 :] if change == 1 else own[:at] + [rng.choice(words)] + own[at:] if change == 2 else [w.replace("5", "8") for w in own]
        docs.append((k, " ".join(["Some", *rng.choices(words, k=rng.randrange(0, 9)), *own, *rng.choices(words, k=3), *(own if k % 9 == 0 else [])])))
    docs.append((150, " ".join(rng.choices(words, k=40_000)) + " " + items[3][1]))  # a very long text
    lower = lower_of(item for _, item in items)
    want = {(i, k): x for i, t in docs[:-1] for k, item in items if (x := brute_leak(t or "", item, lower))}
    rows = leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], r["item_id"]): r["kind"] for r in rows if r["doc_id"] < 150} == want
    assert set(want.values()) == {"exact", "reparameterised", "partial"} and (150, 3) in {(r["doc_id"], r["item_id"]) for r in rows}


def test_beyond_the_key_bound_windows_are_shuffled(spark, monkeypatch):
    from folioscope.llm import decontaminate

    docs = spark.createDataFrame([(1, f"x {ITEM} y"), (2, "nothing here")], "doc_id long, text string")
    items = spark.createDataFrame([(100, ITEM)], "item_id long, text string")
    monkeypatch.setattr(decontaminate, "KEYS", 0)
    assert [r["doc_id"] for r in leaks(docs, items).collect()] == [1]


def test_words_and_slots():
    assert word_kind("120")[1] == 1 and word_kind("km")[1] == 2 and word_kind("Berlin,") == ("berlin", 0, True) and word_kind("+") == ("+", 0, False)
    assert slots_agree(["1", "2", "1"], ["5", "6", "5"]) and not slots_agree(["1", "1"], ["5", "6"]) and not slots_agree(["1", "2"], ["5", "5"])


def test_planted_benchmark_passages(spark):
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet").toPandas() for t in ("documents", "benchmark"))
    flat = [" ".join(t.split()) for t in docs.text]
    want = {(i, k) for k, t in zip(items.item_id, items.text) for i, x in zip(docs.doc_id, flat) if " ".join(t.split()) in x}
    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op8_decontaminate"](spark, d).collect()}
    assert want <= got


CLASHES = ["_id", "_th", "_n", "_gone", "_score", "row", "n", "root", "gone", "left", "n_lines", "text_", "h1"]


def test_pipeline_stages(spark):
    """Columns with the operators' own names pass with their values; rows that stay are rows that were there."""
    docs = spark.read.parquet(f"{D}/documents.parquet")
    docs = docs.select("*", *(F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in CLASHES))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, D)
        out.write.parquet(path := f"{spark.conf.get('spark.checkpoint.dir')}/t-{name}")
        docs, old = spark.read.parquet(path), docs
        if name != "encoding":
            assert docs.columns == old.columns
            assert docs.where(" OR ".join(f"`{c}` IS NULL OR `{c}` <> concat('{c}-', doc_id)" for c in CLASHES)).isEmpty()
            same = [c for c in docs.columns if c != "text" or name != "line_dedup"]
            assert docs.select(same).exceptAll(old.select(same)).isEmpty()
    assert 0 < docs.count() < before and docs.where("not round_trip").count() == 0


def test_scores_of_very_long_texts_and_clashing_names(spark):
    docs = spark.createDataFrame([(1, "good words " * 100_000, 1.5), (2, None, 1.5)], "doc_id long, text string, _score double")
    model = Model(np.ones(2 * BUCKETS, np.float32), 0.0)
    out = good_documents(docs, model)
    assert out.columns == docs.columns and sorted((r["doc_id"], r["_score"]) for r in out.collect()) == [(1, 1.5), (2, 1.5)]


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_have_a_row_a_document(spark, name):
    out = queries.QUERIES[name](spark, D)
    n = out.count()
    if name in ("op11_ranked_search", "op12_whitening", "op13_near_vectors"):
        assert n > 0
        return
    assert n == spark.read.parquet(f"{D}/documents.parquet").count() or name == "op8_decontaminate" and n > 0
