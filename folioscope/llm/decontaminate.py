"""Benchmark decontamination by templates: typed placeholders, hash-joined windows, consistent slots.

Tokens are space-separated words, lower-cased and stripped of punctuation at their ends; operators (+ * / = and the like, - after a
number) are tokens too. Numbers (digits, or number words, of which neighbours count as one), units and names (neighbours count as one)
become placeholders that keep their value as a slot. A capitalised word is a name wherever it stands, unless the benchmark has it in
lower case too, a tenth as often or more (among its LOWER most frequent such words). Windows of 8 tokens are hash-joined between documents and
benchmark: by their templates if 4 tokens are literal (operators included), else by their values, as a template of hardly anything but
placeholders says nothing: there, only unchanged values are found.

Windows of a document and an item on one diagonal make a run; runs on diagonals that lie close (a quarter of the item) belong
together, so words put in or left out don't hide an item. The tokens of runs are compared place by place: those of equal template are
matched, and half of the item's tokens must be. Slots are consistent if equal values of the item stand for equal values in the
document and different for different ones, wherever a placeholder is matched; if they aren't, there is no leak. Kinds: `exact` if all
tokens are matched on one diagonal and all values are equal; `reparameterised` if values differ consistently; `partial` if values are
equal but not all tokens are there in a row.

The benchmark's window hashes and words go to the tasks (as a broadcast variable) while they are at most KEYS windows; beyond that all
windows are shuffled for the join. Items of 3 to 7 tokens are matched whole: by template if 3 are literal, else by values. Items of one or
two tokens are no questions and match nothing, nor do null and empty texts and empty tables; very long texts are windowed whole. Rows that repeat a document give one result row; items of equal id and different text are matched each.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import NULL_ID, documents, identified, kept, lean, sided, text_batches, wrapped

WINDOW, LITERALS, COVER, APART = 8, 4, 0.5, 0.25
#: Least tokens of an item; literal ones of a short item that is matched by its template.
SHORTEST, SHORT_LITERALS = 3, 3
#: Words of the benchmark in lower case that are known not to be names, the most frequent ones.
LOWER = 200_000
KEYS = 4_000_000
UNITS = frozenset(
    "mm cm dm m km inch inches foot feet yard yards mile miles mg g kg t gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs "
    "ms s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years ml cl l liter liters litre litres gallon gallons "
    "hz khz mhz ghz w kw mw kwh j kj cal kcal v kv a ma n kn pa kpa bar atm k c f °c °f degree degrees mph kmh km/h m/s cent cents dollar dollars euro euros "
    "usd eur gbp $ € £ % percent bit bits byte bytes kb mb gb tb".split()
)
NUMBERS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty "
    "fifty sixty seventy eighty ninety hundred thousand million billion".split()
)
_NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*")
_GLUED = re.compile(r"(?<=\d)(?=[A-Za-z%°€£$+*=×÷^])|(?<=\d[+*=×÷^])(?=\d)")
OPERATORS, MINUS = frozenset("+*/=×÷^<>"), frozenset("-−–")
_PUNCTUATION = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "%$") + "«»“”„‘’…–—¿¡"
LITERAL, NUMBER, UNIT, NAME = range(4)
_HOLDER = np.array([0, 0x1D8E4E27C47D124F, 0x2545F4914F6CDD1D, 0x3C6EF372FE94F82B], np.uint64)
_CACHE = 800_000


def word_kind(word: str) -> tuple[str, int, bool]:
    """Core, kind by the word alone, whether it is capitalised."""
    if word.isalpha() and word.islower():  # most words
        return word, NUMBER if word in NUMBERS else UNIT if word in UNITS else LITERAL, False
    if word in OPERATORS or word in MINUS:
        return word if word in OPERATORS else "-", LITERAL, False
    core = word.strip(_PUNCTUATION)
    low = core.lower()
    if _NUMBER.fullmatch(core) or low in NUMBERS:
        return low, NUMBER, False
    if low in UNITS and (len(low) > 1 or core == low):
        return low, UNIT, False
    return low, LITERAL, core[:1].isupper() and core[1:].islower()


class Words:
    """Hash and flags of distinct words, cached up to a bound; columns: hash, kind, capital, blank, sought, spelled number, minus, in lower case known.

    With a vocabulary, only its literal words are sought and hashed; a window with any other can't match. Words like 5kg are two: they
    stand in `cut` with their parts, and at place -1.
    """

    def __init__(self, lower: frozenset[str], vocabulary: frozenset[str] | None = None) -> None:
        self.lower, self.vocabulary, self.index, self.cut, self.size = lower, vocabulary, {}, {}, 0
        self.table = [np.empty(1 << 16, t) for t in (np.uint64, np.int8, bool, bool, bool, bool, bool, bool)]

    def row(self, word: str) -> tuple:
        core, kind, capital = word_kind(word)
        sought = kind != LITERAL or self.vocabulary is None or core in self.vocabulary
        return xxhash.xxh64_intdigest(core.encode()) if sought else 0, kind, capital, not core, sought, kind == NUMBER and core.isalpha(), word in MINUS, core in self.lower

    def _learn(self, words: set[str]) -> None:
        for w in words:
            if not w.isalpha() and len(parts := _GLUED.sub(" ", w).split()) > 1:
                self.cut[w] = parts
        parts = {x for w in words if w in self.cut for x in self.cut[w]}
        new = [w for w in words - self.cut.keys() | parts if w not in self.index]
        n = self.size
        if n + len(new) > len(self.table[0]):
            self.table = [np.concatenate([c[:n], np.empty(n + 2 * len(new), c.dtype)]) for c in self.table]
        for c, values in zip(self.table, zip(*map(self.row, new))):
            c[n : n + len(new)] = np.array(values, c.dtype)
        self.index.update(zip(new, range(n, n + len(new))))
        self.size = n + len(new)
        self.index.update(dict.fromkeys(words & self.cut.keys(), -1))

    def split(self, texts: list[str]) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
        """The words of texts, their places in the table in one row, and how many each text has."""
        if len(self.index) > _CACHE:
            self.index.clear()
            self.cut.clear()
            self.size = 0
        index = self.index
        out = [t.split() for t in texts]
        places = [list(map(index.get, words)) for words in out]
        if new := {w for words, at in zip(out, places) if None in at for w, i in zip(words, at) if i is None}:
            self._learn(new)
        for k, (words, at) in enumerate(zip(out, places)):
            if None in at:
                at = places[k] = [index[w] for w in words]
            if -1 in at:
                out[k] = [x for w, i in zip(words, at) for x in (self.cut[w] if i < 0 else (w,))]
                places[k] = [index[w] for w in out[k]]
        sizes = np.array([len(x) for x in places], np.int64)
        return out, np.fromiter(chain.from_iterable(places), np.int64, sizes.sum()), sizes

    def tokens(self, at: np.ndarray, sizes: np.ndarray) -> Tokens:
        """The tokens of texts of so many words at these places."""
        hashed, kind, capital, blank, sought, spelled, minus, known = (a[at] for a in self.table)
        begins = np.zeros(len(at) + 1, bool)
        begins[np.cumsum(sizes) - sizes] = True
        begins = begins[:-1]
        kind = np.where((kind == LITERAL) & capital & ~known, NAME, kind)
        name = kind == NAME
        keep = ~blank & ~minus
        keep[1:] |= minus[1:] & (kind[:-1] == NUMBER) & ~begins[1:]
        keep[1:] &= begins[1:] | ~(name[1:] & name[:-1] | spelled[1:] & spelled[:-1])
        where = np.flatnonzero(keep)
        kind, value = kind[where], hashed[where]
        literal = kind == LITERAL
        text = np.repeat(np.arange(len(sizes)), sizes)
        return Tokens(np.where(literal, value, _HOLDER[kind]), value, kind, sought[where] | ~literal, where, text[where])


class Tokens(NamedTuple):
    """Of each token of some texts: template hash, hash of its first word, kind, whether it is sought, its first word, its text."""

    template: np.ndarray
    value: np.ndarray
    kind: np.ndarray
    sought: np.ndarray
    where: np.ndarray
    text: np.ndarray


def windows(t: Tokens, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and places of the windows of n sought tokens inside a text: of templates with enough literal tokens, else of values."""
    if not SHORTEST <= n <= len(t.kind):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    count = np.cumsum(np.concatenate([[0], t.sought]))
    at = np.flatnonzero((count[n:] - count[:-n] == n) & (t.text[n - 1 :] == t.text[: len(t.text) - n + 1]))
    literal = np.cumsum(np.concatenate([[0], t.kind == LITERAL]))
    many = literal[at + n] - literal[at] >= (LITERALS if n == WINDOW else SHORT_LITERALS)
    keys, places = [], []
    for own, column, seed in ((at[many], t.template, n), (at[~many], t.value, WINDOW - n)):
        out = np.full(len(own), seed, np.uint64)
        for k in range(n):
            out = (out ^ column[own + k]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        keys.append(out.view(np.int64))
        places.append(own)
    return np.concatenate(keys), np.concatenate(places)


_HITS = "_id long, _th long, key long, pos long, n long"


def _windowed(lower: Broadcast, sought: Broadcast | None, lengths: list[int] | None) -> Callable:
    """Windows of documents by the given lengths, all or those among sorted keys. No lengths: an item's own, WINDOW or the whole of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, vocabulary = sought.value if sought else (None, None)
        words = Words(lower.value, vocabulary)
        for b in batches:
            texts, ids = b.column("text").to_pylist(), [b.column(c).to_numpy() for c in ("_id", "_th")]
            for lo in range(0, len(texts), 100 if lengths else 1):
                part = texts[lo : lo + (100 if lengths else 1)]
                _, at, sizes = words.split(part)
                t = words.tokens(at, sizes)
                n = np.bincount(t.text, minlength=len(part))
                for own in lengths or [min(WINDOW, len(t.kind))]:
                    key, at = windows(t, own)
                    if keys is not None and len(key):
                        hit = keys[np.minimum(np.searchsorted(keys, key), len(keys) - 1)] == key if len(keys) else np.zeros(len(key), bool)
                        key, at = key[hit], at[hit]
                    if len(key):
                        of = t.text[at]
                        cols = [ids[0][lo + of], ids[1][lo + of], key, at - (np.cumsum(n) - n)[of], n[of]]
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["_id", "_th", "key", "pos", "n"])

    return lean(run)


def slots_agree(item: list[str], own: list[str]) -> bool:
    """Whether values map one to one."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    return all(there.setdefault(a, b) == b and back.setdefault(b, a) == a for a, b in zip(item, own))


_FOUND = "doc_id long, item_id long, kind string, n_matched long, n_item_tokens long, coverage double, position long"


def matched(item: Tokens, own: Tokens, runs: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    """Places in the item and in the document of tokens of equal template on the diagonals of runs; longer runs first, each place once."""
    place = np.full(len(item.kind), -1)
    used: set[int] = set()
    for r in sorted(runs, key=lambda r: (r["lo"] - r["hi"], r["diagonal"])):
        k = np.arange(max(r["lo"], -r["diagonal"]), min(r["hi"], len(own.kind) - r["diagonal"], len(item.kind)))
        k = k[(place[k] < 0) & (item.template[k] == own.template[k + r["diagonal"]])]
        k = k[[int(x) not in used for x in k + r["diagonal"]]] if used else k
        place[k] = k + r["diagonal"]
        used.update((k + r["diagonal"]).tolist())
    k = np.flatnonzero(place >= 0)
    return k, place[k]


def judged(cache: Words, item: str, own: str, runs: list[dict]) -> dict | None:
    """kind, n_matched, n_item_tokens, coverage and position of an item's place in a document, if it is a leak."""
    parts = []
    for text in (item, own):
        words, at, sizes = cache.split([text])
        parts.append((cache.tokens(at, sizes), words[0]))
    k, there = matched(parts[0][0], parts[1][0], runs)
    n = len(parts[0][0].kind)
    if not n or len(k) < COVER * n:
        return None
    slots = []
    for (t, words), at in zip(parts, (k, there)):
        ends = np.append(t.where[1:], len(words))
        slots.append([" ".join(w.strip(_PUNCTUATION).lower() for w in words[t.where[x] : ends[x]]).strip() for x in at[parts[0][0].kind[k] != LITERAL]])
    if not slots_agree(*slots):
        return None
    in_a_row = len(k) == n and (there - k == there[0] - k[0]).all()
    kind = "reparameterised" if slots[0] != slots[1] else "exact" if in_a_row else "partial"
    return {"kind": kind, "n_matched": len(k), "n_item_tokens": n, "coverage": round(len(k) / n, 6), "position": int(parts[1][0].where[there.min()])}


def _verified(lower: Broadcast) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = Words(lower.value)
        for b in batches:
            rows = [{"doc_id": x["doc_id"], "item_id": x["item_id"]} | found for x in b.to_pylist() if (found := judged(cache, x["item"], x["text"], x["runs"]))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([(c, {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[k]) for c, k in (f.split() for f in _FOUND.split(", "))]))

    return lean(run)


def lower_words(items: DataFrame) -> frozenset[str]:
    """The most frequent words that items have in lower case, a tenth as often as capitalised or more."""
    words = items.select(F.explode(F.split(F.coalesce("text", F.lit("")), r"(?U)\s+")).alias("word"))
    words = words.select(F.regexp_replace("word", r"^[^\p{L}]+|[^\p{L}]+$", "").alias("word")).where(F.col("word").rlike(r"^\p{L}\p{Ll}*$"))
    small = F.col("word") == F.lower("word")
    words = words.groupBy(F.lower("word").alias("word")).agg(F.count_if(small).alias("n"), F.count_if(~small).alias("capital")).where("n > 0 AND n * 10 >= capital")
    return frozenset(r["word"] for r in words.orderBy(F.desc("n"), "word").limit(LOWER).collect())


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, kind, n_matched, n_item_tokens, coverage, position (first word): one row for each document and item that it holds."""
    docs, spark = identified(docs), docs.sparkSession
    bench = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    bench = kept(bench.select("item_id", "text", F.coalesce("item_id", F.lit(NULL_ID)).alias("_id"), F.xxhash64("text").alias("_th")).dropDuplicates(["_id", "_th"]), "items")
    lower = spark.sparkContext.broadcast(lower_words(bench))
    theirs = kept(bench.select("_id", "_th", "text").mapInArrow(_windowed(lower, None, None), _HITS), "item-windows")
    sought = None
    if theirs.select("key").distinct().count() <= KEYS:  # so is what the vocabulary has
        cores = bench.select(F.explode(F.split(F.regexp_replace("text", r"(?U)\s+", " "), " ")).alias("word")).distinct()
        vocabulary = frozenset(word_kind(x)[0] for w in cores.toArrow()["word"].to_pylist() for x in _GLUED.sub(" ", w).split())
        keys = np.sort(theirs.select("key").distinct().toArrow()["key"].to_numpy())
        sought = spark.sparkContext.broadcast((keys, vocabulary))
    lengths = [r["n"] for r in theirs.select(F.least("n", F.lit(WINDOW)).alias("n")).distinct().collect()]  # WINDOW values at most
    hits = docs.select("_id", "_th", "text").mapInArrow(_windowed(lower, sought, lengths or [WINDOW]), _HITS)
    side = sided(theirs).select("key", F.col("_id").alias("item"), F.col("_th").alias("item_th"), F.col("pos").alias("item_pos"), F.col("n").alias("item_n"))
    joined = hits.select("_id", "_th", "key", "pos").join(side, "key")
    pair = ["_id", "_th", "item", "item_th", "item_n"]
    runs = joined.groupBy(*pair, (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(F.min("item_pos").alias("lo"), (F.max("item_pos") + F.least(F.lit(WINDOW), F.max("item_n"))).alias("hi"))
    by = Window.partitionBy(*pair).orderBy("diagonal")
    far = F.col("diagonal") - F.lag("diagonal").over(by) > F.greatest(F.lit(2), F.floor(F.col("item_n") * APART))
    runs = runs.withColumn("far", F.coalesce(far, F.lit(False))).withColumn("at", F.sum(F.col("far").cast("int")).over(by))
    runs = runs.groupBy(*pair, "at").agg(F.collect_list(F.struct("diagonal", "lo", "hi")).alias("runs"), F.sum(F.col("hi") - F.col("lo")).alias("span"))
    runs = kept(runs.where(F.col("span") >= COVER * F.col("item_n")).drop("at", "span"), "candidates")
    texts = bench.select(F.col("_id").alias("item"), F.col("_th").alias("item_th"), "item_id", F.col("text").alias("item_text"))
    small = sided(bench) is not bench
    found = docs.join(sided(runs), ["_id", "_th"]).join(F.broadcast(texts) if small else texts, ["item", "item_th"])
    found = found.select("doc_id", "item_id", "text", F.col("item_text").alias("item"), "runs")
    best = F.max(F.struct("coverage", "kind", "n_matched", "n_item_tokens", "position")).alias("x")
    return found.mapInArrow(_verified(lower), _FOUND).groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "x.kind", "x.n_matched", "x.n_item_tokens", "x.coverage", "x.position")


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of docs (all columns, whatever they are called) that hold no item."""
    ids = leaks(docs, items).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("_id")).distinct()
    gone = kept(ids, "leaked")
    return wrapped(docs).join(sided(gone), "_id", "left_anti").select("row.*")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    return leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
