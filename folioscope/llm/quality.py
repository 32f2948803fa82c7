"""Quality classifier: supervised subword embeddings, trained by numpy stochastic gradient descent.

A word has hashed features: itself and its byte n-grams (3 to 5, with word-end marks). A word that repeats the one before it
also counts as the mark AGAIN, which has a vector as words have. A document is the average of the
learned vectors of all features of all its words; a softmax over two classes gives its score. As the output is linear in the
average, a trained model folds into one number a feature, so that scoring is a sum of numbers over words (distinct words
are hashed once per task, in batches).

Training takes at most SAMPLE labelled documents, those with the smallest hash of doc_id; whole texts count. Rows with
crc32(doc_id as text) mod 5 = 0 are held out. Null texts are empty and score as the learned prior; without any label every
score is 0.5. Rows are scored each, so equal texts have equal scores; very long texts are scored whole, a few rows at a time. An
empty table gives no row.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.llm.common import documents, lean, text_batches, unused
from folioscope.llm.windows import _BYTE, _hashes, _prefix

BUCKETS, DIM, GRAMS = 1 << 15, 16, (3, 4, 5)
SAMPLE, EPOCHS, RATE, SEED = 3000, 4, 0.5, 7
THRESHOLD, FOLDS = 0.3, 5
#: Holds a space, so that it equals no word.
AGAIN = b"a word again"
#: Vectors move this much faster than the output layer, as each has only its share in an average.
FASTER = 20
_CACHE = 300_000


def word_features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature ids of all words in a row, and how many each word has. Ids below BUCKETS are n-grams, the rest whole words."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    prefix = _prefix(_BYTE[data])
    of = np.repeat(np.arange(len(words)), sizes)
    left = (starts + sizes)[of] - np.arange(len(data))  # bytes up to the word's end
    ids = [(_hashes(prefix, starts, starts + sizes) % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS]
    owner = [np.arange(len(words))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        ids.append((_hashes(prefix, at, at + n) % np.uint64(BUCKETS)).astype(np.int64))
        owner.append(of[at])
    ids, owner = np.concatenate(ids), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    return ids[order], np.bincount(owner, minlength=len(words))


def document_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature ids of a whole text and how often each occurs."""
    words = text.encode().split()
    if not words:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    count = Counter(words)
    if again := sum(map(bytes.__eq__, words[1:], words)):
        count[AGAIN] = again
    ids, n = word_features(list(count))
    total = np.bincount(ids, np.repeat(list(count.values()), n), 2 * BUCKETS)
    own = np.flatnonzero(total)
    return own, total[own].astype(np.int64)


@dataclass(frozen=True)
class Model:
    """The folded model: what each feature adds to the log-odds of label 1, before averaging; and the prior log-odds."""

    weights: np.ndarray
    prior: float

    def scores(self, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums / np.maximum(counts, 1) + self.prior, -40, 40)))


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Softmax over averaged vectors, one document a step, the rate falling linearly to zero."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (2 * BUCKETS, DIM)).astype(np.float32)
    out, bias = np.zeros((DIM, 2), np.float32), np.zeros(2, np.float32)
    steps, at = max(1, epochs * len(rows)), 0
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            ids, n, label = rows[k]
            share = (n / max(1, n.sum())).astype(np.float32)[:, None]
            hidden = (vectors[ids] * share).sum(0)
            logits = hidden @ out + bias
            grad = np.exp(logits - logits.max())
            grad /= grad.sum()
            grad[label] -= 1
            step = np.float32(rate * (1 - at / steps))
            back = out @ grad
            out -= step * np.outer(hidden, grad)
            bias -= step * grad
            vectors[ids] -= FASTER * step * back * share
            at += 1
    return Model((vectors @ (out[:, 1] - out[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS == 0


#: How ids (below 2 * BUCKETS) and counts go to the driver.
_SPARSE = ("<u2", "<u4")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [document_features(t or "") for t in b.column("text").to_pylist()]
        ids, n = (pa.array([x[k].astype(kind).tobytes() for x in found], pa.binary()) for k, kind in enumerate(_SPARSE))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("label"), ids, n], ["doc_id", "label", "ids", "n"])


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """The model of a bounded sample of the labelled documents that aren't held out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("long").alias("label"))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    chosen = own.join(ids, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = text.join(F.broadcast(chosen), "doc_id").mapInArrow(lean(_features), "doc_id long, label long, ids binary, n binary").toArrow()
    rows = rows.sort_by([("doc_id", "ascending")])
    got = [(np.frombuffer(i.as_buffer(), _SPARSE[0]), np.frombuffer(n.as_buffer(), _SPARSE[1]), label.as_py()) for i, n, label in zip(rows["ids"], rows["n"], rows["label"])]
    return train(got) if got else Model(np.zeros(2 * BUCKETS, np.float32), 0.0)


class WordSums:
    """Sum and number of the features' weights of each distinct word, cached up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.sums, self.counts = np.empty(0), np.empty(0, np.int64)

    def score(self, texts: list[str]) -> np.ndarray:
        split = [t.encode().split() for t in texts]
        if len(self.index) > _CACHE:
            self.clear()
        if new := list({w for s in (*split, [AGAIN]) for w in s if w not in self.index}):
            ids, n = word_features(new)
            sums = np.add.reduceat(self.model.weights[ids].astype(np.float64), np.cumsum(n) - n)
            self.index.update(zip(new, range(len(self.sums), len(self.sums) + len(new))))
            self.sums, self.counts = np.concatenate([self.sums, sums]), np.concatenate([self.counts, n])
        out = np.zeros((2, len(texts)))
        for k, s in enumerate(split):
            at = np.fromiter(map(self.index.__getitem__, s), np.int64, len(s))
            again, mark = int((at[1:] == at[:-1]).sum()), self.index[AGAIN]
            out[:, k] = self.sums[at].sum() + again * self.sums[mark], self.counts[at].sum() + again * self.counts[mark]
        return np.round(self.model.scores(*out), 9)


def _scored(model: Model, name: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordSums(model)
        for whole in batches:
            for lo in range(0, whole.num_rows, 250):
                b = whole.slice(lo, 250)
                yield b.append_column(name, pa.array(words.score([t or "" for t in b.column("text").to_pylist()])))

    return lean(run)


def scored(docs: DataFrame, model: Model, name: str = "_score") -> DataFrame:
    """docs with a column of a name that none has: the probability of label 1."""
    return docs.mapInArrow(_scored(model, name), T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def good_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs (all columns, whatever they are called) that score the threshold or more."""
    name = unused("_score", docs.columns)
    return scored(docs, model, name).where(F.col(name) >= threshold).select(*docs.columns)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    docs = documents(spark, sf_dir).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = fitted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"))
