"""Ranked lexical search of all documents for a stated set of items, by dense blocked matrix products.

Terms are runs of ASCII letters and digits and of any character beyond ASCII, of the whole text; A-Z alone are lower-cased.
First each document is stored as its length and the counts of those of its terms that any item holds; N, L and the document
frequencies follow from the stored rows. Then documents are taken in tiles and items in tiles: of a tile of items only its own terms
are columns (a compact vocabulary). A tile of impacts (documents x terms) times a tile of weights (terms x items) is one BLAS
product in doubles. An impact is below 10^6, so vocabulary tiles end before the sum of an item's weights times 10^6 would reach
2^53: each product is an exact integer, and products of several vocabulary tiles are added as 64-bit integers.

Of each tile the documents with an item's k-th highest score or more are candidates, ties included, and are cut to k by score and
doc_id together with those so far; so a task gives at most k rows an item. These meet in two rounds of ranks, the first by salted item.

Items are searched in blocks of BLOCK_BYTES of text, each with one pass over the stored counts of its own; a block's vocabulary is what
a task holds, beside one tile.

Given results: null and empty texts have no term and are never ranked; an item without a known term gives no row; only scores above 0
are ranked; equal scores go by doc_id, null ids first. Repeated rows of documents are documents of their own; rows of items that
repeat item_id and text are one item, and rows that repeat item_id alone are items each ranked from 1. An empty table gives no row.
Very long texts are counted whole. Other columns, whatever they are called, aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import NULL_ID, documents, kept, text_batches

#: ASCII bytes that aren't letters or digits become spaces, A-Z become a-z, all others stay.
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
BLOCK_BYTES = 32 << 20
#: Items and documents of a tile; entries of an impact tile at most.
ITEMS, DOCUMENTS, ENTRIES = 128, 512, 1 << 21
IMPACT = 1_000_000
EXACT = 2**53
SALTS = 32


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


@dataclass
class Tile:
    """Items first to last of a block; `columns` gives vocabulary ids, `parts` slices of them with their weights (terms x items)."""

    first: int
    last: int
    columns: np.ndarray
    parts: list[tuple[slice, np.ndarray]]


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def tiles(items: list[Counter], weights: np.ndarray) -> list[Tile]:
    """items: counts of vocabulary ids. Vocabulary tiles end where an item's sum of weights could make a product inexact."""
    out = []
    for first in range(0, len(items), ITEMS):
        own = items[first : first + ITEMS]
        columns = np.array(sorted(set().union(*own)), np.int64)
        place = {int(c): k for k, c in enumerate(columns)}
        matrix = np.zeros((len(columns), len(own)), np.int64)
        for k, item in enumerate(own):
            for term, times in item.items():
                matrix[place[term], k] = times * int(weights[term])
        parts, start, sums = [], 0, np.zeros(len(own), np.int64)
        for row in range(len(columns)):
            if (sums + matrix[row]).max() * IMPACT >= EXACT or (row - start + 1) * DOCUMENTS > ENTRIES:
                parts.append((slice(start, row), matrix[start:row].astype(np.float64)))
                start, sums = row, np.zeros(len(own), np.int64)
            sums = sums + matrix[row]
        if start < len(columns):
            parts.append((slice(start, len(columns)), matrix[start:].astype(np.float64)))
        out.append(Tile(first, first + len(own), columns, [p for p in parts if len(p[1])]))
    return out


def _counted(vocabulary: dict[bytes, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = vocabulary.get
        for b in batches:
            n, sizes, ids, counts = [], [0], [], []
            for text in b.column("text"):
                words = terms(text.as_py())
                found = Counter(map(get, words))
                found.pop(None, None)
                n.append(len(words))
                ids.extend(found.keys())
                counts.extend(found.values())
                sizes.append(len(ids))
            ends = pa.array(sizes, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (ids, counts)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "ids", "counts"])

    return run


def counted(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (all terms), ids and counts of the vocabulary's terms, for each document."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_counted(vocabulary), "doc_id long, n long, ids array<int>, counts array<int>")


def best(item: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each item: by score, then by doc_id."""
    order = np.lexsort((doc, -score, item))
    of = item[order]
    starts = np.flatnonzero(np.append(True, of[1:] != of[:-1])) if len(of) else np.empty(0, np.int64)
    rank = np.arange(len(of)) - np.repeat(starts, np.diff(np.append(starts, len(of))))
    return order[rank < k]


def scores(tile: Tile, rows: np.ndarray, ids: np.ndarray, impacts: np.ndarray, n_docs: int, place: np.ndarray) -> np.ndarray:
    """Exact scores (documents x items). rows, ids, impacts: the document, vocabulary id and impact of each posting; place: scratch, -1 everywhere."""
    out = np.zeros((n_docs, tile.last - tile.first), np.int64)
    place[tile.columns] = np.arange(len(tile.columns))
    at = place[ids]
    place[tile.columns] = -1
    for part, weights in tile.parts:
        own = (at >= part.start) & (at < part.stop)
        dense = np.zeros((n_docs, part.stop - part.start))
        dense[rows[own], at[own] - part.start] = impacts[own]
        out += (dense @ weights).astype(np.int64)
    return out


def _searched(all_tiles: list[Tile], item_ids: list[int | None], n_terms: int, n: int, total: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(n_terms, -1, np.int64)
        top = [np.empty(0, np.int64) for _ in range(3)]  # item, doc_id, score
        floor = np.ones(len(item_ids), np.int64)  # scores below an item's are out
        for whole in batches:
            for at in range(0, whole.num_rows, DOCUMENTS):
                b = whole.slice(at, DOCUMENTS)
                docs = b.column("doc_id").fill_null(NULL_ID).to_numpy()
                lists, tf = b.column("ids"), b.column("counts").flatten().to_numpy().astype(np.int64)
                rows = np.repeat(np.arange(len(docs)), lists.value_lengths().to_numpy())
                length = b.column("n").to_numpy()
                if length.size and 75 * int(length.max()) * n >= 2**63:
                    length = length.astype(object)
                m = (25 + 75 * length * n // total).astype(np.int64)
                impacts = 1_000_000_000 * tf // (1000 * tf + 8 * m[rows])
                found = [top]
                for tile in all_tiles:
                    s = scores(tile, rows, lists.flatten().to_numpy(), impacts, len(docs), place)
                    least = floor[tile.first : tile.last]
                    if len(docs) > k:
                        least = np.maximum(least, np.partition(s, len(docs) - k, axis=0)[len(docs) - k])
                    doc, item = np.nonzero(s >= least)
                    found.append([item + tile.first, docs[doc], s[doc, item]])
                top = [np.concatenate(x) for x in zip(*found)]
                keep = best(*top, k)
                top = [x[keep] for x in top]
                full = np.bincount(top[0], minlength=len(floor)) == k
                lowest = np.full(len(floor), np.iinfo(np.int64).max)
                np.minimum.at(lowest, top[0], top[2])
                floor[full] = lowest[full]
        item, doc, score = top
        yield pa.RecordBatch.from_arrays(
            [pa.array(item), pa.array([item_ids[i] for i in item.tolist()], pa.int64()), pa.array(doc, mask=doc == NULL_ID), pa.array(score)], ["item", "item_id", "doc_id", "score"]
        )

    return run


def _ranked(rows: DataFrame, k: int, *by: str) -> DataFrame:
    order = Window.partitionBy("item", *by).orderBy(F.desc("score"), F.col("doc_id").asc_nulls_first())
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id, score: the k highest-scoring documents of each item."""
    spark = docs.sparkSession
    text_batches(spark)
    items = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n_blocks = -(-size // BLOCK_BYTES)
    found = None
    for block in range(n_blocks):
        own = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)) == block).collect()  # about BLOCK_BYTES
        held = [Counter(terms(r["text"])) for r in own]
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*held)))}
        stored = kept(counted(docs, vocabulary), "term-counts")
        n, total = stored.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not n or not vocabulary:
            continue
        df = np.zeros(len(vocabulary), np.int64)
        for r in stored.select(F.explode("ids").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
            df[r["t"]] = r["count"]
        weights = np.array([weight(n, int(x)) for x in df])
        cut = tiles([Counter({vocabulary[t]: c for t, c in h.items()}) for h in held], weights)
        rows = stored.mapInArrow(_searched(cut, [r["item_id"] for r in own], len(vocabulary), n, total, k), "item long, item_id long, doc_id long, score long")
        rows = _ranked(rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))), k, "salt").drop("rank", "salt")
        rows = _ranked(rows, k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        found = rows if found is None else found.union(rows)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if found is None else found


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
