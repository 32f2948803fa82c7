"""BPE encoding and decoding in numpy: batched merge rounds over many words at once.

The symbols of all distinct words of a batch lie in one flat array. A round looks up the rank of every pair of neighbours by
binary search over the sorted pair keys, takes each word's lowest rank, and merges every place of that pair (from the left,
where places overlap); words without a known pair leave. Texts are cut at special tokens and by the byte-level pattern
as the tokenizers library does; equal pieces are merged once per task (a cache of bounded size). Decoding gathers the bytes
of ids.

Null and empty texts have no ids and decode to the empty text. Equal texts give equal rows; repeated rows are kept. Very long texts are encoded
whole. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import documents, lean, text_batches
from folioscope.llm.tokens import CACHE, LATIN, VOCABULARY, byte_letters, latin

NONE = np.iinfo(np.int64).max


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            held = json.load(f)
        model, letters = held["model"], byte_letters()
        vocab = model["vocab"]
        byte_of = {c: b for b, c in letters.items()}
        self.special = {t["content"]: t["id"] for t in held["added_tokens"]}
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        new = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks, self.new = key[order], order.astype(np.int64), new
        raw: dict[int, bytes] = {i: bytes(byte_of[c] for c in t) if all(c in byte_of for c in t) else t.encode() for t, i in vocab.items()}
        raw |= {i: t.encode() for t, i in self.special.items()}
        table = [raw.get(i, b"") for i in range(max(raw) + 1)]
        self.lengths = np.array([len(t) for t in table], np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(table), np.uint8)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.special_ids = {t: np.array([i], "<u4").tobytes() for t, i in self.special.items()}
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, bytes] = dict(self.special_ids)

    def ranked(self, symbols: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Rank of each symbol with its right neighbour in the same word, or NONE."""
        out = np.full(len(symbols), NONE)
        if len(symbols) > 1:
            key = symbols[:-1] << 32 | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            good = (self.keys[at] == key) & (word[1:] == word[:-1])
            out[:-1][good] = self.ranks[at[good]]
        return out

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """ids of each word."""
        sizes = np.array([len(w) for w in words], np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), sizes)
        done_word, done_symbol = [], []
        while len(symbols):
            rank = self.ranked(symbols, word)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            low = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(word))))
            over = low == NONE
            done_word.append(word[over])
            done_symbol.append(symbols[over])
            symbols, word, rank, low = (x[~over] for x in (symbols, word, rank, low))
            hit = rank == low
            run = hit.copy()  # of overlapping places (equal symbols in a row) every other one, from the left
            if len(hit) and (hit[1:] & hit[:-1]).any():
                at = np.arange(len(hit))
                since = at - np.maximum.accumulate(np.where(~hit, at, -1))
                run = hit & (since % 2 == 1)
            symbols[run] = self.new[rank[run]]
            gone = np.zeros(len(symbols), bool)
            gone[1:] = run[:-1]
            symbols, word = symbols[~gone], word[~gone]
        if not done_word:
            return [np.empty(0, np.int64) for _ in words]
        word, symbols = np.concatenate(done_word), np.concatenate(done_symbol)
        order = np.argsort(word, kind="stable")
        return np.split(symbols[order], np.cumsum(np.bincount(word, minlength=len(words)))[:-1])

    def pieces(self, text: str) -> list[str]:
        """The special tokens and pre-tokenised pieces of a text. Below U+0100 Python's own pattern engine does the cutting."""
        if self.cut and any(s in text for s in self.special):
            return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.pieces(part))]
        return (LATIN if latin(text) else self.pattern).findall(text)

    def encode(self, texts: list[str]) -> list[bytes]:
        """ids of each text as bytes of 32-bit integers. Pieces not met before are merged together; the cache is emptied when full."""
        if len(self.known) > CACHE:
            self.forget()
        known = self.known
        cut = [self.pieces(t) for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(known))
        known.update(zip(new, (x.astype("<u4").tobytes() for x in self.merge([w.encode() for w in new]))))
        return [b"".join(map(known.__getitem__, p)) for p in cut]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text of ids as UTF-8; invalid sequences become the replacement character."""
        n, at = self.lengths[ids], self.offsets[ids]
        to = np.cumsum(n)
        if not len(to):
            return b""
        flat = self.bytes[np.arange(to[-1]) + np.repeat(at - (to - n), n)].tobytes()
        return flat.decode("utf-8", "replace").encode()


@lru_cache(maxsize=2)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def _coded(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 250):
                b = whole.slice(lo, 250)
                ids = own.encode(b.column("text").to_pylist())
                text = [own.decode(np.frombuffer(x, "<u4").astype(np.int64)) for x in ids]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(text, pa.binary())], ["doc_id", "ids", "decoded"])

    return lean(run, lambda: bpe(path).forget())


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (binary, little-endian unsigned 32-bit), decoded (binary, UTF-8) of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_coded(path), "doc_id long, ids binary, decoded binary")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, text = b.column("ids").to_pylist(), b.column("decoded").to_pylist()
        n = pa.array([len(x) // 4 for x in ids], pa.int64())
        sha = [pa.array([hashlib.sha256(x).hexdigest() for x in c]) for c in (ids, text)]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, *sha], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    out = encoded(documents(spark, sf_dir), public_tokenizers.path(VOCABULARY))
    return out.mapInArrow(_digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _round_trips(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 250):
                b = whole.slice(lo, 250)
                texts = b.column("text").to_pylist()
                ids = own.encode(texts)
                good = [own.decode(np.frombuffer(x, "<u4").astype(np.int64)) == t.encode() for x, t in zip(ids, texts)]
                flat = [np.frombuffer(x, "<u4").astype(np.int32) for x in ids]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in flat])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), lists, pa.array(np.diff(offsets).astype(np.int64)), pa.array(good)], ["doc_id", "ids", "n_tokens", "round_trip"])

    return lean(run, lambda: bpe(path).forget())


def round_trips(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_tokens, round_trip (whether the ids decode to the text) of each whole text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_round_trips(path), "doc_id long, ids array<int>, n_tokens long, round_trip boolean")
