"""Token-id output: flat unsigned integer files with 64-bit document offsets, and their memory-mapped reader.

Documents are range-partitioned and sorted by doc_id; each partition streams its ids into one `.bin` file (little-endian,
16 bits where the vocabulary fits, else 32) and writes an `.idx` file beside it: the doc_ids, then the offsets of the
documents in ids, both 64-bit, n and n + 1 of them. Files get their names when complete, under a name of their own for
each attempt, so that repeated or lost tasks leave no half file among those in the manifest. The manifest has one row a file; prefix
sums over its rows give each partition's base. `read_ids` maps the files and never reads more than one document's ids at once.

Encoding is the tokenizers library's (`LibraryEncoder`).

Null and empty texts have the end id alone. Null doc_ids come first. Repeated rows are written each. Very long texts are encoded whole. An
empty table gives no file and no row.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import NULL_ID, documents, identified, kept, new_path, text_batches

VOCABULARY, END = "byte_bpe_50k.json", 2
CACHE = 800_000


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def vocabulary_size(path: str) -> int:
    return tokenizer(path).get_vocab_size()


def byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in a byte-level vocabulary: itself, or the next free one from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    out, free = {b: chr(b) for b in plain}, 256
    for b in range(256):
        if b not in out:
            out[b], free = chr(free), free + 1
    return out


class Pieces(dict):
    """ids of pre-tokenised pieces by the tokenizers library's model, as little-endian bytes."""

    def __init__(self, model, dtype: str) -> None:
        super().__init__()
        self.model, self.code, self.letters = model, "H" if dtype == "<u2" else "I", byte_letters()

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        out = self[piece] = struct.pack(f"<{len(ids)}{self.code}", *ids)
        return out


# What \\p{L}, \\p{N} and \\s are below U+0100, where Python's own pattern engine can do the byte-level pattern's work.
_L, _N, _S = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be", "\t-\r \u0085\u00a0"
LATIN = re.compile(f" ?[{_L}]+|'(?:[stmd]|re|ve|ll)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


def latin(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


class LibraryEncoder:
    """Lists of texts to ids (bytes of an integer type) with the tokenizers library.

    Texts below U+0100 without special tokens are cut by the byte-level pattern here, and each distinct piece is encoded once
    by the library's model (the cache is emptied when full); other texts are encoded whole by the library.
    """

    def __init__(self, path: str, dtype: str) -> None:
        self.tokenizer, self.dtype = tokenizer(path), dtype
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces = Pieces(self.tokenizer.model, dtype)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > CACHE:
            self.pieces.clear()
        ids, cut = self.pieces.__getitem__, LATIN.findall
        own = [latin(x) and not any(s in x for s in self.special) for x in texts]
        rest = iter(self.tokenizer.encode_batch_fast([x for x, p in zip(texts, own) if not p], add_special_tokens=False))
        return [b"".join(map(ids, cut(x))) if p else np.array(next(rest).ids, self.dtype).tobytes() for x, p in zip(texts, own)]


@lru_cache(maxsize=2)
def library_encoder(path: str, dtype: str) -> LibraryEncoder:
    return LibraryEncoder(path, dtype)


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)


_MANIFEST = "partition long, file string, n_docs long, n_tokens long"


def _write(folder: str, vocabulary: str, end: int, dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = _at(folder)
        encode = library_encoder(vocabulary, dtype)
        number = TaskContext.get().partitionId()
        name = f"{number:06d}-{uuid.uuid4().hex[:8]}"
        ids, sizes, last = [], [], np.array([end], dtype).tobytes()
        with store.open_output_stream(f"{at}/{name}.bin.part") as out:
            for whole in batches:
                for lo in range(0, whole.num_rows, 250):
                    b = whole.slice(lo, 250)
                    for i, x in zip(b.column("_id").to_pylist(), encode(b.column("text").to_pylist())):
                        out.write(x)
                        out.write(last)
                        ids.append(i)
                        sizes.append(len(x) // len(last) + 1)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype("<u8")
        with store.open_output_stream(f"{at}/{name}.idx") as out:
            out.write(np.array(ids, "<i8").tobytes())
            out.write(offsets.tobytes())
        store.move(f"{at}/{name}.bin.part", f"{at}/{name}.bin")
        cols = [[number], [name], [len(ids)], [int(offsets[-1])]]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string() if k == 1 else pa.int64()) for k, c in enumerate(cols)], ["partition", "file", "n_docs", "n_tokens"])

    return run


def write_ids(docs: DataFrame, folder: str, vocabulary: str, end: int = END) -> DataFrame:
    """Writes the ids of all documents in ascending doc_id order; returns the manifest: file, n_docs, n_tokens, base."""
    dtype = "<u2" if vocabulary_size(vocabulary) <= 1 << 16 else "<u4"
    store, at = _at(folder)
    store.create_dir(at, recursive=True)
    rows = identified(docs).select("_id", "text", "_th").repartitionByRange("_id", "_th").sortWithinPartitions("_id", "_th").select("_id", "text")
    files = kept(rows.mapInArrow(_write(folder, vocabulary, end, dtype), _MANIFEST), "manifest")
    before = Window.orderBy("partition").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.where("n_docs > 0").withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    files = kept(files, "manifest")
    with store.open_output_stream(f"{at}/format.json") as out:
        out.write(json.dumps({"dtype": dtype, "index": "<i8 doc_ids, <u8 offsets", "end": end}).encode())
    return files


def mapped(folder: str, name: str, dtype: str, n_docs: int) -> tuple[Callable[[int, int], np.ndarray], np.ndarray, np.ndarray]:
    """Ids from one place to another (a function), doc_ids, offsets of one file: memory-mapped where the store is a file system of this machine, else read by range."""
    store, at = _at(folder)
    if isinstance(store, fs.LocalFileSystem):
        ids, index = np.memmap(f"{at}/{name}.bin", dtype, "r"), np.memmap(f"{at}/{name}.idx", "<i8", "r")
        return lambda a, z: ids[a:z], index[:n_docs], index[n_docs:]
    with store.open_input_file(f"{at}/{name}.idx") as f:
        index = np.frombuffer(f.readall(), "<i8")
    file, size = store.open_input_file(f"{at}/{name}.bin"), np.dtype(dtype).itemsize
    return lambda a, z: np.frombuffer(file.read_at((z - a) * size, a * size), dtype), index[:n_docs], index[n_docs:]


def _read(folder: str, dtype: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, n, base in zip(*(b.column(c).to_pylist() for c in ("file", "n_docs", "base"))):
                ids, docs, offsets = mapped(folder, name, dtype, n)
                for lo in range(0, n, 10_000):
                    hi = min(lo + 10_000, n)
                    ends = offsets[lo : hi + 1].tolist()
                    crc = [zlib.crc32(ids(a, z).astype("<u4").tobytes()) for a, z in zip(ends, ends[1:])]
                    cols = [docs[lo:hi], offsets[lo:hi] + base, np.diff(offsets[lo : hi + 1]), np.array(crc, np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c), pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files of a manifest, which are dealt out by a hash of their names to as many partitions as there are files (some get two, some none)."""
    store, at = _at(folder)
    with store.open_input_stream(f"{at}/format.json") as f:
        dtype = json.loads(f.read())["dtype"]
    dealt = files.repartition(max(1, files.count()), "file")
    out = dealt.mapInArrow(_read(folder, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(NULL_ID)))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    folder = new_path(spark, "token-ids")
    return read_ids(write_ids(documents(spark, sf_dir), folder, public_tokenizers.path(VOCABULARY)), folder)
