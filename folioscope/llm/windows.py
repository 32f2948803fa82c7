"""Deals windows of words or bytes out to buckets in which repeats meet, without a row for each position.

Every window of W units (words or bytes) is filed under its minimiser: the smallest-hashed gram of k units inside it (the
leftmost of equals). Equal windows have equal minimisers, and neighbouring windows share theirs, so a document gives about
2 / (W - k + 2) rows a unit: runs of windows under one gram. A level then works on runs alone:

1. Runs are counted by gram. A gram that occurs once holds no repeated window; its runs leave (nearly all unique text).
2. Runs of the same content (class: gram and a 64-bit digest of the run) are carried by one representative, the one at the first place,
   with the number of its copies as its weight.
3. The windows of each gram are compared inside tasks, by the operator's own method (`Rule.repeats`), which decides on the words or
   bytes themselves; a window counts as often as its weight says. A class that is alone under its gram, with one place of it, has windows
   that equal no others (equal ones hold the gram at the same distance), which the method needn't tell apart. The text of the representatives is fetched for this from the
   documents. What the method finds in a representative holds for all copies of its class: without it, nothing is marked.
4. Grams with more than LIMIT units of representatives go on to the next level with longer grams, which splits them, after each class with
   copies was compared on its own; at the last level the gram is the window, and counts and minima decide. So a hot passage never
   meets in one task.

Two rules: `first_stays` marks all but the first place (smallest doc_id, then text hash, then start), else all places.
Rows that repeat doc_id and text are one place for `first_stays`, and copies of each other otherwise. Null texts are empty; texts
below the window length are kept whole; very long texts are read in overlapping pieces. Matches never cross documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import forget, identified, kept, sided

#: Units of representatives under one gram that one task compares, and units that it compares at a time.
LIMIT, AT_ONCE = 1 << 17, 1 << 20
SLAB = 1 << 17
RUN = 4096
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_IS_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])


@dataclass(frozen=True)
class Rule:
    width: int  # units of a window
    levels: tuple[int, ...]  # gram lengths; the last is the width
    repeats: Callable[[list[bytes], int, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]  # texts, width, weights, alone to row, offset, name of windows that occur twice
    words: bool
    first_stays: bool


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


_BASE = 0x9E3779B97F4A7C15
_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_powers: list[np.ndarray] = []


def _pows(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if not _powers or len(_powers[0]) < n:
        size, new = max(n, 2 * SLAB), []
        for b in (_BASE, pow(_BASE, -1, 2**64)):
            factors = np.full(size, b, np.uint64)
            factors[0] = 1
            new.append(np.cumprod(factors))
        _powers[:] = new
    return _powers[0], _powers[1]


def _prefix(units: np.ndarray) -> np.ndarray:
    out = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * _pows(len(units) + 1)[0][: len(units)], out=out[1:])
    return out


def _hashes(prefix: np.ndarray, at: np.ndarray | slice, to: np.ndarray | slice, n: int = 0) -> np.ndarray:
    """Hashes of the unit sequences that start and end at these offsets."""
    return _mix((prefix[to] - prefix[at]) * _pows(len(prefix))[1][: len(prefix)][at])


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in bytes."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_IS_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def units_of(data: bytes, words: bool) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    if not words:
        return _BYTE[raw]
    a, b = word_bounds(raw)
    return _hashes(_prefix(_BYTE[raw]), a, b) if len(a) else np.empty(0, np.uint64)


def _pieces(data: bytes, rule: Rule) -> Iterator[tuple[int, np.ndarray]]:
    """(offset, units) of overlapping pieces; every window of a text is in exactly one of them."""
    w = rule.width
    if not rule.words:
        for at in range(0, len(data) - w + 1, SLAB):
            yield at, _BYTE[np.frombuffer(data[at : at + SLAB + w - 1], np.uint8)]
        return
    at, base, held = 0, 0, np.empty(0, np.uint64)
    while at < len(data):
        end = len(data)
        if at + 8 * SLAB < end and (m := _SPACE.search(data, at + 8 * SLAB)):
            end = m.start()
        units = np.concatenate([held, units_of(data[at:end], True)])
        if len(units) >= w:
            yield base, units
            base, units = base + len(units) - w + 1, units[len(units) - w + 1 :]
        held, at = units, end


def _sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values (block-wise running minima from both sides)."""
    if w == 1:
        return v
    n = len(v) - w + 1
    rows = -(-len(v) // w)
    padded = np.full(rows * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(v)] = v
    blocks = padded.reshape(rows, w)
    ahead = np.minimum.accumulate(blocks, 1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


_RUNS = ["_id", "_th", "key", "ctx", "lo", "hi", "multi"]
RUNS = ", ".join(f"{c} long" for c in _RUNS)
_MASK = np.uint64((1 << 20) - 1)


def _slab_runs(slab: list[tuple[int, int, int, np.ndarray]], k: int, rule: Rule) -> pa.RecordBatch:
    units = np.concatenate([u for *_, u in slab])
    sizes = np.array([len(u) for *_, u in slab])
    starts = np.cumsum(sizes) - sizes
    prefix, w = _prefix(units), rule.width
    grams = _hashes(prefix, slice(0, len(units) - k + 1), slice(k, None))
    m = _sliding_min((grams & ~_MASK) | np.arange(len(grams), dtype=np.uint64), w - k + 1)
    anchor = (m & _MASK).astype(np.int64)
    n_win = sizes - w + 1
    piece = np.repeat(np.arange(len(slab)), n_win)
    at = np.arange(n_win.sum()) + np.repeat(starts - (np.cumsum(n_win) - n_win), n_win)
    anchor = anchor[at]
    key = grams[anchor]
    new = np.concatenate([[True], (key[1:] != key[:-1]) | (piece[1:] != piece[:-1])])
    first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
    begin = np.flatnonzero((np.arange(len(at)) - first) % RUN == 0)
    end = np.append(begin[1:], len(at)) - 1
    raw, digest = memoryview(units.view(np.uint8)), xxhash.xxh3_64_intdigest
    ctx = np.fromiter((digest(raw[a * 8 : b * 8]) for a, b in zip(at[begin].tolist(), (at[begin if k == w else end] + w).tolist())), np.uint64, len(begin))
    of = piece[begin]
    shift = np.array([b for _, _, b, _ in slab]) - starts
    cols = [np.array([x[0] for x in slab])[of], np.array([x[1] for x in slab])[of], key[begin].view(np.int64), ctx.view(np.int64), at[begin] + shift[of], at[end] + shift[of]]
    whole_run = np.diff(np.append(np.flatnonzero(new), len(at)))  # several anchors of one gram: windows of a run may be equal
    multi = (anchor[begin] != anchor[end]) | (np.repeat(whole_run, whole_run)[begin] > RUN)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*cols, multi.astype(np.int64))], _RUNS)


def _runs(level: int, rule: Rule) -> Callable:
    k = rule.levels[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab, size = [], 0
        for b in batches:
            text = b.column("text").cast(pa.large_binary())
            for i, d, base, t in zip(b.column("_id").to_pylist(), b.column("_th").to_pylist(), b.column("base").to_pylist(), text):
                for at, units in _pieces(t.as_buffer().to_pybytes() if t.is_valid else b"", rule):
                    slab.append((i, d, base + at, units))
                    size += len(units)
                    if size >= SLAB:
                        yield _slab_runs(slab, k, rule)
                        slab, size = [], 0
        if slab:
            yield _slab_runs(slab, k, rule)

    return run


_LISTS = ["key", "ctx", "n", "lo", "more", "kind"]


def _lists(wanted: DataFrame, own: Callable) -> DataFrame:
    """_LISTS of the representatives that `own` chooses: a list a column, of the narrowest type that holds it, as joins broadcast or shuffle them.

    more: hi - lo, below RUN. kind: 1 for multi, 2 for hot.
    """
    chosen = wanted.select("_id", "_th", F.filter("wanted", own).alias("all")).where(F.size("all") > 0)
    more = F.transform("all", lambda x: (x["hi"] - x["lo"]).cast("short"))
    kind = F.transform("all", lambda x: (x["multi"] + F.when(x["hot"], 2).otherwise(0)).cast("byte"))
    return chosen.select("_id", "_th", *(F.col(f"all.{c}").alias(c) for c in _LISTS[:4]), more.alias("more"), kind.alias("kind"))


def _slices(rule: Rule) -> Callable:
    """The texts of representatives: rows of documents with _LISTS. by: what they are compared by, the gram, or the class alone under hot grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            size = 0
            for i, d, t, *lists in zip(*(b.column(c).to_pylist() for c in ("_id", "_th", "text", *_LISTS))):
                data = t.encode()
                if rule.words:
                    a, z = word_bounds(np.frombuffer(data, np.uint8))
                for key, ctx, n, lo, more, kind in zip(*lists):
                    end = lo + more + rule.width
                    if rule.words:
                        part = b" ".join(data[p:q] for p, q in zip(a[lo:end].tolist(), z[lo:end].tolist()))
                    else:
                        part = data[lo:end]
                    by = (key * 31 + ctx) % 2**63 if kind & 2 else key
                    out.append((i, d, key, ctx, n, lo, by, kind & 1, part))
                    size += len(part)
                    if size > 8 << 20:
                        yield _rows(out)
                        out, size = [], 0
            yield _rows(out)

    def _rows(out: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*out)) or [()] * 9
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:8]] + [pa.array(cols[8], pa.binary())], ["_id", "_th", "key", "ctx", "n", "base", "by", "multi", "text"])

    return run


def _in_order(row: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((off, row))
    return row[order], off[order]


def marked_windows(texts: list[bytes], ids: np.ndarray, weights: np.ndarray, alone: np.ndarray, rule: Rule) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(row, offset) of the windows to mark among texts of runs, and of those that repeat, first places too; ids: doc_id, text hash and offset of each."""
    row, off, name = rule.repeats(texts, rule.width, weights, alone)
    every = _in_order(row, off)
    if rule.first_stays and len(row):
        place = np.stack([ids[row, 2] + off, ids[row, 1], ids[row, 0]])
        order = np.lexsort((*place, name))
        new = np.concatenate([[True], name[order][1:] != name[order][:-1]])
        first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
        order = order[(place[:, order] != place[:, first]).any(0)]  # repeated rows are at the first place too
        row, off = row[order], off[order]
    return _in_order(row, off), every


_FOUND = "_id long, _th long, start long, end long, key long, ctx long, base long"


def _compared(rule: Rule) -> Callable:
    """Streams representatives sorted by what they are compared `by`; gives the spans of the windows to mark, and (with key, ctx, base) the spans of repeated windows in classes with copies."""

    def flush(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.array([(r[0], r[1], r[5], r[2], r[3], r[4]) for r in rows], np.int64)
        by = np.array([r[7] for r in rows])
        _, of, count = np.unique(by, return_inverse=True, return_counts=True)
        alone = (count[of] == 1) & (np.array([r[8] for r in rows]) == 0)
        both = marked_windows([r[6] for r in rows], ids[:, :3], ids[:, 5], alone, rule)
        for (row, off), of_class in zip(both, (False, True)):
            if of_class:
                row, off = row[ids[row, 5] > 1], off[ids[row, 5] > 1]
            new = np.concatenate([[True], (row[1:] != row[:-1]) | (off[1:] != off[:-1] + 1)]) if len(row) else np.empty(0, bool)
            a = np.flatnonzero(new)
            z = np.append(a[1:], len(row)) - 1 if len(a) else a
            r = row[a]
            cols = [pa.array(c, pa.int64()) for c in (ids[r, 0], ids[r, 1], ids[r, 2] + off[a], ids[r, 2] + off[z] + rule.width)]
            cols += [pa.array(ids[r, c], pa.int64()) if of_class else pa.nulls(len(r), pa.int64()) for c in (3, 4, 2)]
            yield pa.RecordBatch.from_arrays(cols, ["_id", "_th", "start", "end", "key", "ctx", "base"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for b in batches:
            for r in zip(*(b.column(c).to_pylist() for c in ("_id", "_th", "key", "ctx", "n", "base", "text", "by", "multi"))):
                if size > AT_ONCE and r[7] != held[-1][7]:
                    yield from flush(held)
                    held, size = [], 0
                held.append(r)
                size += len(r[6])
        if held:
            yield from flush(held)

    return run


def repeated_spans(docs: DataFrame, rule: Rule) -> DataFrame:
    """_id, _th, start, end (units): the marked windows of `identified` documents, joined where they touch within a run."""
    source = docs.select("_id", "_th", F.lit(0).cast("long").alias("base"), "text")
    found: list[DataFrame] = []
    for level, k in enumerate(rule.levels):
        runs = kept(source.mapInArrow(_runs(level, rule), RUNS), f"runs-{k}")
        often = kept(runs.groupBy("key").agg(F.sum(F.col("multi") + 1).alias("n")).where("n > 1").select("key"), f"repeated-{k}")
        alive = kept(runs.join(sided(often), "key", "left_semi"), f"alive-{k}")
        forget(runs)
        if k == rule.width:  # the gram is the window, and so is what the digest is of
            same = alive.groupBy("key", "ctx").agg(F.sum(F.col("multi") + 1).alias("n"), F.min(F.struct("_id", "_th", "lo")).alias("first")).where("n > 1")
            start = F.col("lo") + (F.struct("_id", "_th", "lo") == F.col("first")).cast("long") if rule.first_stays else F.col("lo")
            ends = alive.join(same, ["key", "ctx"]).select("_id", "_th", start.alias("start"), "hi").where("start <= hi")
            found.append(ends.select("_id", "_th", "start", (F.col("hi") + k).alias("end")))
            break
        place = F.struct("_id", "_th", "lo", "hi")
        classes = alive.groupBy("key", "ctx").agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("multi"), F.min(place).alias("first"))
        classes = kept(classes, f"classes-{k}")
        weight = F.sum(F.col("first.hi") - F.col("first.lo") + rule.width)
        grams = kept(classes.groupBy("key").agg((weight > LIMIT).alias("hot")), f"grams-{k}")
        one = F.struct("key", "ctx", "n", "multi", "first.lo", "first.hi", "hot")
        wanted = classes.join(sided(grams), "key").groupBy("first._id", "first._th").agg(F.collect_list(one).alias("wanted"))
        wanted = kept(wanted, f"wanted-{k}")
        forget(classes)
        hot = not grams.where("hot").isEmpty()
        for is_hot in (False, True)[: 1 + hot]:
            # What is compared: classes of grams that aren't hot, and classes with copies of the others. The others' classes go on, too.
            part = _lists(wanted, (lambda x: x["hot"]) if is_hot else (lambda x: ~x["hot"] | (x["n"] > 1)))
            rows = docs.join(sided(part, of=wanted), ["_id", "_th"]).select("_id", "_th", "text", *_LISTS)
            rows = rows.mapInArrow(_slices(rule), "_id long, _th long, key long, ctx long, n long, base long, by long, multi long, text binary")
            if is_hot:
                source = rows
                continue
            spans = rows.repartition("by").sortWithinPartitions("by").mapInArrow(_compared(rule), _FOUND)
            spans = kept(spans, f"spans-{k}")
            found.append(spans.where("key IS NULL").select("_id", "_th", "start", "end"))
            of_class = spans.where("key IS NOT NULL").select("key", "ctx", F.col("_id").alias("of"), F.col("_th").alias("of_th"), "base", "start", "end")
            of_class = kept(of_class, f"copies-{k}")
            if of_class.isEmpty():
                continue
            copies = alive.join(sided(of_class), ["key", "ctx"]).where("NOT (_id = of AND _th = of_th AND lo = base)")
            found.append(copies.select("_id", "_th", (F.col("lo") + F.col("start") - F.col("base")).alias("start"), (F.col("lo") + F.col("end") - F.col("base")).alias("end")))
        if not hot:
            break
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def span_lists(docs: DataFrame, rule: Rule) -> DataFrame:
    """_id, _th, spans: for each document with marked windows."""
    spans = repeated_spans(docs, rule)
    return kept(spans.groupBy("_id", "_th").agg(F.collect_list(F.struct("start", "end")).alias("spans")), "span-lists")


def covered(spans: list[dict], n: int) -> np.ndarray:
    """Which of n units the spans cover."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, [s["start"] for s in spans], 1)
    np.add.at(edge, [s["end"] for s in spans], -1)
    return np.cumsum(edge[:n]) > 0


def _cut(rule: Rule) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc_id, text, spans in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "spans"))):
                data = text.encode()
                n_spans = n_removed = 0
                if rule.words:
                    words = data.split()
                    n = len(words)
                    if spans:
                        gone = covered(spans, n)
                        words = [w for w, g in zip(words, gone.tolist()) if not g]
                    out = b" ".join(words)
                else:
                    n, out = len(data), data
                    if spans:
                        gone = covered(spans, n)
                        out = np.frombuffer(data, np.uint8)[~gone].tobytes()
                if spans:
                    n_removed = int(gone.sum())
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                rows.append((doc_id, n, n_removed, n_spans, out))
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[:4]] + [pa.array(cols[4], pa.binary())], ["doc_id", "n_units", "n_removed", "n_spans", "kept"])

    return run


def without_repeats(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_units, n_removed, n_spans, kept (binary: the remaining words joined by a space, or the remaining bytes)."""
    docs = identified(docs)
    lists = span_lists(docs, rule)
    both = docs.join(sided(lists), ["_id", "_th"], "left").select("doc_id", "text", "spans")
    return both.mapInArrow(_cut(rule), "doc_id long, n_units long, n_removed long, n_spans long, kept binary")


def digested(kept_rows: DataFrame) -> DataFrame:
    """The rows of `without_repeats` with the SHA-256 of what is kept in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sha = [hashlib.sha256(x).hexdigest() for x in b.column("kept").to_pylist()]
            yield b.drop_columns(["kept"]).append_column("kept_sha256", pa.array(sha, pa.string()))

    return kept_rows.mapInArrow(run, "doc_id long, n_units long, n_removed long, n_spans long, kept_sha256 string")
