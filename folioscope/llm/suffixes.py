"""Suffix-array dedup over bytes by a depth-limited radix sort, most significant digit first.

Suffixes are ordered only as deep as the threshold of 400 bytes. The first pass deals them out by their anchor, the smallest-hashed
gram of 100 bytes in the first 400 (windows.py): suffixes that are equal to that depth have equal anchors, and an anchor that
occurs once leaves with all its suffixes. Inside a bucket `radix_sorted` orders suffixes by digits of 8 bytes from the front: each pass
splits the groups of equal suffixes by the values of the next digit, what is alone leaves, and groups that the digit doesn't split
aren't sorted again. The groups left at depth 400 are exactly the repeated windows, byte for byte. All their places are removed. Runs of
suffixes that are equal as a whole (by a 64-bit digest) are ordered once, with the number of their copies: such a suffix is a group even
if it is alone, and its group holds for each copy.

Null, empty and short texts (below 400 bytes) have no such suffix and stay whole; very long texts are read in overlapping pieces. Repeated
rows are copies of each other. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import documents, text_batches
from folioscope.llm.windows import Rule, digested, without_repeats

DIGIT = 8


def digits_of(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from every place on, as a big-endian number; beyond the end there are zeros."""
    padded = np.concatenate([data, np.zeros(DIGIT, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(DIGIT):
        out = out << np.uint64(8) | padded[k : k + len(data)]
    return out


def _edges(group: np.ndarray, digit: np.ndarray) -> np.ndarray:
    """Where a group or a digit differs from the one before; true at the start."""
    return np.concatenate([[True], (group[1:] != group[:-1]) | (digit[1:] != digit[:-1])]) if len(group) else np.empty(0, bool)


def radix_sorted(data: np.ndarray, starts: np.ndarray, depth: int, copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes that equal another one for `depth` bytes, in order, and the number of each one's group. All starts have so many bytes.

    copies: how often each suffix is there (by place in data). One that is alone in its group but has copies is a group of its own,
    ordered against all others, and needs no more digits; these come last.
    """
    digits, order, group = digits_of(data), starts, np.zeros(len(starts), np.int64)
    single = [np.empty(0, np.int64)]
    for at in range(0, depth, DIGIT):
        digit = digits[order + at]
        if depth - at < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - depth + at))
        inside = group[1:] == group[:-1]
        split = np.unique(group[1:][inside & (digit[1:] != digit[:-1])])  # groups in which the digit has several values
        if len(split):
            own = np.flatnonzero(np.isin(group, split))
            by = own[np.lexsort((digit[own], group[own]))]
            order, digit = order.copy(), digit.copy()
            order[own], digit[own] = order[by], digit[by]
        new = _edges(group, digit)
        alone = new & np.append(new[1:], True)
        if copies is not None:
            single.append(order[alone][copies[order[alone]] > 1])
        group = np.cumsum(new)[~alone]
        order = order[~alone]
        if not len(order):
            break
    own = np.concatenate(single)
    return np.concatenate([order, own]), np.concatenate([group, np.arange(len(own)) + (group[-1] + 1 if len(group) else 0)])


def ordered(texts: list[bytes], width: int, weights: np.ndarray | None = None, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and name of every window of bytes that occurs twice or more in texts, of which each counts as often as its weight.

    alone: texts of which every suffix differs from all others by its anchor already, the first digit. They need no pass: each is a
    group, if it has copies.
    """
    if alone is not None and alone.any():
        own, rest = np.flatnonzero(alone & (weights > 1)), np.flatnonzero(~alone)
        n = np.array([len(texts[r]) - width + 1 for r in own.tolist()], np.int64)
        row, at, group = ordered([texts[r] for r in rest.tolist()], width, weights[rest]) if len(rest) else (own[:0],) * 3
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.concatenate([rest[row], np.repeat(own, n)]), np.concatenate([at, off]), np.concatenate([group, np.arange(n.sum()) + group.max(initial=-1) + 1])
    sizes = np.array([len(t) for t in texts])
    first, n = np.cumsum(sizes) - sizes, sizes - width + 1
    starts = np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)
    order, group = radix_sorted(np.frombuffer(b"".join(texts), np.uint8), starts, width, None if weights is None else np.repeat(weights, sizes))
    row = np.searchsorted(first, order, "right") - 1
    return row, order - first[row], group


BYTES = Rule(400, (100, 250, 325, 363, 382, 391, 396, 398, 399, 400), ordered, words=False, first_stays=False)


def op6_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    out = digested(without_repeats(documents(spark, sf_dir), BYTES))
    return out.select("doc_id", out.n_units.alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")
