"""Substring dedup over words by level-wise doubling.

Windows of 20 words, by levels: words repeated alone are extended to two words, then to 4, 5, 10 and 20: only what is repeated at one
length goes on to the next, until no candidate survives. A window's name at a length is the pair of the names of its two halves at
the length before, so names are exact. The first place of a window stays. Windows meet in buckets by their smallest gram of 5
words; hot grams are split by grams of 10 and 20 words (windows.py). Runs of windows that are equal as a whole are levelled once, with the
number of their copies as a weight, and what is found in them holds for each copy.

Null, empty and short texts (below 20 words) have no window and stay whole; very long texts are read in overlapping pieces. Rows that
repeat doc_id and text are one place, and each gets a result row. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from folioscope.llm.common import documents, text_batches
from folioscope.llm.windows import Rule, digested, without_repeats

FIRST = 5


def lengths(width: int) -> list[int]:
    """1, then doubled up to FIRST, then doubled up to the width."""
    out = [1]
    for end in (min(FIRST, width), width):
        while out[-1] < end:
            out.append(min(2 * out[-1], end))
    return out


def doubled(texts: list[bytes], width: int, weights: np.ndarray | None = None, alone: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, offset and name of every window of words that occurs twice or more in texts (words joined by a space), of which each counts as often as its weight.

    alone: texts of which every window differs from all others. They have nothing to double for: each window is a name, if it has copies.
    """
    if alone is not None and alone.any():
        own, rest = np.flatnonzero(alone & (weights > 1)), np.flatnonzero(~alone)
        n = np.array([texts[r].count(b" ") + 2 - width for r in own.tolist()], np.int64)
        row, at, name = doubled([texts[r] for r in rest.tolist()], width, weights[rest]) if len(rest) else (own[:0],) * 3
        off = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.concatenate([rest[row], np.repeat(own, n)]), np.concatenate([at, off]), np.concatenate([name, np.arange(n.sum()) + name.max(initial=-1) + 1])
    index: dict[bytes, int] = {}
    words = [np.array([index.setdefault(w, len(index)) for w in t.split(b" ")], np.int64) for t in texts]
    sizes = np.array([len(w) for w in words])
    ends = np.cumsum(sizes)
    row = np.repeat(np.arange(len(texts)), sizes)
    name, room = np.concatenate(words), np.repeat(ends, sizes) - np.arange(ends[-1])  # words to the end of the text
    at = np.arange(len(name))
    steps = lengths(width)
    for old, new in zip(steps, steps[1:]):
        at = at[room[at] >= new]
        at = at[name[at + new - old] >= 0]
        _, pair = np.unique(name[at] << 32 | name[at + new - old], return_inverse=True)
        often = np.bincount(pair, None if weights is None else weights[row[at]])[pair] > 1
        at = at[often]
        name = np.full(len(name), -1)
        name[at] = pair[often]
    return row[at], at - (ends - sizes)[row[at]], name[at]


WORDS = Rule(20, (5, 10, 20), doubled, words=True, first_stays=True)


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    out = digested(without_repeats(documents(spark, sf_dir), WORDS))
    return out.select("doc_id", out.n_units.alias("n_words"), "n_removed", "kept_sha256")
