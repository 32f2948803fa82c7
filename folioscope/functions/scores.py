"""Row-level metrics of a hypothesis against a reference, as column expressions; edit distances and BLEU by Arrow UDFs."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from folioscope.functions.text import canonicalize_latex, tokenize_latex

#: Pairs whose columns of distances are taken together, codes that these hold at most, and the length up to which both are done.
TOGETHER, HELD, SHORT = 2048, 1 << 22, 512
#: Bytes of the masks that a distance keeps; further ones are made when they are needed.
MASKS = 64 << 20


def edit_distance(a: Sequence, b: Sequence) -> int:
    """Edit distance over characters or tokens, exact: a column of the table of distances is two integers of a bit a row (Hyyrö's form of Myers' method)."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    m = len(a)
    if m == 0:
        return len(b)
    places, masks = defaultdict(list), {}
    for i, x in enumerate(a):
        places[x].append(i)
    most = MASKS // (m // 8 + 1)

    def mask(x) -> int:
        if (known := masks.get(x)) is not None:
            return known
        bits = bytearray(m // 8 + 1)
        for i in places.get(x, ()):
            bits[i >> 3] |= 1 << (i & 7)
        made = int.from_bytes(bits, "little")
        if len(masks) < most:
            masks[x] = made
        return made

    full, top, out = (1 << m) - 1, 1 << (m - 1), m
    up, down = full, 0
    for x in b:
        same = mask(x)
        right = same | down
        across = (((same & up) + up) ^ up) | same
        more, less = down | ~(across | up), up & across
        if more & top:
            out += 1
        elif less & top:
            out -= 1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(right | more)) & full, more & right
    return out


def _padded(rows: list[np.ndarray], lengths: np.ndarray, width: int, other: int, kind: np.dtype) -> np.ndarray:
    out = np.full((len(rows), width), other, kind)
    out[np.arange(width) < lengths[:, None]] = np.concatenate(rows)
    return out


def _distances_together(a: list[np.ndarray], b: list[np.ndarray], kind: np.dtype) -> np.ndarray:
    """Distances of pairs (b in rising length, a not empty, all of as many 64-bit words), a column of all pairs at once; the step is that of edit_distance."""
    m, n, one, last = np.array([len(x) for x in a]), np.array([len(x) for x in b]), np.uint64(1), np.uint64(63)
    words = (int(m[0]) + 63) // 64
    most = np.iinfo(kind).max
    rows, columns = _padded(a, m, 64 * words, most, kind), _padded(b, n, int(n[-1]), most - 1, kind).T.copy()
    up, down = np.full((words, len(a)), np.iinfo(np.uint64).max, np.uint64), np.zeros((words, len(a)), np.uint64)
    out, top, first = m.copy(), ((m - 1) % 64).astype(np.uint64), np.searchsorted(n, np.arange(int(n[-1])), "right")
    for j, at in enumerate(first.tolist()):
        equal = np.packbits(rows[at:] == columns[j, at:, None], axis=1, bitorder="little").view("<u8")
        plus, minus = one, np.uint64(0)
        for w in range(words):
            u, d, same = up[w, at:], down[w, at:], equal[:, w]
            right = same | d
            same = same | minus
            across = (((same & u) + u) ^ u) | same
            more, less = d | ~(across | u), u & across
            if w == words - 1:
                out[at:] += (more >> top[at:] & one).astype(np.int64) - (less >> top[at:] & one).astype(np.int64)
            carry = more >> last, less >> last
            more, less = more << one | plus, less << one | minus
            up[w, at:], down[w, at:] = less | ~(right | more), more & right
            plus, minus = carry
    return out


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Edit distances of pairs of codes, all of one type, below its largest two numbers."""
    out, rest = np.zeros(len(pairs), np.int64), []
    for i, pair in enumerate(pairs):
        short, long_ = sorted(pair, key=len)
        if len(short) == len(long_) and short.tobytes() == long_.tobytes():
            continue
        if 0 < len(short) <= SHORT:
            rest.append(((len(short) + 63) // 64, len(long_), i, short, long_))
        else:
            out[i] = edit_distance(short.tolist(), long_.tolist())
    rest.sort(key=lambda r: r[:3])
    at = 0
    while at < len(rest):
        end = at + 1
        while end < len(rest) and end - at < TOGETHER and rest[end][0] == rest[at][0] and (end + 1 - at) * rest[end][1] <= HELD:
            end += 1
        own = rest[at:end]
        out[[r[2] for r in own]] = _distances_together([r[3] for r in own], [r[4] for r in own], own[0][3].dtype)
        at = end
    return out


def _codes(a: pa.Array, b: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of characters or tokens as numbers, of the smallest type that leaves two free. No nulls."""
    both = pa.concat_arrays([a, b])
    if pa.types.is_list(both.type):
        lengths, flat = both.value_lengths().to_numpy(zero_copy_only=False), both.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    else:
        texts = both.to_pylist()
        lengths, flat = np.array([len(t) for t in texts], np.int64), np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    most = int(flat.max(initial=0))
    flat = flat.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if most < np.iinfo(t).max - 1))
    rows = np.split(flat, np.cumsum(lengths)[:-1])
    return list(zip(rows[: len(a)], rows[len(a) :]))


def _of_pairs(a: pa.Array, b: pa.Array, f: Callable) -> pa.Array:
    """f of the pairs' codes; null where either is."""
    there = pc.and_(a.is_valid(), b.is_valid())
    at = np.flatnonzero(there.to_numpy(zero_copy_only=False))
    if not len(at):
        return pa.nulls(len(a))
    found = np.asarray(f(_codes(a.filter(there), b.filter(there))))
    out, null = np.zeros(len(a), found.dtype), np.ones(len(a), bool)
    out[at], null[at] = found, False
    return pa.array(out, mask=null)


def distance(a: Column, b: Column) -> Column:
    """Edit distance of two texts (over characters) or two arrays of tokens; null if either is."""

    @F.arrow_udf("int")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _of_pairs(a, b, edit_distances).cast(pa.int32())

    return run(a, b)


def _rate(edits: Column, n: Column, hyp_empty: Column) -> Column:
    return F.when(n == 0, F.when(hyp_empty, 0.0).otherwise(1.0)).otherwise(edits / n)


def cer(hyp: Column, ref: Column) -> Column:
    """Edit distance over the reference's length, unbounded; empty reference: 0 if both are empty, else 1."""
    return _rate(distance(hyp, ref).cast("double"), F.length(ref), F.length(hyp) == 0)


def tokens_of(c: Column) -> Column:
    """Words split at any Unicode white space, without empty ones."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def wer(hyp: Column, ref: Column) -> Column:
    a, b = tokens_of(hyp), tokens_of(ref)
    return _rate(distance(a, b).cast("double"), F.size(b), F.size(a) == 0)


def sentence_bleu(hyp: list, ref: list, order: int = 4) -> float:
    if not hyp:
        return 0.0
    logs, same = 0.0, hyp == ref
    for n in range(1, order + 1):
        if same:  # all n-grams are matched
            logs += math.log((len(hyp) >= n) + 1e-10) / order
            continue
        ours, theirs = (Counter(zip(*(words[i:] for i in range(n)))) for words in (hyp, ref))
        clipped = sum(min(k, theirs[g]) for g, k in ours.items() if g in theirs)
        logs += math.log(clipped / max(len(hyp) - (n - 1), 1) + 1e-10) / order
    return min(1.0, math.exp(1 - len(ref) / len(hyp))) * math.exp(logs)


def bleu(hyp: Column, ref: Column, order: int = 4) -> Column:
    """Sentence BLEU: brevity penalty times the geometric mean of clipped precisions (plus 1e-10); 0 for an empty hypothesis, null if either is."""

    @F.arrow_udf("double")
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        return _of_pairs(a, b, lambda pairs: [sentence_bleu(x.tolist(), y.tolist(), order) for x, y in pairs]).cast(pa.float64())

    return run(tokens_of(hyp), tokens_of(ref))


def token_error_rate(hyp: Column, ref: Column, clamp: bool = False) -> Column:
    """Error rate over LaTeX tokens; clamp divides by max(tokens, 1) instead of the empty-reference rule."""
    a, b = tokenize_latex(hyp), tokenize_latex(ref)
    edits = distance(a, b).cast("double")
    return edits / F.greatest(F.size(b), F.lit(1)) if clamp else _rate(edits, F.size(b), F.size(a) == 0)


def exp_rate(hyp: Column, ref: Column) -> Column:
    """1 if canonical forms are equal and not empty."""
    a, b = canonicalize_latex(hyp), canonicalize_latex(ref)
    return ((a == b) & (b != "")).cast("int")


def edit_ratio_guard(orig: Column, new: Column, most: float = 0.30) -> Column:
    """The correction, unless it changes too much of the original."""
    ratio = F.when(F.length(orig) == 0, F.when(F.length(new) == 0, 0.0).otherwise(1.0)).otherwise(F.levenshtein(orig, new) / F.length(orig))
    return F.when(ratio > most, orig).otherwise(new)


def grade(c: Column) -> Column:
    return F.when(c < 0.05, "good").when(c < 0.2, "fair").otherwise("poor")


def wilson_ci(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    p = k / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    return (middle - spread) / (1 + z * z / n), (middle + spread) / (1 + z * z / n)
