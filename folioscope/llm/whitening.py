"""Whitening of embeddings from exact sums of bit planes.

An entry c becomes the integer floor(1024 c) + 100000. Of a chunk of rows, each dimension is shifted by its least value, so that few
bits are left, and cut into bit planes: plane b of dimension i packs bit b of all rows into 64-bit words. The sum of products of two
dimensions is the sum over their planes of 2^(b + c) times the set bits of (plane b AND plane c), exactly; the shift is taken back
with integers, so every chunk may choose its own. Tasks give one row for each pair of dimensions, added up as decimals; the driver
holds sums of d x d integers, whatever the number of rows. The covariance is n G - S S^T in integers, divided once, then `eigh`.

Given results: vectors that are null, empty, hold null or non-finite entries, or aren't of the most frequent length (of equally
frequent ones the longest) are left out. Repeated rows count as often as they are there, and null ids are kept. Components whose
eigenvalue is zero to double precision don't exist (fewer rows a vector than asked for); one vector, or equal vectors only, give no
row, as does an empty table. Other columns, whatever they are called, aren't read. Entries of 2^40 / 1024 or more in size raise
an error, as their sums needn't fit 38 digits. Ties between eigenvalues leave the choice of components to `eigh`, the same for all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.arrays import finite_rows
from folioscope.llm.common import kept
from folioscope.shipping import ship

SCALE, OFFSET = 1024, 100_000
#: Rows whose planes are counted at once.
CHUNK = 16_384
LARGEST = 2.0**40
#: Widths of planes up to which sums of one chunk fit 64 bits.
NARROW = 24


def integers(rows: np.ndarray) -> np.ndarray:
    scaled = np.floor(SCALE * rows)
    if scaled.size and np.abs(scaled).max() >= LARGEST:
        raise ValueError(f"an entry is {LARGEST / SCALE:.0f} or more in size")
    return scaled.astype(np.int64) + OFFSET


def bit_planes(y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """planes (one row of words each), their bit numbers, and the first plane of each column of the non-negative y."""
    widths = [max(1, int(m).bit_length()) for m in y.max(0)]
    starts = np.concatenate([[0], np.cumsum(widths)[:-1]])
    bits = np.concatenate([np.arange(w) for w in widths])
    of = np.repeat(np.arange(y.shape[1]), widths)
    set_ = (y.T[of] >> bits[:, None] & 1).astype(np.uint8)
    packed = np.packbits(np.pad(set_, ((0, 0), (0, -len(y) % 64))), axis=1)
    return np.ascontiguousarray(packed).view(np.uint64), bits, starts


def cross_products(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of each column and of the products of each two columns of x (longs), as Python integers."""
    low = x.min(0)
    planes, bits, starts = bit_planes(x - low)
    counts = np.zeros((len(planes), len(planes)), np.int64)
    for p, plane in enumerate(planes):
        counts[p, p:] = np.bitwise_count(plane & planes[p:]).sum(1, dtype=np.int64)
        counts[p:, p] = counts[p, p:]
    kind = np.int64 if bits.max() < NARROW else object
    weights = np.array([1 << int(b) for b in bits], kind)
    squares = np.add.reduceat(np.add.reduceat(counts.astype(kind) * weights[:, None] * weights, starts, 0), starts, 1).astype(object)
    sums = np.add.reduceat(np.diag(counts).astype(kind) * weights, starts).astype(object)
    low, n = low.astype(object), len(x)
    return sums + n * low, squares + np.outer(sums, low) + np.outer(low, sums) + n * np.outer(low, low)


def _chunks(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[np.ndarray]:
    held, n = [], 0
    for b in batches:
        _, rows = finite_rows(b.column("embedding"), dims)
        held.append(rows)
        n += len(rows)
        if n >= CHUNK:
            whole = np.concatenate(held)
            for at in range(0, n - n % CHUNK, CHUNK):
                yield whole[at : at + CHUNK]
            held, n = [whole[n - n % CHUNK :]], n % CHUNK
    if n:
        yield np.concatenate(held)


def _summed(dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, 0, 0
        for rows in _chunks(batches, dims):
            s, q = cross_products(integers(rows))
            n, sums, squares = n + len(rows), sums + s, squares + q
        if n:
            i, j = np.triu_indices(dims)
            values = [n, *sums.tolist(), *squares[i, j].tolist()]
            cols = [np.concatenate([[-1], np.arange(dims), i]), np.concatenate([[-1], np.full(dims, -1), j])]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in cols), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], ["i", "j", "v"])

    return run


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # a row each
    values: np.ndarray
    explained: np.ndarray


def fitted(vectors: DataFrame, most: int = 8) -> Whitening | None:
    """The whitening by at most so many components of all usable vectors in the column embedding; None without a usable vector."""
    ship(vectors.sparkSession)
    sizes = vectors.select(F.size("embedding").alias("d")).where("d > 0").groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if sizes is None:
        return None
    d = sizes["d"]
    sums = vectors.select("embedding").mapInArrow(_summed(d), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not sums:
        return None
    at = {(r["i"], r["j"]): int(r["v"]) for r in sums}  # (d + 1)(d + 2) / 2 integers
    n, s = at[-1, -1], [at[i, -1] for i in range(d)]
    centred = [[n * at[min(i, j), max(i, j)] - s[i] * s[j] for j in range(d)] for i in range(d)]
    values, columns = np.linalg.eigh(np.array([[c / n**2 for c in row] for row in centred]))
    values, components = values[::-1], columns.T[::-1]
    real = int((values > d * np.finfo(float).eps * max(values[0], 0)).sum())
    total = sum(centred[i][i] for i in range(d)) / n**2
    m = min(most, real)
    return Whitening(n, s, np.ascontiguousarray(components[:m]), values[:m], values[:m] / total if m else values[:0])


def _projected(w: Whitening):
    d, largest = len(w.sums), max(abs(x) for x in w.sums)
    matrix = w.components.T / np.sqrt(w.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok, rows = finite_rows(b.column("embedding"), d)
            x = integers(rows)
            most = int(np.abs(x).max()) if x.size else 0
            wide = w.n * most + largest >= 2**62
            centred = w.n * (x.astype(object) if wide else x) - np.array(w.sums, object if wide else np.int64)
            reach = max(map(abs, (int(centred.max()), int(centred.min())))) if x.size else 0
            squared = centred.astype(object if reach**2 * d >= 2**62 else np.int64) ** 2
            moved = (centred / w.n).astype(np.float64) @ matrix
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("vec_id").filter(pa.array(ok)),
                    pa.array([Decimal(v) for v in squared.sum(1).tolist()], pa.decimal128(38, 0)),
                    pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(w.values), moved.ravel()),
                ],
                ["vec_id", "deviation", "whitened"],
            )

    return run


def whitened(vectors: DataFrame, w: Whitening) -> DataFrame:
    """vec_id, deviation (decimal: sum over dimensions of (n x - S)^2, exact), whitened (an entry a component) of each usable vector."""
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(_projected(w), "vec_id long, deviation decimal(38,0), whitened array<double>")


def identity_error(rows: DataFrame, m: int) -> float:
    """The largest absolute entry of the covariance (divisor n) of the m whitened entries minus the identity."""
    w = F.col("whitened")
    each = [F.abs(F.covar_pop(w[i], w[j]) - (1.0 if i == j else 0.0)) for i in range(m) for j in range(i, m)]
    return rows.agg(F.greatest(*each, F.lit(0.0)).alias("e")).first()["e"]


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deviation is null where it doesn't fit a long (it grows with n^2); `whitened` has it as a decimal."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    w = fitted(vectors)
    if w is None or not len(w.values):
        return spark.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    m = len(w.values)
    rows = kept(whitened(vectors, w), "whitened")
    off = identity_error(rows, m)
    explained = F.array(*(F.lit(float(e)) for e in w.explained))
    rows = rows.select("vec_id", F.expr("try_cast(deviation as long)").alias("deviation"), F.posexplode("whitened").alias("k", "whitened"))
    return rows.select(
        "vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(w.n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("k")].alias("explained"), F.lit(off).alias("identity_error")
    )
