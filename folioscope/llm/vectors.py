"""Near-duplicate embeddings by collision-counting projections.

A table has a one-dimensional random projection by which the vectors of a cell are sorted; two vectors collide in it if one is in the
window centred at the other. Cells are what keeps windows short on large inputs: a vector's cell is its label and `width` further projections,
rounded, so that windows hold about CANDIDATES vectors whatever the number of rows (width 0 on small inputs, one more a factor of 2.4).
A pair's collisions are counted over all tables; pairs that reach the calibrated count are verified by cosine in double precision.
Calibration: for unit vectors at the least cosine to be found the chance of a collision in one table follows from the normal
distribution, independently from table to table; `plan` takes as many tables as make LEAST collisions certain to RECALL, then the
largest count that still is.

A pair is counted where it collides first. Every posting carries the vector's cells and projections of all tables (computed once), so
the task that holds the first common cell counts, verifies and tallies, and no row a pair leaves it: it gives the number of links of each vector
and a spanning forest. Sorted cells are read as a stream. Cells of more than a block are cut into blocks by hash, dealt out by pairs of
blocks. Equal vectors of a label are one class with the number of its copies.

Given results: vectors that are null, empty, zero or hold null or non-finite entries, and those without a label, link with nothing and are
their own component; so do vectors of different lengths. Rows that repeat vec_id, label and vector are one vector, each with a result
row; rows that repeat vec_id alone are different vectors under one name, which share a component. Null ids are smaller than all others.
An empty table gives no row. Other columns, whatever they are called, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, comb, erf, exp, log, pi, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from folioscope.llm.arrays import finite_rows
from folioscope.llm.common import NULL_ID, kept, sided
from folioscope.llm.components import components
from folioscope.shipping import ship

COSINE = 0.98
#: Widths of cells and half-widths of windows, in units of the largest distance of linked vectors.
CELL, WINDOW = 8.0, 3.0
#: Vectors in a window that aren't linked, about; collisions that are counted at least; share of links to be found.
CANDIDATES, LEAST, RECALL = 32, 2, 0.99999
SEED = 20_240
#: Entries of a block's vectors, and its rows at most.
BLOCK_ENTRIES, BLOCK = 1 << 18, 4096
#: Pairs looked at at once.
PAIRS = 1 << 18


@dataclass(frozen=True)
class Plan:
    width: int  # projections that make a cell
    tables: int
    least: int  # collisions
    cell: float
    window: float
    cosine: float
    kind: str = "<f8"  # of the stored entries

    def doubles(self, vecs: list[bytes], d: int) -> np.ndarray:
        return np.frombuffer(b"".join(vecs), self.kind).reshape(-1, d).astype(np.float64)

    def sizes(self, vecs: list[bytes]) -> np.ndarray:
        return np.array([len(v) for v in vecs], np.int64) // np.dtype(self.kind).itemsize


def _same_cell(sigma: float, cell: float) -> float:
    """The chance that two values, a normal difference of this deviation apart, round to one cell."""
    z = cell / sigma
    return erf(z / sqrt(2)) - sqrt(2 / pi) / z * (1 - exp(-z * z / 2))


def _at_least(k: int, n: int, p: float) -> float:
    return 1 - sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k))


def plan(n: int, cosine: float = COSINE, kind: str = "<f8") -> Plan:
    """For n vectors of one label. Unlinked vectors are taken to be at right angles; closer ones cost more, and change no result."""
    near, far = sqrt(2 - 2 * cosine), sqrt(2)
    cell, window = CELL * near, WINDOW * near
    alike = n * erf(window / far / sqrt(2))
    width = max(0, ceil(log(max(alike, 1) / CANDIDATES) / -log(_same_cell(far, cell))))
    p = _same_cell(near, cell) ** width * erf(window / near / sqrt(2))
    tables = LEAST
    while _at_least(LEAST, tables, p) < RECALL:
        tables += 1
    least = max(k for k in range(1, tables + 1) if _at_least(k, tables, p) >= RECALL)
    return Plan(width, tables, least, cell, window, cosine, kind)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    scaled = rows / np.abs(rows).max(1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))


def _usable(kind: str):
    """The embedding's entries as bytes; null if it can't be linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column("embedding")
            out: list[bytes | None] = [None] * b.num_rows
            for d in pc.unique(pc.list_value_length(column)).to_pylist():
                if d:
                    ok, rows = finite_rows(column, d)
                    rows = (rows + 0.0).astype(kind)  # -0.0 is 0.0
                    for at, row in zip(np.flatnonzero(ok).tolist(), rows):
                        if row.any():
                            out[at] = row.tobytes()
            yield pa.RecordBatch.from_arrays([b.column("_id"), b.column("lab"), pa.array(out, pa.binary())], ["_id", "lab", "vec"])

    return run


def _signed(p: Plan):
    """Adds to classes: gs, lines (the key of the cell and the projection of each table) and sig (all cells as 32 bits, all projections as floats)."""
    matrices: dict[int, np.ndarray] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vec, labels = b.column("vec").to_pylist(), b.column("lab").to_numpy()
            keys, sigs = np.zeros((len(vec), p.tables), np.int64), [b""] * len(vec)
            lines = np.zeros((len(vec), p.tables), np.float32)
            sizes = p.sizes(vec)
            for d in np.unique(sizes).tolist():
                if d not in matrices:
                    rng = np.random.default_rng([SEED, d])
                    matrices[d] = rng.standard_normal((d, p.tables * (p.width + 1))), rng.random((p.tables, p.width))
                matrix, shifts = matrices[d]
                own = np.flatnonzero(sizes == d)
                u = unit_rows(p.doubles([vec[i] for i in own], d))
                on = (u @ matrix).reshape(len(own), p.tables, p.width + 1)
                rounded = np.floor(on[:, :, : p.width] / p.cell + shifts).astype(np.int64).astype(np.uint64)
                h = np.broadcast_to((np.arange(p.tables, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), (len(own), p.tables)) ^ np.uint64(d)
                for k in range(p.width):
                    h = (h ^ rounded[:, :, k]) * np.uint64(0xBF58476D1CE4E5B9)
                    h = h ^ h >> np.uint64(29)
                cells, lines[own] = h >> np.uint64(32), on[:, :, -1]
                numbered = cells | np.arange(p.tables, dtype=np.uint64) << np.uint64(32)
                keys[own] = ((numbered ^ labels[own].view(np.uint64)[:, None]) * np.uint64(0x94D049BB133111EB)).view(np.int64)
                for i, c in zip(own.tolist(), cells.astype("<u4")):
                    sigs[i] = c.tobytes() + lines[i].tobytes()
            ends = pa.array(np.arange(len(vec) + 1) * p.tables, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v.ravel())) for v in (keys, lines)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists, pa.array(sigs, pa.binary())], [*b.schema.names, "gs", "lines", "sig"])

    return run


class _Roots:
    """Smallest places reachable among n, as links come in."""

    def __init__(self, n: int):
        self.of = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.of[a], self.of[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(self.of, np.maximum(x, y), np.minimum(x, y))
            while (self.of != self.of[self.of]).any():
                self.of = self.of[self.of]


def _window_pairs(group: np.ndarray, cross: np.ndarray, second: np.ndarray, line: np.ndarray, window: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of one group within a window, a bounded number at a time. Rows are sorted by group, second, line.

    cross: of a pair of blocks, whose rows are of the first block or (second) of the other; only pairs between them count.
    """
    wide = window * (1 + 1e-3)  # rounding; collisions are decided later
    span = float(line.max() - line.min()) + 4 * wide
    place = (2 * group + second) * span + (line - line.min())
    at = np.flatnonzero(~(cross & second))
    shift = np.where(cross[at], span, 0)
    lo = np.where(cross[at], np.searchsorted(place, place[at] + shift - wide), at + 1)
    hi = np.searchsorted(place, place[at] + shift + wide, "right")
    many = np.maximum(hi - lo, 0)
    done = np.concatenate([[0], np.cumsum(many)])
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(done, done[first] + PAIRS, "right")) - 1)
        n = many[first:last]
        a = np.repeat(at[first:last], n)
        yield a, np.arange(len(a)) - np.repeat(done[first:last] - done[first], n) + np.repeat(lo[first:last], n)
        first = last


_FOUND = "h1 long, h2 long, links long, a long, b long"


def _compared(p: Plan):
    """Streams postings sorted by group; gives links of each class, and edges that connect what is linked."""

    def group_rows(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lab, rep, copies = (b.column(c).to_numpy() for c in ("lab", "rep", "copies"))
        table, keys = b.column("l").to_numpy(), np.stack([b.column(c).to_numpy() for c in ("g", "x", "y")])
        fresh = np.append(True, (keys[:, 1:] != keys[:, :-1]).any(0))
        group, cross = np.cumsum(fresh) - 1, keys[1] != keys[2]
        second = cross & (b.column("b").to_numpy() == keys[2])
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), np.uint8).reshape(b.num_rows, -1)
        cells = np.ascontiguousarray(sig[:, : 4 * p.tables]).view("<u4").T.copy()
        lines = np.ascontiguousarray(sig[:, 4 * p.tables :]).view("<f4").T.copy()
        vec = b.column("vec").to_pylist()
        sizes = p.sizes(vec)
        units, spot = {}, np.zeros(b.num_rows, np.int64)
        for d in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == d)
            spot[own] = np.arange(len(own))
            units[d] = unit_rows(p.doubles([vec[i] for i in own], d))
        links, roots = np.zeros(b.num_rows, np.int64), _Roots(b.num_rows)
        for x, y in _window_pairs(group, cross, second, b.column("line").to_numpy().astype(np.float64), p.window):
            same = (lab[x] == lab[y]) & (sizes[x] == sizes[y])
            x, y = x[same], y[same]
            count, first = np.zeros(len(x), np.int64), np.full(len(x), p.tables)
            for t in reversed(range(p.tables)):
                hit = (cells[t][x] == cells[t][y]) & (np.abs(lines[t][x] - lines[t][y]) <= p.window)
                count += hit
                first[hit] = t
            keep = (count >= p.least) & (first == table[x])
            x, y = x[keep], y[keep]
            for d, u in units.items():
                own = np.flatnonzero(sizes[x] == d) if len(units) > 1 else np.arange(len(x))
                step = max(1, (1 << 22) // d)
                for s in range(0, len(own), step):
                    i, j = x[own[s : s + step]], y[own[s : s + step]]
                    near = np.einsum("ij,ij->i", u[spot[i]], u[spot[j]]) >= p.cosine
                    i, j = i[near], j[near]
                    np.add.at(links, i, copies[j])
                    np.add.at(links, j, copies[i])
                    roots.link(i, j)
        some = np.flatnonzero(links)
        none = pa.nulls(len(some), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("h1").take(pa.array(some)), b.column("h2").take(pa.array(some)), pa.array(links[some]), none, none], ["h1", "h2", "links", "a", "b"])
        moved = np.flatnonzero(roots.of != np.arange(b.num_rows))
        none = pa.nulls(len(moved), pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, pa.array(rep[moved]), pa.array(rep[roots.of[moved]])], ["h1", "h2", "links", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for new in batches:
            for at in range(0, new.num_rows, BLOCK):
                held.append(new.slice(at, BLOCK))
                whole = pa.concat_batches(held)
                keys = np.stack([whole.column(c).to_numpy() for c in ("g", "x", "y")])
                fresh = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0))
                held = [whole]
                if len(fresh) and whole.num_rows >= BLOCK:
                    yield from group_rows(whole.slice(0, int(fresh[-1]) + 1))
                    held = [whole.slice(int(fresh[-1]) + 1)]
        if held:
            yield from group_rows(pa.concat_batches(held))

    return run


def _postings(signed: DataFrame, p: Plan, block: int) -> DataFrame:
    """A row for each class and table, and for each pair of blocks where the cell has more than one."""
    hot = kept(signed.select(F.explode("gs").alias("g")).groupBy("g").count().where(F.col("count") > block).select("g", F.ceil(F.col("count") / block).cast("int").alias("n")), "hot-cells")
    tables = F.posexplode(F.arrays_zip("gs", "lines")).alias("l", "at")
    rows = signed.select(tables, *(c for c in signed.columns if c not in ("gs", "lines"))).select("*", F.col("at.gs").alias("g"), F.col("at.lines").alias("line")).drop("at")
    rows = rows.join(sided(hot), "g", "left").withColumn("b", F.coalesce(F.pmod(F.xxhash64("h1", "h2"), "n").cast("int"), F.lit(0)))
    other = F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)).alias("other")
    return rows.select("*", other).select("*", F.least("b", "other").alias("x"), F.greatest("b", "other").alias("y")).drop("n", "other")


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links (other vectors of the label at that cosine or more), component_id (the smallest vec_id reachable) of each row."""
    spark = vectors.sparkSession
    ship(spark)
    kind = "<f4" if isinstance(vectors.schema["embedding"].dataType.elementType, FloatType) else "<f8"
    name, labelled = F.coalesce(F.col("vec_id").cast("long"), F.lit(NULL_ID)).alias("_id"), F.col("label").isNotNull()
    given = vectors.select(name, F.when(labelled, F.xxhash64("label")).alias("lab"), F.when(labelled, F.col("embedding")).alias("embedding"))
    points = given.mapInArrow(_usable(kind), "_id long, lab long, vec binary")
    hashed = {n: F.when(F.col("vec").isNotNull(), F.xxhash64(*seed, "lab", "vec")) for n, seed in (("h1", ()), ("h2", (F.lit(1),)))}
    points = kept(points.withColumns(hashed), "points")
    usable = points.where("vec is not null")
    each = usable.groupBy("h1", "h2", "_id").agg(F.first("lab").alias("lab"), F.first("vec").alias("vec"))
    classes = each.groupBy("h1", "h2").agg(F.first("lab").alias("lab"), F.first("vec").alias("vec"), F.min("_id").alias("rep"), F.count("*").alias("copies"))
    classes = kept(classes, "classes")
    most = classes.groupBy("lab").count().agg(F.max("count")).first()[0] or 0
    p = plan(most, cosine, kind)
    dims = (classes.agg(F.max(F.length("vec"))).first()[0] or 8) // np.dtype(kind).itemsize
    signed = "h1 long, h2 long, lab long, vec binary, rep long, copies long, gs array<long>, lines array<float>, sig binary"
    posted = _postings(kept(classes.mapInArrow(_signed(p), signed), "signed"), p, max(64, min(BLOCK, BLOCK_ENTRIES // dims)))
    found = kept(posted.repartition("g", "x", "y").sortWithinPartitions("g", "x", "y", "b", "line").mapInArrow(_compared(p), _FOUND), "links")
    links = found.where("h1 is not null").groupBy("h1", "h2").agg(F.sum("links").alias("links"))
    roots = components(found.where("a is not null").select("a", "b"))
    named = classes.select("h1", "h2", "rep", "copies").join(links, ["h1", "h2"], "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = kept(named.select("h1", "h2", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named")
    out = points.select("_id", "h1", "h2").join(sided(named), ["h1", "h2"], "left")
    return out.select(F.nullif("_id", F.lit(NULL_ID)).alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.nullif(F.coalesce("root", "_id"), F.lit(NULL_ID)).alias("component_id"))


def op13_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return rows.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
