"""SimHash near-duplicates through an inverted index of byte positions with count filtering.

A fingerprint has 8 bytes a lane. Two fingerprints that differ in at most b bits share at least 8 - b bytes at their positions. A
posting list of one positional byte would hold a 256th of the corpus, so the index posts each distinct fingerprint under tuples of 4
positional bytes, each the intersection of 4 such lists: 70 lists of 8 positions, of which a pair within 3 bits shares C(5, 4) = 5 at
least. Each list counts one for each of its pairs; counts are added up per pair over all lists, pairs below the guaranteed minimum
leave, and the rest are verified bit by bit.

A list of over SHORT postings doesn't give a row a pair: it tallies the shared bytes of its pairs itself, verifies those that reach the
minimum, and gives links, or a minimum spanning forest of them (by differing bits) if they are many, which keeps what is connected.
Lists are read as a sorted stream; those of over BLOCK postings are cut into blocks, and pairs of blocks are dealt out to tasks by
list and both block numbers, so a hot list meets in no single task.

`near_groups` finds the groups of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more. Two steps:
256-bit fingerprints of the distinct shingles, 48 tuples and at most 56 differing bits give most links cheaply (tuples are as wide as
the number of documents needs); then an exact prefix-filter join finds every pair of different groups that may be similar enough. All
pairs are verified against the sets (made again from the texts, unless parity bitmaps of the sets show that they differ too much), so
the first step decides only what the second costs. Of two sets the
smaller one needs a shorter prefix (a ninth of it instead of a fifth): only postings from there index a shingle, and only they meet the
others. So sets that have a frequent shingle in common and differ in more than the similarity allows don't meet for it, however many they
are: with m index postings a shingle's rows are as many as its postings times m / CELL, not times their number.

Null and empty texts have no shingle and fingerprint zero; they are linked like any other. Words are split at ASCII white space after
lower-casing A-Z. Repeated rows share a fingerprint and a component. Very long texts are shingled whole, in parts of 16,384 hashes. An empty
table gives no row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import ceil, comb, log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import documents, forget, identified, kept, lean, sided, text_batches, wrapped
from folioscope.llm.components import components
from folioscope.sources.scratch import shuffles_end

SEED = 42
BLOCK = 4096
#: Lists up to this many postings give a row for each of their pairs.
SHORT = 8
#: Lists with more links than this many for each posting yield a spanning forest of them.
DENSE = 4


def shingle_hashes(text: str, words: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; fewer words than a shingle has: the whole sequence; none: no hash."""
    own = text.encode().lower().split()
    if not own:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(own))
    ends = np.cumsum([len(w) + 1 for w in own]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(own) > words:
        starts, ends = starts[: len(own) - words + 1], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    hashed = xxhash.xxh64_intdigest
    return np.fromiter((hashed(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends.tolist())), np.uint64, len(starts))


def _mixed(h: np.ndarray, lane: int) -> np.ndarray:
    """Lane 0 is the hash itself; further lanes are finalised from it."""
    if not lane:
        return h
    h = h + np.uint64(0x9E3779B97F4A7C15 * lane % 2**64)
    h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return h ^ h >> np.uint64(31)


def fingerprint(h: np.ndarray, lanes: int = 1) -> np.ndarray:
    """One unsigned word a lane: a bit is 1 if set in over half the hashes."""
    out = np.zeros(lanes, np.uint64)
    for lane in range(lanes):
        count = np.zeros(64, np.int64)
        for at in range(0, len(h), 1 << 14):
            part = _mixed(h[at : at + (1 << 14)], lane).astype(">u8")
            count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.uint32)
        out[lane] = np.packbits(count * 2 > len(h)).view(">u8")[0]
    return out


def fingerprints(docs: DataFrame, words: int, lanes: int = 1) -> DataFrame:
    """doc_id, _id, _th, f0, f1, ... (signed longs) for each row of `identified` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            f = np.array([fingerprint(shingle_hashes(t, words), lanes) for t in b.column("text").to_pylist()], np.uint64).reshape(-1, lanes).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("doc_id", "_id", "_th")] + [pa.array(f[:, i]) for i in range(lanes)], ["doc_id", "_id", "_th", *(f"f{i}" for i in range(lanes))])

    return docs.mapInArrow(lean(run), "doc_id long, _id long, _th long, " + ", ".join(f"f{i} long" for i in range(lanes)))


def tuples_of(width: int, positions: int) -> list[tuple[int, ...]]:
    """All tuples: complete if any pair to be found shares width of these positions."""
    return list(combinations(range(positions), width))


def spread_tuples(n: int, width: int, positions: int) -> list[tuple[int, ...]]:
    """n tuples that use all positions alike: position i with i + s, i + 2s, ... for one stride s after another."""
    return [tuple((i + k * s) % positions for k in range(width)) for s in range(1, positions) for i in range(positions)][:n]


def _postings(tuples: list[tuple[int, ...]], lanes: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                node = b.column("node").to_numpy()
                f = np.stack([b.column(f"f{i}").to_numpy() for i in range(lanes)], 1)
                by = np.ascontiguousarray(f.astype(">i8")).view(np.uint8).reshape(len(node), 8 * lanes).astype(np.int64)
                keys = np.stack([sum((by[:, p] << 8 * k for k, p in enumerate(ps)), np.int64(t) << 8 * len(ps)) for t, ps in enumerate(tuples)], 1)  # up to 6 bytes
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys.ravel()), pa.array(np.repeat(node, len(tuples)))] + [pa.array(np.repeat(f[:, i], len(tuples))) for i in range(lanes)],
                    ["key", "node", *(f"f{i}" for i in range(lanes))],
                )

    return lean(run)


def _linked_pairs(a: np.ndarray, b: np.ndarray, least: int, most: int) -> np.ndarray:
    """Which rows share `least` bytes, and of those, differ in `most` bits or fewer."""
    x = a ^ b
    out = (np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 8 * x.shape[1]) == 0).sum(1) >= least
    out[out] = np.bitwise_count(x[out]).sum(1, dtype=np.int64) <= most
    return out


def _forest(nodes: np.ndarray, f: np.ndarray, most: int) -> tuple[list[int], list[int]]:
    """Edges of a minimum spanning forest over the links of one list (Prim's, a row of distances at a time)."""
    n, a, b = len(nodes), [], []
    best, parent, out = np.full(n, 10_000), np.zeros(n, np.int64), np.ones(n, bool)
    for _ in range(n):
        at = int(np.argmin(np.where(out, best, 20_000)))
        if best[at] <= most:
            a.append(int(nodes[parent[at]]))
            b.append(int(nodes[at]))
        out[at] = False
        d = np.bitwise_count(f ^ f[at]).sum(1, dtype=np.int64)
        nearer = out & (d < best)
        best[nearer], parent[nearer] = d[nearer], at
    return a, b


def _within(key: np.ndarray, node: np.ndarray, f: np.ndarray, least: int, most: int, across: int) -> Iterator[pa.RecordBatch]:
    """What the lists of rows sorted by key give: counts of the pairs of short lists (if pairs are counted across lists), links of the others."""
    starts = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(key)))
    short = np.repeat((sizes <= SHORT) & (across > 0), sizes)
    pairs: list[list[np.ndarray]] = [[], [], []]  # of short lists, and both ends of links
    at = np.arange(len(key))
    for d in range(1, len(key)):
        at = at[at + d < len(key)]
        at = at[key[at] == key[at + d]]
        if not len(at):
            break
        own = at[short[at]]
        pairs[0].append(np.stack([own, own + d]))
        own = at[~short[at]]
        own = own[node[own] != node[own + d]]
        own = own[_linked_pairs(f[own], f[own + d], least, most)]
        pairs[1].append(own)
        pairs[2].append(own + d)
    if not pairs[0]:
        return
    a, b = node[np.concatenate(pairs[0], 1)]
    yield _links(a, b, 0)
    first, second = np.concatenate(pairs[1]), np.concatenate(pairs[2])
    of = np.searchsorted(starts, first, "right") - 1
    dense = np.flatnonzero(np.bincount(of, minlength=len(starts)) > DENSE * sizes)
    sparse = ~np.isin(of, dense)
    more = [_forest(node[s : s + n], f[s : s + n], most) for s, n in zip(starts[dense], sizes[dense])]
    a = np.concatenate([node[first[sparse]], *(np.array(x, np.int64) for x, _ in more)])
    b = np.concatenate([node[second[sparse]], *(np.array(x, np.int64) for _, x in more)])
    yield _links(a, b, across)


_LINK = "a long, b long, n long, list long, block binary"


def _links(a, b, n: int) -> pa.RecordBatch:
    """Pairs with n, or with how often each is there if n is 0."""
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    count = np.empty(0, np.int64)
    if len(lo):
        (lo, hi), count = np.unique(np.stack([lo, hi]), axis=1, return_counts=True)
    none = pa.nulls(len(lo))
    counts = pa.array(np.full(len(lo), n) if n else count, pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), counts, none.cast(pa.int64()), none.cast(pa.binary())], ["a", "b", "n", "list", "block"])


def _tally(lanes: int, least: int, most: int, across: int = 0) -> Callable:
    """Streams sorted postings; gives counts and links of pairs, and the blocks of lists that are longer than BLOCK."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((0, 2 + lanes), np.int64)
        cut: int | None = None  # the list of which blocks were given already

        def done(rows: np.ndarray, last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, cut
            while len(rows):
                end = len(rows) if last else int(np.searchsorted(rows[:, 0], rows[-1, 0]))
                if end == 0 and len(rows) <= BLOCK:
                    break
                if cut is not None or end == 0 or rows[0, 0] == rows[min(BLOCK, len(rows) - 1), 0]:
                    key = rows[0, 0]
                    n = min(int(np.searchsorted(rows[:, 0], key, "right")), BLOCK)
                    whole = n < len(rows) and rows[n, 0] != key or n == len(rows) and last
                    if cut == key or not whole:
                        part = np.ascontiguousarray(rows[:n, 1:])
                        yield from _within(rows[:n, 0], part[:, 0], part[:, 1:].view(np.uint64), least, most, across if n > SHORT else 0)
                        none = [pa.nulls(1, pa.int64())] * 3
                        yield pa.RecordBatch.from_arrays([*none, pa.array([int(key)]), pa.array([part.tobytes()])], ["a", "b", "n", "list", "block"])
                        cut, rows = int(key), rows[n:]
                        continue
                    cut = None
                part = rows[:end]
                yield from _within(part[:, 0], part[:, 1], np.ascontiguousarray(part[:, 2:]).view(np.uint64), least, most, across)
                rows, cut = rows[end:], None
            held = rows

        for batch in batches:
            new = np.stack([c.to_numpy() for c in batch.columns], 1)
            yield from done(np.concatenate([held, new]), False)
        yield from done(held, True)

    return lean(run)


def _across(lanes: int, least: int, most: int, across: int = 0) -> Callable:
    """Links between the blocks x and y of a list."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = (np.frombuffer(v, np.int64).reshape(-1, 1 + lanes) for v in (x, y))
                f, g = (np.ascontiguousarray(v[:, 1:]).view(np.uint64) for v in (x, y))
                hits = [np.flatnonzero(_linked_pairs(np.broadcast_to(row, g.shape), g, least, most)) for row in f]
                if sum(map(len, hits)) > DENSE * (len(x) + len(y)):
                    yield _links(*map(np.array, _forest(np.concatenate([x[:, 0], y[:, 0]]), np.concatenate([f, g]), most)), across or 1)
                else:
                    yield _links(np.repeat(x[:, 0], [len(h) for h in hits]), y[np.concatenate(hits), 0], across or 1)

    return lean(run)


def block_pairs(blocks: DataFrame) -> DataFrame:
    """x, y: the blocks (list, block) of a list, paired by number, each pair dealt out on its own."""
    numbered = blocks.select("list", F.xxhash64("block").alias("no"), "block")
    nos = numbered.select("list", "no")
    pairs = nos.withColumnRenamed("no", "x_no").join(nos.withColumnRenamed("no", "y_no"), "list").where("x_no < y_no")
    for c in "xy":
        pairs = pairs.join(numbered.select("list", F.col("no").alias(f"{c}_no"), F.col("block").alias(c)), ["list", f"{c}_no"])
    return pairs.repartition(int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "list", "x_no", "y_no").select("x", "y")


def linked(points: DataFrame, tuples: list[tuple[int, ...]], lanes: int, least: int, most: int, across: int = 0) -> DataFrame:
    """Links a < b among distinct points (node, f0, ...): all, or in dense lists a spanning forest of them.

    across: how many lists a linked pair shares at least; short lists then only count, and node must be the fingerprint. 0: lists decide.
    """
    cols = ["key", "node", *(f"f{i}" for i in range(lanes))]
    posted = points.mapInArrow(_postings(tuples, lanes), ", ".join(f"{c} long" for c in cols))
    found = kept(posted.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_tally(lanes, least, most, across), _LINK), "links")
    blocks, pairs = found.where("block is not null").select("list", "block"), found.where("block is null").select("a", "b", "n")
    if not blocks.isEmpty():
        pairs = pairs.union(block_pairs(blocks).mapInArrow(_across(lanes, least, most, across), _LINK).select("a", "b", "n"))
    if not across:
        return pairs.select("a", "b").distinct()
    pairs = pairs.groupBy("a", "b").agg(F.sum("n").alias("n")).where(F.col("n") >= across)
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b")


def simhash_groups(docs: DataFrame, words: int = 3, most: int = 3) -> DataFrame:
    """doc_id, _id, _th, f0, component_id of `identified` documents: fingerprints link at `most` (0 to 3) or fewer differing bits.

    component_id is the smallest doc_id reachable; null only if no row of the component has one.
    """
    f = kept(fingerprints(docs, words), "fingerprints")
    distinct = f.groupBy(F.col("f0").alias("node")).agg(F.min("doc_id").alias("low"))
    points = distinct.select("node", F.col("node").alias("f0"))
    groups = components(linked(points, tuples_of(4, 8), 1, 8 - most, most, comb(8 - most, 4)))
    named = distinct.join(groups, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = kept(named.join(lowest, "root").select("node", "component_id"), "components")
    return f.join(sided(named), f.f0 == named.node).drop("node")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    text_batches(spark)
    g = simhash_groups(identified(documents(spark, sf_dir)))
    return g.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")


WIDE, TABLES, WIDE_BITS = 4, 48, 56


#: Shingles that this many documents of about SAMPLED, or of one in SPARSEST if that is more, share come last in the order of shingles; the order changes cost, not results.
#: A sparser sample misses shingles of ever more documents, whose pairs meet for them.
FREQUENT, SAMPLED, SPARSEST, FREQUENT_ROWS = 4, 20_000, 10, 1_000_000
#: Postings taken at once; index postings of a shingle in a block.
CHUNK, CELL = 50_000, 2048


#: Bits of the parity bitmap of a set of shingles. Sets of LONG shingles or more have a second one as wide as they need: two of them may differ in half of PARITY and be similar, and more than half of these bits seldom differ.
PARITY, LONG = 1024, 1600


def parity_bits(h: np.ndarray, classes: int = PARITY) -> bytes:
    """A bit for each of the classes of hashes: whether their number is odd. Sets whose bitmaps differ in d bits differ in d elements or more."""
    return np.packbits(np.bincount((h % np.uint64(classes)).astype(np.int64), minlength=classes) & 1).tobytes()


def long_parity_bits(h: np.ndarray) -> bytes | None:
    """A bitmap of as many classes as h has elements, or up to twice as many (a power of two); none of a set below LONG."""
    return parity_bits(h, 1 << (len(h) - 1).bit_length()) if len(h) >= LONG else None


def differing_bits(x: bytes, y: bytes) -> int:
    """Of two bitmaps, the wider folded to the classes of the other (numbers of classes are powers of two)."""
    a, b = sorted((np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def _wide(words: int) -> Callable:
    """node, _id, fingerprint of the distinct shingles, their number and their parity bitmaps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)) for t in b.column("text").to_pylist()]
            f = np.array([fingerprint(h, WIDE) for h in sets], np.uint64).reshape(-1, WIDE).view(np.int64)
            cols = [b.column("_th"), b.column("_id"), *(pa.array(f[:, i]) for i in range(WIDE)), pa.array([len(h) for h in sets], pa.int64()), pa.array([parity_bits(h) for h in sets], pa.binary()), pa.array([long_parity_bits(h) for h in sets], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["node", "_id", *(f"f{i}" for i in range(WIDE)), "n", "bits", "more"])

    return lean(run)


def _sets(words: int) -> Callable:
    """node, shingles: the sorted distinct shingles as packed words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [np.unique(shingle_hashes(t, words)).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("node"), pa.array(sets, pa.binary())], ["node", "shingles"])

    return lean(run)


def _hashes_of(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column("text").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(shingle_hashes(t, words)).view(np.int64))], ["h"])

    return lean(run)


def _may_be_similar(similarity: float) -> Callable:
    """Pairs whose bitmaps don't rule the similarity out: at 0.8, sets of n and m elements differ in (n + m) / 9 at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint64).reshape(-1, PARITY // 64) for c in ("x", "y"))
            total = b.column("n").to_numpy() + b.column("m").to_numpy()
            keep = np.bitwise_count(x ^ y).sum(1, dtype=np.int64) <= (1 - similarity) / (1 + similarity) * total + 1e-6
            yield b.select(["a", "b", "n", "m"]).filter(pa.array(keep))

    return lean(run)


def _long_may_be_similar(similarity: float) -> Callable:
    """The same by the second bitmaps, of pairs in which both sets have one; others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            most = (1 - similarity) / (1 + similarity) * (b.column("n").to_numpy() + b.column("m").to_numpy()) + 1e-6
            keep = [x is None or y is None or differing_bits(x, y) <= k for x, y, k in zip(b.column("x").to_pylist(), b.column("y").to_pylist(), most)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


def _least_shared(n: np.ndarray | int, similarity: float) -> np.ndarray:
    return np.ceil(similarity * n - 1e-6)


def _ordered(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Distinct shingles, rare ones first."""
    often = np.zeros(len(h), np.int64)
    if len(h) and len(common):
        at = np.minimum(np.searchsorted(common, h), len(common) - 1)
        often = np.where(common[at] == h, counts[at], 0)
    return h[np.argsort(often, kind="stable")]


def _prefix_lengths(n: int, similarity: float) -> tuple[int, int]:
    """How many of the first shingles of a set meet a larger set's (as index), and a smaller one's.

    Sets of n <= m that are similar enough share t = s / (1 + s) (n + m) shingles at least, so one of the first n - t + 1 and m - t + 1; t is
    2 s / (1 + s) n or more, as m is n or more, and s m or more, as n is s m or more.
    """
    of_smaller = n - int(_least_shared(n, 2 * similarity / (1 + similarity))) + 1
    return (of_smaller, n - int(_least_shared(n, similarity)) + 1) if n else (1, 1)


def _indexed(common: np.ndarray, counts: np.ndarray, words: int, similarity: float) -> Callable:
    """key: the shingles that index postings of texts are under."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [_ordered(np.unique(shingle_hashes(t, words)), common, counts) for t in b.column("text").to_pylist()]
            keys = [h[: _prefix_lengths(len(h), similarity)[0]] for h in own]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64))], ["key"])

    return lean(run)


def _prefixes(common: np.ndarray, counts: np.ndarray, hot: np.ndarray, n_hot: np.ndarray, words: int, similarity: float) -> Callable:
    """Postings of the first shingles of each set, rare ones first. Under hot shingles index postings are in one block by a hash of the node, all postings in each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, sizes, lengths = [], [], []
            for t in b.column("text").to_pylist():
                h = _ordered(np.unique(shingle_hashes(t, words)), common, counts)
                index, every = _prefix_lengths(len(h), similarity)
                keys.append(h[:every] if len(h) else np.zeros(1, np.uint64))
                sizes.append(len(h))
                lengths.append(index)
            if not keys:
                continue
            m = [len(k) for k in keys]
            key, place = np.concatenate(keys).view(np.int64), np.concatenate([np.arange(k) for k in m])
            n_blocks = np.ones(len(key), np.int64)
            if len(hot):
                at = np.minimum(np.searchsorted(hot, key), len(hot) - 1)
                n_blocks = np.where(hot[at] == key, n_hot[at], 1)
            node = np.repeat(b.column("node").to_numpy(), m)
            cols = [key, np.repeat(b.column("comp").to_numpy(), m), node, np.repeat(np.array(sizes, np.int64), m), place]
            own = ((node.view(np.uint64) >> np.uint64(17)) % n_blocks.astype(np.uint64)).astype(np.int64)
            block = np.arange(n_blocks.sum()) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
            index = np.repeat(place < np.repeat(np.array(lengths), m), n_blocks) & (np.repeat(own, n_blocks) == block)
            cols = [np.repeat(c, n_blocks) for c in cols] + [block, index.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], _POSTING)

    return lean(run)


_POSTING = ["key", "comp", "node", "n", "place", "block", "indexed"]


def _crossing(similarity: float) -> Callable:
    """Pairs of different groups in the cells (key, block) of sorted postings, an indexed one with one of a set as large or larger, unless sizes or places rule them out.

    Most of a large cell is often one group: only the postings outside of it are gone through, each compared with the others, or, if it
    isn't indexed itself, with the indexed ones.
    """

    def possible(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        n, m = x[:, 3], y[:, 3]
        shared = np.minimum(n - x[:, 4], m - y[:, 4])
        hit = (x[:, 1] != y[:, 1]) & ((x[:, 6] > 0) & (n <= m) | (y[:, 6] > 0) & (m <= n)) & (np.minimum(n, m) >= similarity * np.maximum(n, m) - 1e-6)
        return hit & (shared >= similarity / (1 + similarity) * (n + m) - 1e-6)

    def found(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        same = lambda r: (r[1:, [0, 5]] == r[:-1, [0, 5]]).all(1)
        starts = np.flatnonzero(np.append(True, ~same(rows)))
        sizes = np.diff(np.append(starts, len(rows)))
        mixed = rows[starts, 1] != rows[starts + sizes - 1, 1]  # sorted by group
        mixed &= np.add.reduceat(rows[:, 6], starts) > 0
        for s, n in zip(starts[mixed & (sizes > 64)].tolist(), sizes[mixed & (sizes > 64)].tolist()):
            cell = rows[s : s + n]
            _, of, count = np.unique(cell[:, 1], return_inverse=True, return_counts=True)
            largest = of == np.argmax(count)
            a, b = [], []
            inside, outside = cell[largest], cell[~largest]
            to, at = inside[inside[:, 6] > 0], np.flatnonzero(outside[:, 6])
            for k, row in enumerate(outside):
                others = np.concatenate([inside, outside[k + 1 :]] if row[6] else [to, outside[at[at > k]]])
                hit = others[possible(np.broadcast_to(row, others.shape), others), 2]
                a.append(np.full(len(hit), row[2]))
                b.append(hit)
            yield _links(np.concatenate(a), np.concatenate(b), 1).select(["a", "b"])
        rows = rows[np.repeat(mixed & (sizes <= 64), sizes)]
        at, first, second = np.arange(len(rows)), [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        label = np.cumsum(np.append(True, ~same(rows))) if len(rows) else at
        for d in range(1, 64):
            at = at[at + d < len(rows)]
            at = at[label[at] == label[at + d]]
            if not len(at):
                break
            hit = at[possible(rows[at], rows[at + d])]
            first.append(rows[hit, 2])
            second.append(rows[hit + d, 2])
        yield _links(np.concatenate(first), np.concatenate(second), 1).select(["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for b in batches:
            held.append(np.stack([c.to_numpy() for c in b.columns], 1))
            n += b.num_rows
            if n >= CHUNK:
                rows = np.concatenate(held)
                last = (rows[:, [0, 5]] == rows[-1, [0, 5]]).all(1)
                end = len(rows) - int(last.sum())
                if end:
                    yield from found(rows[:end])
                held, n = [rows[end:]], 0
        if held and sum(map(len, held)):
            yield from found(np.concatenate(held))

    return lean(run)


def _similar(least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = []
            for x, y in zip(b.column("x").to_pylist(), b.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both >= least * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return lean(run)


def near_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """_th, root: the group (smallest text hash in it) of every distinct text of `identified` documents that is linked to another."""
    fs = [f"f{i}" for i in range(WIDE)]
    made = docs.select("_id", "_th", "text").mapInArrow(_wide(words), "node long, _id long, " + ", ".join(f"{c} long" for c in fs) + ", n long, bits binary, more binary")
    made = kept(made, "wide")
    copies = kept(made.groupBy("node").agg(F.min("_id").alias("low"), F.count(F.lit(1)).alias("rows")).where("rows > 1").select("node", "low"), "copies")
    one = lambda rows: rows.join(sided(copies), "node", "left").where("low is null or _id = low").drop("low")  # noqa: E731  rows that repeat a document are still there
    more = kept(one(made.where("more is not null").select("node", "_id", "more")).select("node", "more").dropDuplicates(["node"]), "long-bitmaps")
    texts, maps = one(docs.select(F.col("_th").alias("node"), "_id", "text")).select("node", "text"), kept(one(made.select("node", "_id", "n", "bits")).select("node", "n", "bits").distinct(), "bitmaps")

    def verified(pairs: DataFrame, label: str) -> DataFrame:
        """Pairs of similar sets: bitmaps rule most of the others out, and the sets of the rest are made again from the texts."""
        x = maps.select(F.col("node").alias("a"), "n", F.col("bits").alias("x"))
        y = maps.select(F.col("node").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y"))
        maybe = kept(pairs.join(x, "a").join(y, "b").select("a", "b", "n", "m", "x", "y").mapInArrow(_may_be_similar(similarity), "a long, b long, n long, m long"), "maybe")
        both = maybe  # stored between, as two Python functions in one stage are two workers a core
        for c, n in ("ax", "by"):
            both = both.join(sided(more).select(F.col("node").alias(c), F.col("more").alias(n)), c, "left")
        close = kept(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_long_may_be_similar(similarity), "a long, b long"), "close")
        needed = kept(close.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "needed")
        own = kept(texts.join(sided(needed), "node", "left_semi").mapInArrow(_sets(words), "node long, shingles binary"), "shingles")
        x, y = (own.select(F.col("node").alias(c), F.col("shingles").alias(n)) for c, n in ("ax", "by"))
        out = kept(close.join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_similar(similarity), "a long, b long"), label)
        forget(maybe, close, needed, own)
        return out

    n_docs = made.count()
    width = max(2, ceil((log2(n_docs + 1) - 4) / 8))  # a list has some 16 unrelated postings at most
    near = kept(linked(made.select("node", *fs).dropDuplicates(["node"]), spread_tuples(TABLES, width, 8 * WIDE), WIDE, width, WIDE_BITS), "candidates")
    links = verified(near, "near-links")
    groups = kept(components(links).withColumnRenamed("root", "comp"), "near-groups")
    every = max(1, min(n_docs // SAMPLED, SPARSEST))
    sample = texts.where(F.pmod(F.xxhash64("node"), F.lit(every)) == 0).select("text")
    with shuffles_end(docs.sparkSession):  # asked when a frame is made
        often = sample.mapInArrow(_hashes_of(words), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= FREQUENT).orderBy(F.desc("n"), "h").limit(FREQUENT_ROWS).toArrow()
    common, counts = often["h"].to_numpy().view(np.uint64), often["n"].to_numpy()
    order = np.argsort(common)
    common, counts = common[order], counts[order]
    hot = sample.mapInArrow(_indexed(common, counts, words, similarity), "key long").groupBy("key").count().where(F.col("count") * every > CELL).orderBy(F.desc("count"), "key").limit(FREQUENT_ROWS).orderBy("key").toArrow()
    n_hot = -(-hot["count"].to_numpy() * every // CELL)
    points = texts.join(sided(groups), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"), "text")
    posted = points.mapInArrow(_prefixes(common, counts, hot["key"].to_numpy(), n_hot, words, similarity), ", ".join(f"{c} long" for c in _POSTING))
    crossing = posted.repartition("key", "block").sortWithinPartitions("key", "block", "comp", "node").mapInArrow(_crossing(similarity), "a long, b long")
    rest = kept(crossing.distinct(), "crossing")
    out = components(links.union(verified(rest, "rest-links")))
    forget(made, copies, maps, more, near, rest, groups)
    return out.select(F.col("node").alias("_th"), "root")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of docs (all columns, whatever they are called) without near copies: of each group the row with the smallest doc_id stays (null ids first), of equal rows one."""
    own = identified(docs)
    groups = near_groups(own, words, similarity)
    rows = own.groupBy("_th", "_id").agg(F.count(F.lit(1)).alias("n"))
    rows = rows.join(groups, "_th", "left").select("_th", "_id", "n", F.coalesce("root", "_th").alias("root"))
    first = rows.groupBy("root").agg(F.min("_id").alias("low"))
    stay = rows.join(first, "root").where("_id = low").groupBy("root", "_id").agg(F.min("_th").alias("_th"), F.min_by("n", "_th").alias("n"))
    stay = kept(stay.select("_id", "_th", "n"), "stay")
    out = wrapped(docs).join(sided(stay), ["_id", "_th"])
    once, often = out.where("n = 1"), out.where("n > 1").dropDuplicates(["_id", "_th"])
    return once.union(often).select("row.*")
