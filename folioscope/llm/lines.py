"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; keys below 40 code points never count.
`LineRuns` holds the keys seen so far in runs: tables of (128-bit key hash, documents, largest doc_id), bucketed and sorted by the hash,
in which each key stands once. `add` aggregates a batch with map-side combine and merge-joins it with the runs: keys that none of them
has become a run of level 0, what is known already only adds to counts. `fanout` runs of a level are merged into one of the next. As
buckets meet, neither joins nor merges shuffle the runs again. `totals` joins each run with the counts added later. Texts aren't
shuffled to find repeats: only hashes are.

A key found in at least 5 documents (distinct doc_ids; null is one) loses its lines in all but the largest doc_id that holds it (null is
the smallest). Null and empty texts are one empty line; very long texts and lines are treated whole. Rows that repeat a doc_id are one
document; all rows of the largest doc_id keep the line. Other columns pass through, whatever they are called. An
empty table gives no row.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.common import documents, forget, identity, kept, new_path, sided, wrapped

STRIP = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_DOCS, BATCHES, FANOUT = 40, 5, 4, 2
KEY = ["h1", "h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(STRIP)), UPPER, LOWER)


def _hash(key: Column) -> Column:
    """128 bits: XXH64 under two seeds."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


def line_hashes(docs: DataFrame, least_length: int = LEAST_LENGTH, batches: int = BATCHES) -> DataFrame:
    """h1, h2, _id, _th, batch: the distinct long keys of each row."""
    keys = F.filter(F.transform(_lines(F.col("text")), _key), lambda k: F.length(k) >= least_length)
    found = docs.select(*(c.alias(n) for n, c in identity().items()), F.explode(F.array_distinct(F.transform(keys, _hash))).alias("h"))
    return found.select("h.h1", "h.h2", "_id", "_th", F.pmod(F.xxhash64("_id"), F.lit(batches)).cast("int").alias("batch"))


def once_a_document(hashes: DataFrame, docs: DataFrame) -> DataFrame:
    """h1, h2, _id, batch: of doc_ids with several rows, each key once; all rows of a doc_id are in one batch."""
    rows = hashes.select(*KEY, "_id", "batch")
    several = kept(docs.select(identity()["_id"].alias("_id")).groupBy("_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_id"), "repeated-ids")
    if several.isEmpty():
        return rows
    side = sided(several)
    return rows.join(side, "_id", "left_anti").union(rows.join(side, "_id", "left_semi").distinct().select("_id", *KEY, "batch")).select(*KEY, "_id", "batch")


class LineRuns:
    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = []
        self.tables: list[DataFrame] = []

    def _stored(self, rows: DataFrame, label: str) -> DataFrame:
        name = f"line_run_{uuid.uuid4().hex[:12]}"
        path = new_path(self.spark, label)
        rows.write.format("parquet").option("path", path).option("compression", "zstd").bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        out = self.spark.table(name)
        out.stored_at, out.stored_as = path, name
        self.tables.append(out)
        return out

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the rows (h1, h2, _id) of a batch; returns its keys that no earlier batch had."""
        new = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"), F.max("_id").alias("last")).withColumn("known", F.lit(False))
        for level in self.levels:
            for run in level:
                new = new.join(run.select(*KEY, F.lit(True).alias("there")), KEY, "left").select(*KEY, "docs", "last", (F.col("known") | F.col("there").isNotNull()).alias("known"))
        fresh = self._stored(new, "batch").where("NOT known").select(*KEY, "docs", "last")
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(fresh)
        level = 0
        while len(self.levels[level]) >= self.fanout:
            merged, *rest = self.levels[level]
            for run in rest:
                other = run.select(*KEY, F.col("docs").alias("docs2"), F.col("last").alias("last2"))
                merged = merged.join(other, KEY, "full_outer").select(*KEY, F.coalesce("docs", "docs2").alias("docs"), F.coalesce("last", "last2").alias("last"))
            if len(self.levels) == level + 1:
                self.levels.append([])
            self.levels[level + 1].append(self._stored(merged, f"run-{level + 1}"))
            self.levels[level] = []
            level += 1
        return fresh.select(*KEY)

    def totals(self, least: int = 1) -> DataFrame:
        """h1, h2, docs, last of every key found in so many documents."""
        known = [t.where("known").select(*KEY, "docs", "last") for t in self.tables if "known" in t.columns]
        out = None
        if known:
            more = known[0]
            for k in known[1:]:
                more = more.union(k)
            more = kept(more.groupBy(*KEY).agg(F.sum("docs").alias("more"), F.max("last").alias("later")), "added")
            for run in (r for level in self.levels for r in level):
                own = run.join(sided(more), KEY, "left").select(*KEY, (F.col("docs") + F.coalesce("more", F.lit(0))).alias("docs"), F.greatest("last", "later").alias("last"))
                own = own.where(F.col("docs") >= least)
                out = own if out is None else out.union(own)
        return out

    def forget(self) -> None:
        for t in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t.stored_as}")
        forget(*self.tables)


def _cut(docs: DataFrame, least_length: int, least_docs: int, batches: int) -> DataFrame:
    """row (docs' columns as a struct), left (the remaining lines), n_lines, n_dropped."""
    hashes = kept(line_hashes(docs, least_length, batches), "line-hashes", by="batch")
    single = once_a_document(hashes, docs)
    runs = LineRuns(docs.sparkSession)
    for b in range(batches):
        runs.add(single.where(F.col("batch") == b))
    often = kept(runs.totals(least_docs).select(*KEY, "last"), "repeated-lines")
    runs.forget()
    gone = hashes.join(sided(often), KEY).where("_id <> last").groupBy("_id", "_th").agg(F.collect_set(F.struct(*KEY)).alias("gone"))
    gone = kept(gone, "gone")
    forget(hashes)
    text = F.coalesce(F.col("row.text"), F.lit(""))
    stays = F.filter(_lines(text), lambda x: ~((F.length(_key(x)) >= least_length) & F.array_contains(F.col("gone"), _hash(_key(x)))))
    both = wrapped(docs).join(sided(gone), ["_id", "_th"], "left").select("row", F.when(F.col("gone").isNotNull(), stays).alias("stays"))
    same, n = F.col("stays").isNull(), F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    left = F.when(same, text).otherwise(F.array_join("stays", "\n"))
    dropped = F.when(same, F.lit(0)).otherwise(n - F.size("stays"))
    return both.select("row", left.alias("left"), n.cast("long").alias("n_lines"), dropped.cast("long").alias("n_dropped"))


def cleaned(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs (all columns, whatever they are called) with the remaining lines as text."""
    return _cut(docs, least_length, least_docs, batches).select(*(F.col("left" if c == "text" else f"row.`{c}`").alias(c) for c in docs.columns))


def without_repeated_lines(docs: DataFrame, least_length: int = LEAST_LENGTH, least_docs: int = LEAST_DOCS, batches: int = BATCHES) -> DataFrame:
    """docs with the remaining lines as text, and n_lines, n_dropped (which replace columns of these names)."""
    own = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    return _cut(docs, least_length, least_docs, batches).select(*(F.col("left" if c == "text" else f"row.`{c}`").alias(c) for c in own), "n_lines", "n_dropped")


def op4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = f"""
WITH lines AS (
  SELECT r, doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key
  FROM (SELECT r, doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS i
        FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) p) l
), often AS (
  SELECT key, max(coalesce(doc_id, {-(2**63)})) AS last FROM lines WHERE length(key) >= {LEAST_LENGTH} GROUP BY key HAVING count(DISTINCT coalesce(doc_id, {-(2**63)})) >= {LEAST_DOCS}
), marked AS (
  SELECT l.r, l.doc_id, l.i, l.line, o.key IS NOT NULL AND coalesce(l.doc_id, {-(2**63)}) <> o.last AS gone FROM lines l LEFT JOIN often o ON l.key = o.key
)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""
