"""Helpers that the corpus operators share: scratch tables, size-checked joins, row identity.

Row identity. A document is the pair (doc_id, text): `identified` adds `_id` (doc_id, nulls as the
smallest long, so they sort first and join) and `_th` (XXH64 of the text). Rows that repeat both are
one document given several times; every operator returns one row for each input row.
"""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.shipping import ship
from folioscope.sources.scratch import shuffles_end

#: Null doc_ids are carried as this value.
NULL_ID = -(2**63)
#: A stored side of a join is broadcast up to this many bytes in memory; larger sides are shuffled.
BROADCAST_BYTES = 128 << 20
#: Of each row of a broadcast table, beside its values.
ROW_OVERHEAD = 32


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a temporary one in local mode."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at is None:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        at = held.get() if held.isDefined() else None
    if at is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = tempfile.mkdtemp(prefix="folioscope-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return at.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, label: str, codec: str = "zstd", by: str | None = None) -> DataFrame:
    """df written as Parquet to the shared folder (a folder for each value of `by`, the last column) and read from there: cuts lineage and outlives executors."""
    path = new_path(df.sparkSession, label)
    out = df.write.option("compression", codec)
    with shuffles_end(df.sparkSession):
        (out.partitionBy(by) if by else out).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def stored_bytes(df: DataFrame) -> int:
    fs, at = _file_system(df.sparkSession, df.stored_at)
    return fs.getContentSummary(at).getLength()


def forget(*frames: DataFrame) -> None:
    """Deletes the files of kept frames that nothing reads any more."""
    for df in frames:
        fs, at = _file_system(df.sparkSession, df.stored_at)
        fs.delete(at, True)


_FLAT = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8}


def _width(c: Column, kind: T.DataType) -> Column:
    """Bytes of a value in memory."""
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(kind, T.StructType):
        return F.lit(8 + sum(8 for _ in kind.fields))
    if isinstance(kind, T.ArrayType):
        n = F.coalesce(F.size(c), F.lit(0))
        if isinstance(kind.elementType, tuple(_FLAT)):  # values side by side, with a bit each for nulls, in words of 8 bytes
            return 24 + F.ceil(n / 64) * 8 + F.ceil(n * _FLAT[type(kind.elementType)] / 8) * 8
        fixed = 8 + 8 * len(kind.elementType.fields) if isinstance(kind.elementType, T.StructType) else 8
        return n * (fixed + 8) + 16
    return F.lit(8)


def held_bytes(df: DataFrame) -> int:
    """Bytes of a kept frame's rows in memory."""
    row = F.lit(ROW_OVERHEAD)
    for f in df.schema.fields:
        row = row + _width(F.col(f.name), f.dataType)
    return df.agg(F.sum(row.cast("long"))).first()[0] or 0


def sided(side: DataFrame, limit: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """A kept frame, or one narrowed from the kept frame `of`, marked for broadcast if its rows take no more than the limit in memory; else Spark shuffles it.

    Files above the limit aren't read for this; those below are, by an aggregate.
    """
    limit = BROADCAST_BYTES if limit is None else limit
    return F.broadcast(side) if stored_bytes(side if of is None else of) <= limit and held_bytes(side) <= limit else side


def identity() -> dict[str, Column]:
    text = F.coalesce(F.col("text"), F.lit(""))
    return {"_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_th": F.xxhash64(text)}


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text, _id, _th of documents; null texts become empty, other columns are left out."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *(c.alias(n) for n, c in identity().items()))


def wrapped(docs: DataFrame) -> DataFrame:
    """row (a struct of all columns), _id, _th: whatever the columns of docs are called, none clashes with the operators' own."""
    return docs.select(F.struct("*").alias("row"), *(c.alias(n) for n, c in identity().items()))


def unused(name: str, columns: list[str]) -> str:
    """The name, with underscores after it until it is none of the columns (whatever their case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_batches(spark: SparkSession, rows: int = 500) -> None:
    """Makes the package known to Python workers, and Arrow batches of so many rows, so that a batch of whole texts stays small."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def give_back() -> None:
    """Returns memory that this process has freed to the system: Arrow's pool and the C library keep it else."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def lean(run: Callable, end: Callable[[], None] | None = None) -> Callable:
    """A function of batches that, after `end`, gives back at the end of its task what it used: Spark keeps Python workers for later stages."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            if end:
                end()
            give_back()

    return own


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
