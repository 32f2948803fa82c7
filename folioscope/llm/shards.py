"""Sharding by fixed virtual slots, with DataFrame functions only.

A row's virtual slot is a hash of its doc_id modulo 4,096, for good. A map of slot to shard, a few thousand rows whatever the corpus,
says where slots live. `SlotMap` stores it as Parquet, a folder a version, with the bytes of each slot, and changes it only by loading
the last version, editing it and storing the next: `grow` gives a new shard its part of the slots from the fullest ones, and no
other slot moves; `rebalance` moves slots by their bytes from the heaviest shard to the lightest until they are within a tolerance.

The query keeps the law `key`: doc_id and the number of shards alone decide. A row's place within its shard (`slot`, gapless from
0) is a prefix sum over cells of virtual slot and a 16-fold split by content, plus its rank in its own cell, so that no
shard or slot is ranked as a whole. Null doc_ids share one virtual slot; null texts have no bytes; texts of any length count by their
bytes alone; equal rows take places of their own. An empty table gives no row.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import documents, kept, new_path

SLOTS, SHARDS, CELLS, ROW_BYTES = 4096, 40, 16, 16


def grown(owner: list[int]) -> list[int]:
    """The map with one more shard: it takes slots (lowest first) from the shard that has most (lowest first) until it has its part."""
    new = max(owner) + 1
    out, own = list(owner), [[] for _ in range(new)]
    for slot in range(len(owner) - 1, -1, -1):
        own[owner[slot]].append(slot)
    most = [(-len(s), i) for i, s in enumerate(own)]
    heapq.heapify(most)
    for _ in range(len(owner) // (new + 1)):
        n, i = most[0]
        out[own[i].pop()] = new
        heapq.heapreplace(most, (n + 1, i))
    return out


def slot_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map that one shard becomes when shards are added one by one."""
    owner = [0] * slots
    for _ in range(shards - 1):
        owner = grown(owner)
    return owner


def rebalanced(owner: list[int], sizes: list[int], tolerance: float = 0.05) -> list[int]:
    """The map edited until the heaviest shard is within tolerance of the mean, or no single slot helps."""
    out, load = list(owner), [0] * (max(owner) + 1)
    for slot, shard in enumerate(out):
        load[shard] += sizes[slot]
    mean = sum(load) / len(load)
    while max(load) > mean * (1 + tolerance):
        heavy, light = load.index(max(load)), load.index(min(load))
        room = load[heavy] - load[light]
        fit = [s for s, shard in enumerate(out) if shard == heavy and 0 < sizes[s] < room]
        if not fit:
            break
        move = min(fit, key=lambda s: abs(sizes[s] - room / 2))
        out[move] = light
        load[heavy] -= sizes[move]
        load[light] += sizes[move]
    return out


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, cell of each row."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    slot = F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")
    return rows.withColumns({"virtual_slot": slot, "cell": F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(CELLS)).cast("int")})


class SlotMap:
    """Versions of a map in a folder: version, virtual_slot, shard, slot_bytes. All have SLOTS rows, so they are edited on the driver."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def versions(self) -> DataFrame:
        return self.spark.read.schema("virtual_slot int, shard int, slot_bytes long, version int").parquet(self.folder)

    def _store(self, version: int, owner: list[int], sizes: list[int]) -> int:
        rows = [(slot, shard, size) for slot, (shard, size) in enumerate(zip(owner, sizes))]
        table = self.spark.createDataFrame(rows, "virtual_slot int, shard int, slot_bytes long").coalesce(1)
        table.write.mode("errorifexists").parquet(f"{self.folder}/version={version}")  # of two edits of one version, one fails
        return version

    def create(self, owner: list[int], sizes: list[int] | None = None) -> int:
        return self._store(1, owner, sizes or [0] * len(owner))

    def load(self, version: int | None = None) -> tuple[int, list[int], list[int]]:
        """Number, owners and bytes of a version, or of the last."""
        rows = self.versions() if version is None else self.versions().where(F.col("version") == version)
        rows = rows.orderBy("version", "virtual_slot").collect()
        last = rows[-1]["version"]
        own = [r for r in rows if r["version"] == last]
        return last, [r["shard"] for r in own], [r["slot_bytes"] for r in own]

    def _edit(self, change, sizes: list[int] | None = None) -> int:
        version, owner, held = self.load()
        return self._store(version + 1, change(owner, sizes or held), sizes or held)

    def grow(self) -> int:
        """Stores a version with one more shard."""
        return self._edit(lambda owner, sizes: grown(owner))

    def rebalance(self, tolerance: float = 0.05, sizes: list[int] | None = None) -> int:
        """Stores a version with shards of nearly equal bytes, by given bytes of slots or those stored."""
        return self._edit(lambda owner, sizes: rebalanced(owner, sizes, tolerance), sizes)


def slot_sizes(cells: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes of every slot (one row a slot)."""
    held = {r["virtual_slot"]: r["b"] for r in cells.groupBy("virtual_slot").agg(F.sum("bytes").alias("b")).collect()}
    return [held.get(slot, 0) for slot in range(slots)]


def sharded(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """One row a document: size, checksum, shard, place in the shard, and the shard with one shard more."""
    spark = docs.sparkSession
    rows = kept(slotted(docs), "slotted")
    cells = kept(rows.groupBy("virtual_slot", "cell").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "cells")
    store = SlotMap(spark, new_path(spark, "slot-map"))
    first = store.create(slot_map(shards), slot_sizes(cells))
    more = store.grow()
    now, then = (store.versions().where(F.col("version") == v) for v in (first, more))
    # The map has SLOTS rows and cells SLOTS * CELLS at most, whatever the corpus: both may be broadcast.
    here = now.drop("version").join(F.broadcast(then.select("virtual_slot", F.col("shard").alias("grown_shard"))), "virtual_slot")
    placed = cells.join(F.broadcast(here), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "cell").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("virtual_slot", "cell", "shard", "grown_shard", "slot_bytes", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("virtual_slot", "cell").orderBy("doc_id", "size", "text_crc32"))
    ranked = rows.withColumn("rank", rank).join(F.broadcast(placed), ["virtual_slot", "cell"])
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("rank") - 1).cast("long").alias("slot"),
        "grown_shard", "virtual_slot", "slot_bytes",
    )


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir))
