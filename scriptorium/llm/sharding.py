"""Sharding by fixed virtual slots.

A record's virtual slot is a hash of (doc_id, text) modulo SLOTS and never changes. Bytes are added up per
slot, and a versioned map gives each slot a shard. Only the map is edited: the first version places the
slots by falling size on the lightest shard; a rebalance for another shard count moves slots only from
shards above the new mean, each to the lightest, and is a new version of the same table.

The law is `bytes`: shards are near equal in bytes. SLOTS bounds the map and all that reaches the driver,
however large the input. A record's place in its shard is its slot's offset (records in the shard's slots
before it) plus its rank in the virtual slot, so no window spans a shard.

Defined cases. A null text has no bytes (size 8), its CRC is that of no bytes. A null doc_id is hashed like a value.
Equal rows land in one virtual slot and get different places. Equal texts with other ids are spread like any others:
the law is on bytes, and groups of copies do not fill a shard. An empty table gives an empty table and a map
of empty slots. Other columns are ignored; the key columns may be named by the caller.
"""

from __future__ import annotations

import heapq
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import scratch_dir

SHARDS, SLOTS, OVERHEAD = 24, 16384, 8
MAP = "version int, vslot int, shard int, bytes long, n long"


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, vslot of each row."""
    data = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(data) + OVERHEAD).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(slots)).cast("int").alias("vslot")
    )


def slot_bytes(rows: DataFrame, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and records of each virtual slot, at most SLOTS numbers each."""
    size, n = np.zeros(slots, np.int64), np.zeros(slots, np.int64)
    for r in rows.groupBy("vslot").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect():
        size[r.vslot], n[r.vslot] = r["size"], r["n"]
    return size, n


def place(size: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each slot: slots by falling size, each on the shard that has least so far."""
    heap = [(0, s) for s in range(shards)]
    out = np.zeros(len(size), np.int32)
    for k in np.lexsort((np.arange(len(size)), -size)).tolist():
        have, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (have + int(size[k]), s))
    return out


def rebalance(shard: np.ndarray, size: np.ndarray, shards: int) -> np.ndarray:
    """The map for another shard count with few moves. Slots of shards that go, and slots taken from shards
    above the new mean, largest fit first, go to the lightest shard; all others stay."""
    out = shard.astype(np.int32).copy()
    mean = size.sum() / shards
    have = np.bincount(out[out < shards], size[out < shards], shards) if len(out) else np.zeros(shards)
    moving = np.flatnonzero(out >= shards).tolist()
    for s in range(shards):
        own = np.flatnonzero(out == s)
        for k in own[np.lexsort((own, -size[own]))].tolist():
            if have[s] - size[k] >= mean:
                have[s] -= size[k]
                moving.append(k)
    heap = [(have[s], s) for s in range(shards)]
    heapq.heapify(heap)
    for k in sorted(moving, key=lambda k: (-size[k], k)):
        h, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (h + size[k], s))
    return out


def slot_map(spark: SparkSession, version: int, shard: np.ndarray, size: np.ndarray, n: np.ndarray) -> DataFrame:
    """One version of the map as a table; versions are appended, never changed."""
    return spark.createDataFrame([(version, k, int(shard[k]), int(size[k]), int(n[k])) for k in range(len(shard))], MAP)


def assign(rows: DataFrame, map_: DataFrame, version: int) -> DataFrame:
    """rows with shard and slot, the record's place in its shard, gapless from 0."""
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    places = map_.where(F.col("version") == version).select("vslot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    rank = F.row_number().over(Window.partitionBy("vslot").orderBy("doc_id", "text_crc32", "size")) - 1
    # The map has at most SLOTS rows.
    return rows.withColumn("rank", rank).join(F.broadcast(places), "vslot").select("doc_id", "size", "text_crc32", "vslot", "shard", (F.col("offset") + F.col("rank")).cast("long").alias("slot"))


class SlotMap:
    """The stored map: a folder below path for each version, written once."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def add(self, version: int, shard: np.ndarray, size: np.ndarray, n: np.ndarray) -> None:
        """Writes a version; one that is there already is an error."""
        slot_map(self.spark, version, shard, size, n).drop("version").coalesce(1).write.parquet(f"{self.path}/version={version}")

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}").withColumn("version", F.lit(version))

    def rebalanced(self, version: int, shards: int) -> int:
        """Edits a version for another shard count; the number of the version after it."""
        rows = self.read(version).orderBy("vslot").collect()  # as many as there are slots
        shard, size, n = (np.array([r[c] for r in rows]) for c in ("shard", "bytes", "n"))
        self.add(version + 1, rebalance(shard, size, shards), size, n)
        return version + 1


def shard_by_slots(docs: DataFrame, path: str, shards: int = SHARDS, slots: int = SLOTS) -> tuple[DataFrame, SlotMap]:
    """(rows with their shard and slot, the map stored at path with version 1)."""
    rows = sized(docs, slots)
    size, n = slot_bytes(rows, slots)
    stored = SlotMap(docs.sparkSession, path)
    stored.add(1, place(size, shards), size, n)
    return assign(rows, stored.read(1), 1), stored


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = shard_by_slots(spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{scratch_dir(spark)}/slots-{uuid.uuid4().hex[:12]}")
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
