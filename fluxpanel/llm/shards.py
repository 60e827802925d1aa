"""Sharding (operator 5): jump consistent hashing.

A key's shard follows from the key and the number of shards alone, without a
ring table; when shards are appended, a key stays or moves to a new shard.

Plan: one scan that adds the shards and each row's number within its input
task and shard, written once; a small count per (task, shard), whose running
sums are the offsets; a join of the two.  The rows are never sorted or gathered
by shard, so one shard, key or source may hold any share of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, IntegerType, LongType, StructField, StructType

from .runtime import map_batches, materialise, named, plain, small_side

#: Shards of the production layout.
SHARDS = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of 64-bit keys."""
    state = keys.astype(np.uint64)
    bucket = np.full(len(state), -1, np.int64)
    reach = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        bucket[live] = reach[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = float(1 << 31) / ((state[live] >> np.uint64(33)).astype(np.float64) + 1.0)
        reach[live] = ((bucket[live] + 1) * step).astype(np.int64)
        live = live[reach[live] < shards]
    return bucket.astype(np.int32)


def _numbered(batches, shards: int):
    seen = np.zeros(shards, np.int64)
    task = TaskContext.get().partitionId()
    for batch in batches:
        key = batch.column(batch.schema.get_field_index("__key"))
        keys = np.asarray(key.fill_null(0), np.int64).view(np.uint64)
        shard, grown = jump(keys, shards), jump(keys, shards + 1)
        order = np.argsort(shard, kind="stable")
        sizes = np.bincount(shard, minlength=shards)
        rank = np.empty(len(shard), np.int64)
        rank[order] = np.arange(len(shard)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(seen, sizes)
        seen += sizes
        kept = [batch.column(k) for k, name in enumerate(batch.schema.names) if name != "__key"]
        names = [name for name in batch.schema.names if name != "__key"]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(shard), pa.array(rank), pa.array(grown), pa.array(np.full(len(shard), task, np.int32))],
            [*names, "shard", "slot", "grown_shard", "__task"],
        )


def jump_shards(df: DataFrame, key: str = "doc_id", shards: int = SHARDS) -> DataFrame:
    """`df` with shard, slot (0, 1, ... without gaps in each shard) and
    grown_shard (the shard if there were one more).

    Integer keys are used as they are, others by their 64-bit hash; a null key
    counts as 0.  Rows that share a key share its shard and get slots of their
    own.  Columns of these three names are replaced; an empty table stays empty."""
    df, named_own = plain(df, ("shard", "slot", "grown_shard"), (key,))
    own = df.columns
    kind = df.schema[key].dataType
    hashed = F.col(key).cast("long") if isinstance(kind, IntegralType) else F.when(F.col(key).isNotNull(), F.xxhash64(key))
    schema = StructType([df.schema[c] for c in own] + [StructField("shard", IntegerType()), StructField("slot", LongType()), StructField("grown_shard", IntegerType()), StructField("__task", IntegerType())])
    rows = materialise(map_batches(df.select(*own, hashed.alias("__key")), lambda b: _numbered(b, shards), schema))
    counts = materialise(rows.groupBy("shard", "__task").agg(F.count(F.lit(1)).alias("__n")))
    before = Window.partitionBy("shard").orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", "__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    placed = rows.join(small_side(offsets, counts.count()), ["shard", "__task"])
    return named(placed.select(*own, "shard", (F.col("slot") + F.col("__before")).alias("slot"), "grown_shard"), named_own)


def shard_digest(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document.
    A null text has size 1 and the checksum of an empty one."""
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return jump_shards(sized, shards=shards).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
