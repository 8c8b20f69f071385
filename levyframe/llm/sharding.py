"""Sharding by a two-pass external shuffle.

Pass one scatters whole records, texts and all, uniformly into memory-sized buckets with seeded hashes; pass two shuffles
each bucket by Fisher-Yates in one task and writes it, in that order, as a file of its shard's folder.  A record's place
follows from its bucket's start, which is the sum of the bucket sizes before it in its shard.

The law is ``key``: a record's shard follows from its key and the number of shards alone, by jump consistent hashing,
so one more shard takes records only into itself.  A shard has as many buckets as it takes to keep each near
``bucket_bytes``, a share of an executor's memory, counted from that shard's own bytes; the bucket follows from a hash of the whole record, so many records of one key (also a null one)
spread over the buckets of their shard.  Within a bucket records are put in the order of that hash before they are
shuffled with a seed of (seed, shard, bucket): a task that runs again gives the same places.  Rows that are equal in all
columns share a bucket.

Defined cases: null keys are one key; repeated records each get a place; a null text has no bytes and the checksum 0;
an empty table gives an empty one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.llm.sizing import share_of_executor
from levyframe.storage import fresh_path

SHARDS = 40
BUCKET_SHARE = 48  # a bucket is this part of an executor's heap: a task takes some six times as much
LEAST_BUCKET = 16 << 20
RECORD_BYTES = 64  # what a record takes beside its own columns
_PLACES = ("shard", "grown_shard", "bucket", "bucket_slot", "slot")


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach, 2014) of 64-bit keys."""
    state = keys.astype(np.uint64).copy()
    shard = np.zeros(len(state), np.int64)
    following = np.zeros(len(state), np.int64)
    live = np.arange(len(state))
    while len(live):
        shard[live] = following[live]
        state[live] = state[live] * np.uint64(2862933555777941757) + np.uint64(1)
        step = (state[live] >> np.uint64(33)).astype(np.float64) + 1.0
        following[live] = ((shard[live] + 1) * (float(1 << 31) / step)).astype(np.int64)
        live = live[following[live] < shards]
    return shard.astype(np.int32)


def _shard(keys, shards: int):
    @F.pandas_udf("int")
    def jump(values: pd.Series) -> pd.Series:
        return pd.Series(jump_hash(values.to_numpy(np.int64).view(np.uint64), shards))

    return jump(keys)


def shuffled_shards(
    df: DataFrame, key: str, size: str, shards: int = SHARDS, seed: int = 7, bucket_bytes: int | None = None
) -> DataFrame:
    """All columns of ``df`` with ``shard``, ``grown_shard`` (with one shard more), ``bucket`` and ``slot``.

    ``size`` names a column of bytes that tells how many buckets a shard must have.  The written records are returned
    in no order; ``slot`` counts each shard's records from 0 without a gap.
    """
    if clash := set(df.columns) & {*_PLACES, "row_order"}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    bucket_bytes = bucket_bytes or share_of_executor(df.sparkSession, BUCKET_SHARE, LEAST_BUCKET)
    hashed = F.xxhash64(F.lit(seed), F.col(key))
    held = df.select(_shard(hashed, shards).alias("shard"), (F.coalesce(F.col(size), F.lit(0)) + RECORD_BYTES).alias("held"))
    totals = {r["shard"]: int(r["held"]) for r in held.groupBy("shard").agg(F.sum("held").alias("held")).collect()}
    # the driver sees one total for each shard
    buckets = F.array(*(F.lit(totals.get(k, 0) // bucket_bytes + 1) for k in range(shards)))
    scattered = df.select(
        "*",
        _shard(hashed, shards).alias("shard"),
        _shard(hashed, shards + 1).alias("grown_shard"),
        F.xxhash64(F.lit(seed + 1), *(F.col(f"`{c}`") for c in df.columns)).alias("row_order"),
    ).withColumn("bucket", F.pmod("row_order", F.get(buckets, F.col("shard"))).cast("int"))
    names = [*df.columns, "shard", "grown_shard", "bucket"]
    fields = {f.name: f for f in scattered.schema.fields}
    schema = T.StructType([*(fields[c] for c in names), T.StructField("bucket_slot", T.LongType())])

    def shuffle(table: pa.Table) -> pa.Table:
        shard, bucket = table["shard"][0].as_py(), table["bucket"][0].as_py()
        order = np.argsort(table["row_order"].to_numpy(), kind="stable")
        np.random.default_rng((seed, shard, bucket)).shuffle(order)  # Fisher-Yates
        places = pa.array(np.arange(len(order)), pa.int64())
        return table.take(pa.array(order)).select(names).append_column("bucket_slot", places)

    shuffled = scattered.groupBy("shard", "bucket").applyInArrow(shuffle, schema)
    path = fresh_path(df.sparkSession, "shards")
    _write(shuffled, path, "bucket_slot")
    written = df.sparkSession.read.schema(shuffled.schema).parquet(path)
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("rows"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start"))
    # one row for each bucket_bytes of records; without the hint the records would be shuffled once more
    return written.join(F.broadcast(starts), ["shard", "bucket"]).select(
        *(F.col(f"`{c}`") for c in names), (F.col("start") + F.col("bucket_slot")).alias("slot")
    )


def _write(records: DataFrame, path: str, order: str) -> None:
    records.sortWithinPartitions("shard", "bucket", order).write.partitionBy("shard", "bucket").parquet(path)


def write_shards(placed: DataFrame, path: str) -> None:
    """Write placed records as one folder per shard and bucket; each file holds one shuffled bucket's records in order."""
    _write(placed.repartition("shard", "bucket"), path, "slot")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = 7, bucket_bytes: int | None = None) -> DataFrame:
    """Sizes, checksums and places of all documents, told from the shards that were written with all their columns."""
    if "text_bytes" in docs.columns:
        raise ValueError("a column text_bytes is there already")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long")
    placed = shuffled_shards(docs.withColumn("text_bytes", size), "doc_id", "text_bytes", shards, seed, bucket_bytes)
    return placed.select(
        "doc_id", size.alias("size"), F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard",
    )
