from __future__ import annotations

import zlib

import numpy as np
import pytest
from corpora import empty, odd, table, texts_of
from pyspark.sql import functions as F

from levyframe.llm import sharding
from levyframe.llm.queries import LLM_QUERIES
from levyframe.llm.sharding import jump_hash, shard_documents, shuffled_shards, write_shards


def test_one_more_shard_takes_rows_only_into_itself():
    keys = np.random.default_rng(1).integers(0, 2**63, 20_000).astype(np.uint64)
    for shards in (1, 2, 7, 40):
        before, after = jump_hash(keys, shards), jump_hash(keys, shards + 1)
        moved = before != after
        assert set(after[moved]) <= {shards} and before.min() >= 0 and before.max() < shards
        assert abs(moved.mean() - 1 / (shards + 1)) < 0.02


def check(rows, shards=40):
    slots: dict[int, list[int]] = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(0 <= s < shards for s in slots)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_query(spark):
    texts = texts_of(table(spark))
    rows = LLM_QUERIES["op7_shards"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    check(rows)
    for r in rows:
        data = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law) == (len(data) + 16, zlib.crc32(data), "key")
        assert r.grown_shard in (r.shard, 40)
    again = LLM_QUERIES["op7_shards"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_buckets_are_shuffled_whole(spark, tmp_path):
    df = spark.range(5000).select(F.col("id").alias("key"), F.lit(1000).alias("size"), F.lit("x").alias("other"))
    placed = shuffled_shards(df, "key", "size", shards=3, bucket_bytes=200_000)
    rows = placed.collect()
    check(rows, 3)
    assert len({(r.shard, r.bucket) for r in rows}) > 15 and sorted(r.key for r in rows) == list(range(5000))
    first = [r.key for r in sorted(rows, key=lambda r: r.slot) if r.shard == 0]
    assert abs(np.corrcoef(first, range(len(first)))[0, 1]) < 0.1
    write_shards(placed, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5000


def test_odd_rows(spark):
    rows = shard_documents(odd(spark)).collect()
    assert len(rows) == 15
    check(rows)
    assert {(r.size, r.text_crc32) for r in rows if r.doc_id in (4, 5)} == {(16, 0)}
    assert len({r.shard for r in rows if r.doc_id is None}) == 1
    assert shard_documents(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        shuffled_shards(odd(spark).withColumnRenamed("extra", "slot"), "doc_id", "slot")


def test_whole_documents_are_written(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "written")
    monkeypatch.setattr(sharding, "fresh_path", lambda spark, name: path, raising=False)
    docs = table(spark)
    rows = shard_documents(docs, shards=5, bucket_bytes=20_000).collect()
    check(rows, 5)
    written = spark.read.parquet(path)
    assert sorted((r.doc_id, r.text) for r in written.collect()) == sorted(texts_of(docs).items())
    assert set(docs.columns) <= set(written.columns)
    held = {}
    for r in written.collect():
        held.setdefault((r.shard, r.bucket), []).append(len(r.text.encode()))
    assert len(held) > 20 and max(sum(v) - max(v) for v in held.values()) < 60_000
    files = [spark.read.parquet(str(f)).collect() for f in (tmp_path / "written").rglob("*.parquet")]
    assert len(files) == len(held) and all([r.bucket_slot for r in f] == list(range(len(f))) for f in files)


def test_a_large_shard_has_more_buckets(spark):
    df = spark.range(4000).select(F.when(F.col("id") < 3000, 0).otherwise(F.col("id")).alias("key"), "id", F.lit(1000).alias("size"))
    rows = shuffled_shards(df, "key", "size", shards=8, bucket_bytes=200_000).collect()
    check(rows, 8)
    buckets: dict[tuple, int] = {}
    for r in rows:
        buckets[r.shard, r.bucket] = buckets.get((r.shard, r.bucket), 0) + 1
    large = max(rows, key=lambda r: r.key == 0).shard
    assert max(buckets.values()) * 1000 < 300_000 and sum(s == large for s, _ in buckets) > 12
    assert all(sum(s == k for s, _ in buckets) <= 2 for k in range(8) if k != large)
