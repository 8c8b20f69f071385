"""The registered queries of the corpus operators: each applies one operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from levyframe.llm import (
    byte_bpe,
    centroids,
    divergence,
    fingerprints,
    licenses,
    line_dedup,
    mixture,
    neighbours,
    ngram_join,
    repeated_spans,
    sharding,
    toxicity,
    window_dedup,
)
from levyframe.llm.oracles import LLM_ORACLES  # noqa: F401

VOCABULARY = "byte_bpe_50k.tiktoken"


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_components(_documents(spark, sf_dir))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(_documents(spark, sf_dir).select("doc_id", "text"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.with_kept_lines(_documents(spark, sf_dir).select("doc_id", "text"))
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return kept.select("doc_id", "n_lines", "n_removed", digest)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.Mixture(_documents(spark, sf_dir)).documents()


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return byte_bpe.round_trip(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op8_repeated_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans.span_digests(repeated_spans.repeated_spans(_documents(spark, sf_dir)))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return neighbours.nearest_neighbours(vectors, F.col("vec_id") % 20 == 0)


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(_documents(spark, sf_dir))


def op11_window_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_dedup.window_digests(_documents(spark, sf_dir))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_documents(spark, sf_dir))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digests(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_license_scan": op2_license_scan,
    "op3_line_dedup": op3_line_dedup,
    "op4_toxicity": op4_toxicity,
    "op5_mixture": op5_mixture,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_shards": op7_shards,
    "op8_repeated_spans": op8_repeated_spans,
    "op9_neighbours": op9_neighbours,
    "op10_fingerprints": op10_fingerprints,
    "op11_window_dedup": op11_window_dedup,
    "op12_source_divergence": op12_source_divergence,
    "op13_centroids": op13_centroids,
}
