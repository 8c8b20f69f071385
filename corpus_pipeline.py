"""The corpus pipeline: toxic documents go, repeated lines go, one document of each group of near copies stays, sources
are mixed to their target weights, and what is left is encoded.

Each stage gets all that the stage before it kept, as a written table.  ``ORACLE_SQL`` is None: a trained classifier, a
random mix and a tokenizer are beyond SQL; ``tests/llm`` holds the pipeline against a plain version.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from levyframe.llm import byte_bpe, line_dedup, mixture, ngram_join, toxicity
from levyframe.storage import stage

VOCABULARY = "byte_bpe_50k.tiktoken"
BATCH_ROWS = "2000"  # whole texts that a Python worker gets at once; Spark's default of 10,000 takes some 100 MB of each
ENCODED_ROWS = "500"  # with 2,000 an encoder takes 90 MB more for the new words of a batch, and keeps most of it
ORACLE_SQL = None


def _small_batches(spark: SparkSession, rows: str = BATCH_ROWS) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the labels, calls toxic go."""
    _small_batches(spark)
    return toxicity.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; a document goes when no line is left in it that is not blank."""
    _small_batches(spark)
    return line_dedup.dedup_lines(docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by their word shingles the one of the smallest id stays."""
    _small_batches(spark)
    return ngram_join.one_of_each_group(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, some not at all."""
    _small_batches(spark)
    return mixture.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids instead of texts."""
    _small_batches(spark, ENCODED_ROWS)
    return byte_bpe.tokenized(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_sources),
    ("byte-level BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name.split()[0])
    return docs
