"""Document fingerprints: one-permutation MinHash with optimal densification, stored as packed low-order bits.

Each distinct five-word shingle is hashed once; the high bits choose a bin, a bin keeps its smallest hash.  An empty
bin takes the value of a bin that is not empty, drawn by a hash of (bin, attempt) alone, so two documents draw alike.
A bin then keeps its lowest ``bits`` bits.  Bins of unlike documents agree by chance with probability ``2 ** -bits``;
``likeness`` takes that out: ``(agreeing - chance) / (1 - chance)``, held between 0 and 1.

A document without words has the empty fingerprint, which is like itself (1) and nothing else (0).
Fingerprints are made where rows are read, without a shuffle.  ``with_edits`` needs each row's next document and deals
rows out by ranges of the id; a range's last row gets its partner as one extra row, so nothing meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from levyframe.llm.text import Shingler, mixed, utf8

BINS = 256
BITS = 8


def _draws(bins: int) -> np.ndarray:
    """The bins that an empty bin tries, in order; fixed for all documents."""
    attempts = 4 * bins
    grid = np.arange(bins, dtype=np.uint64)[:, None] * np.uint64(attempts) + np.arange(attempts, dtype=np.uint64)
    return (mixed(mixed(grid)) % np.uint64(bins)).astype(np.int64)


class Fingerprinter:
    def __init__(self, bins: int = BINS, bits: int = BITS):
        if bins & (bins - 1) or not 2 <= bins or bits not in (1, 2, 4, 8):
            raise ValueError("bins: a power of two; bits: 1, 2, 4 or 8")
        self.bins, self.bits = bins, bits
        self._shift = np.uint64(64 - bins.bit_length() + 1)
        self._shingler = Shingler()
        self._draws = _draws(bins)

    def many(self, texts: Iterable[bytes | None]) -> Iterator[bytes]:
        return map(self.of_shingles, self._shingler.many(texts))

    def of(self, text: str | bytes | None) -> bytes:
        return self.of_shingles(self._shingler.of(text))

    def of_shingles(self, values: np.ndarray) -> bytes:
        """``values``: sorted distinct 64-bit hashes."""
        if not len(values):
            return b""
        where = (values >> self._shift).astype(np.int64)
        first = np.flatnonzero(np.diff(where, prepend=-1))
        low = np.zeros(self.bins, np.uint8)
        filled = np.zeros(self.bins, bool)
        low[where[first]] = (mixed(values[first]) & np.uint64((1 << self.bits) - 1)).astype(np.uint8)
        filled[where[first]] = True
        empty = np.flatnonzero(~filled)
        for tried in (slice(0, 32), slice(32, None)):  # few shingles need many draws
            hits = filled[self._draws[empty, tried]]
            found = hits.any(axis=1)
            source = self._draws[empty, tried][found, hits[found].argmax(axis=1)]
            low[empty[found]] = low[source]
            empty = empty[~found]
            if not len(empty):
                break
        else:  # the next filled bin, round the circle
            order = np.flatnonzero(filled)
            low[empty] = low[order[np.searchsorted(order, empty) % len(order)]]
        bits = np.unpackbits(low[:, None], axis=1)[:, 8 - self.bits :]
        return np.packbits(bits).tobytes()

    def likeness(self, a: bytes, b: bytes) -> float:
        if not a or not b:
            return float(a == b)
        x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8)).reshape(self.bins, self.bits)
        chance = 2.0**-self.bits
        return float(min(1.0, max(0.0, ((~x.any(axis=1)).mean() - chance) / (1 - chance))))


def fingerprints(df: DataFrame, text: str = "text", bins: int = BINS, bits: int = BITS) -> DataFrame:
    """All columns of ``df`` and ``fingerprint``, a packed binary."""
    if "fingerprint" in df.columns:
        raise ValueError("a column fingerprint is there already")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprinter(bins, bits)
        for batch in batches:
            new = pa.array(list(made.many(utf8(batch.column(text)))), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, "fingerprint"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("fingerprint", T.BinaryType())]))


def edited(text: str, following: str) -> str:
    """The last third of the text's code points gives way to as many of the next one's first."""
    third = len(text) // 3
    return text[: len(text) - third] + following[:third] if third else text


_EDITS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("edited_sha256", T.StringType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("edited_fingerprint", T.StringType()),
        T.StructField("near_edited", T.DoubleType()),
        T.StructField("near_next", T.DoubleType()),
    ]
)


def with_edits(df: DataFrame, parts: int | None = None, bins: int = BINS, bits: int = BITS) -> DataFrame:
    """Each document's fingerprint, its edited text's, and both likenesses.

    The next document is the one with the next smaller ``doc_id`` (after the smallest: the largest); rows of one id
    follow each other by a hash of the text, rows without an id come last.  A lone row is its own next document.
    ``parts`` is the number of ranges, ``spark.sql.shuffle.partitions`` by default; the driver sees one cut and one
    head row of each range.
    """
    spark = df.sparkSession
    docs = df.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    points = [x / parts for x in range(1, parts)]
    found = docs.where("doc_id is not null").approxQuantile("doc_id", points, 0.2 / parts) if points else []
    cuts = np.array(sorted({int(x) for x in found}), np.int64)
    last = len(cuts) + 1

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        below = np.searchsorted(cuts, ids.fillna(0).to_numpy(np.int64), side="left")
        return pd.Series(np.where(known, len(cuts) - below, last).astype(np.int32))

    # text_order decides between rows of one id
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_order"), range_of("doc_id").alias("part"))
    top = F.max(F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), "text_order"))
    heads = sorted((r.part, r.top.id, r.top.text_order) for r in docs.groupBy("part").agg(top.alias("top")).collect())
    partners = [(h[1] if h[0] != last else None, h[2], heads[k - 1][0]) for k, h in enumerate(heads)]
    guards = spark.createDataFrame(partners, "head_id long, head_order long, to_part int")
    same = F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.col("text_order") == F.col("head_order"))
    guards = docs.join(F.broadcast(guards), same).select(
        "doc_id", "text", "text_order", F.col("to_part").alias("part"), F.lit(1).alias("guard")
    )
    dealt = docs.withColumn("guard", F.lit(0)).union(guards).repartitionById(last + 1, "part")
    ordered = dealt.sortWithinPartitions("guard", F.desc_nulls_last("doc_id"), F.desc("text_order"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = Fingerprinter(bins, bits)
        waiting: list[tuple] = []  # the row whose next one is not known yet
        done = False
        for batch in batches:
            if done:
                continue
            texts = batch.column("text").to_pylist()
            own = made.many(t.encode() for t in texts)
            rows = [*waiting, *zip(batch.column("doc_id").to_pylist(), texts, own, strict=True)]
            guards = batch.column("guard").to_pylist()
            done = 1 in guards
            if done:  # what follows the first partner row is the same row again
                rows = rows[: len(waiting) + guards.index(1) + 1]
            waiting = rows[-1:]
            if len(rows) > 1:
                changed = [edited(one[1], after[1]).encode() for one, after in zip(rows, rows[1:], strict=False)]
                out = [
                    _row(made, one, text, print_, after[2])
                    for one, after, text, print_ in zip(rows, rows[1:], changed, made.many(changed), strict=False)
                ]
                columns = [pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    schema = to_arrow_schema(_EDITS)
    return ordered.select("doc_id", "text", "guard").mapInArrow(run, _EDITS)


def _row(made: Fingerprinter, row: tuple, changed: bytes, after: bytes, next_own: bytes) -> tuple:
    doc_id, text, own = row
    near = made.likeness(own, after), made.likeness(own, next_own)
    return (doc_id, len(text), sha256(changed).hexdigest(), own.hex(), after.hex(), *near)
