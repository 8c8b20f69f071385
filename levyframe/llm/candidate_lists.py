"""Lists of candidates that share a token: streaming passes over rows sorted by (token, n, key).

A row says that the class ``key`` (of size or length ``n``) has ``token`` at ``pos``.  The passes hold one row at a
time beside the batch, so a token that very many classes have takes no memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POSTING = "token long, n int, pos int, key long"
SHARED = f"{POSTING}, previous long"
MARK_BITS = 23


def shared_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (token, n, key): one of each key, and no token that only one key has.

    ``previous`` is the key before in the token's list, null for the first.
    """
    names = ["token", "n", "pos", "key"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64())
    held = [np.empty(0, np.int64)] * 4  # the last row, whose follower is not known yet
    before: int | None = None  # the key before the held row in its list

    def made(rows: list[np.ndarray], keep: np.ndarray, previous: np.ndarray, first: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(r[keep], t) for r, t in zip(rows, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(previous[keep], pa.int64(), mask=first[keep])], [*names, "previous"])

    for batch in batches:
        rows = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, names, strict=True)]
        token, key = rows[0], rows[3]
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = (token[1:] != token[:-1]) | (key[1:] != key[:-1])
        rows = [r[new] for r in rows]
        token, key = rows[0], rows[3]
        first = np.ones(len(token), bool)  # of its list
        first[1:] = token[1:] != token[:-1]
        previous = np.concatenate([[0], key[:-1]])
        if before is not None:
            first[0], previous[0] = False, before
        last = np.append(first[1:], True)
        keep = ~(first & last)
        keep[-1] = False
        if keep.any():
            yield made(rows, keep, previous, first)
        before = None if first[-1] else int(previous[-1])
        held = [r[-1:] for r in rows]
    if before is not None:
        yield made(held, np.ones(1, bool), np.array([before]), np.zeros(1, bool))


def marked(keys: DataFrame) -> np.ndarray:
    """A bitmap of ``2 ** MARK_BITS`` bits with one for each value of ``key``; the driver sees its words, however many
    keys there are."""
    place = F.pmod(F.col("key"), F.lit(1 << MARK_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = keys.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    found = np.zeros(1 << (MARK_BITS - 6), np.int64)
    for row in words.collect():
        found[row.word] = row.bits
    return np.unpackbits(found.view(np.uint8), bitorder="little").view(bool)


def _neighbours(room: Callable[..., np.ndarray]):
    """Of rows sorted by (token, n, key): each row with the nearest row before it of its token and another component,
    where ``room(n, pos, m, other_pos)`` says that the two may link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["token", "n", "pos", "key", "component"]
        last = np.empty((5, 0), np.int64)  # the row before this batch
        outside = np.full((5, 1), -1, np.int64)  # the nearest row before that row that is of another component
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in names])
            told = last.shape[1]  # rows of the batch before
            rows = np.concatenate([last, rows], axis=1)
            token, component = rows[0], rows[4]
            starts = np.ones(rows.shape[1], bool)
            starts[1:] = (token[1:] != token[:-1]) | (component[1:] != component[:-1])
            run_start = np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))
            other = np.concatenate([outside, rows], axis=1)[:, run_start]  # the row before the run's first
            last, outside = rows[:, -1:], other[:, -1:]
            fits = (other[0] == token) & (np.arange(len(token)) >= told)
            fits &= room(rows[1], rows[2], other[1], other[2])
            if fits.any():
                yield pa.RecordBatch.from_arrays([pa.array(rows[3][fits]), pa.array(other[3][fits])], ["x", "y"])

    return run


def nearest(postings: DataFrame, room: Callable[..., np.ndarray]) -> DataFrame:
    """(x, y): for each class at most one class of another component, the one it follows most often in the lists of
    their common tokens.  ``postings`` has a column ``component``."""
    ordered = postings.repartition("token").sortWithinPartitions("token", "n", "key")
    near = ordered.select("token", "n", "pos", "key", "component").mapInArrow(_neighbours(room), "x long, y long")
    often = near.groupBy("x", "y").agg(F.count("*").alias("times"))
    return often.groupBy("x").agg(F.max_by("y", "times").alias("y"))


def most_common_previous(postings: DataFrame) -> DataFrame:
    """(x, y): for each class at most one class, the one it follows most often in its lists."""
    met = postings.where("previous is not null").groupBy(F.col("key").alias("x"), F.col("previous").alias("y"))
    return met.agg(F.count("*").alias("times")).groupBy("x").agg(F.max_by("y", "times").alias("y"))


def most_common_head(postings: DataFrame, weight: str) -> DataFrame:
    """(x, y): for each class at most one class, that which is most often the heaviest of its lists."""
    head = F.max(F.struct(F.col(weight).alias("weight"), "key")).alias("head")
    heads = postings.groupBy("token").agg(head).select("token", F.col("head.key").alias("y"))
    met = postings.select("token", F.col("key").alias("x")).join(heads, "token").where("x <> y")
    often = met.groupBy("x", "y").agg(F.count("*").alias("times"))
    return often.groupBy("x").agg(F.max_by("y", "times").alias("y"))


def with_components(postings: DataFrame, found: DataFrame | None) -> DataFrame:
    """Postings with each class' component; of classes that ``found`` (node, root) doesn't have, the class itself."""
    if found is None:
        return postings.withColumn("component", F.col("key"))
    known = found.select(F.col("node").alias("key"), "root")
    return postings.join(known, "key", "left").withColumn("component", F.coalesce("root", "key")).drop("root")


def apart(postings: DataFrame, found: DataFrame | None, measures: DataFrame | None = None) -> DataFrame:
    """Postings of the tokens that more than one component has, with what ``measures`` knows of each key."""
    rows = with_components(postings, found)
    if measures is not None:
        rows = rows.join(measures, "key")
    if found is None:
        return rows
    ends = rows.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    return rows.join(ends.where("low < high").select("token"), "token", "left_semi")
