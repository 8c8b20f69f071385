"""Records of delimited text, read as lines: one scan, split over tasks, with the line at hand for every check.

A file's first line is its header.  In a scan of a single file it is the first row of the task that reads from byte 0, so a
folder of up to ``FILES_APART`` files is read file by file; of more files, tasks may read several, and a second, light
scan proves which line is first.

Line breaks inside quotes: whether a line begins inside quotes depends on all lines before it.  But a line's effect is one of
four: it keeps, switches or sets the state "inside quotes", and so does a whole block of the file that one task reads.  A
first pass finds each block's effect, a window over a file's blocks tells the state each one begins in, and a second pass
joins lines into records.  Only a record that goes on in the next block is put together by a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import pairwise
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE, FILE, OFFSET, FIRST = "__line", "__file", "__offset", "__first"
FILES_APART = 32
QUOTE = '"'
_IN_TASK = (1 << 33) - 1  # bits of monotonically_increasing_id that count rows within a task
_CLOSED, _OPEN, _JUST_CLOSED, _LITERAL = 0, 1, 2, 3

RECORD_SCHEMA = f"{LINE} string, {FILE} string, {OFFSET} long, {FIRST} boolean, place int, begins boolean"


def _scan(spark: SparkSession, paths: str | Sequence[str], **options: str) -> DataFrame:
    return spark.read.options(**options).text(paths).select(
        F.col("value").alias(LINE), F.col("_metadata.file_path").alias(FILE), F.col("_metadata.file_block_start").alias(OFFSET),
        F.monotonically_increasing_id().alias("__at"),
    )


def _files(spark: SparkSession, path: str | Sequence[str]) -> list[str]:
    """The files below a path, as paths that stand for themselves."""
    found = (unquote(file) for file in spark.read.text(path).inputFiles())
    return sorted(re.sub(r"([*?{}\[\]\\])", r"\\\1", file) for file in found)


def text_lines(spark: SparkSession, path: str | Sequence[str], header: str) -> DataFrame:
    """(line, file, offset of its block, whether it is the file's first); ``header`` is the first line of some file."""
    files = _files(spark, path)
    begins = (F.col(OFFSET) == 0) & (F.col("__at").bitwiseAND(F.lit(_IN_TASK)) == 0)
    if len(files) <= FILES_APART:
        parts = [_scan(spark, file).withColumn(FIRST, begins) for file in files]
        return reduce(DataFrame.unionAll, parts).drop("__at") if parts else _scan(spark, path).withColumn(FIRST, begins).drop("__at")
    lines = _scan(spark, path)
    is_header = (F.col(OFFSET) == 0) & (F.col(LINE) == header)
    heads = lines.where(F.col(OFFSET) == 0).groupBy(FILE).agg(
        F.min("__at").alias("first"), F.min(F.when(is_header, F.col("__at"))).alias("head"), F.count_if(is_header).alias("times")
    )
    proper = F.col("head").eqNullSafe(F.col("first")) & (F.col("times") == 1)
    text = F.concat(F.col(FILE), F.lit(": its first line is not the header, or the header stands there again"))
    check = heads.where(F.when(proper, F.lit(False)).otherwise(F.raise_error(text).cast("boolean")))
    checked = check.select(F.lit("").alias(LINE), F.col(FILE), F.lit(0).cast("long").alias(OFFSET), F.lit(True).alias(FIRST))
    return lines.withColumn(FIRST, is_header).drop("__at").unionByName(checked)


def first_line(spark: SparkSession, path: str | Sequence[str]) -> str | None:
    """The first line of some file; None when there is no line."""
    found = spark.read.text(path).head()
    return None if found is None else found[0]


# Line breaks inside quotes ---------------------------------------------------------------------------------


def _ends_open(line: Column, start: int, separator: str) -> Column:
    """Whether a quote is open after ``line`` when the line begins in state ``start``."""

    def after_quote(state: Column, before: Column) -> Column:
        """The state after a quote that follows the text ``before``."""
        opens = ((before == "") & state.isin(_CLOSED, _JUST_CLOSED)) | before.endswith(separator)
        return F.when(state == _OPEN, F.lit(_JUST_CLOSED)).when(opens, F.lit(_OPEN)).otherwise(F.lit(_LITERAL))

    pieces = F.split(line, QUOTE, -1)
    state = F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(start), after_quote)
    return F.when(line.contains(QUOTE), state == _OPEN).otherwise(F.lit(start == _OPEN))


def _before(closed: np.ndarray, opened: np.ndarray, start: bool) -> tuple[np.ndarray, bool]:
    """(whether each line begins inside quotes, whether the text after the last one does).

    ``closed`` and ``opened`` tell how each line ends when it begins outside and inside quotes.
    """
    sets, flips = closed == opened, closed & ~opened
    n = len(closed)
    switched = np.concatenate([[0], np.cumsum(flips)])
    last = np.concatenate([[-1], np.maximum.accumulate(np.where(sets, np.arange(n), -1))]) if n else np.array([-1])
    known = last >= 0
    state = np.where(known, closed[last] if n else False, start)
    since = switched - np.where(known, switched[last + 1], 0)
    found = state ^ (since % 2 == 1)
    return found[:-1], bool(found[-1])


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Runs of rows of one block."""
    for batch in batches:
        offset = batch.column(OFFSET).to_numpy()
        file = batch.column(FILE).dictionary_encode().indices.to_numpy()
        if not len(offset):
            continue
        cuts = np.flatnonzero((np.diff(offset) != 0) | (np.diff(file) != 0)) + 1
        for low, high in pairwise([0, *cuts.tolist(), len(offset)]):
            yield (batch.column(FILE)[low].as_py(), int(offset[low])), batch.slice(low, high - low)


def _flags(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return tuple(part.column(name).to_numpy(zero_copy_only=False).astype(bool) for name in ("closed", "opened"))


def _effects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's effect: how it ends when it begins outside and inside quotes."""
    current: tuple[str, int] | None = None
    ends = [False, True]
    rows: list[tuple] = []
    for key, part in _blocks(batches):
        if key != current:
            if current is not None:
                rows.append((*current, *ends))
            current, ends = key, [False, True]
        ends = [_before(*_flags(part), start)[1] for start in ends]
    if current is not None:
        rows.append((*current, *ends))
    names = (FILE, OFFSET, "closed", "opened")
    if rows:
        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)), strict=True)))


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines joined to records, block by block.

    ``place`` is 0 for a whole record, 1 for what goes on in the next block, and ``begins`` tells whether the piece is
    the start of its record.
    """
    current: tuple[str, int] | None = None
    inside = False
    held: list[str] = []  # lines of the record that is open
    begins = first = True
    out: list[tuple] = []

    def flush(place: int) -> None:
        nonlocal held, begins, first
        if held:
            out.append(("\n".join(held), *current, first and begins and current[1] == 0, place, begins))
            first = False
        held, begins = [], True

    def batch() -> pa.RecordBatch:
        columns = list(map(list, zip(*out, strict=True)))
        kinds = (pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int32(), pa.bool_())
        names = (LINE, FILE, OFFSET, FIRST, "place", "begins")
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], list(names))

    for key, part in _blocks(batches):
        if key != current:
            if current is not None:
                flush(1 if inside else 0)
            current, held, first = key, [], True
            inside = bool(part.column("inside")[0].as_py())
            begins = not inside
        before, after = _before(*_flags(part), inside)
        for line, opened in zip(part.column(LINE).to_pylist(), before.tolist(), strict=True):
            if not opened and held:
                flush(0)
            held.append(line)
        inside = after
        if len(out) >= 4096:
            yield batch()
            out.clear()
    if current is not None:
        flush(1 if inside else 0)
    if out:
        yield batch()


def quoted_records(spark: SparkSession, path: str | Sequence[str], separator: str) -> DataFrame:
    """(record, file, offset, whether it is the file's first) of text with line breaks inside quotes.

    Lines end with a line feed, before which a carriage return is dropped at the end of a record.  A record's offset is
    that of its block, or one more when it goes on in the next block, so that records sort by it.
    """
    text = F.concat(F.col(FILE), F.lit(": bytes that are not UTF-8: "), F.make_valid_utf8(LINE))
    sound = F.when(F.is_valid_utf8(LINE), F.col(LINE)).otherwise(F.raise_error(text).cast("string"))
    lines = _scan(spark, path, lineSep="\n").withColumn(LINE, sound)
    flagged = lines.select(
        "*", _ends_open(F.col(LINE), _CLOSED, separator).alias("closed"), _ends_open(F.col(LINE), _OPEN, separator).alias("opened")
    )
    small = flagged.select(FILE, OFFSET, "closed", "opened")
    effects = small.mapInArrow(_effects, f"{FILE} string, {OFFSET} long, closed boolean, opened boolean")
    # The state a block begins in: what the last block that sets it has set, switched by those after it.
    earlier = Window.partitionBy(FILE).orderBy(OFFSET).rowsBetween(Window.unboundedPreceding, -1)
    sets = F.col("closed") == F.col("opened")
    flips = F.coalesce(F.sum((F.col("closed") & ~F.col("opened")).cast("int")).over(earlier), F.lit(0))
    counted = effects.withColumn("flips", flips)
    mark = F.when(sets, F.struct(F.col("closed").alias("state"), F.col("flips").alias("flips")))
    last = F.last(mark, ignorenulls=True).over(earlier)
    counted = counted.withColumn("last", last)
    state = F.coalesce(F.col("last.state"), F.lit(False)).cast("int") + F.col("flips") - F.coalesce(F.col("last.flips"), F.lit(0))
    starts = counted.select(F.col(FILE).alias("in_file"), F.col(OFFSET).alias("at_offset"), (F.pmod(state, F.lit(2)) == 1).alias("inside"))
    same = (F.col(FILE) == F.col("in_file")) & (F.col(OFFSET) == F.col("at_offset"))
    # One row for each block is sent to all tasks, so that texts are not shuffled: a block's lines stay in their task.
    told = flagged.join(F.broadcast(starts), same).drop("in_file", "at_offset").sortWithinPartitions(FILE, OFFSET, "__at")
    pieces = told.drop("__at").mapInArrow(_assembled, RECORD_SCHEMA)
    whole = pieces.where((F.col("place") == 0) & F.col("begins"))
    # Pieces of records that cross blocks: a start, then one of each block that goes on, up to the one that ends it.
    crossing = pieces.where((F.col("place") == 1) | ~F.col("begins"))
    order = Window.partitionBy(FILE).orderBy(OFFSET, F.col("begins"))
    number = F.sum(F.col("begins").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = crossing.withColumn("number", number)
    parts = F.sort_array(F.collect_list(F.struct(OFFSET, LINE)))
    joined = numbered.groupBy(FILE, "number").agg(
        F.array_join(F.transform(parts, lambda p: p[LINE]), "\n").alias(LINE), (F.min(OFFSET) + 1).alias(OFFSET), F.max(FIRST).alias(FIRST)
    )
    columns = [LINE, FILE, OFFSET, FIRST]
    records = whole.select(*columns).unionByName(joined.select(*columns))
    return records.withColumn(LINE, F.regexp_replace(LINE, r"\r\z", ""))

