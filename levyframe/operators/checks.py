"""Checks on attribute tables.  Each is one aggregate over the table whose result is as small as its schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.errors import ResultError, TableError
from levyframe.functions.cells import FLOAT, INTEGER, KIND_NAMES, KIND_TYPES, TEXT, cell_kind, checked_cast
from levyframe.functions.names import column
from levyframe.storage import stage

SUPPORTED_TYPES = (T.IntegerType, T.DoubleType, T.StringType)
MIXED = "mixed"


def _columns(df: DataFrame, leave_out: Sequence[str]) -> list[str]:
    return [name for name in df.columns if name not in leave_out]


def _per_column(aggregated: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn the one row of aggregates ``<field>_<i>`` into one row per column."""
    entries = (
        F.struct(F.lit(name).alias("attribute"), *(F.col(f"{field}_{i}").alias(field) for field in fields))
        for i, name in enumerate(names)
    )
    return aggregated.select(F.explode(F.array(*entries)).alias("entry")).select("entry.*")


def column_types(df: DataFrame, promote_int: bool = False, leave_out: Sequence[str] = ()) -> DataFrame:
    """The type of each text column as rows (attribute, type): int, double, string, or ``mixed``.

    All cells of a column must be of one kind; ``promote_int`` lets integers stand in a float column.  One
    pass over the table, combined before the single-row exchange.
    """
    names = _columns(df, leave_out)
    kinds = df.select(*(cell_kind(column(name)).alias(f"k{i}") for i, name in enumerate(names)))
    ends = kinds.agg(
        *(F.min(f"k{i}").alias(f"low_{i}") for i in range(len(names))),
        *(F.max(f"k{i}").alias(f"high_{i}") for i in range(len(names))),
    )
    rows = _per_column(ends, names, ["low", "high"])
    kind = F.when(F.col("low") == F.col("high"), F.col("low"))
    if promote_int:
        kind = F.when(F.col("high") == FLOAT, F.lit(FLOAT)).otherwise(kind)
    named = F.lit(MIXED)
    for code, text in KIND_NAMES.items():
        named = F.when(kind == code, F.lit(text)).otherwise(named)
    return rows.where(F.col("low").isNotNull()).select("attribute", named.alias("type"))


def resolve_types(df: DataFrame, promote_int: bool = False, leave_out: Sequence[str] = ()) -> dict[str, T.DataType]:
    """``column_types`` as a dict; raises when the table has no row or a column mixes kinds."""
    names = _columns(df, leave_out)
    found = {row["attribute"]: row["type"] for row in column_types(df, promote_int, leave_out).collect()}
    if not found:
        raise TableError("the table has no row")
    mixed = sorted(name for name in names if found[name] == MIXED)
    if mixed:
        raise TableError(f"columns mix integers, floats or text: {', '.join(mixed)}")
    codes = {text: code for code, text in KIND_NAMES.items()}
    return {name: KIND_TYPES[codes[found[name]]] for name in names}


def apply_types(df: DataFrame, types: Mapping[str, T.DataType], promote_int: bool = True) -> DataFrame:
    """Cast text columns to types that ``resolve_types`` found; an empty cell is the text ''.

    A cell that no longer fits, as the text has changed since, stops the query.
    """
    return df.select(
        *(
            checked_cast(column(name), types[name], name, promote_int).alias(name) if name in types else column(name)
            for name in df.columns
        )
    )


def first_type_mismatch(df: DataFrame, index: str, promote_int: bool = False) -> DataFrame:
    """The first pair of neighbouring rows whose cells differ in kind: (index of the earlier row, attribute).

    ``index`` numbers the rows without gaps.  Empty when every column is of one kind; of several columns
    that fail at the same row, the alphabetically first is named.

    Neighbours are never compared.  A column holds at most three kinds; the smallest index of each kind
    comes from one aggregate, and the second smallest of the three is the first row unlike the first row.
    """
    names = _columns(df, [index])
    cells = df.select(
        column(index).alias("at"),
        *(
            (
                F.when(cell_kind(column(name)) == TEXT, F.lit(TEXT)).otherwise(F.lit(FLOAT))
                if promote_int
                else cell_kind(column(name))
            ).alias(f"k{i}")
            for i, name in enumerate(names)
        ),
    )
    firsts = cells.agg(
        *(
            F.min(F.when(F.col(f"k{i}") == kind, F.col("at"))).alias(f"c{i}_{kind}")
            for i in range(len(names))
            for kind in (INTEGER, FLOAT, TEXT)
        )
    )
    faults = F.array(
        *(
            F.struct(
                (F.get(F.sort_array(_present(i)), F.lit(1)) - 1).alias("index"), F.lit(name).alias("attribute")
            )
            for i, name in enumerate(names)
        )
    )
    first = F.array_min(F.filter(faults, lambda fault: fault["index"].isNotNull()))
    return firsts.select(first.alias("fault")).where("fault IS NOT NULL").select("fault.index", "fault.attribute")


def _present(i: int) -> Column:
    return F.array_compact(F.array(*(F.col(f"c{i}_{kind}") for kind in (INTEGER, FLOAT, TEXT))))


def null_cells(df: DataFrame, index: str) -> DataFrame:
    """Columns that hold NULL, with the index of the first such row: rows (attribute, index)."""
    names = _columns(df, [index])
    firsts = df.agg(
        *(F.min(F.when(column(name).isNull(), column(index))).alias(f"index_{i}") for i, name in enumerate(names))
    )
    return _per_column(firsts, names, ["index"]).where(F.col("index").isNotNull())


def unsupported_columns(schema: T.StructType) -> list[str]:
    """Columns that are not int32, float64 or text; reads the schema only."""
    return [field.name for field in schema if not isinstance(field.dataType, SUPPORTED_TYPES)]


def check_table(df: DataFrame) -> DataFrame:
    """Raise unless the table has a row, holds only int32, float64 and text columns, and no NULL.

    One aggregate; returns the table so that calls can be chained.
    """
    wrong = unsupported_columns(df.schema)
    if wrong:
        raise TableError(f"columns of an unsupported type: {', '.join(wrong)}")
    counts = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *(F.count(column(name)).alias(f"c{i}") for i, name in enumerate(df.columns)),
    ).first()
    if counts["rows"] == 0:
        raise TableError("the table has no row")
    holes = [name for i, name in enumerate(df.columns) if counts[f"c{i}"] < counts["rows"]]
    if holes:
        raise TableError(f"columns with missing values: {', '.join(holes)}")
    return df


def attribute_gaps(eav: DataFrame, entity: str, attribute: str, *, words_per_block: int = 1024) -> DataFrame:
    """Attributes that some entity lacks although another has them: rows (entity, attribute).

    ``eav`` holds one row per (entity, attribute), repeats allowed; a NULL entity is an entity, a NULL attribute is none.
    The distinct names get numbers without gaps, so what an entity has is bits in 64-bit words, and what it lacks is their
    complement.  The table is shuffled once, its bits combined before that; words meet in blocks of ``words_per_block``.
    Only of entities that lack something are whole blocks made that they have nothing of.  The driver sees how many names
    each task has numbered.
    """
    pairs = eav.select(column(entity).alias("e"), column(attribute).alias("a")).where("a IS NOT NULL")
    named = pairs.select("a").distinct().withColumn("id", F.monotonically_increasing_id())
    names = stage(named, "names")
    task, place = F.shiftright("id", 33).cast("int"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    counts = {row["task"]: row["count"] for row in names.groupBy(task.alias("task")).count().collect()}
    total, starts = 0, []
    for number in range(max(counts, default=-1) + 1):
        starts.append(total)
        total += counts.get(number, 0)
    starts_of = F.array(*(F.lit(start).cast("long") for start in starts)).cast("array<long>")
    numbers = names.select("a", (F.get(starts_of, task) + place).alias("n"))

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("n").bitwiseAND(F.lit(63)).cast("int"))
    bits = pairs.join(numbers, "a").groupBy("e", F.shiftright("n", 6).alias("w")).agg(F.bit_or(bit).alias("bits"))
    words = -(-total // 64)
    last = words - 1
    full = lambda w: F.when(w == last, F.lit(_ones(total - 64 * last))).otherwise(F.lit(-1).cast("long"))
    if words <= 1:
        lacking = bits.select("e", "w", (full(F.col("w")).bitwiseAND(F.bitwise_not("bits"))).alias("gaps"))
    else:
        lacking = _word_gaps(bits, words, words_per_block, total, full)
    each = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("gaps", i) == 1)
    gaps = lacking.where("gaps <> 0").select("e", "w", F.explode(each).alias("i"))
    found = gaps.select("e", (F.shiftleft("w", 6) + F.col("i")).alias("n")).join(numbers, "n")
    return found.select(F.col("e").alias(entity), F.col("a").alias(attribute))


def _ones(n: int) -> int:
    """The signed 64-bit integer whose lowest ``n`` bits are set."""
    return -1 if n == 64 else (1 << n) - 1


def _word_gaps(bits: DataFrame, words: int, words_per_block: int, total: int, full: Callable[[Column], Column]) -> DataFrame:
    """(e, w, gaps) of every word of which an entity lacks a bit."""
    block = F.floor(F.col("w") / words_per_block).cast("long")
    blocks = bits.groupBy("e", block.alias("b")).agg(
        F.map_from_entries(F.collect_list(F.struct("w", "bits"))).alias("has"), F.sum(F.bit_count("bits")).alias("held")
    )
    if words > words_per_block:
        # An entity may have nothing of a block, and then no row for it.
        blocks = stage(blocks, "blocks")
        short = blocks.groupBy("e").agg(F.sum("held").alias("held")).where(F.col("held") < total)
        asked = short.select(F.col("e").alias("se"), F.explode(F.sequence(F.lit(0), F.lit((words - 1) // words_per_block))).alias("sb"))
        same = F.col("e").eqNullSafe(F.col("se")) & (F.col("b") == F.col("sb"))
        blocks = asked.join(blocks, same, "left").select(F.col("se").alias("e"), F.col("sb").cast("long").alias("b"), "has")
    first = F.col("b") * words_per_block
    every = F.sequence(first, F.least(first + words_per_block, F.lit(words).cast("long")) - 1)
    none = F.create_map().cast("map<bigint,bigint>")
    missing = lambda w: full(w).bitwiseAND(F.bitwise_not(F.coalesce(F.coalesce("has", none)[w], F.lit(0).cast("long"))))
    gaps = F.filter(F.transform(every, lambda w: F.struct(w.alias("w"), missing(w).alias("gaps"))), lambda x: x["gaps"] != 0)
    return blocks.select("e", F.inline(gaps))


def missing_results(results: DataFrame, results_map: str, index: str, names: Sequence[str]) -> DataFrame:
    """Expected result names absent from a row's name-to-value map: rows (index, name); a NULL map has none."""
    expected = F.array(*(F.lit(name) for name in names))
    lacking = F.array_except(
        expected, F.coalesce(F.map_keys(column(results_map)), F.array().cast("array<string>"))
    )
    return results.select(column(index), F.explode(lacking).alias("name"))


def check_result_columns(df: DataFrame, names: Sequence[str]) -> None:
    """Raise when an expected result column is absent; reads the schema only."""
    lacking = sorted(set(names) - set(df.columns))
    if lacking:
        raise ResultError(f"missing results: {', '.join(lacking)}")
