"""Strictly typed delimited text: ';', a header, equally many fields in every row."""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.errors import TableError
from levyframe.functions.cells import checked_cast
from levyframe.functions.names import case_clashes, column, quoted
from levyframe.operators.checks import apply_types, first_type_mismatch, resolve_types, unsupported_columns
from levyframe.operators.ordering import with_index
from levyframe.sources.text_records import FILE, FIRST, LINE, OFFSET, first_line, quoted_records, text_lines

DELIMITER = ";"
SOURCE_FILE, SOURCE_OFFSET = FILE, OFFSET
POSITIONS = (SOURCE_FILE, SOURCE_OFFSET)
CORRUPT = "__corrupt"
ROW = "__row"


def check_suffix(path: str | Sequence[str], suffix: str) -> None:
    for one in [path] if isinstance(path, str) else path:
        if not one.rstrip("/").endswith(suffix):
            raise TableError(f"{one} is not a {suffix} file")


# A doubled quote stands for a quote, as in the files to be read; Spark's default is a backslash.
_FORM = {"sep": DELIMITER, "quote": '"', "escape": '"', "columnPruning": "false", "maxCharsPerColumn": "-1"}


def read_header(spark: SparkSession, path: str | Sequence[str], multi_line: bool = False) -> tuple[list[str], str]:
    """(the fields of the header, its text), from the first line or record of some file."""
    if multi_line:
        first = spark.read.options(**_FORM).option("multiLine", True).option("header", False).csv(path).head()
        text, names = "", [] if first is None else ["" if name is None else name for name in first]
    else:
        line = first_line(spark, path)
        text, names = line or "", [] if line is None else next(csv.reader([line], delimiter=DELIMITER), [""])
    if not names:
        raise TableError(f"{path} is empty")
    if "" in names:
        raise TableError(f"{path}: the header has an empty field")
    return names, text


def _records(spark: SparkSession, path: str | Sequence[str], header: Sequence[str], text: str, multi_line: bool) -> DataFrame:
    """Lines or records with their cells ``f0``, ``f1`` ... and the column ``CORRUPT``, which is not NULL where the number
    of cells is not the header's.  Each is parsed once, whatever is asked of it."""
    clashes = case_clashes(spark, set(header))
    if clashes:
        raise TableError(
            f"columns differ only by case, set spark.sql.caseSensitive=true: {clashes}"
        )
    if multi_line:
        lines = quoted_records(spark, path, DELIMITER)
    else:
        lines = text_lines(spark, path, text)
    fields = [*(f"f{i} string" for i in range(len(header))), f"{CORRUPT} string"]
    parsed = F.from_csv(LINE, ", ".join(fields), {**_FORM, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select("*", F.inline(F.array(parsed)))


def _blank() -> Column:
    return F.col(LINE).rlike(r"\A[\x00-\x20]+\z")


def read_text_cells(
    spark: SparkSession, path: str | Sequence[str], *, multi_line: bool = False, positions: bool = False
) -> DataFrame:
    """All cells as text; of columns with one name the last one stays."""
    check_suffix(path, ".csv")
    header, text = read_header(spark, path, multi_line)
    records = _records(spark, path, header, text, multi_line)
    same = [F.coalesce(F.col(f"f{i}"), F.lit("")) == name for i, name in enumerate(header)]
    fault = F.when(~F.is_valid_utf8(LINE), F.lit("bytes that are not UTF-8"))
    fault = fault.when(F.col(FIRST) & ~reduce(and_, same, F.col(CORRUPT).isNull()), F.lit("its header is another"))
    cells = [F.col(f"f{i}") for i in range(len(header))]
    if len(header) > 1:
        fault = fault.when(_blank(), F.lit(f"a line of blanks, where the header has {len(header)} fields"))
        fault = fault.when((F.col(LINE) != "") & F.col(CORRUPT).isNotNull(), F.lit(f"a record that has not {len(header)} fields"))
    else:
        cells = [F.when(_blank(), F.col(LINE)).otherwise(cells[0])]
        fault = fault.when((F.col(LINE) != "") & F.col(CORRUPT).isNotNull() & ~_blank(), F.lit("a record that has not one field"))
    complaint = F.concat(F.col(FILE), F.lit(": "), fault, F.lit(": "), F.make_valid_utf8(LINE))
    kept = F.when(fault.isNotNull(), F.raise_error(complaint).cast("boolean")).otherwise(~F.col(FIRST) & (F.col(LINE) != ""))
    last = {name: i for i, name in enumerate(header)}
    columns = [cells[i].alias(header[i]) for i in sorted(last.values())]
    places = [F.col(FILE).alias(SOURCE_FILE), F.col(OFFSET).alias(SOURCE_OFFSET)] if positions else []
    return records.where(kept).select(*columns, *places)


def read_delimited(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType | Mapping[str, T.DataType] | None = None,
    *,
    promote_int: bool = False,
    multi_line: bool = False,
    positions: bool = False,
) -> DataFrame:
    """Read ``.csv`` text into int, double and string columns.

    With ``schema`` the file is read once and a cell of another type stops the query.  Without it one pass
    over the text finds the types: every cell of a column must be an int32, or every cell a float, or every
    cell text; ``promote_int`` also takes integers in a float column.  Empty cells are the text ''.

    ``multi_line`` allows line breaks inside quotes, at the price of a second pass (see ``text_records``).  ``positions``
    adds the columns ``POSITIONS``, by which ``with_index`` finds the order of the input.  A file's first line is its
    header.  Empty lines are skipped; a line of blanks is a record of one field, so an error when the header has more.
    Bytes that are not UTF-8 are an error.
    """
    cells = read_text_cells(spark, path, multi_line=multi_line, positions=positions)
    names = [name for name in cells.columns if not (positions and name in POSITIONS)]
    if schema is None:
        return apply_types(
            cells, resolve_types(cells, promote_int, leave_out=POSITIONS if positions else ()), promote_int
        )
    if not isinstance(schema, T.StructType):
        schema = T.StructType([T.StructField(name, kind) for name, kind in schema.items()])
    if sorted(schema.names) != sorted(names):
        raise TableError(f"the header is {names}, the schema has {schema.names}")
    wrong = unsupported_columns(schema)
    if wrong:
        raise TableError(f"columns of an unsupported type: {', '.join(wrong)}")
    typed = [checked_cast(column(f.name), f.dataType, f.name, promote_int).alias(f.name) for f in schema]
    return cells.select(*typed, *(quoted(name) for name in cells.columns if name not in names))


def locate_type_fault(
    spark: SparkSession, path: str | Sequence[str], *, promote_int: bool = False, multi_line: bool = False
) -> DataFrame:
    """Where ``read_delimited`` finds mixed kinds: (index of the row before the first fault, attribute).

    Numbers the rows of the text (see ``with_index``), so it costs more than finding that kinds are mixed.
    """
    cells = read_text_cells(spark, path, multi_line=multi_line, positions=True)
    return first_type_mismatch(with_index(cells, block=POSITIONS, name=ROW), ROW, promote_int)


def ragged_rows(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Records whose number of fields is not the header's, lines of blanks among them: rows (file, record)."""
    check_suffix(path, ".csv")
    header, text = read_header(spark, path)
    blank = _blank() if len(header) > 1 else F.lit(False)
    short = F.is_valid_utf8(LINE) & ((F.col(CORRUPT).isNotNull() & ~_blank()) | blank)
    found = _records(spark, path, header, text, False).where(~F.col(FIRST) & (F.col(LINE) != "") & short)
    return found.select(F.col(FILE).alias("file"), F.col(LINE).alias("record"))


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write ``df`` as ';'-separated files with a header; NULL and '' become empty cells.

    Blanks around text are kept.  A table of one column writes '' as a quoted empty cell, since a blank
    line would be skipped on reading.
    """
    check_suffix(path, ".csv")
    (
        df.write.mode(mode)
        .option("sep", DELIMITER)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("emptyValue", "" if len(df.columns) > 1 else '""')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
