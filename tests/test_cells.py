from __future__ import annotations

import math
import random
import re

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe import apply_types, column_types, resolve_types
from levyframe.errors import TableError
from levyframe.functions.cells import FLOAT, INTEGER, TEXT, cast_cell, cell_kind, checked_cast

CASES = {
    "5": INTEGER, "+5": INTEGER, "-0": INTEGER, "007": INTEGER, "2147483647": INTEGER, "-2147483648": INTEGER,
    "2147483648": FLOAT, "3000000000": FLOAT, "5.": FLOAT, ".5": FLOAT, "1e5": FLOAT, "1E-5": FLOAT, "-.5e+3": FLOAT,
    "iNf": FLOAT, "-Infinity": FLOAT, "NaN": FLOAT, "-nan": FLOAT,
    " 5 ": TEXT, "1d": TEXT, "1f": TEXT, "1_000": TEXT, "": TEXT, ".": TEXT, "e5": TEXT, "1e": TEXT, "0x10": TEXT,
    "5\n": TEXT, "--5": TEXT, "1,5": TEXT, "٣": TEXT, "infinit": TEXT, "+": TEXT,
}


def kinds(spark, cells):
    df = spark.createDataFrame([(i, cell) for i, cell in enumerate(cells)], "i int, cell string")
    return [row.kind for row in df.select("i", cell_kind(F.col("cell")).alias("kind")).orderBy("i").collect()]


def test_edge_cases(spark):
    assert dict(zip(CASES, kinds(spark, CASES))) == CASES


def test_null_is_text(spark):
    assert kinds(spark, [None]) == [TEXT]


def brute_force_kind(cell: str) -> int:
    if re.fullmatch(r"[+-]?[0-9]+", cell):
        return INTEGER if -(2**31) <= int(cell) < 2**31 else FLOAT
    body = cell[1:] if cell[:1] in ("+", "-") else cell
    if body.lower() in ("inf", "infinity", "nan"):
        return FLOAT
    mantissa, mark, exponent = body.lower().partition("e")
    if mark and not re.fullmatch(r"[+-]?[0-9]+", exponent):
        return TEXT
    whole, dot, rest = mantissa.partition(".")
    digits = whole + rest
    return FLOAT if digits and re.fullmatch("[0-9]+", digits) else TEXT


def test_random_cells_against_brute_force(spark):
    random.seed(7)
    cells = ["".join(random.choices("0123456789+-.eE_ dnaif", k=random.randint(0, 6))) for _ in range(4000)]
    assert kinds(spark, cells) == [brute_force_kind(cell) for cell in cells]


def test_float_values(spark):
    df = spark.createDataFrame([("1e5",), (".5",), ("5.",), ("-nan",), ("+inf",), ("1e999",)], "cell string")
    values = [row[0] for row in df.select(cast_cell(F.col("cell"), T.DoubleType())).collect()]
    assert values[:3] == [1e5, 0.5, 5.0]
    assert math.isnan(values[3]) and values[4:] == [math.inf, math.inf]


def test_resolved_types(spark):
    df = spark.createDataFrame([("1", "1.5", "a", ""), ("-2", "2e3", "b", None)], "i string, d string, s string, e string")
    types = resolve_types(df)
    assert types == {"i": T.IntegerType(), "d": T.DoubleType(), "s": T.StringType(), "e": T.StringType()}
    assert [tuple(r) for r in apply_types(df, types).collect()] == [(1, 1.5, "a", ""), (-2, 2000.0, "b", "")]


def test_whole_number_among_floats(spark):
    df = spark.createDataFrame([("500.5",), ("500",)], "revenue string")
    assert column_types(df).first()["type"] == "mixed"
    with pytest.raises(TableError, match="revenue"):
        resolve_types(df)
    types = resolve_types(df, promote_int=True)
    assert sorted(r[0] for r in apply_types(df, types).collect()) == [500.0, 500.5]


def test_promotion_does_not_touch_text_or_pure_integers(spark):
    df = spark.createDataFrame([("5", "1", "1.5"), ("x", "2", "y")], "a string, b string, c string")
    found = {row["attribute"]: row["type"] for row in column_types(df, promote_int=True).collect()}
    assert found == {"a": "mixed", "b": "int", "c": "mixed"}


def test_types_of_no_rows(spark):
    with pytest.raises(TableError, match="no row"):
        resolve_types(spark.createDataFrame([], "a string"))


def test_checked_cast(spark):
    df = spark.createDataFrame([("5",), ("6.5",)], "cell string")
    cell = F.col("cell")
    assert [r[0] for r in df.select(checked_cast(cell, T.StringType(), "cell")).collect()] == ["5", "6.5"]
    assert [r[0] for r in df.select(checked_cast(cell, T.DoubleType(), "cell", True)).collect()] == [5.0, 6.5]
    for wanted in (T.IntegerType(), T.DoubleType()):
        with pytest.raises(Exception, match="column cell: not a"):
            df.select(checked_cast(cell, wanted, "cell")).collect()
