"""Strict typing of text cells: a cell is an int32, else a float, else text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER, FLOAT, TEXT = 0, 1, 2
KIND_NAMES = {INTEGER: "int", FLOAT: "double", TEXT: "string"}
KIND_TYPES = {INTEGER: T.IntegerType(), FLOAT: T.DoubleType(), TEXT: T.StringType()}

# \A and \z, because $ would also accept a trailing newline.
INTEGER_PATTERN = r"\A[+-]?[0-9]+\z"
FLOAT_PATTERN = (
    r"\A[+-]?(?i:inf|infinity|nan|([0-9]+[.]?[0-9]*|[.][0-9]+)(e[+-]?[0-9]+)?)\z"
)
NAN_PATTERN = r"\A[+-]?(?i:nan)\z"


def cell_kind(cell: Column) -> Column:
    """0 for an int32, 1 for any other number, 2 for text; an empty or NULL cell is text.

    The patterns come before the cast because Spark's own casts also take blanks around the digits and
    the suffixes ``d`` and ``f``.  An integer that does not fit into 32 bits is a float.
    """
    cell = F.coalesce(cell, F.lit(""))
    return (
        F.when(cell.rlike(INTEGER_PATTERN) & cell.try_cast("int").isNotNull(), F.lit(INTEGER))
        .when(cell.rlike(FLOAT_PATTERN), F.lit(FLOAT))
        .otherwise(F.lit(TEXT))
    )


def as_float(cell: Column) -> Column:
    """The float in a cell of kind 0 or 1; signed NaN is spelt out, as Spark's cast does not know it."""
    return F.when(cell.rlike(NAN_PATTERN), F.lit(float("nan"))).otherwise(cell.try_cast("double"))


def cast_cell(cell: Column, data_type: T.DataType) -> Column:
    """The value of a cell whose kind is already known to suit ``data_type``."""
    cell = F.coalesce(cell, F.lit(""))
    if isinstance(data_type, T.IntegerType):
        return cell.try_cast("int")
    if isinstance(data_type, T.DoubleType):
        return as_float(cell)
    return cell


def checked_cast(cell: Column, data_type: T.DataType, name: str, promote_int: bool = False) -> Column:
    """The value of a cell under a declared type; a cell of another kind stops the query.

    Text accepts every cell.  A double column accepts integer cells only with ``promote_int``.
    """
    if isinstance(data_type, T.StringType):
        return cast_cell(cell, data_type)
    kind = cell_kind(cell)
    fits = kind == INTEGER
    if isinstance(data_type, T.DoubleType):
        fits = kind.isin(INTEGER, FLOAT) if promote_int else kind == FLOAT
    complaint = F.concat(
        F.lit(f"column {name}: not a {data_type.simpleString()}: '"), F.coalesce(cell, F.lit("")), F.lit("'")
    )
    return F.when(fits, cast_cell(cell, data_type)).otherwise(
        F.raise_error(complaint).cast(data_type)
    )
