"""Shape of exported tables: which columns, in which order, and maps of results turned into columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyframe.errors import ResultError
from levyframe.functions.names import column, quoted

INDEX = "Index"


def output_columns(attributes: Sequence[str], results: Sequence[str], fmt: str, index: str | None = None) -> list[str]:
    """Column order of an exported table.

    Delimited: the index, then attributes and results sorted together.  Arrow: sorted attributes, then
    sorted results.  Sorting is by code point.
    """
    clashes = sorted(set(attributes) & set(results))
    if clashes:
        raise ResultError(f"results and attributes share names: {', '.join(clashes)}")
    if index is not None and index in (*attributes, *results):
        raise ResultError(f"{index} is the name of the position column")
    if fmt == "csv":
        names = sorted([*attributes, *results])
    elif fmt == "arrow":
        names = sorted(attributes) + sorted(results)
    else:
        raise ValueError(f"format must be 'csv' or 'arrow', not {fmt!r}")
    return names if index is None else [index, *names]


def output_layout(
    df: DataFrame, attributes: Sequence[str], results: Sequence[str], fmt: str, index: str | None = None
) -> DataFrame:
    """``df`` with exactly the columns of ``output_columns``, in that order."""
    return df.select(*map(quoted, output_columns(attributes, results, fmt, index)))


def result_names(df: DataFrame, results_map: str) -> DataFrame:
    """All names that occur in a map column: rows (name)."""
    return df.select(F.explode(F.map_keys(column(results_map))).alias("name")).distinct()


def results_to_columns(df: DataFrame, results_map: str, names: Sequence[str]) -> DataFrame:
    """Replace a name-to-value map by one double column per name, sorted; NULL where a row lacks the name.

    ``names`` are known from the policy, or from ``result_names``.
    """
    rest = [name for name in df.columns if name != results_map]
    values = column(results_map)
    return df.select(
        *map(quoted, rest),
        *(F.try_element_at(values, F.lit(name)).cast("double").alias(name) for name in sorted(names)),
    )
