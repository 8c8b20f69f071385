"""The choice of format for attribute tables; the input format also decides the output format."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from levyframe.errors import TableError
from levyframe.functions.names import quoted
from levyframe.operators.layout import INDEX, output_layout
from levyframe.sources.arrow_ipc import SUFFIX as ARROW_SUFFIX
from levyframe.sources.arrow_ipc import register
from levyframe.sources.delimited import check_suffix, read_delimited, write_delimited
from levyframe.storage import exists, qualified

FORMATS = ("csv", "arrow")


def check_format(fmt: str) -> None:
    if fmt not in FORMATS:
        raise TableError(f"format must be one of {', '.join(FORMATS)}, not {fmt!r}")


def read_households(
    spark: SparkSession, path: str, fmt: str, *, columns: Sequence[str] | None = None, **options: object
) -> DataFrame:
    """Read an attribute table; ``options`` are those of ``read_delimited`` or of the ``arrow_ipc`` format.

    ``columns``: those to read, in this order; of Arrow files nothing else is decoded.  Filters on integers and text run
    in the tasks that read Arrow files where ``spark.sql.python.filterPushdown.enabled`` is set.
    """
    check_format(fmt)
    if fmt == "csv":
        table = read_delimited(spark, path, **options)
        return table if columns is None else table.select(*map(quoted, columns))
    check_suffix(path, ARROW_SUFFIX)
    register(spark)
    # The sizes Spark uses for its own file sources.
    sizes = {
        "splitBytes": _bytes(spark.conf.get("spark.sql.files.maxPartitionBytes")),
        "parallelism": spark.sparkContext.defaultParallelism,
        "pushFilters": spark.conf.get("spark.sql.python.filterPushdown.enabled", "false"),
    }
    if columns is not None:
        sizes["columns"] = json.dumps(list(columns))
    return spark.read.format("arrow_ipc").options(**{**sizes, **options}).load(qualified(spark, path))


def _bytes(size: str) -> int:
    """The number in a size setting such as 134217728b, 128m or 1gb."""
    number = size.lower().rstrip("b")
    unit = "kmgtp".find(number[-1]) + 1
    return int(number[:-1] if unit else number) * 1024**unit


def write_arrow_ipc(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Write int, double and string columns as Arrow files, one per task; an existing path is an error."""
    check_suffix(path, ARROW_SUFFIX)
    register(df.sparkSession)
    if not overwrite and exists(df.sparkSession, path):
        raise TableError(f"{path} exists already")
    mode = "overwrite" if overwrite else "append"
    df.write.format("arrow_ipc").mode(mode).save(qualified(df.sparkSession, path))


def result_path(folder: str, which: str, fmt: str, prefix: str | None = None) -> str:
    """Where a result goes: ``[<prefix>-]<which>-results.<format>`` below ``folder``."""
    check_format(fmt)
    start = f"{prefix}-" if prefix is not None else ""
    return f"{folder.rstrip('/')}/{start}{which}-results.{fmt}"


def write_result(
    df: DataFrame,
    attributes: list[str],
    results: list[str],
    fmt: str,
    path: str,
    *,
    indexed: bool = True,
) -> None:
    """Write attributes and results in the layout of the format; delimited text starts with the index."""
    check_format(fmt)
    if fmt == "csv":
        index = INDEX if indexed else None
        write_delimited(output_layout(df, attributes, results, fmt, index), path, mode="overwrite")
    else:
        write_arrow_ipc(output_layout(df, attributes, results, fmt), path, overwrite=True)
