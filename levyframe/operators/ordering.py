"""Row positions without a global window.

Rows are numbered inside each task of one write, the write is kept as a table, and only one number per task
(or per file block) has to be added up.  As the numbers are stored, a lost executor cannot change them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.errors import TableError
from levyframe.functions.names import column, quoted
from levyframe.storage import stage

ROW_ID = "__row_id"
TASK_BITS = 33  # monotonically_increasing_id: task number above bit 33, position in the task below
GROUP_TASKS = 1000


def _task(row_id: Column) -> Column:
    return F.shiftright(row_id, TASK_BITS)


def _arranged(df: DataFrame, keys: Sequence[str], order_is_total: bool) -> DataFrame:
    """``df`` staged in the order of ``keys`` with row ids that follow it.

    The table is staged once, so that what it comes from runs once, and the copy is range-partitioned.  Unless the
    keys are said to be unique, a row's place in the first copy breaks ties, so that rows of one key spread over tasks.
    """
    by = [column(name) for name in keys]
    if order_is_total:
        first = stage(df, "given")
    else:
        first = stage(df.withColumn("__tie", F.monotonically_increasing_id()), "given")
        by.append(F.col("__tie"))
    ordered = first.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
    return stage(ordered.withColumn(ROW_ID, F.monotonically_increasing_id()), "arranged")


def with_index(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    *,
    block: Sequence[str] | None = None,
    name: str = "Index",
    order_is_total: bool = False,
) -> DataFrame:
    """Add a column 1..n without gaps, in the order of ``order_by`` or else in input order.

    Input order is the order of the tasks, unless ``block`` names columns that sort the blocks the input
    came in (file and offset, see ``read_delimited(..., positions=True)``; they are dropped from the
    result).  The rows before a block are those before its group (the first of the columns, or ``GROUP_TASKS``
    tasks) and those before it in its group, which a window over the group's blocks adds up.  The driver sees one
    row per group: a file, or a thousand tasks.
    """
    spark = df.sparkSession
    if order_by is not None:
        staged, block = _arranged(df, order_by, order_is_total), None
    else:
        staged = stage(df.withColumn(ROW_ID, F.monotonically_increasing_id()), "indexed")
    task = _task(F.col(ROW_ID))
    blocks = [column(part) for part in block] if block else [F.floor(task / GROUP_TASKS).cast("long"), task]
    keys = [f"__block_{i}" for i in range(len(blocks))]
    keyed = staged.select("*", *(part.alias(key) for part, key in zip(blocks, keys, strict=True)))
    sizes = stage(
        keyed.groupBy(*keys).agg(
            F.min(ROW_ID).alias("__first"), F.max(ROW_ID).alias("__last"), F.count(F.lit(1)).alias("__rows")
        ),
        "blocks",
    )
    together = F.col("__last") - F.col("__first") + 1 == F.col("__rows")
    groups = sizes.groupBy(keys[0]).agg(F.sum("__rows").alias("rows"), F.min(together).alias("together"))
    starts, total = [], 0
    for row in sorted(groups.collect(), key=lambda row: row[0]):
        if not row["together"]:
            raise TableError("the rows of a block are not together; number them before anything shuffles them")
        starts.append((row[0], total))
        total += row["rows"]
    schema = T.StructType([T.StructField(keys[0], sizes.schema[keys[0]].dataType), T.StructField("__before", T.LongType())])
    earlier = Window.partitionBy(keys[0]).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    inside = sizes.withColumn("__inside", F.coalesce(F.sum("__rows").over(earlier), F.lit(0)))
    offsets = inside.join(spark.createDataFrame(starts, schema), keys[0]).select(
        *keys, (F.col("__before") + F.col("__inside") - F.col("__first") + 1).alias("__start")
    )
    placed = keyed.join(offsets, keys)
    kept = [part for part in df.columns if part not in (block or ())]
    return placed.select((F.col(ROW_ID) + F.col("__start")).alias(name), *map(quoted, kept))


def with_rank(
    df: DataFrame,
    group: Sequence[str],
    order_by: Sequence[str],
    name: str = "rank",
    *,
    order_is_total: bool = False,
) -> DataFrame:
    """Add the position 1..k of each row within its group; rows equal in ``order_by`` follow in any order.

    ``order_is_total`` says that (group, order_by) is unique, which saves carrying a tie-breaker.

    The table is range-partitioned by group and order, so a large group is cut over many tasks.  A row's
    rank is its position among the rows of its group in its task plus the rows of the group in earlier
    tasks; those pieces are joined back on (task, group), keys that hold at most one task's rows.
    """
    staged = _arranged(df, [*group, *order_by], order_is_total)
    groups = [column(part).alias(f"__group_{i}") for i, part in enumerate(group)]
    keys = [f"__group_{i}" for i in range(len(group))]
    tagged = staged.select("*", _task(F.col(ROW_ID)).alias("__task"), *groups)
    pieces = tagged.groupBy("__task", *keys).agg(
        F.min(ROW_ID).alias("__first"), F.count(F.lit(1)).alias("__rows")
    )
    # A group has at most one piece per task, however many rows it has.
    earlier = Window.partitionBy(*keys).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        F.col("__task").alias("__piece_task"),
        *(F.col(key).alias(f"__piece{key}") for key in keys),
        (F.coalesce(F.sum("__rows").over(earlier), F.lit(0)) - F.col("__first") + 1).alias("__start"),
    )
    same = F.col("__task") == F.col("__piece_task")
    for key in keys:
        same = same & F.col(key).eqNullSafe(F.col(f"__piece{key}"))
    ranked = tagged.join(pieces, same)
    return ranked.select(
        *map(quoted, df.columns), (F.col(ROW_ID) + F.col("__start")).alias(name)
    )
