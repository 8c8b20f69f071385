"""Scenario comparison: a baseline policy, a variant policy, and variant minus baseline."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.errors import ResultError
from levyframe.functions.names import column, quoted
from levyframe.operators.evaluate import check_free, evaluate
from levyframe.operators.rules import Policy

BASELINE, VARIANT, DIFF = "baseline_", "variant_", "diff_"


def _difference(name: str, baseline_names: Sequence[str], baseline: Column, variant: Column) -> Column:
    if name in baseline_names:
        return variant - baseline
    return F.lit(None).cast("double")


def compare_policies(
    df: DataFrame,
    baseline: Policy,
    variant: Policy,
    *,
    attributes: Sequence[str] | None = None,
    strict_dependencies: bool = False,
    null_results: str = "error",
    trust_source: bool = False,
    compiled: bool = False,
    faults: bool = False,
) -> DataFrame:
    """Both policies and their difference on the same row, in one pass over the table.

    Adds ``baseline_<component>``, ``variant_<component>`` and, per component of the variant,
    ``diff_<component>``: variant minus baseline, NULL when the baseline has no such component.  There is
    no join: both results come from the same row.
    """
    check_free(df.sparkSession, df.columns, [DIFF + name for name in variant.outputs])
    wide = evaluate(
        df,
        [(BASELINE, baseline), (VARIANT, variant)],
        attributes=attributes,
        strict_dependencies=strict_dependencies,
        null_results=null_results,
        trust_source=trust_source,
        compiled=compiled,
        faults=faults,
    )
    return wide.select(
        "*",
        *(
            _difference(name, baseline.outputs, column(BASELINE + name), column(VARIANT + name)).alias(DIFF + name)
            for name in variant.outputs
        ),
    )


def results_of(wide: DataFrame, which: str, attributes: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One of the three results of ``compare_policies``: the attributes and the plain component names."""
    check_free(wide.sparkSession, attributes, names)
    return wide.select(
        *map(quoted, attributes), *(column(which + name).alias(name) for name in names)
    )


def difference_results(df: DataFrame, baseline: Policy, variant: Policy, **options: object) -> DataFrame:
    """Variant minus baseline per component of the variant."""
    return results_of(compare_policies(df, baseline, variant, **options), DIFF, df.columns, variant.outputs)


def key_reports(tables: Mapping[str, DataFrame], key: Sequence[str]) -> dict[str, tuple[int, int, bool]]:
    """Per table (rows, size of the largest group of one key, whether some key is NULL), in one job.

    Reads the key columns only.  Counts are combined before the shuffle, so a hot key costs nothing, and a
    table bucketed by the key is not shuffled at all.
    """
    keys = [column(name) for name in key]
    any_null = reduce(or_, (name.isNull() for name in keys))
    reports = [
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("__n"))
        .agg(F.sum("__n").alias("rows"), F.max("__n").alias("largest"), F.max(any_null).alias("has_null"))
        .select(F.lit(name).alias("name"), "*")
        for name, df in tables.items()
    ]
    found = reduce(DataFrame.unionAll, reports).collect()
    return {row["name"]: (row["rows"] or 0, row["largest"] or 0, bool(row["has_null"])) for row in found}


def diff_results(
    baseline: DataFrame,
    variant: DataFrame,
    key: str | Sequence[str],
    *,
    check_rows: bool = True,
    bucketed: bool = False,
) -> DataFrame:
    """Variant minus baseline for two stored result tables that share a unique key.

    Every column other than the key is a result.  A key that is NULL or occurs twice on one side stops the query, and
    so does, unless ``check_rows`` is False, a key that only one side has; without that check the variant's keys count.

    Both tables are tagged and grouped by the key in one shuffle, combined before it, so no key is hot and nothing is
    joined.  ``bucketed`` is for tables bucketed by the key: keys are then checked in a job of their own, reading key
    columns only, and the tables are joined without a shuffle; for it, only the numbers of rows must agree.
    """
    key = [key] if isinstance(key, str) else list(key)
    for side, table in (("baseline", baseline), ("variant", variant)):
        wrong = [f.name for f in table.schema if f.name not in key and not isinstance(f.dataType, T.NumericType)]
        if wrong:
            raise ResultError(f"{side} results: columns that are not numbers: {', '.join(wrong)}")
    if bucketed:
        return _joined(baseline, variant, key, check_rows)
    names = [name for name in variant.columns if name not in key]
    shared = [name for name in names if name in baseline.columns]
    base_kinds = {f.name: f.dataType for f in baseline.schema}
    kinds = {f.name: f.dataType for f in variant.schema}
    parts = []
    for side, table in enumerate((baseline, variant)):
        columns = [column(name).alias(f"k{i}") for i, name in enumerate(key)]
        columns += [F.lit(1 - side).alias("in_baseline"), F.lit(side).alias("in_variant")]
        for i, name in enumerate(names):
            columns.append((column(name) if side else F.lit(None).cast(kinds[name])).alias(f"v{i}"))
            if name in shared:
                columns.append((F.lit(None).cast(base_kinds[name]) if side else column(name)).alias(f"b{i}"))
        parts.append(table.select(*columns))
    keys = [f"k{i}" for i in range(len(key))]
    values = [name for name in parts[0].columns if name not in keys and not name.startswith("in_")]
    met = parts[0].unionByName(parts[1]).groupBy(*keys).agg(
        F.sum("in_baseline").alias("in_baseline"), F.sum("in_variant").alias("in_variant"), *(F.max(v).alias(v) for v in values)
    )
    named = ", ".join(key)
    shown = F.concat_ws(", ", *(F.col(k).cast("string") for k in keys))
    fault = F.when(reduce(or_, (F.col(k).isNull() for k in keys)), F.lit(f"key ({named}) is NULL in some row"))
    for side in ("baseline", "variant"):
        times = F.col(f"in_{side}")
        many = F.concat(F.lit(f"{side} results: key ({named}) occurs "), times.cast("string"), F.lit(" times: "), shown)
        fault = fault.when(times > 1, many)
        if check_rows:
            fault = fault.when(times == 0, F.concat(F.lit(f"{side} results lack the key ({named}): "), shown))
    sound = F.when(fault.isNotNull(), F.raise_error(fault).cast("boolean")).otherwise(F.col("in_variant") > 0)
    return met.where(sound).select(
        *(F.col(k).alias(name) for k, name in zip(keys, key, strict=True)),
        *(_difference(name, shared, F.col(f"b{i}"), F.col(f"v{i}")).alias(name) for i, name in enumerate(names)),
    )


def _joined(baseline: DataFrame, variant: DataFrame, key: list[str], check_rows: bool) -> DataFrame:
    reports = key_reports({"baseline": baseline, "variant": variant}, key)
    for side, (_, largest, has_null) in reports.items():
        if has_null:
            raise ResultError(f"{side} results: key ({', '.join(key)}) is NULL in some row")
        if largest > 1:
            raise ResultError(f"{side} results: key ({', '.join(key)}) occurs up to {largest} times")
    if check_rows and reports["baseline"][0] != reports["variant"][0]:
        raise ResultError(
            f"baseline has {reports['baseline'][0]} rows, variant has {reports['variant'][0]} rows"
        )
    baseline_names = [name for name in baseline.columns if name not in key]
    variant_names = [name for name in variant.columns if name not in key]
    left = variant.select(
        *(column(name).alias(f"k{i}") for i, name in enumerate(key)),
        *(column(name).alias(f"v{i}") for i, name in enumerate(variant_names)),
    )
    shared = [name for name in variant_names if name in baseline_names]
    right = baseline.select(
        *(column(name).alias(f"j{i}") for i, name in enumerate(key)),
        *(column(name).alias(f"b{variant_names.index(name)}") for name in shared),
    )
    same_key = [F.col(f"k{i}") == F.col(f"j{i}") for i in range(len(key))]
    joined = left.join(right, same_key, "left")
    return joined.select(
        *(F.col(f"k{i}").alias(name) for i, name in enumerate(key)),
        *(
            _difference(name, baseline_names, F.col(f"b{i}"), F.col(f"v{i}")).alias(name)
            for i, name in enumerate(variant_names)
        ),
    )
