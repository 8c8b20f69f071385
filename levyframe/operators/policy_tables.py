"""Policies as tables, many at once.

``documents``   one row per policy document: source, policy, label, components (nested), error
``components``  one row per component, with its place in the document and its rank in evaluation order
``parameters``  one row per parameter name, value and label of a component
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.functions.names import column
from levyframe.operators.ordering import with_rank

# A source text binds a name where a line starts with "def <name>" (decorated or not), "class <name>", "<name> =" (a lambda,
# another function, a partial), "<name>: <type> =", or is an import that ends with the name.
DEFINITION = (
    r"(?mU)^(?:async[ \t]+)?(?:def|class)[ \t]+[^\W\d]\w*"
    r"|^[^\W\d]\w*(?=[ \t]*(?::[^=\n]*)?=(?!=))"
    r"|^(?:from[ \t]+[\w.]+[ \t]+)?import[ \t]+[^#\n]*?\b[^\W\d]\w*(?=[ \t]*(?:#.*)?$)"
)
DEFINED_NAME = r"(?U)([^\W\d]\w*)$"


def policies(documents: DataFrame) -> DataFrame:
    """One row per valid document: source, policy, label, number of components."""
    return documents.where("error IS NULL").select(
        "source", "policy", "label", F.size("components").alias("components")
    )


def policy_errors(documents: DataFrame) -> DataFrame:
    """One row per document that is not a policy, with the reason."""
    return documents.where("error IS NOT NULL").select("source", "error")


def components(documents: DataFrame) -> DataFrame:
    """One row per component with its position in the document and its rank by logical order.

    The rank comes from sorting the document's own array, so nothing is shuffled; ties keep file order.
    """
    placed = F.transform(
        F.col("components"),
        lambda part, at: F.struct(part["logical_order"].alias("order"), at.alias("at"), part.alias("part")),
    )
    ranked = documents.where("error IS NULL").select(
        "source", "policy", F.posexplode(F.sort_array(placed)).alias("rank", "entry")
    )
    part = "entry.part."
    return ranked.select(
        "source",
        "policy",
        (F.col("rank") + 1).alias("rank"),
        (F.col("entry.at") + 1).alias("position"),
        F.col(part + "name").alias("component"),
        F.col(part + "label").alias("label"),
        F.col(part + "logical_order").alias("logical_order"),
        F.col(part + "parameter_names").alias("parameter_names"),
        F.col(part + "parameter_labels").alias("parameter_labels"),
        F.col(part + "parameter_values").alias("parameter_values"),
        F.col(part + "dependencies").alias("dependencies"),
        F.col(part + "function").alias("function"),
    )


def ordered_components(df: DataFrame, policy: Sequence[str], order: str, position: str) -> DataFrame:
    """Rank components by logical order within their policy, ties by position, for any component table.

    ``position`` must be unique within a policy.  A policy may hold any share of the rows (see ``with_rank``).
    """
    return with_rank(df, policy, [order, position], order_is_total=True)


def _paired(df: DataFrame, keep: Sequence[str], names: str, others: str, target: str) -> DataFrame:
    """Rows of (names[i], others[i]) up to the shorter of the two lists; a missing list is empty."""
    length = F.least(*(F.coalesce(F.array_size(column(part)), F.lit(0)) for part in (names, others)))
    cut = F.slice(column(names), F.lit(1), length)
    return df.select(
        *(column(name) for name in keep),
        column(others).alias("__others"),
        F.posexplode(cut).alias("__at", "name"),
    ).select(
        *(column(name) for name in keep),
        (F.col("__at") + 1).alias("parameter_position"),
        "name",
        F.get("__others", F.col("__at")).alias(target),
    )


def parameter_values(
    df: DataFrame, keep: Sequence[str], names: str = "parameter_names", values: str = "parameter_values"
) -> DataFrame:
    """One row per parameter that has a value, in list order."""
    return _paired(df, keep, names, values, "value")


def parameter_labels(
    df: DataFrame, keep: Sequence[str], names: str = "parameter_names", labels: str = "parameter_labels"
) -> DataFrame:
    """One row per parameter that has a label, in list order."""
    return _paired(df, keep, names, labels, "label")


def _place(df: DataFrame, order: Sequence[str]) -> Column:
    """What orders rows: one long where the order is one or two integers, which aggregates in place; else a struct."""
    kinds = [df.schema[name].dataType for name in order]
    if len(order) == 2 and all(isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)) for kind in kinds):
        first, second = (column(name).cast("long") for name in order)
        return F.shiftleft(first, 32) + second
    if len(order) == 1 and isinstance(kinds[0], T.IntegralType):
        return column(order[0]).cast("long")
    return F.struct(*(column(part) for part in order))


def merged_parameters(
    pairs: DataFrame, policy: Sequence[str], name: str, target: str, order: Sequence[str]
) -> DataFrame:
    """One value (or label) per parameter name of a policy: the last in ``order`` wins.

    One aggregate with partial results, so a hot policy or name is combined before the shuffle.  Of texts only the
    places are aggregated, and the winners' texts fetched by their place, which is unique within a policy and name.
    """
    keys = [*policy, name]
    rows = pairs.select(*(column(part) for part in keys), column(target), _place(pairs, order).alias("__place"))
    kind = pairs.schema[target].dataType
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        last = F.max_by(column(target), F.col("__place"))
        return rows.groupBy(*(column(part) for part in keys)).agg(last.alias(target))
    winners = rows.groupBy(*(column(part).alias(f"__k{i}") for i, part in enumerate(keys))).agg(
        F.max("__place").alias("__last")
    )
    same = F.col("__place").eqNullSafe(F.col("__last"))
    for i, part in enumerate(keys):
        same = same & column(part).eqNullSafe(F.col(f"__k{i}"))
    return winners.join(rows, same).select(*(column(part) for part in keys), column(target))


def dependency_set(df: DataFrame, policy: Sequence[str], dependencies: str = "dependencies") -> DataFrame:
    """The distinct attributes each policy declares: rows (policy, attribute)."""
    return df.select(
        *(column(part) for part in policy), F.explode(column(dependencies)).alias("attribute")
    ).distinct()


def missing_dependencies(
    df: DataFrame, policy: Sequence[str], columns: Sequence[str], dependencies: str = "dependencies"
) -> DataFrame:
    """Declared attributes that a table with ``columns`` lacks: rows (policy, attribute).

    The table's columns are a literal list, so each component is checked in place before the distinct.
    """
    known = F.array(*(F.lit(name) for name in columns)).cast("array<string>")
    lacking = F.array_except(column(dependencies), known)
    return df.select(*(column(part) for part in policy), F.explode(lacking).alias("attribute")).distinct()


def defined_functions(source: Column) -> Column:
    """Names of the functions a source text defines at top level, in order, repeats included."""
    found = F.regexp_extract_all(source, F.lit(DEFINITION), F.lit(0))
    return F.transform(found, lambda text: F.regexp_extract(text, DEFINED_NAME, 1))


def function_resolution(
    df: DataFrame,
    policy: Sequence[str],
    component: str = "component",
    source: str = "function",
    order: Sequence[str] = ("rank",),
) -> DataFrame:
    """Which component's source supplies the function of each component.

    The sources of a policy form one module in evaluation order, a function is looked up by the component's
    name, and a later definition replaces an earlier one.  Rows: policy, component, ``defined_by`` (the
    order values of the winning source, NULL when no source defines the function) and ``function``.

    Every component contributes one lookup and its definitions; one aggregate per (policy, name) pairs them, combined
    before the shuffle, so no name can be hot.  It carries places only; the winners' sources are fetched by (policy,
    place), which is unique.
    """
    entry = "struct<name: string, wanted: boolean>"
    lookup = F.array(F.struct(column(component).alias("name"), F.lit(True).alias("wanted")))
    definitions = F.transform(
        defined_functions(column(source)), lambda name: F.struct(name.alias("name"), F.lit(False).alias("wanted"))
    )
    keys = [column(part) for part in policy]
    place = _place(df, order).alias("__place")
    entries = df.select(
        *keys,
        place,
        F.explode(F.concat(lookup.cast(f"array<{entry}>"), definitions.cast(f"array<{entry}>"))).alias("__entry"),
    ).select(*keys, "__place", F.col("__entry.name").alias("__name"), F.col("__entry.wanted").alias("__wanted"))
    grouped = entries.groupBy(*keys, "__name").agg(
        F.max("__wanted").alias("__wanted"), F.max(F.when(~F.col("__wanted"), F.col("__place"))).alias("__last")
    )
    wanted = grouped.where("__wanted")
    sources = df.select(
        *(column(part).alias(f"__k{i}") for i, part in enumerate(policy)),
        place,
        *(column(part).alias(f"__o{i}") for i, part in enumerate(order)),
        column(source).alias("__source"),
    )
    same = F.col("__last") == F.col("__place")
    for i, part in enumerate(policy):
        same = same & column(part).eqNullSafe(F.col(f"__k{i}"))
    return wanted.join(sources, same, "left").select(
        *keys,
        F.col("__name").alias(component),
        *(F.col(f"__o{i}").alias(f"defined_by_{part}") for i, part in enumerate(order)),
        F.col("__source").alias("function"),
    )
