"""Rules whose parameters come from a table: each row names the policy, or whatever the parameters hang on."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyframe.errors import PolicyError
from levyframe.functions.names import column
from levyframe.operators.compile_rules import compile_policy
from levyframe.operators.evaluate import apply_policy
from levyframe.operators.rules import COLUMN, Policy

_BOUND, _KEY = "__parameters", "__parameters_of"


def apply_policy_by_key(
    df: DataFrame,
    policy: Policy,
    key: str,
    parameters: DataFrame,
    *,
    name: str = "name",
    value: str = "value",
    compiled: bool = False,
    **options: object,
) -> DataFrame:
    """``apply_policy`` with parameters bound by row: thousands of variants of one policy in one pass.

    ``parameters`` has rows (key, name, value), one for each name of a key (see ``merged_parameters``).  The policy's own
    parameters are the defaults: they hold for keys, NULL among them, and names that the table lacks, and for NULL values.  A name
    that the policy does not have, and a name that stands twice under one key, are errors.

    The table becomes one map for each key and is joined by it.  Adaptive execution broadcasts it where it is small, and
    else cuts a key that has very many rows; nothing is multiplied.  Rules are columns, or Python that compiles.
    """
    if compiled:
        policy = compile_policy(policy, df.schema, **{k: v for k, v in options.items() if k in ("attributes", "strict_dependencies", "null_results")})[0]
    if policy.kind != COLUMN:
        stay = ", ".join(c.name for c in policy.ordered if c.kind != COLUMN)
        raise PolicyError(f"policy {policy.name}: parameters by row are for rules that are columns, not {stay}")
    if clash := {_BOUND, _KEY} & set(df.columns):
        raise PolicyError(f"columns {sorted(clash)} are there already")
    defaults = dict(policy.parameters)
    unknown = F.concat(F.lit(f"policy {policy.name} has no parameter "), F.coalesce(column(name), F.lit("NULL")))
    known = F.coalesce(column(name).isin(list(defaults)), F.lit(False))
    named = F.when(known, column(name)).otherwise(F.raise_error(unknown).cast("string"))
    entries = F.collect_list(F.struct(named, column(value).cast("double")))
    bound = parameters.groupBy(column(key).alias(_KEY)).agg(F.map_from_entries(entries).alias(_BOUND))
    joined = df.join(bound, column(key) == F.col(_KEY), "left").drop(_KEY)
    values = {n: F.coalesce(F.col(_BOUND)[n], F.lit(float(default))) for n, default in defaults.items()}
    by_row = replace(policy, shared_parameters=values)
    options.setdefault("attributes", list(df.columns))
    return apply_policy(joined, by_row, **options).drop(_BOUND)
