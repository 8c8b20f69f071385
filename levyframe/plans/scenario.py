"""A run from files to files: an attribute table, a baseline policy, and perhaps a variant."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from levyframe.errors import TableError
from levyframe.operators.compare import BASELINE, DIFF, VARIANT, compare_policies, results_of
from levyframe.operators.evaluate import apply_policy
from levyframe.operators.layout import INDEX
from levyframe.operators.ordering import with_index
from levyframe.operators.rules import Policy
from levyframe.sources.delimited import POSITIONS
from levyframe.sources.households import read_households, result_path, write_result
from levyframe.sources.policy_files import load_policy
from levyframe.storage import stage, temporary_stages

# The words that name the three results.
RESULT_WORDS = {BASELINE: "baseline", VARIANT: "variante", DIFF: "diff"}


def run_scenario(
    spark: SparkSession,
    households: str,
    fmt: str,
    baseline: str | Policy,
    variant: str | Policy | None = None,
    *,
    folder: str,
    prefix: str | None = None,
    functions: Mapping[str, Callable[..., Any]] | None = None,
    trust_source: bool = False,
    compiled: bool = False,
    **read_options: Any,
) -> dict[str, str]:
    """Read, check, evaluate, compare and write; returns the path of each result written.

    Policies are ``Policy`` objects or ``.toml`` files, whose Python source runs only with
    ``trust_source=True`` unless it can be ``compiled`` to columns.  Results of which several are written, or that need row positions, are staged
    first: the input is read and each rule runs once per row, and a rule that fails leaves no result behind.
    """
    positions = list(POSITIONS) if fmt == "csv" else []
    options = {**read_options, "positions": True} if fmt == "csv" else read_options
    table = read_households(spark, households, fmt, **options)
    attributes = [name for name in table.columns if name not in positions]
    first = _policy(spark, baseline, functions)
    second = None if variant is None else _policy(spark, variant, functions)
    if second is None:
        wide = apply_policy(table, first, prefix=BASELINE, attributes=attributes, trust_source=trust_source, compiled=compiled)
        outputs = {BASELINE: first.outputs}
    else:
        wide = compare_policies(table, first, second, attributes=attributes, trust_source=trust_source, compiled=compiled)
        outputs = {BASELINE: first.outputs, VARIANT: second.outputs, DIFF: second.outputs}
    with temporary_stages(spark):
        return _written(spark, wide, fmt, attributes, positions, outputs, folder, prefix, second is not None)


def _written(
    spark: SparkSession,
    wide: DataFrame,
    fmt: str,
    attributes: list[str],
    positions: list[str],
    outputs: Mapping[str, list[str]],
    folder: str,
    prefix: str | None,
    several: bool,
) -> dict[str, str]:
    kept = attributes
    if fmt == "csv":
        if INDEX in attributes:
            raise TableError(f"{INDEX} is the name of the position column")
        wide = with_index(wide, block=positions, name=INDEX)
        kept = [INDEX, *attributes]
    elif several:
        wide = stage(wide, "scenario")
    if wide.isEmpty():
        raise TableError("the table has no row")
    written = {RESULT_WORDS[which]: result_path(folder, RESULT_WORDS[which], fmt, prefix) for which in outputs}

    def write(which: str) -> None:
        names = outputs[which]
        write_result(results_of(wide, which, kept, names), attributes, names, fmt, written[RESULT_WORDS[which]])

    if fmt == "csv":
        # Side by side: a result has its own columns and header, and reads only those of the staged table.
        with ThreadPoolExecutor(len(outputs)) as pool:
            list(pool.map(write, outputs))
    else:  # a registered Python source is known to the session of this thread alone
        for which in outputs:
            write(which)
    return written


def _policy(spark: SparkSession, policy: str | Policy, functions: Mapping[str, Callable[..., Any]] | None) -> Policy:
    return policy if isinstance(policy, Policy) else load_policy(spark, policy, functions)
