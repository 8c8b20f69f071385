"""Column names are data here (attribute, parameter and component names), so they are always quoted."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def quoted(name: str) -> str:
    """``name`` as ``select`` takes it, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    """The top-level column called exactly ``name``."""
    return F.col(quoted(name))


def is_case_sensitive(spark: SparkSession) -> bool:
    return spark.conf.get("spark.sql.caseSensitive", "false").lower() == "true"


def folded(spark: SparkSession, names: Iterable[str]) -> list[str]:
    """The names as Spark compares them under the session's case rule."""
    return list(names) if is_case_sensitive(spark) else [name.lower() for name in names]


def case_clashes(spark: SparkSession, names: Iterable[str]) -> list[list[str]]:
    """Groups of different names that Spark would take for one column."""
    names = list(names)
    groups: dict[str, set[str]] = defaultdict(set)
    for name, form in zip(names, folded(spark, names)):
        groups[form].add(name)
    return [sorted(group) for group in groups.values() if len(group) > 1]
