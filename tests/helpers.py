"""What several test modules use."""

from __future__ import annotations


def rows(df):
    return sorted((tuple(row) for row in df.collect()), key=repr)


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
