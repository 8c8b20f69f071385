"""Sizes of portions that follow from an executor's memory."""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def executor_bytes(spark: SparkSession) -> int:
    """The heap of an executor; that of the driver in a local session."""
    local = spark.conf.get("spark.master", "").startswith("local[") or spark.conf.get("spark.master", "") == "local"
    text = spark.conf.get("spark.driver.memory" if local else "spark.executor.memory", "1g")
    found = re.fullmatch(r"([0-9]+)([bkmgt]?)b?", text.strip().lower())
    return int(found[1]) * _UNITS[found[2]] if found else 1 << 30


def share_of_executor(spark: SparkSession, parts: int, least: int) -> int:
    """An executor's heap divided by ``parts``, but ``least`` at least."""
    return max(least, executor_bytes(spark) // parts)
