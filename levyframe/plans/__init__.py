"""Whole runs: files to files, and the registered queries with their oracles."""

from levyframe.plans.scenario import run_scenario

__all__ = ["run_scenario"]
