"""Ordered, parameterised rules over large tables, and the comparison of two rule sets."""

from levyframe.operators import *  # noqa: F403
from levyframe.operators import __all__ as _operators
from levyframe.sources import *  # noqa: F403
from levyframe.plans.scenario import run_scenario
from levyframe.sources import __all__ as _sources
from levyframe.storage import remove_staged

__all__ = [*_operators, *_sources, "remove_staged", "run_scenario"]
