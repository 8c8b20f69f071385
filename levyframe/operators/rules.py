"""Policies: ordered, parameterised components, each one function of (variables, parameters, attributes)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from itertools import groupby
from types import MappingProxyType
from typing import Any

from levyframe.errors import PolicyError

COLUMN, PYTHON, VECTOR, MIXED = "column", "python", "vector", "mixed"


@dataclass(frozen=True)
class Component:
    """One rule.

    ``function(variables, parameters, attributes)`` gets the earlier results, all parameters of the policy
    and the attributes of the row.  With ``kind="column"`` the first and the last hold Columns and the
    function returns a Column; with ``kind="python"`` they hold plain values of one row and it returns a
    number; with ``kind="vector"`` they hold NumPy arrays of a batch of rows and it returns an array as long, or a
    number.  A component read from a policy file may carry Python ``source`` instead of a function.
    """

    name: str
    function: Callable[..., Any] | None = None
    parameters: Mapping[str, float] = field(default_factory=dict)
    logical_order: int = 0
    dependencies: Sequence[str] = ()
    label: str = ""
    kind: str = COLUMN
    source: str | None = None
    extra_outputs: Sequence[str] = ()
    parameter_labels: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind not in (COLUMN, PYTHON, VECTOR):
            raise PolicyError(
                f"component {self.name}: kind must be 'column', 'python' or 'vector', not {self.kind!r}"
            )
        if self.function is None and self.source is None:
            raise PolicyError(f"component {self.name} has neither a function nor source text")
        if self.function is None and self.kind == COLUMN:
            raise PolicyError(f"component {self.name}: source text cannot be a 'column' component")


@dataclass(frozen=True)
class Policy:
    """A named set of components; evaluation follows ``logical_order``, ties keep the given order.

    Components may be of different kinds; each run of one kind in that order is a step of the plan.
    """

    name: str
    components: Sequence[Component]
    label: str = ""
    shared_parameters: Mapping[str, float] | None = None  # of the policy that this is a part of, or Columns by row

    def __post_init__(self) -> None:
        if not self.components:
            raise PolicyError(f"policy {self.name} has no component")

    @property
    def kind(self) -> str:
        kinds = {component.kind for component in self.components}
        return kinds.pop() if len(kinds) == 1 else MIXED

    @property
    def parts(self) -> list[Policy]:
        """Policies of one kind each that make up this one when evaluated in turn."""
        runs = [list(run) for _, run in groupby(self.ordered, key=lambda component: component.kind)]
        parts = [Policy(self.name, run, self.label, self.parameters) for run in runs]
        repeated = [name for name, times in Counter(n for part in parts for n in part.outputs).items() if times > 1]
        if repeated:
            raise PolicyError(f"policy {self.name}: components of several kinds compute {', '.join(sorted(repeated))}")
        return parts

    @property
    def ordered(self) -> list[Component]:
        return sorted(self.components, key=lambda component: component.logical_order)

    @property
    def parameters(self) -> Mapping[str, float]:
        """All parameter values by name; every component sees all of them, the later component wins."""
        if self.shared_parameters is not None:
            return self.shared_parameters
        merged: dict[str, float] = {}
        for component in self.ordered:
            merged.update({name: float(value) for name, value in component.parameters.items()})
        return MappingProxyType(merged)

    @property
    def parameter_labels(self) -> Mapping[str, str]:
        merged: dict[str, str] = {}
        for component in self.ordered:
            merged.update(component.parameter_labels)
        return MappingProxyType(merged)

    @property
    def dependencies(self) -> set[str]:
        return {name for component in self.components for name in component.dependencies}

    @property
    def outputs(self) -> list[str]:
        """Result names in evaluation order, each once, declared extra outputs after their component."""
        names: dict[str, None] = {}
        for component in self.ordered:
            names.update(dict.fromkeys((component.name, *component.extra_outputs)))
        return list(names)

    @property
    def functions(self) -> Mapping[str, Callable[..., Any]]:
        """Given functions by component name; a later definition of a name replaces an earlier one."""
        return {c.name: c.function for c in self.ordered if c.function is not None}

    @property
    def source(self) -> str:
        """The components' source texts joined in order: one module."""
        return "\n".join(c.source for c in self.ordered if c.function is None and c.source is not None)
