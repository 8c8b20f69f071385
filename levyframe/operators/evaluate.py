"""Ordered rule evaluation: every component becomes one double column of the same row.

Nothing here shuffles.  Column rules are projections inside whole-stage code generation; Python and vector
rules of all policies together are one Arrow function (see ``evaluate_python``); a policy of several kinds has one step
for each run of components of one kind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator, Mapping, MutableMapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.errors import PolicyError, RuleError
from levyframe.functions.names import column, folded, quoted
from levyframe.operators.compile_rules import CompiledRule, compile_policy, function_key
from levyframe.operators.evaluate_python import FAULT, python_results
from levyframe.operators.rules import COLUMN, MIXED, PYTHON, VECTOR, Component, Policy
from levyframe.operators.sharing import Shared, fingerprint

REPLACED = "__replaced_"


class _Attributes(Mapping[str, Column]):
    """The attributes a rule sees; a Column is made when it is read, as a table may have many."""

    def __init__(self, names: Iterable[str]) -> None:
        self.names = dict.fromkeys(names)

    def __getitem__(self, name: str) -> Column:
        if name not in self.names:
            raise KeyError(f"no attribute {name!r}")
        return column(name)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


class _Variables(MutableMapping[str, Any]):
    """Earlier results of a policy.

    Remembers how deep in the chain of results the current component has read, so that components that do
    not need each other can share one projection.
    """

    def __init__(self) -> None:
        self.values_by_name: dict[str, Any] = {}
        self.depths: dict[str, int] = {}
        self.depth = 0
        self.set_here: set[str] = set()
        self.read_here: set[str] = set()

    def __getitem__(self, name: str) -> Any:
        if name not in self.values_by_name:
            raise KeyError(f"result {name!r} is read before it is computed")
        self.depth = max(self.depth, self.depths[name])
        self.read_here.add(name)
        return self.values_by_name[name]

    def __setitem__(self, name: str, value: Any) -> None:
        self.settle(name, value, self.depth)
        self.set_here.add(name)

    def __delitem__(self, name: str) -> None:
        del self.values_by_name[name], self.depths[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self.values_by_name)

    def __len__(self) -> int:
        return len(self.values_by_name)

    def settle(self, name: str, value: Any, depth: int) -> None:
        self.values_by_name[name] = value
        self.depths[name] = depth


class _Parameters(Mapping[str, float]):
    """A policy's parameters; remembers which ones the current component has read."""

    def __init__(self, values: Mapping[str, float]) -> None:
        self.values_by_name = values
        self.read_here: set[str] = set()

    def __getitem__(self, name: str) -> float:
        value = self.values_by_name[name]
        self.read_here.add(name)
        return value

    def __iter__(self) -> Iterator[str]:
        self.read_here.update(self.values_by_name)
        return iter(self.values_by_name)

    def __len__(self) -> int:
        self.read_here.update(self.values_by_name)
        return len(self.values_by_name)

    def __contains__(self, name: object) -> bool:
        self.read_here.update(self.values_by_name)  # that a name is missing is read, too
        return name in self.values_by_name


@dataclass
class _Step:
    """One result to add: its column, the component it comes from, and how many projections come before it."""

    component: str
    target: str
    value: Column
    depth: int
    fault: Column | None = None  # what is wrong with the row, where a rule can tell


def missing_attributes(policy: Policy, columns: Iterable[str]) -> list[str]:
    """Attributes the policy declares as dependencies but the table lacks, sorted."""
    return sorted(policy.dependencies - set(columns))


def check_dependencies(policy: Policy, df: DataFrame) -> None:
    """Raise when the table lacks a declared attribute; the message lists all of them."""
    _require(policy, df.columns)


def _require(policy: Policy, attributes: Iterable[str]) -> None:
    missing = missing_attributes(policy, attributes)
    if missing:
        raise PolicyError(f"policy {policy.name} depends on attributes the table lacks: {', '.join(missing)}")


def check_free(spark: SparkSession, columns: Iterable[str], names: Sequence[str]) -> None:
    """Raise when a result would take the name of a column."""
    taken = set(folded(spark, columns))
    clashes = sorted(name for name, form in zip(names, folded(spark, names)) if form in taken)
    if clashes:
        raise PolicyError(f"results and attributes share names: {', '.join(clashes)}")


def _as_result(value: Any, component: str) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, (bool, int, float)):
        return F.lit(float(value))
    raise RuleError(f"component {component} returned {type(value).__name__}, not a Column or a number")


def _results_of(component: Component, value: Any, variables: MutableMapping[str, Any]) -> list[tuple[str, Any]]:
    results = [(component.name, value)]
    for name in component.extra_outputs:
        if name not in variables:
            raise RuleError(f"component {component.name} did not set its extra output {name}")
        results.append((name, variables[name]))
    return results


def _column_steps(
    prefix: str,
    policy: Policy,
    attributes: Sequence[str],
    strict_dependencies: bool,
    given: Sequence[str] = (),
    shared: Shared | None = None,
    aliases: dict[str, str] | None = None,
    faults: bool = False,
) -> list[_Step]:
    """Call the column rules in order; needs no DataFrame, as the rules only build expressions.

    ``given`` names results that are columns already.  A result that an earlier policy has, by ``shared``, is no step; it
    goes to ``aliases``.
    """
    functions = policy.functions
    parameters = _Parameters(policy.parameters)
    targets = {name: prefix + name for name in given}
    every_attribute = _Attributes(attributes)
    variables = _Variables()
    for name in given:
        variables.settle(name, column(prefix + name), 0)
    steps: list[_Step] = []
    again = Counter(name for component in policy.ordered for name in (component.name, *component.extra_outputs))
    if max(again.values()) > 1:
        shared = None  # a result that is computed again has several values
    for component in policy.ordered:
        seen = every_attribute
        if strict_dependencies:
            seen = _Attributes(component.dependencies)
        variables.depth = 0
        variables.set_here, variables.read_here, parameters.read_here = set(), set(), set()
        function, told = functions[component.name], None
        try:
            if faults and isinstance(function, CompiledRule):
                value, told = function.with_fault(variables, parameters, seen)
            else:
                value = function(variables, parameters, seen)
        except Exception as error:
            raise RuleError(f"component {component.name} of policy {policy.name}: {error}") from error
        undeclared = sorted(variables.set_here - {component.name, *component.extra_outputs})
        if undeclared:
            raise RuleError(f"component {component.name} set undeclared results: {', '.join(undeclared)}")
        results = _results_of(component, value, variables)
        depth = variables.depth
        twin = None
        if shared is not None:
            own = {component.name, *component.extra_outputs}
            mark = fingerprint(
                component.kind, function_key(functions[component.name]), component,
                component.dependencies if strict_dependencies else None,
                {name: parameters.values_by_name[name] for name in parameters.read_here},
                {name: targets[name] for name in variables.read_here - own},
            )
            twin = shared.twin(mark, prefix + component.name)
        for name, result in results:
            targets[name] = prefix + name
            if twin is not None:
                targets[name] = twin.removesuffix(component.name) + name
                aliases[prefix + name] = targets[name]
                variables.settle(name, column(targets[name]), depth + 1)
                continue
            again[name] -= 1
            # A result that is computed again later stays apart for the components that read it before.
            target = f"{REPLACED}{again[name]}_{prefix}{name}" if again[name] else prefix + name
            steps.append(_Step(component.name, target, _as_result(result, component.name), depth, told))
            variables.settle(name, column(target), depth + 1)
    return steps


def _as_double(step: _Step, result_type: T.DataType, null_results: str) -> Column:
    if not isinstance(result_type, (T.NumericType, T.BooleanType)):
        raise RuleError(f"component {step.component} returned {result_type.simpleString()}, not a number")
    value = step.value if isinstance(result_type, T.DoubleType) else step.value.cast("double")
    if null_results == "error":
        complaint = F.lit(f"component {step.component} returned no value")
        value = F.coalesce(value, F.raise_error(complaint).cast("double"))
    return value.alias(step.target)


def _result_types(df: DataFrame, steps: Sequence[_Step]) -> list[T.DataType]:
    """The types of some results; an expression that does not resolve is blamed on its component."""
    try:
        return [field.dataType for field in df.select(*(step.value for step in steps)).schema]
    except AnalysisException as error:
        if len(steps) == 1:
            raise RuleError(f"component {steps[0].component}: {error}") from error
        for step in steps:
            _result_types(df, [step])
        raise


def _column_results(df: DataFrame, steps: Sequence[_Step], null_results: str) -> DataFrame:
    """Add results depth by depth: as many projections as the longest chain of results, not as components."""
    for depth in range(max(step.depth for step in steps) + 1):
        level = [step for step in steps if step.depth == depth]
        types = _result_types(df, level)
        df = df.select("*", *(_as_double(step, kind, null_results) for step, kind in zip(level, types)))
    replaced = [step.target for step in steps if step.target.startswith(REPLACED)]
    return df.drop(*replaced) if replaced else df


def _column_results_with_faults(df: DataFrame, prefix: str, steps: Sequence[_Step], null_results: str) -> DataFrame:
    """As ``_column_results`` for one policy, with its column ``FAULT``; results are NULL from the faulty component on."""
    hidden: dict[int, str] = {}
    for depth in range(max(step.depth for step in steps) + 1):
        level = [(at, step) for at, step in enumerate(steps) if step.depth == depth]
        types = _result_types(df, [step for _, step in level])
        columns = []
        for (at, step), kind in zip(level, types):
            columns.append(_as_double(step, kind, "keep"))
            if step.fault is not None:
                hidden[at] = f"__fault{at}_{prefix}"
                columns.append(step.fault.alias(hidden[at]))
        df = df.select("*", *columns)
    complaints = []
    for at, step in enumerate(steps):
        text = column(hidden[at]) if at in hidden else F.lit(None).cast("string")
        if null_results == "error":
            none = F.lit(f"component {step.component} returned no value")
            text = F.coalesce(text, F.when(column(step.target).isNull(), none))
        told = F.struct(F.lit(at).alias("at"), F.lit(step.component).alias("component"), text.alias("message"))
        complaints.append(F.when(text.isNotNull(), told))
    first = f"__first_{prefix}"
    found = df.withColumn(first, F.coalesce(*complaints))
    begins = {}
    for at, step in enumerate(steps):  # the results of a component stand together
        begins.setdefault(step.component, at)
    results = {}
    for at, step in enumerate(steps):
        sound = column(first).isNull() | (column(first)["at"] > F.lit(at))
        same = column(first)["component"] == step.component  # nothing of a faulty component stays
        results[step.target] = F.when(sound & ~F.coalesce(same, F.lit(False)), column(step.target)).alias(step.target)
    fault = F.when(column(first).isNotNull(), F.struct(column(first)["component"].alias("component"), column(first)["message"].alias("message")))
    dropped = {*hidden.values(), first}
    kept = [results.get(name, column(name)) for name in found.columns if name not in dropped and not name.startswith(REPLACED)]
    return found.select(*kept, fault.alias(prefix + FAULT))


def _first_fault(df: DataFrame, prefix: str, earlier: str, results: Sequence[str]) -> DataFrame:
    """Of the faults of two steps of a policy the earlier one counts, and later results are NULL then."""
    sound = column(earlier).isNull()
    later = {name: F.when(sound, column(name)).alias(name) for name in results}
    kept = [later.get(name, column(name)) for name in df.columns if name not in (earlier, prefix + FAULT)]
    return df.select(*kept, F.coalesce(column(earlier), column(prefix + FAULT)).alias(prefix + FAULT))


def _with_faults(
    df: DataFrame, policies: Sequence[tuple[str, Policy]], attributes: Sequence[str], strict_dependencies: bool, null_results: str,
    trust_source: bool,
) -> DataFrame:
    """The results of each policy and its column ``FAULT``."""
    for prefix, policy in policies:
        given: list[str] = []
        for part in policy.parts if policy.kind == MIXED else [policy]:
            earlier = f"__earlier_{prefix}"
            if given:
                df = df.withColumnRenamed(prefix + FAULT, earlier)
            if part.kind == COLUMN:
                steps = _column_steps(prefix, part, attributes, strict_dependencies, given, faults=True)
                df = _column_results_with_faults(df, prefix, steps, null_results)
            else:
                df = python_results(
                    df, [(prefix, part)], attributes, strict_dependencies=strict_dependencies, null_results=null_results,
                    trust_source=trust_source, given=given, faults=True,
                )
            if given:
                df = _first_fault(df, prefix, earlier, [prefix + name for name in part.outputs])
            given += part.outputs
    return df


def evaluate(
    df: DataFrame,
    policies: Sequence[tuple[str, Policy]],
    *,
    attributes: Sequence[str] | None = None,
    strict_dependencies: bool = False,
    null_results: str = "error",
    trust_source: bool = False,
    compiled: bool = False,
    faults: bool = False,
) -> DataFrame:
    """Add the results of several policies to each row; every policy sees only its own results.

    Components that do the same in several policies (``sharing``) are evaluated once.

    ``policies`` pairs a column prefix with a policy.  ``attributes`` are the columns the rules see, by
    default all.  Rows keep all their columns.
    """
    if null_results not in ("error", "keep"):
        raise ValueError("null_results must be 'error' or 'keep'")
    attributes = list(df.columns if attributes is None else attributes)
    for _, policy in policies:
        _require(policy, attributes)
    if compiled:
        seen = {"attributes": attributes, "strict_dependencies": strict_dependencies, "null_results": null_results}
        policies = [(prefix, compile_policy(policy, df.schema, **seen)[0]) for prefix, policy in policies]
    check_free(df.sparkSession, df.columns, [prefix + name for prefix, policy in policies for name in policy.outputs])
    order = [*df.columns, *(prefix + name for prefix, policy in policies for name in policy.outputs)]
    if faults:
        check_free(df.sparkSession, order, [prefix + FAULT for prefix, _ in policies])
        df = _with_faults(df, policies, attributes, strict_dependencies, null_results, trust_source)
        return df.select(*map(quoted, order), *(quoted(prefix + FAULT) for prefix, _ in policies))
    shared, aliases = Shared(), {}
    steps = [
        step
        for prefix, policy in policies
        if policy.kind == COLUMN
        for step in _column_steps(prefix, policy, attributes, strict_dependencies, shared=shared if len(policies) > 1 else None, aliases=aliases)
    ]
    if steps:
        df = _column_results(df, steps, null_results)
    if aliases:
        df = df.select("*", *(column(twin).alias(name) for name, twin in aliases.items()))
    options = {
        "strict_dependencies": strict_dependencies, "null_results": null_results, "trust_source": trust_source
    }
    python = [(prefix, policy) for prefix, policy in policies if policy.kind in (PYTHON, VECTOR)]
    if python:
        df = python_results(df, python, attributes, **options)
    for prefix, policy in policies:
        if policy.kind == MIXED:
            given: list[str] = []
            for part in policy.parts:
                if part.kind == COLUMN:
                    steps = _column_steps(prefix, part, attributes, strict_dependencies, given)
                    df = _column_results(df, steps, null_results)
                else:
                    df = python_results(df, [(prefix, part)], attributes, given=given, **options)
                given += part.outputs
    return df if df.columns == order else df.select(*map(quoted, order))


def apply_policy(
    df: DataFrame,
    policy: Policy,
    *,
    prefix: str = "",
    attributes: Sequence[str] | None = None,
    strict_dependencies: bool = False,
    null_results: str = "error",
    trust_source: bool = False,
    compiled: bool = False,
    faults: bool = False,
) -> DataFrame:
    """Add one double column per component of ``policy``.

    Components run in order; each sees all parameters, all attributes and the earlier results.  Reading a
    result that does not exist yet fails while the plan is built (column rules) or in the task (Python
    rules).  A rule without a value for a row is an error unless ``null_results="keep"``.

    ``strict_dependencies`` hides undeclared attributes from the rules, which for Python rules also
    narrows what is sent to the Python workers.

    ``compiled`` turns Python rules into columns where it can (``compile_policy``, which also tells why not); what is
    compiled is not run, so it needs no ``trust_source``.

    ``faults`` keeps the query going where a row is an error: the column ``fault``, a struct of component and message, tells
    the first one of the row, whose results are NULL from that component on.  It catches every exception of Python and
    vector rules (a failing batch of vector rules is run again by row), all faults of compiled rules, and missing values;
    what Spark itself raises within a given column rule still ends the query.

    Moving a rule from Python to columns: Spark's ``round`` rounds half up (``bround`` half to even), ``%``
    takes the sign of the dividend (``pmod`` does not), integer overflow is an error, and ``greatest`` and
    ``least`` skip NULL.
    """
    return evaluate(
        df,
        [(prefix, policy)],
        attributes=attributes,
        strict_dependencies=strict_dependencies,
        null_results=null_results,
        trust_source=trust_source,
        compiled=compiled,
        faults=faults,
    )
