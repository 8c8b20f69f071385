"""Python and vector rules: one Arrow function evaluates every component of every policy, for each row or each batch.

It must be one function: with a chain of dependent Python columns Spark would evaluate the head of the chain
again for each of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping, Sequence
from types import MappingProxyType
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.errors import PolicyError, RuleError
from levyframe.functions.names import column, quoted
from levyframe.operators.rules import PYTHON, VECTOR, Policy
from levyframe.operators.sharing import Shared, shared_components

PACKED = "__python_results"
FAULT = "fault"

# A component: its name, its function (None: an earlier policy has its results), what cuts a row to the attributes it may
# see (None: it sees all), how many results there are after it, and where results come from that are not its own.
_Call = tuple[
    str, Callable[..., Any] | None, Callable[[tuple[Any, ...]], Mapping[str, Any]] | None, int, tuple[tuple[str, int, str], ...]
]


class _Rules:
    """What a worker needs of one policy: functions, parameters and the names to give back."""

    def __init__(self, prefix: str, policy: Policy, strict_dependencies: bool, twins: Mapping[str, tuple[int, str]]) -> None:
        self.policy = policy.name
        self.fault = prefix + FAULT
        self.twins = dict(twins)  # own results that an earlier policy has: which one, and the name there
        self.vector = policy.kind == VECTOR
        self.parameters = dict(policy.parameters)
        self.outputs = [name for name in policy.outputs if name not in twins]
        self.every = policy.outputs
        self.fields = [prefix + name for name in self.outputs]
        self.given = dict(policy.functions)
        self.source = policy.source
        self.steps = [
            (c.name, frozenset(c.dependencies) if strict_dependencies else None) for c in policy.ordered
        ]
        declared: set[str] = set()
        self.counts = [len(declared := declared | {c.name, *c.extra_outputs}) for c in policy.ordered]
        self.results = [(c.name, *c.extra_outputs) for c in policy.ordered]

    def bind(self, names: Sequence[str]) -> list[_Call]:
        """The functions in order, each with what cuts a row of ``names`` to the attributes it may see."""
        functions = dict(self.given)
        if self.source:
            module: dict[str, Any] = {"__name__": f"policy {self.policy}"}
            exec(compile(self.source, f"<policy {self.policy}>", "exec"), module)
            for name, _ in self.steps:
                if name not in functions and callable(module.get(name)):
                    functions[name] = module[name]
        for name, _ in self.steps:
            if name not in functions:
                raise RuleError(f"policy {self.policy} defines no function {name}")
        calls: list[_Call] = []
        for (name, visible), count, results in zip(self.steps, self.counts, self.results):
            if name in self.twins:
                calls.append((name, None, None, count, tuple((r, *self.twins[r]) for r in results)))
            else:
                calls.append((name, functions[name], _cut(visible, names), count, ()))
        return calls


def _cut(visible: frozenset[str] | None, names: Sequence[str]) -> Callable[[tuple[Any, ...]], Mapping[str, Any]] | None:
    """None when a component sees all attributes of the row."""
    if visible is None or visible.issuperset(names):
        return None
    places = [(name, at) for at, name in enumerate(names) if name in visible]
    return lambda row: MappingProxyType({name: row[at] for name, at in places})


def _numbers(values: list[Any], component: str, null_results: str) -> pa.Array:
    if set(map(type, values)) != {float}:
        values = [_number(value, component, null_results) for value in values]
    return pa.array(values, pa.float64())


def _number(value: Any, component: str, null_results: str) -> float | None:
    if value is None and null_results == "keep":
        return None
    kind = type(value)
    if not (hasattr(kind, "__float__") or hasattr(kind, "__index__")):
        raise RuleError(f"component {component} returned {kind.__name__}, not a number")
    return float(value)


def _plain_values(array: pa.Array) -> list[Any]:
    """Python values of an Arrow array; the way over numpy is about ten times as fast as ``to_pylist``."""
    kind = array.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return array.to_numpy(zero_copy_only=False).tolist()
    if array.null_count == 0 and (pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return array.to_numpy(zero_copy_only=False).tolist()
    return array.to_pylist()


def _vector(array: pa.Array) -> np.ndarray:
    """The NumPy array of a column; integers with NULL become floats with NaN, other NULLs None."""
    return array.to_numpy(zero_copy_only=False)


def _vector_numbers(value: Any, rows: int, component: str, null_results: str) -> pa.Array:
    if isinstance(value, (pa.Array, pa.ChunkedArray)):
        value = value.to_numpy(zero_copy_only=False) if isinstance(value, pa.Array) else value.to_numpy()
    found = np.asarray(value)
    if found.ndim == 0:
        return _numbers([found.item()] * rows, component, null_results)
    if found.shape != (rows,):
        raise RuleError(f"component {component} returned {found.shape} values for {rows} rows")
    if found.dtype.kind in "biuf":
        return pa.array(found.astype(np.float64), pa.float64())
    return _numbers(found.tolist(), component, null_results)


def _refuse_undeclared(component: str, variables: Mapping[str, Any], known: set[str]) -> None:
    undeclared = sorted(set(variables) - known)
    if undeclared:
        raise RuleError(f"component {component} set undeclared results: {', '.join(undeclared)}")


def _evaluate_batch(
    rows: Iterable[tuple[Any, ...]],
    names: Sequence[str],
    given: Sequence[str],
    policies: list[tuple[list[_Call], Mapping[str, float], list[tuple[str, list[Any]]], list[str]]],
) -> None:
    """Call every component for every row; its results go to the lists that come with each policy.

    A component whose results an earlier policy has is not called again.

    A row holds the values of ``names`` and then of ``given``, earlier results.  For vector rules the "row" is one of
    whole arrays.
    """
    known = [{*given, *outputs} for _, _, _, outputs in policies]
    for row in rows:
        attributes = MappingProxyType(dict(zip(names, row)))
        earlier = dict(zip(given, row[len(names) :]))
        by_policy: list[dict[str, Any]] = []
        for (calls, parameters, results, _), allowed in zip(policies, known):
            variables: dict[str, Any] = dict(earlier)
            by_policy.append(variables)
            for name, function, cut, count, twins in calls:
                if function is None:
                    for own, which, other in twins:
                        variables[own] = by_policy[which][other]
                    continue
                seen = attributes if cut is None else cut(row)
                try:
                    variables[name] = function(variables, parameters, seen)
                except Exception as error:
                    raise RuleError(f"component {name}: {type(error).__name__}: {error}") from error
                if len(variables) > count + len(earlier):
                    _refuse_undeclared(name, variables, allowed)
            if len(variables) != len(allowed):
                _refuse_undeclared(calls[-1][0], variables, allowed)
            for name, values in results:
                values.append(variables.get(name))


def _evaluate_with_faults(
    rows: Iterable[tuple[Any, ...]], names: Sequence[str], given: Sequence[str], rule: _Rules, calls: list[_Call], null_results: str
) -> tuple[list[list[float | None]], list[str | None], list[str | None]]:
    """As ``_evaluate_batch`` for one policy, but an error ends the evaluation of its row only.

    Returns the values of each result, NULL from the faulty component on, and the component and message of each row's
    fault.  Of vector rules a row is one of arrays of one element.
    """
    allowed = {*given, *rule.outputs}
    values: list[list[float | None]] = [[] for _ in rule.outputs]
    components: list[str | None] = []
    messages: list[str | None] = []
    for row in rows:
        attributes = MappingProxyType(dict(zip(names, row)))
        variables: dict[str, Any] = dict(zip(given, row[len(names) :]))
        found: dict[str, float | None] = {}
        fault: tuple[str | None, str | None] = (None, None)
        for (name, function, cut, _, _), results in zip(calls, rule.results):
            try:
                variables[name] = function(variables, rule.parameters, attributes if cut is None else cut(row))
                for result in results:
                    held = variables.get(result)
                    if rule.vector:
                        found[result] = _vector_numbers(held, 1, name, null_results)[0].as_py()
                    else:
                        found[result] = _number(held, name, null_results)
                    if found[result] is None and null_results == "error":
                        raise RuleError(f"component {name} returned no value")
            except Exception as error:
                text = str(error) if isinstance(error, RuleError) else f"component {name}: {type(error).__name__}: {error}"
                for result in results:
                    found.pop(result, None)
                fault = (name, text)
                break
        _refuse_undeclared(name, variables, allowed)
        for one, result in zip(values, rule.outputs):
            one.append(found.get(result))
        components.append(fault[0])
        messages.append(fault[1])
    return values, components, messages


def _batch_with_faults(arrays: Sequence[pa.Array], names: Sequence[str], given: Sequence[str], rule: _Rules, calls: list[_Call], null_results: str):
    """The columns of a policy's results and of its faults for a batch; vector rules run by row only where a batch fails."""
    size = len(arrays[0])
    if rule.vector:
        whole = [(name, []) for name in rule.outputs]
        try:
            _evaluate_batch([tuple(map(_vector, arrays))], names, given, [(calls, rule.parameters, whole, rule.every)])
            columns = [_vector_numbers(values[0], size, name, null_results) for name, values in whole]
            if null_results == "keep" or not any(column.null_count for column in columns):
                return [*columns, pa.nulls(size, pa.string()), pa.nulls(size, pa.string())]
        except RuleError:
            pass
        rows: Iterable[tuple[Any, ...]] = (tuple(_vector(array.slice(k, 1)) for array in arrays) for k in range(size))
    else:
        rows = zip(*(_plain_values(array) for array in arrays))
    values, components, messages = _evaluate_with_faults(rows, names, given, rule, calls, null_results)
    return [*(pa.array(v, pa.float64()) for v in values), pa.array(components, pa.string()), pa.array(messages, pa.string())]


def python_results(
    df: DataFrame,
    policies: Sequence[tuple[str, Policy]],
    attributes: Sequence[str],
    *,
    strict_dependencies: bool,
    null_results: str,
    trust_source: bool,
    given: Sequence[str] = (),
    faults: bool = False,
) -> DataFrame:
    """Add the results of Python and vector policies as double columns, from one call per component and row or batch.

    ``given`` names earlier results, columns already, that a single policy goes on from.  With ``faults`` an error is a
    struct in the policy's column ``FAULT`` instead of the end of the query.
    """
    for _, policy in policies:
        untrusted = [c.name for c in policy.components if c.function is None]
        if untrusted and not trust_source:
            raise PolicyError(
                f"policy {policy.name}: source text of {', '.join(untrusted)} runs only with trust_source=True"
            )
    if strict_dependencies:
        declared = set().union(*(policy.dependencies for _, policy in policies))
        attributes = [name for name in attributes if name in declared]
    rules: list[_Rules] = []
    aliases: dict[str, str] = {}  # results that are an earlier policy's
    owners: dict[str, tuple[int, str]] = {}
    shared, places = Shared(), {PYTHON: 0, VECTOR: 0}
    for prefix, policy in policies:
        twins = shared_components(prefix, policy, shared, strict_dependencies) if len(policies) > 1 and not faults else {}
        rules.append(_Rules(prefix, policy, strict_dependencies, {name: owners[twin] for name, twin in twins.items()}))
        aliases |= {prefix + name: twin for name, twin in twins.items()}
        owners |= {prefix + name: (places[policy.kind], name) for name in policy.outputs if name not in twins}
        places[policy.kind] += 1
    fields = [field for rule in rules for field in rule.fields]
    result_type = T.StructType([T.StructField(f"f{i}", T.DoubleType()) for i in range(len(fields))])
    if faults:
        fields, kinds = [], []
        for rule in rules:
            fields += [*rule.fields, f"__component{len(fields)}", f"__message{len(fields)}"]
            kinds += [*(T.DoubleType() for _ in rule.fields), T.StringType(), T.StringType()]
        result_type = T.StructType([T.StructField(f"f{i}", kind) for i, kind in enumerate(kinds)])
    names = list(attributes)

    @F.arrow_udf(result_type)
    def evaluate_rows(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        bound = [(rule.bind(names), MappingProxyType(rule.parameters), rule.outputs, rule.every) for rule in rules]
        for arrays in batches:
            if isinstance(arrays, pa.Array):  # a single argument comes without its tuple
                arrays = (arrays,)
            size = len(arrays[0])
            columns: list[pa.Array] = []
            if faults:
                for rule, (calls, _, _, _) in zip(rules, bound):
                    columns += _batch_with_faults(arrays, names, given, rule, calls, null_results)
                yield pa.StructArray.from_arrays(columns, names=result_type.names)
                continue
            work = [[(calls, parameters, [(name, []) for name in outputs], every)] for calls, parameters, outputs, every in bound]
            by_row = [one for rule, (one,) in zip(rules, work) if not rule.vector]
            if by_row:
                _evaluate_batch(zip(*(_plain_values(array) for array in arrays)), names, given, by_row)
            whole = [one for rule, (one,) in zip(rules, work) if rule.vector]
            if whole:
                _evaluate_batch([tuple(map(_vector, arrays))], names, given, whole)
            for rule, ((_, _, results, _),) in zip(rules, work):
                for name, values in results:
                    if rule.vector:
                        columns.append(_vector_numbers(values[0], size, name, null_results))
                    else:
                        columns.append(_numbers(values, name, null_results))
            yield pa.StructArray.from_arrays(columns, names=result_type.names)

    # A function of no column would not see the rows; a constant stands in when nothing is needed.
    earlier = [policies[0][0] + name for name in given]
    arguments = list(map(quoted, [*names, *earlier])) or [F.lit(True)]
    packed = df.withColumn(PACKED, evaluate_rows(*arguments))
    # Unpacked by a generator: filters on results stay above it, so that the function runs once per row whatever is
    # asked of its results; filters on attributes and column pruning pass it.
    unpacked = packed.select(*map(quoted, df.columns), F.inline(F.array(column(PACKED))))
    unpacked = unpacked.toDF(*df.columns, *fields)
    if faults:
        kept = [*df.columns]
        told = []
        for rule in rules:
            at = fields.index(rule.fields[0]) + len(rule.fields)
            component, message = column(fields[at]), column(fields[at + 1])
            kept += rule.fields
            told.append(F.when(component.isNotNull(), F.struct(component.alias("component"), message.alias("message"))).alias(rule.fault))
        return unpacked.select(*map(quoted, kept), *told)
    return unpacked.select("*", *(column(twin).alias(name) for name, twin in aliases.items())) if aliases else unpacked
