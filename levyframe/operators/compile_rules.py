"""Python rules as Columns.

The source of a rule, a ``def`` in a policy file or of a given function, is read as a syntax tree and built up again as
Spark expressions, which stay inside whole-stage code generation.  Nothing of it is run, so policy files need no trust.
What a rule may hold: arithmetic, comparisons, ``and``/``or``/``not``, conditional expressions, ``if`` statements, local
names, constants and dictionaries of its module, calls of other functions of the module, ``in`` a list of constants,
``is None``, and the functions in ``CALLS``.  Anything else is refused with a reason, and that rule stays as it was.

Values keep Python's meaning on every row:

- Python's errors (a NULL in arithmetic, a division by zero, a missing key) are faults of the row.  A rule collects
  them in order, each under the condition that Python would have come to it, and a row with a fault is an error there as
  it is for the Python rule, also where the faulty value is not used in the end.
- NaN is equal to nothing and neither below nor above anything; NULL equals only NULL; text never equals a number.
- Integers are 64-bit; where Python would go beyond, the row is an error instead of a wrong number.
- What Spark computes in another way (``**``, ``round`` to digits, ``//`` and ``%`` of floats, text operations) is refused.
"""

from __future__ import annotations

import ast
import inspect
import math
import operator
import textwrap
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, replace
from functools import reduce
from types import FunctionType
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.operators.rules import COLUMN, PYTHON, Component, Policy

INT, FLOAT, BOOL, TEXT, NONE = "int", "float", "bool", "text", "none"
NUMBERS = (INT, FLOAT, BOOL)
CALLS = ("abs", "min", "max", "float", "int", "bool", "round", "math.floor", "math.ceil", "math.sqrt", "math.isnan", "math.fabs")
MOST_NODES = 4000  # of a rule's expression; a larger one stays in Python
_EXACT = 1 << 53  # integers below it are doubles without loss
_LONG = 1 << 63


class Refused(Exception):
    """Why a rule cannot be compiled."""


@dataclass(frozen=True)
class Value:
    """A Python value: its kind, the Column that holds it, and whether it may be None.

    ``constant`` is set where it is known while the plan is built; ``size`` counts expression nodes.
    """

    kind: str
    column: Column
    nullable: bool = False
    constant: Any = None
    size: int = 1
    small: bool = False  # an integer that is known to fit in 32 bits
    exact: bool = False  # an integer that is known to be a double without loss


@dataclass
class _Scope:
    """Where translation is: local names, and the condition under which Python gets here."""

    names: dict[str, Any]
    path: Column | None = None  # None: on every row
    depth: int = 0  # of calls
    trail: tuple[int, ...] = ()  # numbers of the conditions that ``path`` joins

    def under(self, condition: Column, number: int, names: dict[str, Any] | None = None) -> _Scope:
        return _Scope(self.names if names is None else names, _and(self.path, condition), self.depth, (*self.trail, number))


def _constant(value: Any) -> Value:
    if value is None:
        return Value(NONE, F.lit(None).cast("double"), True)
    if isinstance(value, bool):
        return Value(BOOL, F.lit(value), constant=value)
    if isinstance(value, int):
        if not -_LONG <= value < _LONG:
            raise Refused(f"the integer {value} does not fit in 64 bits")
        return Value(INT, F.lit(value).cast("long"), constant=value, small=-(2**31) <= value < 2**31, exact=abs(value) <= _EXACT)
    if isinstance(value, float):
        return Value(FLOAT, F.lit(value), constant=value)
    if isinstance(value, str):
        return Value(TEXT, F.lit(value), constant=value)
    raise Refused(f"a constant of type {type(value).__name__}")


def _and(one: Column | None, other: Column) -> Column:
    return other if one is None else one & other


class Module:
    """The functions and constants that a rule can refer to by name."""

    def __init__(self, names: Mapping[str, Any]) -> None:
        self.names = names

    @classmethod
    def of_source(cls, source: str) -> Module:
        """Of a policy file's source: later definitions of a name replace earlier ones; statements of other kinds hide
        every name, as they could do anything."""
        names: dict[str, Any] = {}
        try:
            tree = ast.parse(source)
        except SyntaxError as error:
            return cls({"": Refused(f"the source is not Python: {error}")})
        for statement in tree.body:
            match statement:
                case ast.FunctionDef():
                    names[statement.name] = statement
                case ast.Assign(targets=[ast.Name(id=name)], value=ast.Lambda() as function):
                    names[name] = function
                case ast.Assign(targets=[ast.Name(id=name)], value=ast.Name(id=other)) if other in names:
                    names[name] = names[other]
                case ast.Assign(targets=[ast.Name(id=name)], value=value):
                    try:
                        names[name] = ast.literal_eval(value)
                    except ValueError:
                        names[name] = Refused(f"{name} is not a constant")
                case ast.Import(names=[ast.alias(name="math", asname=None)]):
                    names["math"] = math
                case ast.Expr(value=ast.Constant()) | ast.Pass():
                    pass
                case _:
                    return cls({"": Refused(f"the module has a {type(statement).__name__} statement in line {statement.lineno}")})
        return cls(names)

    @classmethod
    def of_function(cls, function: Callable[..., Any]) -> Module:
        """Of a given function: the names it refers to have the values that they have now."""
        if not isinstance(function, FunctionType):
            return cls({"": Refused(f"a {type(function).__name__} has no source")})
        try:
            tree = ast.parse(textwrap.dedent(inspect.getsource(function)))
        except (OSError, TypeError, SyntaxError) as error:
            return cls({"": Refused(f"its source is not to be had: {error}")})
        match tree.body:
            case [ast.FunctionDef() as found]:
                held = inspect.getclosurevars(function)
                return cls({**held.globals, **held.nonlocals, function.__name__: found})
        return cls({"": Refused("its source is not one def")})

    def function(self, name: str) -> ast.FunctionDef | ast.Lambda:
        found = self.get(name)
        if isinstance(found, FunctionType):
            found = Module.of_function(found).get(found.__name__)
        if not isinstance(found, (ast.FunctionDef, ast.Lambda)):
            raise Refused(f"{name} is not a function of the module")
        if getattr(found, "decorator_list", None):
            raise Refused(f"{name} is decorated")
        return found

    def get(self, name: str) -> Any:
        if "" in self.names:
            raise self.names[""]
        if name not in self.names:
            raise Refused(f"the name {name} is not defined")
        if isinstance(self.names[name], Refused):
            raise self.names[name]
        return self.names[name]


def function_key(function: Callable[..., Any]) -> Any:
    """Equal for functions that do the same: one function, or two of the same code, globals and closed-over values."""
    if not isinstance(function, FunctionType):
        return getattr(function, "fingerprint", None) or id(function)
    held = tuple(id(cell.cell_contents) if _is_set(cell) else None for cell in function.__closure__ or ())
    return (function.__code__, id(function.__globals__), id(function.__defaults__) if function.__defaults__ else None, held)


def _is_set(cell: Any) -> bool:
    try:
        cell.cell_contents
    except ValueError:
        return False
    return True


def source_key(module: Module, name: str, source: str) -> Any:
    """Equal for functions of two policy files whose text, and that of all they refer to, is the same."""
    if "" in module.names:
        return source
    found: dict[str, str] = {}
    waiting = [name]
    while waiting:
        one = waiting.pop()
        if one in found or one not in module.names:
            continue
        held = module.names[one]
        if isinstance(held, Refused):
            return source
        if not isinstance(held, ast.AST):
            found[one] = repr(held)
            continue
        found[one] = ast.dump(held)
        waiting += [n.id for n in ast.walk(held) if isinstance(n, ast.Name)]
    return tuple(sorted(found.items()))


def _arguments(function: ast.FunctionDef | ast.Lambda, count: int) -> list[str]:
    given = function.args
    if given.vararg or given.kwarg or given.kwonlyargs or given.defaults or len(given.posonlyargs + given.args) != count:
        raise Refused(f"a function that does not take exactly {count} arguments")
    return [a.arg for a in [*given.posonlyargs, *given.args]]


class _Mapping:
    """One of the three things a rule gets: earlier results, parameters, attributes."""

    def __init__(self, read: Callable[[str], Value | None], write: Callable[[str, Value], None] | None = None) -> None:
        self.read, self.write = read, write


@dataclass
class Compiled:
    """A rule as expressions: its value and results beside it, and the faults of a row in the order Python meets them."""

    value: Value
    extra: dict[str, Value]
    faults: list[tuple[Column, str]]

    def checked(self, value: Value, component: str) -> Column:
        """The value as a double; an error on rows with a fault."""
        found = _as_double(value)
        if not self.faults:
            return found
        complain = lambda text: F.raise_error(F.lit(f"component {component}: {text}")).cast("double")
        (condition, text), *rest = self.faults
        chain = F.when(condition, complain(text))
        for condition, text in rest:
            chain = chain.when(condition, complain(text))
        return chain.otherwise(found)

    def fault(self) -> Column:
        """What Python would complain of, NULL where it would not."""
        if not self.faults:
            return F.lit(None).cast("string")
        (condition, text), *rest = self.faults
        chain = F.when(condition, F.lit(text))
        for condition, text in rest:
            chain = chain.when(condition, F.lit(text))
        return chain


def _as_double(value: Value) -> Column:
    if value.kind == FLOAT:
        return value.column
    return value.column.cast("double")


def _whole_number(value: Value) -> Value:
    """An integer or a bool as an integer."""
    return value if value.kind == INT else replace(value, kind=INT, column=value.column.cast("long"), constant=None, small=True)


def _is_nan(value: Value) -> Column | None:
    """None where the value cannot be NaN."""
    if value.kind != FLOAT or (value.constant is not None and not math.isnan(value.constant)):
        return None
    return F.isnan(value.column)


class Translator:
    """One rule's syntax tree to expressions."""

    def __init__(self, module: Module, variables: _Mapping, parameters: Mapping[str, float], attributes: Mapping[str, Value]) -> None:
        self.module = module
        self.variables = variables
        self.parameters = parameters
        self.attributes = attributes
        self.faults: list[tuple[Column, str]] = []
        self.size = 0
        self._conditions = 0
        self._not_none: list[tuple[Column, tuple[int, ...]]] = []  # columns that were looked at, and where

    def rule(self, name: str) -> Value:
        function = self.module.function(name)
        mappings = (self.variables, _Mapping(self._parameter), _Mapping(self._attribute))
        return self._call(function, list(mappings), _Scope({}))

    # What a rule reads

    def _parameter(self, name: str) -> Value | None:
        if name not in self.parameters:
            return None
        value = self.parameters[name]
        return Value(FLOAT, value) if isinstance(value, Column) else _constant(float(value))

    def _attribute(self, name: str) -> Value | None:
        return self.attributes.get(name)

    # Faults

    def _fault(self, scope: _Scope, condition: Column | None, text: str) -> None:
        """Python stops here with ``text`` where ``condition`` (None: always) holds."""
        found = F.lit(True) if condition is None else condition
        self.faults.append((found if scope.path is None else scope.path & found, text))
        self.size += 2

    def _not_none_here(self, value: Value, scope: _Scope, text: str) -> Value:
        """The value on rows where it is not None; a fault of the others, once on each way."""
        if value.nullable:
            known = any(value.column is c and scope.trail[: len(t)] == t for c, t in self._not_none)
            if not known:
                self._fault(scope, value.column.isNull(), text)
                self._not_none.append((value.column, scope.trail))
        return replace(value, nullable=False)

    def _under(self, scope: _Scope, condition: Column, names: dict[str, Any] | None = None) -> _Scope:
        self._conditions += 1
        return scope.under(condition, self._conditions, names)

    def _sized(self, value: Value) -> Value:
        self.size += 1
        if value.size > MOST_NODES or self.size > MOST_NODES:
            raise Refused(f"more than {MOST_NODES} operations")
        return value

    def _number(self, value: Value, scope: _Scope, what: str) -> Value:
        """A value that arithmetic takes."""
        if value.kind == NONE:
            self._fault(scope, None, f"TypeError: {what} of None")
            return _constant(0)
        if value.kind not in NUMBERS:
            raise Refused(f"{what} of text")
        value = self._not_none_here(value, scope, f"TypeError: {what} of None")
        if value.kind == BOOL:
            return _whole_number(value)
        return value

    def _double(self, value: Value, scope: _Scope, where: Column | None = None) -> Value:
        """A number as a float; where it is one (``where``), an integer must be a double without loss."""
        if value.kind == FLOAT:
            return value
        if value.kind == INT and not value.small and not value.exact:
            beyond = ~value.column.between(-_EXACT, _EXACT)
            self._fault(scope, beyond if where is None else where & beyond, "OverflowError: an integer beyond 53 bits")
        constant = None if value.constant is None else float(value.constant)
        return replace(value, kind=FLOAT, column=_as_double(value), constant=constant)

    # Statements

    def _call(self, function: ast.FunctionDef | ast.Lambda, arguments: list[Any], scope: _Scope) -> Value:
        if scope.depth > 20:
            raise Refused("functions call each other too deeply")
        names = dict(zip(_arguments(function, len(arguments)), arguments, strict=True))
        inner = _Scope(names, scope.path, scope.depth + 1, scope.trail)
        if isinstance(function, ast.Lambda):
            return self._expression(function.body, inner)
        value, rest = self._block(function.body, inner)
        if value is None:
            return _constant(None)
        return value if rest is None else self._chosen(~rest, value, _constant(None), _Scope({}, scope.path))

    def _block(self, statements: Sequence[ast.stmt], scope: _Scope) -> tuple[Value | None, Column | bool | None]:
        """(what the block returns, where it goes on): the second is None where it returns on every row, True where it
        returns on none, or else a condition."""
        found: Value | None = None
        goes_on: Column | None = None  # None: so far on every row
        entry = _Scope({}, scope.path)
        for statement in statements:
            value, rest = self._statement(statement, scope)
            if value is not None:
                # Later statements belong to the rows that have not returned.
                found = value if found is None else self._chosen(goes_on, value, found, entry)
            if rest is None:
                return found, None
            if rest is not True:
                goes_on = _and(goes_on, rest)
                narrowed = self._under(scope, rest)
                scope.path, scope.trail = narrowed.path, narrowed.trail
        return found, True if goes_on is None else goes_on

    def _statement(self, statement: ast.stmt, scope: _Scope) -> tuple[Value | None, Column | bool | None]:
        match statement:
            case ast.Return(value=None):
                return _constant(None), None
            case ast.Return(value=value):
                return self._expression(value, scope), None
            case ast.Pass() | ast.Expr(value=ast.Constant()):
                return None, True
            case ast.Assign(targets=[ast.Name(id=name)], value=value):
                scope.names[name] = self._expression(value, scope)
            case ast.AnnAssign(target=ast.Name(id=name), value=value) if value is not None:
                scope.names[name] = self._expression(value, scope)
            case ast.AugAssign(target=ast.Name(id=name), op=op, value=value):
                scope.names[name] = self._arithmetic(op, self._named(name, scope), self._expression(value, scope), scope)
            case ast.Assign(targets=[ast.Subscript(value=ast.Name(id=held), slice=ast.Constant(value=str(name)))], value=value):
                mapping = scope.names.get(held)
                if not isinstance(mapping, _Mapping) or mapping.write is None:
                    raise Refused(f"{held} cannot be set")
                if scope.path is not None:
                    raise Refused(f"{held}[{name!r}] is set under a condition")
                mapping.write(name, self._expression(value, scope))
            case ast.If(test=test, body=body, orelse=orelse):
                return self._if(test, body, orelse, scope)
            case _:
                raise Refused(f"a {type(statement).__name__} statement")
        return None, True

    def _if(self, test: ast.expr, body: list[ast.stmt], orelse: list[ast.stmt], scope: _Scope):
        condition = self._truth(self._expression(test, scope))
        yes = self._under(scope, condition, dict(scope.names))
        no = self._under(scope, ~condition, dict(scope.names))
        one, one_rest = self._block(body, yes)
        other, other_rest = self._block(orelse, no)
        for name in dict.fromkeys([*yes.names, *no.names]):
            # A name that one of the branches lacks is unbound after it, unless that branch has returned.
            if one_rest is None:
                held = no.names.get(name)
            elif other_rest is None:
                held = yes.names.get(name)
            elif name not in yes.names or name not in no.names:
                held = Refused(f"{name} is not set on every way")
            elif yes.names[name] is no.names[name]:
                continue
            else:
                held = self._chosen_name(name, condition, yes.names[name], no.names[name], scope)
            scope.names[name] = held
        if one is None and other is None:
            value = None
        elif one is None or other is None:
            value = one if other is None else other
        else:
            value = self._chosen(condition, one, other, scope)
        if one_rest is None and other_rest is None:
            return value, None
        if one_rest is True and other_rest is True:
            return value, True
        rests = []
        if one_rest is not None:
            rests.append(condition if one_rest is True else condition & one_rest)
        if other_rest is not None:
            rests.append(~condition if other_rest is True else ~condition & other_rest)
        # ``value`` is asked for only where the block does not go on
        return value, reduce(operator.or_, rests)

    def _chosen_name(self, name: str, condition: Column, one: Any, other: Any, scope: _Scope) -> Any:
        if isinstance(one, Refused) or isinstance(other, Refused):
            return one if isinstance(one, Refused) else other
        if not isinstance(one, Value) or not isinstance(other, Value):
            return Refused(f"{name} is not a plain value on every way")
        try:
            return self._chosen(condition, one, other, scope)
        except Refused as reason:
            return reason

    # Expressions

    def _named(self, name: str, scope: _Scope) -> Any:
        if name in scope.names:
            found = scope.names[name]
        else:
            found = self.module.get(name)
            if isinstance(found, (bool, int, float, str)) or found is None:
                found = _constant(found)
        if found is None:
            raise Refused(f"{name} is not set on every way")
        if isinstance(found, Refused):
            raise found
        return found

    def _expression(self, node: ast.expr, scope: _Scope) -> Value:
        value = self._any(node, scope)
        if not isinstance(value, Value):
            raise Refused(f"{ast.unparse(node)} is not a plain value")
        return self._sized(value)

    def _any(self, node: ast.expr, scope: _Scope) -> Any:
        match node:
            case ast.Constant(value=value):
                return _constant(value)
            case ast.Name(id=name):
                return self._named(name, scope)
            case ast.Subscript(value=held, slice=key):
                return self._looked_up(self._any(held, scope) if isinstance(held, ast.Name) else self._literal(held), key, None, scope)
            case ast.BinOp(left=left, op=op, right=right):
                return self._arithmetic(op, self._expression(left, scope), self._expression(right, scope), scope)
            case ast.UnaryOp(op=ast.Not(), operand=operand):
                truth = self._truth(self._expression(operand, scope))
                return Value(BOOL, ~truth)
            case ast.UnaryOp(op=ast.USub(), operand=operand):
                return self._negated(self._expression(operand, scope), scope)
            case ast.UnaryOp(op=ast.UAdd(), operand=operand):
                return self._number(self._expression(operand, scope), scope, "a sign")
            case ast.BoolOp(op=op, values=values):
                return self._both(isinstance(op, ast.And), values, scope)
            case ast.Compare(left=left, ops=ops, comparators=comparators):
                return self._compared(left, ops, comparators, scope)
            case ast.IfExp(test=test, body=body, orelse=orelse):
                condition = self._truth(self._expression(test, scope))
                one = self._expression(body, self._under(scope, condition))
                other = self._expression(orelse, self._under(scope, ~condition))
                return self._chosen(condition, one, other, scope)
            case ast.Call(func=ast.Attribute(value=ast.Name(id=held), attr="get"), args=[key, *default], keywords=[]) if len(default) < 2:
                return self._looked_up(self._named(held, scope), key, default or [ast.Constant(None)], scope)
            case ast.Call(func=function, args=arguments, keywords=[]):
                return self._called(ast.unparse(function), arguments, scope)
        raise Refused(f"the expression {ast.unparse(node)}")

    @staticmethod
    def _literal(node: ast.expr) -> Any:
        try:
            return ast.literal_eval(node)
        except ValueError:
            raise Refused(f"{ast.unparse(node)} is not a constant") from None

    def _looked_up(self, held: Any, key: ast.expr, default: list[ast.expr] | None, scope: _Scope) -> Value:
        if isinstance(held, _Mapping):
            if not isinstance(key, ast.Constant) or not isinstance(key.value, str):
                raise Refused(f"a name that is computed: {ast.unparse(key)}")
            found = held.read(key.value)
            if found is None and default is None:
                raise Refused(f"there is no {key.value!r} to be read")
            return self._expression(default[0], scope) if found is None else found
        if not isinstance(held, dict):
            raise Refused(f"an item of a {type(held).__name__}")
        wanted = self._expression(key, scope)
        otherwise = None if default is None else self._expression(default[0], scope)
        missing = [self._equal(wanted, _constant(k), scope) for k in held]
        if otherwise is None:
            self._fault(scope, ~reduce(operator.or_, missing) if missing else None, f"KeyError: no key for {ast.unparse(key)}")
            otherwise = _constant(next(iter(held.values()), None))
        for hit, value in zip(missing, held.values(), strict=True):
            otherwise = self._chosen(hit, _constant(value), otherwise, scope)
        return otherwise

    def _chosen(self, condition: Column, one: Value, other: Value, scope: _Scope) -> Value:
        """``one`` where the condition holds, else ``other``."""
        one, other = self._alike(condition, one, other, scope)
        column = F.when(condition, one.column).otherwise(other.column)
        nullable = one.nullable or other.nullable
        bounds = {"small": one.small and other.small, "exact": one.exact and other.exact}
        return self._sized(Value(one.kind, column, nullable, size=one.size + other.size + 2, **bounds))

    def _alike(self, condition: Column, one: Value, other: Value, scope: _Scope) -> tuple[Value, Value]:
        if one.kind == other.kind:
            return one, other
        if one.kind == NONE:
            return replace(other, column=F.lit(None).cast(_TYPES[other.kind]), nullable=True, constant=None), other
        if other.kind == NONE:
            return one, replace(one, column=F.lit(None).cast(_TYPES[one.kind]), nullable=True, constant=None)
        if one.kind in NUMBERS and other.kind in NUMBERS:
            if FLOAT in (one.kind, other.kind):
                return self._double(one, scope, condition), self._double(other, scope, ~condition)
            return _whole_number(one), _whole_number(other)
        raise Refused("a value that is text on one way and a number on another")

    def _truth(self, value: Value) -> Column:
        """Whether Python takes the value for true; never NULL."""
        if value.kind == NONE:
            return F.lit(False)
        if value.kind == BOOL:
            found = value.column
        elif value.kind == TEXT:
            found = value.column != ""
        else:
            found = value.column != 0
        return F.coalesce(found, F.lit(False)) if value.nullable else found

    def _both(self, every: bool, nodes: list[ast.expr], scope: _Scope) -> Value:
        value = self._expression(nodes[0], scope)
        for node in nodes[1:]:
            truth = self._truth(value)
            more = self._expression(node, self._under(scope, truth if every else ~truth))
            if value.kind == BOOL and more.kind == BOOL and not value.nullable and not more.nullable:
                column = value.column & more.column if every else value.column | more.column
                value = self._sized(Value(BOOL, column, size=value.size + more.size + 1))
            else:
                value = self._chosen(truth, more, value, scope) if every else self._chosen(truth, value, more, scope)
            scope = self._under(scope, truth if every else ~truth)
        return value

    def _compared(self, left: ast.expr, ops: list[ast.cmpop], nodes: list[ast.expr], scope: _Scope) -> Value:
        one = self._expression(left, scope)
        result: Column | None = None
        for op, node in zip(ops, nodes, strict=True):
            inner = scope if result is None else self._under(scope, result)
            if isinstance(op, (ast.In, ast.NotIn)):
                found = self._member(one, node, inner)
                found = ~found if isinstance(op, ast.NotIn) else found
                other = None
            else:
                other = self._expression(node, inner)
                found = self._comparison(op, one, other, inner)
            result = found if result is None else result & found
            one = other
        return self._sized(Value(BOOL, result, size=3 * len(ops)))

    def _member(self, one: Any, node: ast.expr, scope: _Scope) -> Column:
        held = self._named(node.id, scope) if isinstance(node, ast.Name) else self._literal(node)
        if not isinstance(held, (tuple, list, set, frozenset, dict)):
            raise Refused("in what is not a list of constants")
        hits = [self._equal(one, _constant(x), scope) for x in held]
        return reduce(operator.or_, hits) if hits else F.lit(False)

    def _equal(self, one: Value, other: Value, scope: _Scope) -> Column:
        if NONE in (one.kind, other.kind):
            value = other if one.kind == NONE else one
            return F.lit(True) if value.kind == NONE else value.column.isNull() if value.nullable else F.lit(False)
        if (one.kind == TEXT) != (other.kind == TEXT):
            both_none = [v.column.isNull() for v in (one, other) if v.nullable]
            return reduce(operator.and_, both_none) if len(both_none) == 2 else F.lit(False)
        one, other = self._comparable(one, other, scope)
        found = one.column.eqNullSafe(other.column) if one.nullable or other.nullable else one.column == other.column
        nan = [x for x in (_is_nan(one), _is_nan(other)) if x is not None]
        if nan:  # Spark takes NaN as equal to itself
            found = found & ~F.coalesce(nan[0], F.lit(False))
        return found

    def _comparable(self, one: Value, other: Value, scope: _Scope) -> tuple[Value, Value]:
        """Numbers of one kind, compared without loss."""
        if one.kind == other.kind:
            return one, other
        if FLOAT in (one.kind, other.kind):
            return self._double(one, scope), self._double(other, scope)
        return _whole_number(one), _whole_number(other)

    def _comparison(self, op: ast.cmpop, one: Value, other: Value, scope: _Scope) -> Column:
        if isinstance(op, (ast.Is, ast.IsNot)):
            if NONE not in (one.kind, other.kind):
                raise Refused("is with something else than None")
            found = self._equal(one, other, scope)
            return ~found if isinstance(op, ast.IsNot) else found
        if isinstance(op, (ast.Eq, ast.NotEq)):
            found = self._equal(one, other, scope)
            return ~found if isinstance(op, ast.NotEq) else found
        if TEXT in (one.kind, other.kind):
            if one.kind != other.kind:
                raise Refused("an order of text and a number")
            one, other = (self._not_none_here(v, scope, "TypeError: an order with None") for v in (one, other))
        else:
            one, other = self._number(one, scope, "an order"), self._number(other, scope, "an order")
            one, other = self._comparable(one, other, scope)
        found = _ORDERS[type(op)](one.column, other.column)
        for nan in (_is_nan(one), _is_nan(other)):
            if nan is not None:
                found = found & ~nan
        return found

    def _negated(self, value: Value, scope: _Scope) -> Value:
        value = self._number(value, scope, "a sign")
        if value.kind == INT:
            return self._arithmetic(ast.Sub(), _constant(0), value, scope)
        return Value(FLOAT, -value.column, constant=None if value.constant is None else -value.constant, size=value.size + 1)

    def _arithmetic(self, op: ast.operator, one: Value, other: Value, scope: _Scope) -> Value:
        name = type(op).__name__
        if TEXT in (one.kind, other.kind):
            raise Refused(f"{name} of text")
        one, other = self._number(one, scope, name), self._number(other, scope, name)
        size = one.size + other.size + 1
        whole = one.kind == INT and other.kind == INT
        if name in ("Add", "Sub", "Mult"):
            if not whole:
                one, other = self._double(one, scope), self._double(other, scope)
                column = _SUMS[name](one.column, other.column)
                return self._sized(Value(FLOAT, column, constant=_folded(name, one, other), size=size))
            column = _TRIED[name](one.column, other.column)
            if not (one.small and other.small):  # two of 32 bits cannot pass 64
                self._fault(scope, column.isNull(), "OverflowError: an integer beyond 64 bits")
            return self._sized(Value(INT, column, size=size))
        if name in ("Div", "Mod", "FloorDiv"):
            if name != "Div" and not whole:
                raise Refused(f"{name} of floats")
            if other.constant is None or other.constant == 0:
                self._fault(scope, other.column == 0, "ZeroDivisionError: division by zero")
            if name == "Div":
                one, other = self._double(one, scope), self._double(other, scope)
                return self._sized(Value(FLOAT, F.try_divide(one.column, other.column), size=size))
            rest = F.try_mod(one.column, other.column)
            odd = (rest != 0) & ((rest < 0) != (other.column < 0))
            if name == "Mod":
                column = F.when(odd, rest + other.column).otherwise(rest)
                return self._sized(Value(INT, column, size=3 * size, small=other.small))
            # the one quotient that does not fit in 64 bits, and a zero, are not divided
            safe = (other.column != 0) & ((other.column != -1) | (one.column != F.lit(-_LONG)))
            cut = F.when(safe, F.call_function("div", one.column, other.column))
            if not one.small:
                self._fault(scope, cut.isNull(), "OverflowError: an integer beyond 64 bits")
            bounds = {"small": False, "exact": one.small or one.exact}
            return self._sized(Value(INT, F.when(odd, cut - 1).otherwise(cut), size=4 * size, **bounds))
        raise Refused(f"the operator {name}")

    # Functions

    def _called(self, name: str, nodes: list[ast.expr], scope: _Scope) -> Any:
        if name in scope.names or name in self.module.names:
            arguments = [self._any(node, scope) for node in nodes]
            return self._call(self.module.function(name), arguments, scope)
        if name.startswith("math.") and self.module.get("math") is not math:
            raise Refused("math is not the module of that name")
        if name not in CALLS:
            raise Refused(f"the function {name}")
        values = [self._expression(node, scope) for node in nodes]
        if name in ("min", "max"):
            return self._extreme(name, values, scope)
        if len(values) != 1:
            raise Refused(f"{name} of {len(values)} arguments")
        (value,) = values
        if name == "bool":
            return Value(BOOL, self._truth(value), size=value.size + 1)
        value = self._number(value, scope, name)
        if name == "float":
            return self._double(value, scope)
        if name in ("math.sqrt", "math.fabs", "math.isnan"):
            number = self._double(value, scope).column
            if name == "math.isnan":
                return Value(BOOL, F.isnan(number), size=value.size + 1)
            if name == "math.fabs":
                return Value(FLOAT, F.abs(number), size=value.size + 1)
            self._fault(scope, (number < 0) & ~F.isnan(number), "ValueError: math domain error")
            return Value(FLOAT, F.sqrt(number), size=value.size + 1)
        if value.kind == INT:
            if name != "abs":
                return value
            smallest = value.column == F.lit(-_LONG)
            if not value.small:
                self._fault(scope, smallest, "OverflowError: an integer beyond 64 bits")
            return Value(INT, F.when(~smallest, F.abs(value.column)), size=value.size + 3, exact=value.small or value.exact)
        if name == "abs":
            return Value(FLOAT, F.abs(value.column), size=value.size + 1)
        return self._whole(name, value, scope)

    def _whole(self, name: str, value: Value, scope: _Scope) -> Value:
        """A float to an integer."""
        number = value.column
        self._fault(scope, F.isnan(number), "ValueError: NaN is no integer")
        self._fault(scope, F.abs(number) >= float(_LONG), "OverflowError: an integer beyond 64 bits")
        cut = F.when(number < 0, F.ceil(number)).otherwise(F.floor(number))
        found = {"int": cut, "math.floor": F.floor(number), "math.ceil": F.ceil(number), "round": F.rint(number)}[name]
        safe = F.when(F.abs(number) < float(_LONG), found.cast("long"))
        return Value(INT, safe, size=value.size + 4)

    def _extreme(self, name: str, values: list[Value], scope: _Scope) -> Value:
        """Python keeps the first unless a later one is beyond it, so NaN counts only in first place."""
        if len(values) < 2:
            raise Refused(f"{name} of {len(values)} arguments")
        best = values[0]
        for value in values[1:]:
            beyond = self._comparison(ast.Gt() if name == "max" else ast.Lt(), value, best, scope)
            best = self._chosen(beyond, replace(value, nullable=False), replace(best, nullable=False), scope)
        return best


def _folded(name: str, one: Value, other: Value) -> float | None:
    if one.constant is None or other.constant is None:
        return None
    return _SUMS[name](float(one.constant), float(other.constant))


_TYPES = {INT: "long", FLOAT: "double", BOOL: "boolean", TEXT: "string"}
_ORDERS: dict[type, Callable[[Any, Any], Any]] = {ast.Lt: operator.lt, ast.LtE: operator.le, ast.Gt: operator.gt, ast.GtE: operator.ge}
_SUMS: dict[str, Callable[[Any, Any], Any]] = {"Add": operator.add, "Sub": operator.sub, "Mult": operator.mul}
_TRIED = {"Add": F.try_add, "Sub": F.try_subtract, "Mult": F.try_multiply}


def attribute_values(schema: T.StructType, names: Iterable[str], of: Callable[[str], Column]) -> dict[str, Value]:
    """The attributes that a compiled rule can read, by name; those of other types are left out."""
    fields = {f.name: f for f in schema.fields}
    found: dict[str, Value] = {}
    for name in names:
        if name not in fields:
            continue
        kind, nullable = fields[name].dataType, fields[name].nullable
        if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            found[name] = Value(INT, of(name).cast("long"), nullable, small=True)
        elif isinstance(kind, T.LongType):
            found[name] = Value(INT, of(name), nullable)
        elif isinstance(kind, (T.DoubleType, T.FloatType)):
            found[name] = Value(FLOAT, of(name).cast("double"), nullable)
        elif isinstance(kind, T.BooleanType):
            found[name] = Value(BOOL, of(name), nullable)
        elif isinstance(kind, T.StringType):
            found[name] = Value(TEXT, of(name), nullable)
    return found


class _Kinds:
    """The kinds of results computed so far; a later rule sees an integer as an integer, though its column is a double."""

    def __init__(self, null_results: str, given: Iterable[str] = ()) -> None:
        self.keep = null_results == "keep"
        self.of: dict[str, Value] = {name: Value(FLOAT, F.lit(0.0), self.keep) for name in given}

    def settle(self, name: str, value: Value) -> None:
        if value.kind == TEXT:
            raise Refused(f"{name} is text")
        self.of[name] = value

    def read(self, name: str, column: Column) -> Value:
        known = self.of[name]
        nullable = self.keep and known.nullable
        if known.kind == INT:
            return Value(INT, column.cast("long"), nullable, small=known.small, exact=True)
        if known.kind == BOOL:
            return Value(BOOL, column != 0, nullable)
        return Value(FLOAT, column, nullable)


def translated(
    module: Module, function: str, name: str, variables: Mapping[str, Column], parameters: Mapping[str, float], attributes: Mapping[str, Value],
    kinds: _Kinds,
) -> Compiled:
    """One rule as expressions, or ``Refused``."""
    written: dict[str, Value] = {}

    def read(result: str) -> Value | None:
        if result in written:
            return written[result]
        if result not in kinds.of or result not in variables:
            return None
        return kinds.read(result, variables[result])

    translator = Translator(module, _Mapping(read, written.__setitem__), parameters, attributes)
    value = translator.rule(function)
    for result, held in ((name, value), *written.items()):
        if held.kind == INT and not held.small and not held.exact:
            # The column of a result is a double, which holds integers to 2 ** 53.
            translator.faults.append((~held.column.between(-_EXACT, _EXACT), f"OverflowError: {result} is an integer beyond 53 bits"))
        kinds.settle(result, held)
    return Compiled(value, written, translator.faults)


def compile_policy(
    policy: Policy, schema: T.StructType, *, attributes: Sequence[str] | None = None, strict_dependencies: bool = False,
    null_results: str = "error",
) -> tuple[Policy, dict[str, str]]:
    """``policy`` with its Python rules as column rules, and why those that stay in Python do, by component.

    ``schema`` is that of the table the policy will be applied to.
    """
    module = Module.of_source(policy.source)
    names = schema.names if attributes is None else attributes
    refused: dict[str, str] = {}
    parts: list[Component] = []
    # A dry run tells what compiles, and what kinds results have; the plan is built when the policy is applied.
    kinds = _Kinds(null_results)
    known: dict[str, Column] = {}
    for component in policy.ordered:
        if component.kind != PYTHON:
            parts.append(component)
        else:
            own = module if component.function is None else Module.of_function(component.function)
            name = component.name if component.function is None else getattr(component.function, "__name__", "")
            visible = [n for n in names if not strict_dependencies or n in component.dependencies]
            rule = CompiledRule(own, name, component, schema, visible, null_results)
            rule.fingerprint = source_key(own, name, policy.source) if component.function is None else function_key(component.function)
            try:
                rule.dry(known, policy.parameters, kinds)
            except Refused as reason:
                refused[component.name] = str(reason)
                # the rest of a policy file is one module, also for a component that stays behind
                parts.append(replace(component, source=None if component.function is not None else policy.source))
            else:
                parts.append(replace(component, function=rule, kind=COLUMN, source=None))
        for result in (component.name, *component.extra_outputs):
            known[result] = F.lit(0.0)
            kinds.of.setdefault(result, Value(FLOAT, F.lit(0.0), null_results == "keep"))
            if component.name in refused or component.kind != PYTHON:
                kinds.of[result] = Value(FLOAT, F.lit(0.0), null_results == "keep")
    compiled = Policy(policy.name, parts, policy.label, policy.shared_parameters)
    return compiled, refused


class CompiledRule:
    """A compiled component as a column rule."""

    def __init__(self, module: Module, function: str, component: Component, schema: T.StructType, visible: list[str], null_results: str):
        self.module, self.function, self.component = module, function, component
        self.schema, self.visible, self.null_results = schema, visible, null_results
        self.kinds: dict[str, Value] = {}
        self.fingerprint: Any = None  # what it was made of

    def _translated(self, variables: Mapping[str, Column], parameters: Mapping[str, float], of: Callable[[str], Column], kinds: _Kinds) -> Compiled:
        attributes = attribute_values(self.schema, self.visible, of)
        found = translated(self.module, self.function, self.component.name, variables, parameters, attributes, kinds)
        missing = {*self.component.extra_outputs} - set(found.extra)
        undeclared = set(found.extra) - {*self.component.extra_outputs, self.component.name}
        if missing or undeclared:
            raise Refused(f"it sets {', '.join(sorted(found.extra)) or 'nothing'} beside its result")
        return found

    def dry(self, variables: Mapping[str, Column], parameters: Mapping[str, float], kinds: _Kinds) -> None:
        trial = _Kinds(self.null_results)
        trial.of = dict(kinds.of)
        self._translated(variables, parameters, lambda name: F.lit(None), trial)
        self.kinds = dict(kinds.of)  # what this rule's reads are
        kinds.of = trial.of

    def with_fault(self, variables: Any, parameters: Mapping[str, float], row: Mapping[str, Column]) -> tuple[Column, Column]:
        """(the value, what Python would complain of): nothing is an error, and what is beside it is set."""
        found = self._compiled(variables, parameters, row)
        for name, value in found.extra.items():
            variables[name] = _as_double(value)
        text = found.fault()
        return _as_double(found.value), F.when(text.isNotNull(), F.concat(F.lit(f"component {self.component.name}: "), text))

    def _compiled(self, variables: Any, parameters: Mapping[str, float], row: Mapping[str, Column]) -> Compiled:
        kinds = _Kinds(self.null_results)
        kinds.of = dict(self.kinds)
        return self._translated(variables, parameters, lambda name: row[name], kinds)

    def __call__(self, variables: Any, parameters: Mapping[str, float], row: Mapping[str, Column]) -> Column:
        found = self._compiled(variables, parameters, row)
        for name, value in found.extra.items():
            variables[name] = found.checked(value, self.component.name)
        return found.checked(found.value, self.component.name)
