from __future__ import annotations

import itertools
import math
import textwrap

import pytest
from helpers import plan
from pyspark.sql import functions as F

from levyframe import Component, Policy, apply_policy, compare_policies, compile_policy
from levyframe.errors import PolicyError
from levyframe.functions.names import column
from levyframe.operators.compile_rules import Module, _Kinds, attribute_values, translated

NAN, INF = float("nan"), float("inf")
SCHEMA = "a double, b double, n int, m int, big long, s string, t string, f boolean, at long"


def rows() -> list[tuple]:
    floats, whole = [None, NAN, 0.0, -0.0, 2.5, -1.5, INF, 1e300], [None, 0, 3, -4]
    texts, flags, bigs = [None, "", "R", "x"], [None, True, False], [None, 1 << 62, -(1 << 63), 7]
    made = [(a, b, n, m) for a, b, n, m in itertools.product(floats, floats, whole, whole)]
    return [
        (*r, bigs[k % 4], texts[k % 4], texts[(k // 4) % 4], flags[k % 3], k) for k, r in enumerate(made)
    ]


HEAD = """
import math
RATES = {"R": 0.5, "x": 2, "": 0.0}
LIMIT = 2.0
STEPS = (1, 2.5, "R")

def half(x):
    return x / 2

def sign(x):
    if x > 0:
        return 1
    elif x < 0:
        return -1
    return 0

twice = lambda x: x + x
"""

RULES = {
    "product": "return a['a'] * (1 - a['b']) + p['tau']",
    "quotient": "return a['a'] / a['b']",
    "whole quotient": "return a['n'] / a['m']",
    "whole division": "return a['n'] // a['m'] * 10 + a['n'] % a['m']",
    "guarded": "return a['a'] / a['b'] if a['b'] is not None and a['b'] != 0 else 0",
    "none": "return None if a['a'] is None else a['a']",
    "equal": "return a['a'] == a['b']",
    "unequal": "return (a['a'] != a['b']) + (a['n'] != a['m'])",
    "order": "return (a['a'] < a['b']) + 2 * (a['a'] >= a['b'])",
    "chain": "return 0 <= a['n'] < a['a'] <= 100",
    "chain stops": "return 1 < a['n'] < a['m']",
    "text": "return 1.0 if a['s'] == 'R' else 0.0",
    "texts": "return a['s'] == a['t']",
    "text order": "return a['s'] < a['t']",
    "text and number": "return a['s'] == 1 or a['s'] == a['n']",
    "member": "return a['s'] in ('R', '') or a['n'] in STEPS",
    "not member": "return a['a'] not in [2.5, 0, None]",
    "and value": "return a['a'] and a['b']",
    "or value": "return a['n'] or a['m'] or 5",
    "not": "return (not a['a']) + (not a['s']) + (not a['f'])",
    "short": "return a['f'] and a['a'] / a['b'] > 1",
    "flag": "return a['f'] + 1",
    "lookup": "return RATES[a['s']]",
    "lookup default": "return RATES.get(a['s'], 9) + {1: 2, 3: 4.5}.get(a['n'], 0)" if False else "return RATES.get(a['s'], 9)",
    "lookup none": "return RATES.get(a['s'])",
    "helper": "return half(a['a']) + twice(a['n'])",
    "helper with if": "return sign(a['a']) * 2 + sign(a['n'])",
    "extremes": "return max(a['a'], a['b']) + min(a['n'], a['m'], 2)",
    "extreme of kinds": "return max(0, a['a'])",
    "functions": "return abs(a['a']) + abs(a['n']) + math.fabs(a['b'])",
    "root": "return math.sqrt(a['a'])",
    "to whole": "return int(a['a'])",
    "rounded": "return round(a['a']) + math.floor(a['b']) - math.ceil(a['b'])",
    "is nan": "return math.isnan(a['a'])",
    "minus": "return -a['a'] + -a['n']",
    "large": "return a['big'] + a['n']",
    "large product": "return a['big'] * 4",
    "large and float": "return a['big'] + a['a']",
    "large order": "return a['big'] > a['a']",
    "large division": "return a['big'] // a['n'] + a['big'] % 7",
    "large on one way": "return a['big'] if a['n'] == 3 else a['a']",
    "unused fault": """
        x = a['a'] / a['b']
        return 1.0
        """,
    "unused fault on one way": """
        if a['n'] == 3:
            x = a['a'] / a['b']
        return 1.0
        """,
    "assigned on ways": """
        if a['s'] == 'R':
            x = a['a']
        elif a['s'] is None:
            x = 0
        else:
            x = a['n']
        x += 1
        return x * LIMIT
        """,
    "returns on ways": """
        if a['n'] is None:
            return 1
        if a['n'] > 0:
            if a['m'] is None:
                return 2
            y = a['m']
        else:
            y = -1
        if y < 0:
            return y
        return y + a['n'] * 10
        """,
    "falls through": """
        if a['n'] == 3:
            return a['a']
        """,
    "bare return": """
        if a['f']:
            return
        return 2.0
        """,
    "docstring": """
        'what it does'
        pass
        rate: float = p['tau']
        return rate
        """,
    "nested": "return (1 if a['a'] > 0 else 2) if a['b'] > 0 else (a['n'] if a['f'] else None)",
    "constant": "return 3",
}


# Where Python's integers go beyond 64 bits, or beyond what a double holds: an error, not a wrong number.
BEYOND = ("large", "large product", "large and float", "large order", "large division", "large on one way", "to whole", "rounded")


def source(body: str) -> str:
    return HEAD + "\ndef rule(v, p, a):\n" + textwrap.indent(textwrap.dedent(body).strip("\n"), "    ") + "\n"


def in_python(function, row: dict):
    try:
        value = function({}, {"tau": 0.25}, row)
    except (TypeError, ZeroDivisionError, KeyError, ValueError, OverflowError) as error:
        return type(error).__name__
    return None if value is None else float(value)


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(4).cache()


@pytest.mark.parametrize("name", list(RULES))
def test_every_row_is_what_python_makes_of_it(spark, table, name):
    text = source(RULES[name])
    kinds = _Kinds("keep")
    found = translated(Module.of_source(text), "rule", "rule", {}, {"tau": 0.25}, attribute_values(table.schema, table.columns, column), kinds)
    fault = found.fault()
    value = F.when(fault.isNull(), found.value.column.cast("double"))
    got = {r["at"]: r for r in table.select("*", value.alias("value"), fault.alias("fault")).collect()}
    module: dict = {}
    exec(text, module)
    for row in rows():
        named = dict(zip(table.columns, row, strict=True))
        wanted, r = in_python(module["rule"], named), got[named["at"]]
        if isinstance(wanted, str) and (r["fault"] or "").split(":")[0] == wanted:
            continue
        if r["fault"] is not None and name in BEYOND:
            assert "an integer beyond" in r["fault"] and (1e300 in row or abs(named["big"] or 0) > 1 << 53)
        else:
            assert r["fault"] is None, (named, r)
            same = (r["value"] is None) == (wanted is None) and (
                wanted is None or r["value"] == wanted or (math.isnan(wanted) and math.isnan(r["value"]))
            )
            assert same, (named, wanted, r)


REFUSED = {
    "power": ("return a['a'] ** 2", "Pow"),
    "round to digits": ("return round(a['a'], 2)", "round of 2"),
    "loop": ("for x in (1, 2):\n    pass\nreturn 1", "For"),
    "float remainder": ("return a['a'] % 2", "Mod of floats"),
    "text sum": ("return a['s'] + 'x'", "text"),
    "computed name": ("return a[a['s']]", "computed"),
    "unknown function": ("return math.exp(a['a'])", "math.exp"),
    "unknown name": ("return rate", "rate is not defined"),
    "absent attribute": ("return a['zz']", "no 'zz'"),
    "absent parameter": ("return p['zz']", "no 'zz'"),
    "absent result": ("return v['zz']", "no 'zz'"),
    "one way only": ("if a['n'] == 1:\n    x = 1\nreturn x", "not set on every way"),
    "kinds mix": ("return 'x' if a['n'] == 1 else 1", "text"),
    "recursion": ("return rule(v, p, a)", "deeply"),
    "lambda call": ("return (lambda x: x)(1)", "function"),
}


@pytest.mark.parametrize("name", list(REFUSED))
def test_refused_with_a_reason(table, name):
    body, reason = REFUSED[name]
    policy = Policy("p", [Component("rule", source=source(body), kind="python", parameters={"tau": 0.25})])
    compiled, refused = compile_policy(policy, table.schema)
    assert reason in refused["rule"] and compiled.kind == "python"


def test_other_statements_of_the_module_refuse_its_rules(table):
    for extra, reason in (("x = open('f')", None), ("import os", "Import"), ("class A: pass", "ClassDef")):
        text = extra + "\ndef rule(v, p, a):\n    return 1.0\n"
        _, refused = compile_policy(Policy("p", [Component("rule", source=text, kind="python")]), table.schema)
        assert (reason is None) == ("rule" not in refused) and (reason is None or reason in refused["rule"])
    decorated = "@staticmethod\ndef rule(v, p, a):\n    return 1.0\n"
    assert "decorated" in compile_policy(Policy("p", [Component("rule", source=decorated, kind="python")]), table.schema)[1]["rule"]


BASE = {"tau": 0.25, "rho": 2.0}
POLICY = Policy("levy", [
    Component("net", parameters=BASE, source="def net(v, p, a):\n    return a['x'] * (1 - p['tau'])\n", kind="python", logical_order=1),
    Component("steps", source="def steps(v, p, a):\n    v['low'] = v['net'] / p['rho']\n    return int(v['net'])\n", kind="python",
              logical_order=2, extra_outputs=("low",)),
    Component("due", source="def due(v, p, a):\n    return v['steps'] // 2 if v['low'] > 1 and a['s'] == 'R' else v['steps'] + 0.5\n",
              kind="python", logical_order=3),
])


@pytest.fixture(scope="module")
def small(spark):
    return spark.createDataFrame([(float(k), "R" if k % 2 else "N", k) for k in range(12)], "x double, s string, k long")


def test_a_policy_of_source_is_one_projection_and_needs_no_trust(small):
    with pytest.raises(PolicyError, match="trust_source"):
        apply_policy(small, POLICY)
    fast, slow = apply_policy(small, POLICY, compiled=True), apply_policy(small, POLICY, trust_source=True)
    assert "Python" not in plan(fast) and "Arrow" not in plan(fast) and "Exchange" not in plan(fast)
    assert fast.schema == slow.schema and sorted(fast.collect()) == sorted(slow.collect())


def test_a_refused_rule_stays_in_python_and_keeps_its_helpers(small):
    rules = [
        Component("net", source="def half(x):\n    return x / 2\ndef net(v, p, a):\n    return half(a['x'])\n", kind="python", logical_order=1),
        Component("curve", source="def curve(v, p, a):\n    return half(v['net']) ** 1.5\n", kind="python", logical_order=2),
        Component("due", source="def due(v, p, a):\n    return v['curve'] + v['net']\n", kind="python", logical_order=3),
    ]
    policy = Policy("p", rules)
    compiled, refused = compile_policy(policy, small.schema)
    assert list(refused) == ["curve"] and [c.kind for c in compiled.ordered] == ["column", "python", "column"]
    with pytest.raises(PolicyError, match="curve"):
        apply_policy(small, policy, compiled=True)
    fast, slow = (apply_policy(small, policy, trust_source=True, compiled=c) for c in (True, False))
    assert sorted(fast.collect()) == sorted(slow.collect())


def test_given_functions_and_both_policies(small):
    rate = 0.5

    def due(v, p, a):
        return a["x"] * rate * p["tau"] if a["s"] != "R" else v["free"]

    def free(v, p, a):
        return 0

    rules = [Component("free", free, kind="python"), Component("due", due, {"tau": 3.0}, 1, kind="python")]
    base, variant = Policy("a", rules), Policy("b", [rules[0], Component("due", due, {"tau": 4.0}, 1, kind="python")])
    fast, slow = (compare_policies(small, base, variant, compiled=c) for c in (True, False))
    assert "Python" not in plan(fast) and sorted(fast.collect()) == sorted(slow.collect())
    unknown = Component("due", lambda v, p, a: 1.0, kind="python")
    assert "due" in compile_policy(Policy("a", [unknown]), small.schema)[1]


def test_null_results_and_hidden_attributes(spark):
    df = spark.createDataFrame([(1, None), (2, 3.0)], "k int, x double")
    rule = "def due(v, p, a):\n    return a['x']\n"
    after = "def more(v, p, a):\n    return 0 if v['due'] is None else v['due'] + 1\n"
    policy = Policy("p", [Component("due", source=rule, kind="python"), Component("more", source=after, kind="python", logical_order=1)])
    kept = apply_policy(df, policy, compiled=True, null_results="keep")
    assert sorted(tuple(r) for r in kept.collect()) == [(1, None, None, 0.0), (2, 3.0, 3.0, 4.0)]
    with pytest.raises(Exception, match="no value"):
        apply_policy(df, policy, compiled=True).collect()
    _, refused = compile_policy(policy, df.schema, strict_dependencies=True)
    assert "no 'x'" in refused["due"]


def test_a_fault_stops_the_query_and_names_the_rule(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "x double, y double")
    policy = Policy("p", [Component("due", source="def due(v, p, a):\n    return a['x'] / a['y']\n", kind="python")])
    with pytest.raises(Exception, match="component due: ZeroDivisionError"):
        apply_policy(df, policy, compiled=True).collect()


def test_a_rule_that_grows_too_large_is_refused(small):
    lines = ["x = a['x']"] + ["x = x * x + x"] * 40 + ["return x"]
    text = "def rule(v, p, a):\n" + textwrap.indent("\n".join(lines), "    ")
    assert "operations" in compile_policy(Policy("p", [Component("rule", source=text, kind="python")]), small.schema)[1]["rule"]
