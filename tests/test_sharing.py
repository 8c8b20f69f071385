from __future__ import annotations

import ast
import sys
from dataclasses import replace

import pytest
from helpers import plan
from pyspark import cloudpickle

from levyframe import Component, Policy, compare_policies
from levyframe.operators.sharing import reads
from levyframe.plans import policies


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tests cannot be imported where tasks run


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(float(k), k % 3, "R" if k % 2 else "N") for k in range(30)], "x double, n int, s string").coalesce(1)


def counting(spark):
    count = spark.sparkContext.accumulator(0)

    def net(v, p, a):
        count.add(1)
        return a["x"] * p["tau"]

    return count, net


def due(v, p, a):
    return v["net"] * p["rho"]


def total(v, p, a):
    return sum(v.values()) + a["n"]


def two(net, kind="python", tau=(0.5, 0.5), rho=(2.0, 3.0), **more):
    return [
        Policy(name, [
            Component("net", net, {"tau": t}, 1, kind=kind, **more), Component("due", due, {"rho": r}, 2, kind=kind),
            Component("again", due, {"rho": r}, 3, kind=kind),
        ])
        for name, t, r in zip("ab", tau, rho, strict=True)
    ]


def alone(df, base, variant):
    """Both policies evaluated by themselves."""
    from levyframe import apply_policy

    one, other = (apply_policy(df, p, prefix=prefix).collect() for p, prefix in ((base, "baseline_"), (variant, "variant_")))
    return sorted({**a.asDict(), **b.asDict()}.items() for a, b in zip(one, other, strict=True))


def both(df, base, variant, **options):
    wide = compare_policies(df, base, variant, **options)
    return sorted({k: v for k, v in r.asDict().items() if not k.startswith("diff_")}.items() for r in wide.collect())


def test_a_shared_python_component_is_called_once_a_row(spark, df):
    count, net = counting(spark)
    base, variant = two(net)
    wide = compare_policies(df, base, variant)
    wide.collect()
    assert count.value == 30
    assert plan(wide).count("ArrowEvalPython") == 1 and "variant_net" in wide.columns
    assert both(df, base, variant) == alone(df, base, variant)


def test_another_parameter_is_another_result(spark, df):
    count, net = counting(spark)
    base, variant = two(net, tau=(0.5, 0.25))
    compare_policies(df, base, variant).collect()
    assert count.value == 60 and both(df, base, variant) == alone(df, base, variant)


def test_what_follows_a_changed_result_is_not_shared(spark, df):
    base, variant = two(lambda v, p, a: a["x"], rho=(2.0, 2.0))
    variant = replace(variant, components=[replace(variant.components[0], function=lambda v, p, a: a["n"]), *variant.components[1:]])
    assert both(df, base, variant) == alone(df, base, variant)
    assert [r.baseline_due for r in compare_policies(df, base, variant).collect()] != [r.variant_due for r in compare_policies(df, base, variant).collect()]


def test_a_rule_that_reads_everything_is_shared_only_after_equal_results(df):
    last = Component("total", total, logical_order=9, kind="python")
    for rho in ((2.0, 2.0), (2.0, 3.0)):
        base, variant = (Policy(p.name, [*p.components, last]) for p in two(lambda v, p, a: a["x"] * p["tau"], rho=rho))
        assert both(df, base, variant) == alone(df, base, variant)


def test_extra_results_are_shared_with_their_component(df):
    def pair(v, p, a):
        v["low"] = a["x"] - 1
        return a["x"] + 1

    def low(v, p, a):
        return v["low"] * p["k"]

    made = [Policy("p", [Component("pair", pair, kind=kind, extra_outputs=("low",)), Component("less", low, {"k": k}, 1, kind=kind)])
            for kind in ("python", "column") for k in (1.0, 2.0)]
    for base, variant in (made[:2], made[2:]):
        assert both(df, base, variant) == alone(df, base, variant)


def test_strict_dependencies_are_part_of_what_a_component_is(df):
    def seen(v, p, a):
        return len(a)

    base, variant = (Policy("p", [Component("seen", seen, kind="python", dependencies=d)]) for d in (("x",), ("x", "n")))
    got = compare_policies(df, base, variant, strict_dependencies=True).first()
    assert (got.baseline_seen, got.variant_seen) == (1.0, 2.0)


@pytest.mark.parametrize("kind", ["column", "vector"])
def test_columns_and_vectors(df, kind):
    net = lambda v, p, a: a["x"] * p["tau"]
    base, variant = two(net, kind)
    wide = compare_policies(df, base, variant)
    assert both(df, base, variant) == alone(df, base, variant)
    if kind == "column":
        assert plan(wide).count("(x#") <= 1 or plan(wide).count(" * 0.5") == 1


def test_compiled_source_is_shared(df):
    text = "RATE = 0.5\ndef net(v, p, a):\n    return a['x'] * RATE\n"
    rest = "def due(v, p, a):\n    return v['net'] * p['rho']\n"
    base, variant = (
        Policy("p", [Component("net", source=text, kind="python"), Component("due", source=rest, parameters={"rho": r}, logical_order=1, kind="python")])
        for r in (2.0, 3.0)
    )
    wide = compare_policies(df, base, variant, compiled=True)
    assert plan(wide).count(" * 0.5") == 1 and "Python" not in plan(wide)
    changed = replace(variant, components=[replace(variant.components[0], source=text.replace("0.5", "0.75")), variant.components[1]])
    row = compare_policies(df, base, changed, compiled=True).where("x = 4").first()
    assert (row.baseline_net, row.variant_net, row.diff_due) == (2.0, 3.0, 5.0)
    slow = compare_policies(df, base, changed, trust_source=True).where("x = 4").first()
    assert row == slow


def test_what_a_rule_reads():
    def of(text):
        return reads(ast.parse(text).body[0])

    assert of("def f(v, p, a):\n    return v['x'] + p.get('y', 1) + a['z']") == ({"x"}, {"y"})
    assert of("def f(v, p, a):\n    return g(v)") is None
    assert of("def f(v, p, a):\n    q = p\n    return q['x']") is None
    assert of("def f(v, p, a):\n    return v[a['x']]") is None
    assert of("def f(v, p, a):\n    return (lambda v: 1)(2)") is None


def test_registered_policies(spark):
    count = spark.sparkContext.accumulator(0)

    def net(v, p, a):
        count.add(1)
        return a["l_extendedprice"] * (1 - a["l_discount"])

    df = spark.createDataFrame([(100.0 + k, 0.05, "R") for k in range(20)], "l_extendedprice double, l_discount double, l_returnflag string")
    base, variant = policies.python_baseline(), policies.python_variant()
    given = lambda p: replace(p, components=[replace(c, function=net) if c.name == "net" else c for c in p.components])
    wide = compare_policies(df, given(base), given(variant))
    wide.collect()
    assert count.value == 20
