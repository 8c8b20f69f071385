from __future__ import annotations

import sys

import numpy as np
import pytest
from helpers import plan
from pyspark import cloudpickle
from pyspark.sql import functions as F

from levyframe import Component, Policy, apply_policy, compare_policies
from levyframe.errors import PolicyError

cloudpickle.register_pickle_by_value(sys.modules[__name__])
SOURCES = {
    "half": "def half(v, p, a):\n    return a['x'] / 2\n",
    "share": "def share(v, p, a):\n    v['low'] = v['half'] - 1\n    return v['half'] / a['n']\n",
    "levy": "def levy(v, p, a):\n    return v['share'] * p['tau'] + RATES[a['s']]\nRATES = {'R': 1.0, 'N': 2.0}\n",
}


def by_hand(kind="python"):
    def half(v, p, a):
        return a["x"] / 2

    def share(v, p, a):
        v["low"] = v["half"] - 1
        if kind == "vector" and (a["n"] == 0).any():
            raise ZeroDivisionError("division by zero")
        return v["half"] / a["n"]

    def levy(v, p, a):
        rates = {"R": 1.0, "N": 2.0}
        if kind == "vector":
            return v["share"] * p["tau"] + np.array([rates[s] for s in a["s"]])
        return v["share"] * p["tau"] + rates[a["s"]]

    return policy({"half": half, "share": share, "levy": levy}, kind)


def policy(functions=None, kind="python", tau=0.5):
    parts = []
    for order, name in enumerate(("half", "share", "levy")):
        given = {"function": functions[name]} if functions else {"source": SOURCES[name]}
        extra = ("low",) if name == "share" else ()
        parts.append(Component(name, kind=kind, parameters={"tau": tau}, logical_order=order, extra_outputs=extra, **given))
    return Policy("p", parts)


ROWS = [(1, 4.0, 2, "R"), (2, 6.0, 0, "R"), (3, None, 1, "N"), (4, 8.0, 4, "z"), (5, 2.0, 0, "z"), (6, 1.0, 1, None), (7, 3.0, 3, "N")]
FAULTY = {2: "share", 3: "half", 4: "levy", 5: "share", 6: "levy"}


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "k int, x double, n int, s string").coalesce(1)


def told(wide, prefix=""):
    return {r["k"]: r for r in wide.collect()} | {"columns": wide.columns}


@pytest.mark.parametrize("way", ["python", "compiled", "vector"])
def test_the_first_fault_of_a_row(df, way):
    rows = df.where("k <> 3") if way == "vector" else df  # NULL is NaN for a vector, no error
    rules = by_hand(way) if way == "vector" else policy()
    options = {"compiled": True} if way == "compiled" else {"trust_source": True}
    got = told(apply_policy(rows, rules, faults=True, **options))
    assert got["columns"][-5:] == ["half", "share", "low", "levy", "fault"]
    for k, x, n, s in ROWS:
        if way == "vector" and k == 3:
            continue
        r = got[k]
        if k not in FAULTY:
            assert r.fault is None and (r.half, r.share, r.low) == (x / 2, x / 2 / n, x / 2 - 1) and r.levy is not None
            continue
        assert r.fault.component == FAULTY[k] and f"component {FAULTY[k]}: " in r.fault.message
        seen = ["half", "share", "levy"].index(FAULTY[k])
        assert [r.half is None, r.share is None, r.low is None, r.levy is None] == [seen < 1, seen < 2, seen < 2, True]


def test_both_ways_tell_the_same_kind_of_error(df):
    slow, fast = (told(apply_policy(df, policy(), faults=True, trust_source=True, compiled=c)) for c in (False, True))
    for k in FAULTY:
        assert slow[k].fault.message.split(":")[:2] == fast[k].fault.message.split(":")[:2]
        assert slow[k][:-1] == fast[k][:-1]
    assert "Python" not in plan(apply_policy(df, policy(), faults=True, compiled=True))


def test_strict_evaluation_is_unchanged(df):
    for compiled in (False, True):
        with pytest.raises(Exception, match="component "):
            apply_policy(df, policy(), trust_source=True, compiled=compiled).collect()
    good = df.where("k in (1, 7)")
    both = [sorted(r[4:8] for r in apply_policy(good, policy(), trust_source=True, faults=f).collect()) for f in (False, True)]
    assert both[0] == both[1]


def test_missing_values(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "k int, x double")
    rules = [Component("a", lambda v, p, a: a["x"], kind=None or "column"), Component("b", lambda v, p, a: v["a"] + 1, logical_order=1)]
    got = told(apply_policy(df, Policy("p", rules), faults=True))
    assert got[1].fault is None and got[1].b == 3.0
    assert tuple(got[2].fault) == ("a", "component a returned no value") and got[2].b is None
    kept = told(apply_policy(df, Policy("p", rules), faults=True, null_results="keep"))
    assert kept[2].fault is None and kept[2].a is None
    text = Policy("p", [Component("a", lambda v, p, a: "x" if a["k"] == 1 else 1, kind="python")])
    got = told(apply_policy(df, text, faults=True))
    assert "returned str" in got[1].fault.message and got[2].a == 1.0


def test_policies_of_several_kinds(df):
    rules = by_hand().components
    mixed = Policy("p", [
        Component("half", lambda v, p, a: F.coalesce(a["x"], F.lit(None)) / 2, kind="column"), *rules[1:],
        Component("last", lambda v, p, a: v["levy"] * 2, kind="column", logical_order=9),
    ])
    got = told(apply_policy(df, mixed, faults=True))
    assert {k: got[k].fault.component for k in FAULTY} == FAULTY
    assert all(got[k].last is None for k in FAULTY) and got[1].last == 2 * got[1].levy
    assert got[2].half == 3.0 and got[3].half is None


def test_two_policies(df):
    base, variant = policy(tau=0.5), policy(tau=1.5)
    wide = compare_policies(df, base, variant, faults=True, compiled=True)
    got = told(wide)
    assert got[1].diff_levy == 1.0 and got[2].diff_levy is None and got[2].diff_half == 0.0
    assert {k: got[k].variant_fault.component for k in FAULTY} == FAULTY == {k: got[k].baseline_fault.component for k in FAULTY}
    table = wide.where("variant_fault is not null").select("k", "variant_fault.*")
    assert table.count() == len(FAULTY) and table.columns == ["k", "component", "message"]


def test_the_name_must_be_free(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, fault double")
    with pytest.raises(PolicyError, match="fault"):
        apply_policy(df, Policy("p", [Component("a", lambda v, p, a: a["x"])]), faults=True)
