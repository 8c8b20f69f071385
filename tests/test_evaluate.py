from __future__ import annotations

import math

import numpy as np
import pytest
from helpers import plan, rows
from pyspark.sql import functions as F
from test_policy_files import CONS, HEAD, NOTIF, VALID

from levyframe import Component, Policy, apply_policy, check_dependencies, load_policy, missing_attributes
from levyframe.errors import PolicyError, RuleError
from levyframe.plans import policies

HOUSEHOLDS = [(70, 1, 10.0, 1.0, 2.0), (70, 2, 20.0, 1.0, 3.0), (30, 1, 30.0, 1.0, 4.0)]


@pytest.fixture
def households(spark):
    return spark.createDataFrame(HOUSEHOLDS, "Age int, GIR int, x double, y double, z double")


def notif_column(variables, parameters, row):
    eligible = (row["Age"] > 60) & (row["GIR"] == 1)
    return F.when(eligible, parameters["tau_1"] * row["x"] + row["y"]).otherwise(parameters["tau_2"] * row["z"])


def cons(variables, parameters, row):
    return variables["plan_notif"] * parameters["taux_ss_conso"]


def column_policy():
    return Policy(
        "apa",
        [
            Component("plan_cons", cons, {"taux_ss_conso": 0.8}, 2),
            Component("plan_notif", notif_column, {"tau_1": 0.15, "tau_2": 0.3}, 1, ("Age", "GIR")),
        ],
    )


def expected():
    out = []
    for age, gir, x, y, z in HOUSEHOLDS:
        notif = 0.15 * x + y if age > 60 and gir == 1 else 0.3 * z
        out.append((age, gir, x, y, z, notif, notif * 0.8))
    return sorted(out, key=repr)


def python_component(function, name="c", **options):
    return Component(name, function, kind="python", **options)


def run_python(df, *parts, **options):
    return apply_policy(df, Policy("p", list(parts)), **options)


def test_column_rules_in_logical_order(households):
    df = apply_policy(households, column_policy())
    assert df.columns == ["Age", "GIR", "x", "y", "z", "plan_notif", "plan_cons"]
    assert rows(df) == expected()


def test_policy_file_with_trusted_source_agrees(spark, households, write):
    policy = load_policy(spark, write("apa.toml", VALID))
    with pytest.raises(PolicyError, match="trust_source"):
        apply_policy(households, policy)
    assert rows(apply_policy(households, policy, trust_source=True)) == expected()


def test_policy_file_with_registered_functions_agrees(spark, households, write):
    path = write("apa.toml", VALID)
    functions = {"plan_notif": notif_column, "plan_cons": cons}
    assert rows(apply_policy(households, load_policy(spark, path, functions, kind="column"))) == expected()


def test_source_is_one_module(spark, households, write):
    """A later source replaces the function of an earlier component, and may use its helpers."""
    text = HEAD + NOTIF + CONS.replace("def plan_cons", "def plan_notif(v, p, a):\n    return 5\ndef plan_cons")
    policy = load_policy(spark, write("apa.toml", text))
    df = apply_policy(households, policy, trust_source=True)
    assert rows(df.select("plan_notif", "plan_cons")) == [(5.0, 4.0)] * 3


def test_source_without_the_function(spark, households, write):
    policy = load_policy(spark, write("apa.toml", VALID.replace("def plan_cons", "def plan_kons")))
    with pytest.raises(Exception, match="defines no function plan_cons"):
        apply_policy(households, policy, trust_source=True).collect()


def test_python_and_column_rules_agree_on_line_items(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    by_column = apply_policy(lines, policies.variant())
    by_python = apply_policy(lines, policies.python_variant()).select(*by_column.columns)
    assert by_column.exceptAll(by_python).isEmpty() and by_python.exceptAll(by_column).isEmpty()


def test_forward_reference_fails_while_planning(spark, households):
    forward = Policy(
        "p",
        [Component("first", lambda v, p, a: v["second"], {}, 1), Component("second", lambda v, p, a: a["x"], {}, 2)],
    )
    spark.sparkContext.setJobGroup("forward", "forward")
    with pytest.raises(RuleError, match="component first.*second.*read before it is computed"):
        apply_policy(households, forward)
    assert spark.sparkContext.statusTracker().getJobIdsForGroup("forward") == []
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_forward_reference_of_python_rules(households):
    parts = [
        python_component(lambda v, p, a: v["second"], "first", logical_order=1),
        python_component(lambda v, p, a: 1, "second", logical_order=2),
    ]
    with pytest.raises(Exception, match="component first: KeyError"):
        run_python(households, *parts).collect()


def test_unknown_attribute_and_parameter(households):
    for rule in (lambda v, p, a: a["none"], lambda v, p, a: p["none"]):
        with pytest.raises(RuleError, match="component c.*none"):
            apply_policy(households, Policy("p", [Component("c", rule)]))


def test_missing_dependencies_are_listed(households):
    policy = Policy("p", [Component("c", lambda v, p, a: a["x"], dependencies=("x", "Zone", "Area"))])
    assert missing_attributes(policy, households.columns) == ["Area", "Zone"]
    with pytest.raises(PolicyError, match="Area, Zone"):
        check_dependencies(policy, households)
    with pytest.raises(PolicyError, match="Area, Zone"):
        apply_policy(households, policy)


def test_name_clash(spark, households):
    for name in ("x", "X"):
        with pytest.raises(PolicyError, match=f"share names: {name}"):
            apply_policy(households, Policy("p", [Component(name, lambda v, p, a: a["x"])]))


def test_strict_dependencies(households):
    def undeclared(v, p, a):
        return a["x"] + a["y"]

    for kind in ("column", "python"):
        policy = Policy("p", [Component("c", undeclared, dependencies=("x",), kind=kind)])
        assert rows(apply_policy(households, policy).select("c")) == [(11.0,), (21.0,), (31.0,)]
        with pytest.raises(Exception, match="component c.*y"):
            apply_policy(households, policy, strict_dependencies=True).collect()


def test_strict_dependencies_narrow_what_python_gets(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    names = ["net", "levy", "relief", "total"]
    df = apply_policy(lines, policies.python_variant(), strict_dependencies=True).select(*names)
    text = plan(df)
    assert "struct<l_extendedprice:double,l_discount:double,l_returnflag:string>" in text
    wide = apply_policy(lines, policies.python_variant()).select(*names)
    assert rows(df) == rows(wide)


@pytest.mark.parametrize(("value", "number"), [(1, 1.0), (True, 1.0), (False, 0.0), (2.5, 2.5), (math.inf, math.inf)])
def test_python_results_become_floats(households, value, number):
    assert rows(run_python(households, python_component(lambda v, p, a: value)).select("c")) == [(number,)] * 3


def test_numpy_and_decimal_results(households):
    def numpy_rule(v, p, a):
        import decimal

        import numpy as np

        return np.float32(1.5) if a["GIR"] == 1 else decimal.Decimal("2.5")

    assert rows(run_python(households, python_component(numpy_rule)).select("c")) == [(1.5,), (1.5,), (2.5,)]


@pytest.mark.parametrize("value", [None, "1", b"1", [1]])
def test_python_results_that_are_no_number(households, value):
    with pytest.raises(Exception, match="component c returned"):
        run_python(households, python_component(lambda v, p, a: value)).collect()


def test_raw_python_results_reach_later_rules(households):
    """Only what is exported has to be a number in the end; in between, rules see what rules returned."""
    parts = [
        python_component(lambda v, p, a: 7, "whole", logical_order=1),
        python_component(lambda v, p, a: isinstance(v["whole"], int), "is_int", logical_order=2),
    ]
    assert rows(run_python(households, *parts).select("whole", "is_int")) == [(7.0, 1.0)] * 3


def test_null_results(households):
    policy = Policy("p", [Component("c", lambda v, p, a: F.when(a["GIR"] == 1, a["x"]))])
    with pytest.raises(Exception, match="component c returned no value"):
        apply_policy(households, policy).collect()
    kept = apply_policy(households, policy, null_results="keep")
    assert rows(kept.select("c")) == [(10.0,), (30.0,), (None,)]
    kept = run_python(households, python_component(lambda v, p, a: None), null_results="keep")
    assert rows(kept.select("c")) == [(None,)] * 3


def test_column_result_types(households):
    good = {
        "whole": lambda v, p, a: a["Age"],
        "flag": lambda v, p, a: a["Age"] > 60,
        "number": lambda v, p, a: 3,
        "parameter": lambda v, p, a: p["q"],
        "exact": lambda v, p, a: a["Age"].cast("decimal(10,2)"),
    }
    policy = Policy("p", [Component(name, rule, {"q": 2}) for name, rule in good.items()])
    df = apply_policy(households, policy).where("GIR = 2").select(*good)
    assert set(kind for _, kind in df.dtypes) == {"double"}
    assert rows(df) == [(70.0, 1.0, 3.0, 2.0, 70.0)]
    for wrong in (lambda v, p, a: F.lit("x"), lambda v, p, a: "x", lambda v, p, a: None):
        with pytest.raises(RuleError, match="component c returned"):
            apply_policy(households, Policy("p", [Component("c", wrong)]))


def test_python_if_on_a_column(households):
    with pytest.raises(RuleError, match="component c"):
        apply_policy(households, Policy("p", [Component("c", lambda v, p, a: 1 if a["Age"] > 3 else 0)]))


def test_errors_name_the_component(households):
    with pytest.raises(Exception, match="component c: ZeroDivisionError"):
        run_python(households, python_component(lambda v, p, a: 1 / 0)).collect()


def test_rules_cannot_change_attributes_or_parameters(households):
    def spoil(v, p, a):
        a["x"] = 0

    with pytest.raises(Exception, match="component c: TypeError"):
        run_python(households, python_component(spoil)).collect()
    with pytest.raises(RuleError, match="component c"):
        apply_policy(households, Policy("p", [Component("c", spoil)]))


def test_parameters_are_merged_and_the_later_component_wins(households):
    for kind in ("column", "python"):
        parts = [
            Component("a", lambda v, p, a: p["q"], {"q": 1.0}, 1, kind=kind),
            Component("b", lambda v, p, a: p["q"] + p["r"], {"q": 5.0, "r": 2.0}, 2, kind=kind),
        ]
        assert rows(apply_policy(households, Policy("p", parts)).select("a", "b")) == [(5.0, 7.0)] * 3


def test_ties_keep_the_given_order(households):
    parts = [Component("b", lambda v, p, a: a["x"]), Component("a", lambda v, p, a: v["b"] + 1)]
    assert rows(apply_policy(households, Policy("p", parts)).select("a")) == [(11.0,), (21.0,), (31.0,)]


def test_one_name_twice(households):
    """Both components run the later definition, and there is one result."""
    for kind in ("column", "python"):
        parts = [
            Component("c", lambda v, p, a: 1.0, logical_order=1, kind=kind),
            Component("c", lambda v, p, a: v.get("c", 10.0) + a["x"] * 0, logical_order=2, kind=kind),
        ]
        df = apply_policy(households, Policy("p", parts))
        assert rows(df.select("c")) == [(10.0,)] * 3


def test_readers_of_a_replaced_result_keep_it(households):
    def twice(v, p, a):
        return 100.0 if "d" in v else a["x"]

    for kind in ("column", "python"):
        parts = [
            Component("c", twice, logical_order=1, kind=kind),
            Component("d", lambda v, p, a: v["c"] + 1, logical_order=2, kind=kind),
            Component("c", twice, logical_order=3, kind=kind),
            Component("e", lambda v, p, a: v["c"] + v["d"], logical_order=4, kind=kind),
        ]
        df = apply_policy(households, Policy("p", parts)).where("GIR = 2")
        assert df.columns[5:] == ["c", "d", "e"]
        assert rows(df.select("c", "d", "e")) == [(100.0, 21.0, 121.0)]


def test_as_many_projections_as_the_longest_chain(spark):
    """Independent rules of both policies share a projection."""
    wide = spark.range(3).selectExpr("id * 1.0D AS x")
    parts = [Component(f"r{i}", lambda v, p, a: a["x"] + 1) for i in range(30)]
    parts += [Component("sum", lambda v, p, a: sum((v[f"r{i}"] for i in range(30)), F.lit(0.0)), logical_order=1)]
    df = apply_policy(wide, Policy("p", parts))
    text = df._jdf.queryExecution().analyzed().toString()
    calls = [line for line in text.splitlines() if line.strip(" +-:").startswith("Project")]
    assert len(calls) == 3
    assert rows(df.select("sum")) == [(30.0,), (60.0,), (90.0,)]


def test_extra_outputs(households):
    def rule(v, p, a):
        v["half"] = a["x"] / 2
        return v["half"] + 1

    for kind in ("column", "python", "vector"):
        parts = [
            Component("c", rule, logical_order=1, extra_outputs=("half",), kind=kind),
            Component("d", lambda v, p, a: v["half"] + a["x"], logical_order=2, kind=kind),
        ]
        df = apply_policy(households, Policy("p", parts))
        assert df.columns[5:] == ["c", "half", "d"]
        assert rows(df.where("GIR = 2").select("c", "half", "d")) == [(11.0, 10.0, 30.0)]
    with pytest.raises(RuleError, match="extra output none"):
        apply_policy(households, Policy("p", [Component("c", rule, extra_outputs=("none", "half"))]))


@pytest.mark.parametrize("kind", ["column", "python", "vector"])
def test_an_undeclared_output_is_an_error(households, kind):
    def rule(v, p, a):
        v["side"] = a["x"]
        return a["x"]

    policy = Policy("p", [Component("c", rule, kind=kind), Component("d", lambda v, p, a: 1.0, kind=kind)])
    with pytest.raises(Exception, match="component c.*undeclared results: side"):
        apply_policy(households, policy).collect()


def test_vector_rules(households):
    def clipped(v, p, a):
        return np.minimum(a["x"], p["cap"])

    parts = [Component("c", clipped, {"cap": 15.0}, 1, kind="vector"), Component("d", lambda v, p, a: 2, {}, 2, kind="vector")]
    found = apply_policy(households, Policy("p", parts))
    assert rows(found.selectExpr("c = least(x, 15.0)", "d")) == [(True, 2.0)] * households.count()
    wrong = Policy("p", [Component("c", lambda v, p, a: a["x"][:1][[0, 0, 0, 0, 0, 0, 0]], kind="vector")])
    with pytest.raises(Exception, match="component c returned .* values for"):
        apply_policy(households.coalesce(1), wrong).collect()


def test_kinds_in_one_policy(households):
    parts = [
        Component("a", lambda v, p, a: a["x"] * p["two"], {"two": 2.0}, 1),
        Component("b", lambda v, p, a: v["a"] + 1 if a["GIR"] == 2 else 0.0, {}, 2, kind="python"),
        Component("c", lambda v, p, a: np.sqrt(v["b"]) * p["two"], {}, 3, kind="vector"),
        Component("d", lambda v, p, a: F.round(v["c"] + v["a"], 6), {}, 4),
    ]
    df = apply_policy(households, Policy("p", parts))
    assert df.columns[5:] == ["a", "b", "c", "d"]
    for r in df.collect():
        b = r.x * 2 + 1 if r.GIR == 2 else 0.0
        assert (r.a, r.b, r.c, r.d) == (r.x * 2, b, b**0.5 * 2, round(b**0.5 * 2 + r.x * 2, 6))
    both = [*parts, Component("a", lambda v, p, a: 1.0, {}, 5)]
    with pytest.raises(PolicyError, match="several kinds compute a"):
        apply_policy(households, Policy("p", both))


def test_a_filter_on_results_does_not_call_rules_again(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    wide = apply_policy(lines, policies.python_variant(), attributes=list(policies.PRICES) + ["l_returnflag"])
    for condition in ("total > 5", "total > 5 AND levy < 3"):
        text = plan(wide.where(condition).where("l_tax > 0.01").select("total"))
        assert text.count("ArrowEvalPython") == 1
        assert "GreaterThan(l_tax" in text and "l_comment" not in text and "l_shipdate" not in text


def test_rules_without_attributes(spark):
    df = run_python(spark.range(5).select(), python_component(lambda v, p, a: len(a)))
    assert rows(df) == [(0.0,)] * 5


def test_invalid_policies():
    with pytest.raises(PolicyError, match="no component"):
        Policy("p", [])
    with pytest.raises(PolicyError, match="kind"):
        Component("a", len, kind="sql")
    with pytest.raises(PolicyError, match="neither"):
        Component("a")


def test_column_rules_are_one_stage_without_shuffle(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    df = apply_policy(lines, policies.variant()).select("total")
    text = plan(df)
    assert "Exchange" not in text and "Python" not in text and text.count("FileScan") == 1
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double,l_returnflag:string>" in text


def test_filters_reach_the_scan_through_rules(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    for policy in (policies.variant(), policies.python_variant()):
        text = plan(apply_policy(lines, policy).where("l_quantity > 40"))
        assert "GreaterThan(l_quantity,40.0)" in text


def test_long_chain_of_rules(spark):
    parts = [Component("r0", lambda v, p, a: a["id"] * 1.0, logical_order=0)]
    for i in range(1, 60):
        rule = lambda v, p, a, i=i: v[f"r{i - 1}"] + v[f"r{max(0, i - 2)}"] * 0 + 1
        parts.append(Component(f"r{i}", rule, logical_order=i))
    assert rows(apply_policy(spark.range(3), Policy("p", parts)).select("r59")) == [(59.0,), (60.0,), (61.0,)]


def test_rules_on_a_stream(spark, tmp_path):
    """Projections of one row each: they also accept a streaming DataFrame."""
    source = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    source.write.parquet(str(tmp_path / "in"))
    stream = apply_policy(spark.readStream.schema(source.schema).parquet(str(tmp_path / "in")), policies.variant())
    assert stream.isStreaming
    query = (
        stream.writeStream.format("parquet")
        .option("path", str(tmp_path / "out"))
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    written = spark.read.parquet(str(tmp_path / "out"))
    batch = apply_policy(source, policies.variant())
    assert written.exceptAll(batch).isEmpty() and batch.count() == written.count()
