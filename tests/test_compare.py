from __future__ import annotations

import math

import pytest
from helpers import plan, rows

from levyframe import Component, Policy, compare_policies, diff_results, difference_results, results_of
from levyframe.errors import PolicyError, ResultError
from levyframe.plans import policies


def constant(value):
    return lambda v, p, a: a["x"] * value


def two(kind="column"):
    base = Policy("base", [Component("a", constant(1.0), kind=kind), Component("b", constant(2.0), kind=kind)])
    variant = Policy("variant", [Component("b", constant(5.0), kind=kind), Component("c", constant(7.0), kind=kind)])
    return base, variant


@pytest.mark.parametrize("kinds", [("column", "column"), ("python", "python"), ("column", "python"), ("python", "column")])
def test_difference(spark, kinds):
    df = spark.createDataFrame([(1.0,), (10.0,)], "x double")
    base, variant = two(kinds[0])[0], two(kinds[1])[1]
    wide = compare_policies(df, base, variant)
    assert sorted(wide.columns) == sorted(
        ["x", "baseline_a", "baseline_b", "variant_b", "variant_c", "diff_b", "diff_c"]
    )
    assert rows(results_of(wide, "baseline_", ["x"], base.outputs)) == [(1.0, 1.0, 2.0), (10.0, 10.0, 20.0)]
    assert rows(results_of(wide, "variant_", ["x"], variant.outputs)) == [(1.0, 5.0, 7.0), (10.0, 50.0, 70.0)]
    diff = difference_results(df, base, variant)
    assert diff.dtypes == [("x", "double"), ("b", "double"), ("c", "double")]
    assert rows(diff) == [(1.0, 3.0, None), (10.0, 30.0, None)]


def test_nan_is_a_difference_not_a_null(spark):
    df = spark.createDataFrame([(math.nan,)], "x double")
    value = difference_results(df, *two()).first()["b"]
    assert math.isnan(value)


def test_prefixed_names_must_be_free(spark):
    df = spark.createDataFrame([(1.0, 2.0)], "x double, diff_b double")
    with pytest.raises(PolicyError, match="diff_b"):
        compare_policies(df, *two())


def test_one_scan_no_shuffle(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    text = plan(difference_results(lines, policies.baseline(), policies.variant()).select("total", "levy"))
    assert "Exchange" not in text and "Join" not in text and text.count("FileScan") == 1
    assert "ReadSchema: struct<l_extendedprice:double,l_discount:double,l_returnflag:string>" in text


def test_both_python_policies_are_one_call(spark):
    lines = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    text = plan(compare_policies(lines, policies.python_baseline(), policies.python_variant()))
    assert text.count("ArrowEvalPython") == 1 and text.count("FileScan") == 1


def test_python_rules_run_once_per_row(spark, tmp_path):
    log = tmp_path / "calls"

    def counted(v, p, a):
        with open(log, "a") as out:
            out.write("x\n")
        return a["x"]

    base = Policy("b", [Component("a", counted, kind="python"), Component("c", lambda v, p, a: v["a"], kind="python")])
    df = spark.createDataFrame([(float(i),) for i in range(20)], "x double")
    compare_policies(df, base, two("python")[1]).selectExpr("baseline_a + baseline_c", "baseline_c * 2").collect()
    assert len(log.read_text().splitlines()) == 20


BASE = [(1, 10.0, 1.0), (2, 20.0, 2.0), (3, None, 3.0)]
VARIANT = [(3, 31.0, 5.0), (1, 11.0, 6.0), (2, 25.0, 7.0)]


def keyed(spark, base=BASE, variant=VARIANT):
    return (
        spark.createDataFrame(base, "id int, b double, a double"),
        spark.createDataFrame(variant, "id int, b double, c double"),
    )


def test_keyed_difference(spark):
    assert rows(diff_results(*keyed(spark), "id")) == [(1, 1.0, None), (2, 5.0, None), (3, None, None)]


def test_keyed_difference_with_two_keys(spark):
    base = spark.createDataFrame([(1, "x", 1.0), (1, "y", 2.0)], "id int, part string, b double")
    variant = spark.createDataFrame([(1, "y", 5.0), (1, "x", 7.0)], "id int, part string, b double")
    assert rows(diff_results(base, variant, ["id", "part"])) == [(1, "x", 6.0), (1, "y", 3.0)]
    with pytest.raises(Exception, match="occurs 2 times"):
        diff_results(base.drop("part"), variant.drop("part"), "id").collect()


@pytest.mark.parametrize("bucketed", [False, True])
def test_key_must_be_unique_and_present(spark, bucketed):
    with pytest.raises(Exception, match="variant results: key .id. occurs"):
        diff_results(
            *keyed(spark, variant=[(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0)]), "id", bucketed=bucketed
        ).collect()
    with pytest.raises(Exception, match="key .id. is NULL"):
        diff_results(
            *keyed(spark, base=[(1, 1.0, 1.0), (None, 1.0, 1.0), (2, 1.0, 1.0)]), "id", bucketed=bucketed
        ).collect()


def test_only_numbers_can_be_compared(spark):
    base, variant = keyed(spark)
    with pytest.raises(ResultError, match="baseline results: columns that are not numbers: city"):
        diff_results(base.selectExpr("*", "'x' AS city"), variant, "id")


def test_keys_must_agree(spark):
    tables = keyed(spark, base=BASE[:2])
    with pytest.raises(Exception, match="baseline results lack the key .id.: 3"):
        diff_results(*tables, "id").collect()
    assert rows(diff_results(*tables, "id", check_rows=False)) == [(1, 1.0, None), (2, 5.0, None), (3, None, None)]
    # as many keys, but others
    tables = keyed(spark, base=BASE[:2], variant=[(2, 25.0, 7.0), (3, 31.0, 5.0)])
    with pytest.raises(Exception, match="results lack the key"):
        diff_results(*tables, "id").collect()
    assert rows(diff_results(*tables, "id", check_rows=False)) == [(2, 5.0, None), (3, None, None)]


def test_keyed_difference_is_one_shuffle(spark):
    text = plan(diff_results(*keyed(spark), "id"))
    assert text.count("Exchange hashpartitioning") == 1 and "Join" not in text and "SortAggregate" not in text


def test_bucketed_tables_join_without_shuffle(spark):
    base, variant = keyed(spark)
    names = ["levy_bucketed_base", "levy_bucketed_variant"]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name, df in zip(names, (base, variant)):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
            df.write.bucketBy(4, "id").sortBy("id").saveAsTable(name)
        df = diff_results(spark.table(names[0]), spark.table(names[1]), "id", bucketed=True)
        assert rows(df) == [(1, 1.0, None), (2, 5.0, None), (3, None, None)]
        assert "Exchange" not in plan(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
