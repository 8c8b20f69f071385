from __future__ import annotations

import sys
from pathlib import Path

import pytest
from helpers import plan

sys.path.insert(0, str(Path(__file__).resolve().parents[1] / "tools"))

import __spark_entry__ as driver  # noqa: E402
from check_oracles import compare, connect  # noqa: E402

from levyframe.plans.oracles import ORACLES  # noqa: E402
from levyframe.plans.queries import QUERIES  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    df = driver.queries()[name](spark, FOLDER)
    text = plan(df)
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    assert "Exchange SinglePartition" not in text or "Window" not in text or name == "type_fault"
    assert compare(df, connection, name) is None


def test_flagship(spark):
    df = driver.entry(spark)
    assert df.columns == ["l_orderkey", "l_linenumber", "d_net", "d_levy", "d_relief", "d_total"]
    assert df.count() == 6000
