from __future__ import annotations

import random

import pytest
from corpora import Union

from levyframe.llm import components as module
from levyframe.llm.components import components


@pytest.mark.parametrize("held", [3, 50, 10**6])
def test_tasks_that_hold_few_nodes(spark, monkeypatch, held):
    monkeypatch.setattr(module, "_NODES_HELD", held)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        rng = random.Random(held)
        edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(260)] + [(k, k + 1) for k in range(1000, 1100)]
        union = Union()
        for a, b in edges:
            union.link(a, b)
        found = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
        linked = {x for a, b in edges if a != b for x in (a, b)}
        assert found == {x: union.root(x) for x in linked}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
