from __future__ import annotations

import pytest
from helpers import rows

from levyframe import POSITIONS, output_columns, output_layout, read_delimited, results_to_columns, with_index, with_rank
from levyframe import storage
from levyframe.errors import ResultError, TableError
from levyframe.operators import ordering
from levyframe.operators.layout import result_names
from levyframe.sources import result_path


def test_column_order():
    attributes, results = ["b", "Z", "é"], ["a", "c", "Y"]
    assert output_columns(attributes, results, "csv", "Index") == ["Index", "Y", "Z", "a", "b", "c", "é"]
    assert output_columns(attributes, results, "arrow") == ["Z", "b", "é", "Y", "a", "c"]
    with pytest.raises(ResultError, match="share names: b"):
        output_columns(attributes, ["b"], "csv")
    with pytest.raises(ResultError, match="Index"):
        output_columns(["Index"], results, "csv", "Index")
    with pytest.raises(ValueError, match="format"):
        output_columns(attributes, results, "xml")


def test_layout(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, a int, unused int")
    assert output_layout(df, ["b"], ["a"], "csv").columns == ["a", "b"]


def test_result_names():
    assert result_path("out/", "diff", "csv") == "out/diff-results.csv"
    assert result_path("out", "variante", "arrow", "run1") == "out/run1-variante-results.arrow"


MAPS = [(1, {"salaire_net": 123.0, "rsa": 0.005}), (2, {"salaire_net": 234.0, "rsa": 0.006})]


def test_results_to_columns(spark):
    df = results_to_columns(spark.createDataFrame(MAPS, "i int, r map<string,double>"), "r", ["salaire_net", "rsa"])
    assert df.dtypes == [("i", "int"), ("rsa", "double"), ("salaire_net", "double")]
    assert rows(df) == [(1, 0.005, 123.0), (2, 0.006, 234.0)]


def test_null_and_missing_results(spark):
    data = [(1, {"salaire_net": 123.0, "rsa": None}), (2, {"rsa": 0.006}), (3, MAPS[0][1])]
    df = spark.createDataFrame(data, "i int, r map<string,double>")
    expected = [(1, None, 123.0), (2, 0.006, None), (3, 0.005, 123.0)]
    assert rows(results_to_columns(df, "r", ["salaire_net", "rsa"])) == expected
    assert rows(result_names(df, "r")) == [("rsa",), ("salaire_net",)]


def test_index_in_input_order(spark):
    df = spark.range(1000, numPartitions=7).selectExpr("id * 3 AS v")
    assert rows(with_index(df)) == rows(spark.range(1000).selectExpr("id + 1", "id * 3"))


def test_index_with_empty_tasks(spark):
    df = spark.range(100, numPartitions=10).where("id % 40 = 5")
    assert sorted(tuple(r) for r in with_index(df).collect()) == [(1, 5), (2, 45), (3, 85)]


def test_index_of_no_rows(spark):
    df = with_index(spark.range(0))
    assert df.columns == ["Index", "id"] and df.count() == 0


def test_index_by_key_with_many_ties(spark):
    """Most rows share one key: positions are still 1..n, in key order."""
    df = spark.range(5000).selectExpr("if(id % 3 = 0, id, 77) AS k", "id AS v").repartition(6)
    found = sorted(tuple(r) for r in with_index(df, ["k"], name="n").select("n", "k", "v").collect())
    assert [r[0] for r in found] == list(range(1, 5001))
    assert [r[1] for r in found] == sorted(r[1] for r in found)
    assert sorted(r[2] for r in found) == list(range(5000))


def test_hot_key_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        staged = ordering._arranged(spark.range(8000).selectExpr("1 AS k", "id AS v"), ["k"], order_is_total=False)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_task = [r["count"] for r in staged.groupBy(ordering._task(staged[ordering.ROW_ID])).count().collect()]
    assert len(per_task) > 4 and max(per_task) < 4000


def test_index_follows_files_and_offsets(spark, write, tmp_path):
    """The second file is larger, so Spark reads it first; positions still follow the file names."""
    write("in.csv/a.csv", "v\n1\n2\n")
    write("in.csv/b.csv", "v\n" + "".join(f"{i}\n" for i in range(3, 3000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = read_delimited(spark, str(tmp_path / "in.csv"), positions=True)
        assert df.rdd.getNumPartitions() > 4
        indexed = with_index(df, block=POSITIONS)
        assert indexed.columns == ["Index", "v"]
        assert rows(indexed) == rows(spark.range(1, 3000).selectExpr("id", "cast(id AS int)"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_blocks_must_be_together(spark):
    df = spark.range(1000).selectExpr("id % 2 AS b", "id").repartition(4)
    with pytest.raises(TableError, match="not together"):
        with_index(df, block=["b"])


def test_rank_within_groups(spark):
    data = [(g, i) for g in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(data, "g string, i int").repartition(4)
    assert rows(with_rank(df, ["g"], ["i"])) == sorted([(g, i, i + 1) for g, i in data], key=repr)


def test_rank_with_hot_ties(spark):
    df = spark.range(6000).selectExpr("if(id % 3 = 0, 'hot', 'b') AS g", "id % 2 AS o", "id AS v").repartition(5)
    ranked = with_rank(df, ["g"], ["o"])
    assert ranked.columns == ["g", "o", "v", "rank"]
    found = ranked.collect()
    assert sorted(r["v"] for r in found) == list(range(6000))
    for group, size in (("hot", 2000), ("b", 4000)):
        members = sorted((r["rank"], r["o"]) for r in found if r["g"] == group)
        assert [rank for rank, _ in members] == list(range(1, size + 1))
        assert [o for _, o in members] == sorted(o for _, o in members)


def test_positions_use_no_global_window(spark):
    from helpers import plan

    text = plan(with_index(spark.range(10).selectExpr("id AS k"), ["k"]))
    assert "SinglePartition" not in text  # a window over the blocks of one group, none over the rows


def test_rules_upstream_run_once(spark, tmp_path):
    log = tmp_path / "calls"

    def counted(x):
        with open(log, "a") as out:
            out.write("x\n")
        return x

    from pyspark.sql import functions as F

    df = spark.range(100).select("id", F.udf(counted, "long")("id").alias("v"))
    assert with_index(df, ["v"]).count() == 100
    assert len(log.read_text().splitlines()) == 100


def test_staged_tables_can_be_removed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(storage, "shared_folder", lambda session: str(tmp_path))
    with_index(spark.range(10)).count()
    assert list(tmp_path.glob("levyframe/*/*/indexed"))
    storage.remove_staged(spark)
    assert not list(tmp_path.glob("levyframe/*"))
