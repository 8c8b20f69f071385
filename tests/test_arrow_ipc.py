from __future__ import annotations

import json

import pyarrow as pa
import pytest
from helpers import plan, rows

from levyframe import null_cells, read_households, register, with_index, write_arrow_ipc
from levyframe.errors import TableError
from levyframe.sources import arrow_ipc
from levyframe.sources.arrow_ipc import ArrowIpcDataSource
from levyframe.sources.households import _bytes

SCHEMA = pa.schema([("Age", pa.int32()), ("Revenu", pa.float64()), ("Type", pa.string())])


def write_file(path, batches, schema=SCHEMA):
    with pa.OSFile(str(path), "wb") as sink, pa.ipc.new_file(sink, schema) as writer:
        for batch in batches:
            writer.write_batch(pa.RecordBatch.from_pydict(dict(zip(schema.names, batch)), schema=schema))
    return str(path)


TWO = [([1, 2], [0.5, 1.5], ["a", "b"]), ([3], [2.5], ["c"])]


def test_all_batches_are_read(spark, tmp_path):
    df = read_households(spark, write_file(tmp_path / "h.arrow", TWO), "arrow")
    assert df.dtypes == [("Age", "int"), ("Revenu", "double"), ("Type", "string")]
    assert rows(df) == [(1, 0.5, "a"), (2, 1.5, "b"), (3, 2.5, "c")]


def test_large_file_is_cut_by_batch(spark, tmp_path):
    path = write_file(tmp_path / "h.arrow", TWO * 5)
    df = read_households(spark, path, "arrow", splitBytes="400")
    assert df.rdd.getNumPartitions() == 10
    assert df.count() == 15
    assert read_households(spark, path, "arrow").rdd.getNumPartitions() == 1


def test_small_files_share_a_task(spark, tmp_path):
    folder = tmp_path / "many.arrow"
    folder.mkdir()
    for i in range(6):
        write_file(folder / f"part-{i}.arrow", [([i], [float(i)], ["x"])])
    (folder / "_SUCCESS").write_text("")
    assert read_households(spark, str(folder), "arrow").rdd.getNumPartitions() == 6
    df = read_households(spark, str(folder), "arrow", parallelism="1")
    assert df.rdd.getNumPartitions() == 1
    assert [r["Index"] for r in with_index(df).orderBy("Age").collect()] == [1, 2, 3, 4, 5, 6]
    sizes = {"splitBytes": str(9 * 1024 * 1024), "parallelism": "1"}
    assert read_households(spark, str(folder), "arrow", **sizes).rdd.getNumPartitions() == 3


@pytest.mark.parametrize(("text", "number"), [("134217728b", 1 << 27), ("128m", 1 << 27), ("1gb", 1 << 30), ("17", 17)])
def test_size_settings(text, number):
    assert _bytes(text) == number


def test_missing_value_is_an_error_with_its_place(spark, tmp_path):
    path = write_file(tmp_path / "h.arrow", [TWO[0], ([3, None], [2.5, 3.5], ["c", "d"])])
    with pytest.raises(Exception, match="missing value in column Age, row 2 of batch 2"):
        read_households(spark, path, "arrow").collect()
    allowed = with_index(read_households(spark, path, "arrow", nulls="allow"))
    assert rows(null_cells(allowed, "Index")) == [("Age", 4)]


def test_unsupported_type(spark, tmp_path):
    path = write_file(tmp_path / "h.arrow", [([1],)], pa.schema([("n", pa.int64())]))
    with pytest.raises(Exception, match="unsupported type: n int64"):
        read_households(spark, path, "arrow").collect()


def test_files_with_other_columns(spark, tmp_path):
    folder = tmp_path / "mixed.arrow"
    folder.mkdir()
    write_file(folder / "a.arrow", TWO)
    write_file(folder / "b.arrow", [([1],)], pa.schema([("n", pa.int32())]))
    with pytest.raises(Exception, match="b.arrow has columns"):
        read_households(spark, str(folder), "arrow").collect()


def test_suffix_and_missing_path(spark, tmp_path):
    with pytest.raises(TableError, match="not a .arrow"):
        read_households(spark, str(tmp_path / "h.csv"), "arrow")
    with pytest.raises(Exception, match="does not exist"):
        read_households(spark, str(tmp_path / "none.arrow"), "arrow").collect()
    other = tmp_path / "h.feather"
    write_file(other, TWO)
    register(spark)
    with pytest.raises(Exception, match="not a .arrow"):
        spark.read.format("arrow_ipc").load(str(other)).collect()


def test_round_trip_over_several_tasks(spark, tmp_path):
    df = spark.range(1000).selectExpr("cast(id as int) i", "id / 4 d", "cast(id as string) s").repartition(5)
    path = str(tmp_path / "out.arrow")
    write_arrow_ipc(df, path)
    files = [p.name for p in (tmp_path / "out.arrow").iterdir()]
    assert len(files) == 5 and all(name.endswith(".arrow") for name in files)
    back = read_households(spark, path, "arrow")
    assert rows(back) == rows(df)
    table = pa.ipc.open_file(str(tmp_path / "out.arrow" / files[0])).schema
    assert [(f.name, str(f.type), f.nullable) for f in table] == [
        ("i", "int32", True), ("d", "double", True), ("s", "string", True),
    ]


def test_existing_path_and_overwrite(spark, tmp_path):
    path = str(tmp_path / "out.arrow")
    one = spark.createDataFrame([(1, 1.5, "x")], "i int, d double, s string")
    write_arrow_ipc(one, path)
    with pytest.raises(TableError, match="exists already"):
        write_arrow_ipc(one, path)
    assert read_households(spark, f"file://{path}", "arrow").count() == 1
    write_arrow_ipc(one.union(one), f"file://{path}", overwrite=True)
    assert read_households(spark, path, "arrow").count() == 2


def test_a_failed_overwrite_keeps_the_table(spark, tmp_path):
    path = str(tmp_path / "out.arrow")
    one = spark.createDataFrame([(1, 1.5, "x")], "i int, d double, s string")
    write_arrow_ipc(one, path)
    broken = one.selectExpr("i", "d", "CAST(raise_error('stop') AS STRING) AS s")
    with pytest.raises(Exception, match="stop"):
        write_arrow_ipc(broken, path, overwrite=True)
    assert rows(read_households(spark, path, "arrow")) == [(1, 1.5, "x")]


def test_no_rows_keep_their_columns(spark, tmp_path):
    path = str(tmp_path / "out.arrow")
    write_arrow_ipc(spark.createDataFrame([], "i int, d double"), path)
    back = read_households(spark, path, "arrow")
    assert back.dtypes == [("i", "int"), ("d", "double")] and back.count() == 0


def test_null_results_and_unsupported_columns(spark, tmp_path):
    path = str(tmp_path / "out.arrow")
    write_arrow_ipc(spark.createDataFrame([(1, None)], "i int, d double"), path)
    assert rows(read_households(spark, path, "arrow", nulls="allow")) == [(1, None)]
    with pytest.raises(Exception, match="unsupported type: id bigint"):
        write_arrow_ipc(spark.range(3), str(tmp_path / "bad.arrow"))


def test_failed_write_leaves_no_result(spark, tmp_path):
    df = spark.range(10, numPartitions=2).selectExpr("cast(assert_true(id < 7) as int) a", "cast(id as int) i")
    with pytest.raises(Exception):
        write_arrow_ipc(df.selectExpr("i", "cast(a as double) a"), str(tmp_path / "out.arrow"))
    # A task that is killed late may leave its temporary folder, which no reader looks into.
    assert list((tmp_path / "out.arrow").glob("*.arrow")) == []


def test_only_the_asked_columns_are_decoded(spark, tmp_path):
    path = str(tmp_path / "wide.arrow")
    table = pa.table({"a": pa.array([1, 2], pa.int32()), "b": pa.array(["x", None]), "c": pa.array([0.5, 1.5]), "d": pa.array([True, False])})
    with pa.ipc.new_file(path, table.schema) as out:
        out.write_table(table)
    df = read_households(spark, path, "arrow", columns=["c", "a"])
    assert df.dtypes == [("c", "double"), ("a", "int")] and rows(df) == [(0.5, 1), (1.5, 2)]
    with pytest.raises(Exception, match="unsupported type: d bool"):
        read_households(spark, path, "arrow")
    with pytest.raises(Exception, match="no column z"):
        read_households(spark, path, "arrow", columns=["z"])
    with pytest.raises(Exception, match="missing value in column b"):
        read_households(spark, path, "arrow", columns=["b"]).collect()


def test_bytes_read_fall_with_the_columns(tmp_path):
    path = str(tmp_path / "wide.arrow")
    table = pa.table({"a": pa.array(range(1000), pa.int32()), "b": ["x" * 1000] * 1000})
    with pa.ipc.new_file(path, table.schema) as out:
        out.write_table(table, max_chunksize=100)
    sizes = {}
    for names in (["a"], ["a", "b"]):
        source = ArrowIpcDataSource({"path": path, "columns": json.dumps(names)})
        reader = source.reader(source.schema())
        sizes[len(names)] = sum(b.nbytes for part in reader.partitions() for b in reader.read(part))
    assert sizes[1] < 5000 and sizes[2] > 1_000_000


def test_filters_run_in_the_reading_tasks(spark, tmp_path):
    path = str(tmp_path / "many.arrow")
    df = spark.createDataFrame([(k, f"t{k % 7}", float("nan") if k % 5 == 0 else k / 2) for k in range(200)], "n int, s string, x double")
    write_arrow_ipc(df.repartition(3), path)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for condition in (
            "n > 150", "n >= 3 and n < 9", "n in (1, 5, 700)", "s = 't3'", "s like 't1%' and n <= 40", "x > 20", "x = 'NaN'", "n = 3 or s = 't2'",
            "n is not null and s > 't4'", "n <> 4",
        ):
            back = read_households(spark, path, "arrow").where(condition)
            assert repr(rows(back)) == repr(rows(df.where(condition))), condition
        text = plan(read_households(spark, path, "arrow").where("n > 150"))
        assert "Filter (" not in text.replace("isnotnull", "") or "n#" not in text.split("Filter (")[-1].split("\n")[0]
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def test_no_footer_is_read_on_the_driver(tmp_path, monkeypatch):
    path = str(tmp_path / "large.arrow")
    table = pa.table({"a": pa.array(range(100_000), pa.int32())})
    with pa.ipc.new_file(path, table.schema) as out:
        out.write_table(table, max_chunksize=1000)
    source = ArrowIpcDataSource({"path": path, "splitbytes": "1"})
    monkeypatch.setattr(arrow_ipc, "FILE_OPEN_BYTES", 50_000)
    reader = source.reader(source.schema())
    reader.split_bytes = 50_000
    opened = []
    monkeypatch.setattr(arrow_ipc, "_open", lambda files, path, real=arrow_ipc._open: opened.append(path) or real(files, path))
    parts = reader.partitions()
    assert len(parts) > 3 and not opened
    found = [n for part in parts for batch in reader.read(part) for n in batch.column(0).to_pylist()]
    assert found == list(range(100_000))
