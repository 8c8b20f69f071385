from __future__ import annotations

import pytest
from helpers import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe import POSITIONS, locate_type_fault, ragged_rows, read_delimited, read_households, write_delimited
from levyframe.errors import TableError

HOUSEHOLD = "Age;Revenu;TypeLogement\n35;500.5;Locataire\n"


def test_typed_read(spark, write):
    df = read_delimited(spark, write("h.csv", HOUSEHOLD))
    assert df.dtypes == [("Age", "int"), ("Revenu", "double"), ("TypeLogement", "string")]
    assert rows(df) == [(35, 500.5, "Locataire")]


def test_declared_schema(spark, write):
    path = write("h.csv", HOUSEHOLD)
    schema = {"Age": T.DoubleType(), "Revenu": T.DoubleType(), "TypeLogement": T.StringType()}
    with pytest.raises(Exception, match="column Age: not a double: '35'"):
        read_delimited(spark, path, schema).collect()
    assert rows(read_delimited(spark, path, schema, promote_int=True)) == [(35.0, 500.5, "Locataire")]
    with pytest.raises(TableError, match="the schema has"):
        read_delimited(spark, path, {"Age": T.IntegerType()})
    with pytest.raises(TableError, match="unsupported type: Age"):
        read_delimited(spark, path, {**schema, "Age": T.LongType()})


@pytest.mark.parametrize(
    "text",
    [
        "Age;Revenu,TypeLogement\n35;500.5;Locataire\n",
        "Age;Revenu\n35;500.5;Locataire\n",
        "Age;Revenu;TypeLogement\n35,500.5;Locataire\n",
        "Age;Revenu;TypeLogement\n35;500.5;Locataire\n36;1.5\n",
    ],
)
def test_ragged_text_fails_whatever_is_selected(spark, write, text):
    path = write("h.csv", text)
    with pytest.raises(Exception):
        read_delimited(spark, path).collect()
    header = text.split("\n")[0].split(";")
    schema = {name: T.StringType() for name in header}
    with pytest.raises(Exception):
        read_delimited(spark, path, schema).select(header[0]).collect()
    with pytest.raises(Exception):
        read_delimited(spark, path, schema).count()


def test_ragged_rows_are_reported(spark, write):
    path = write("h.csv", "a;b\n1;2\n3\n4;5;6\n7;8\n")
    found = ragged_rows(spark, path)
    assert sorted(r["record"] for r in found.collect()) == ["3", "4;5;6"]
    assert all(r["file"].endswith("h.csv") for r in found.collect())
    assert rows(found.select("record")) == [("3",), ("4;5;6",)]


@pytest.mark.parametrize("blank", ["   ", " \t ", "\t"])
def test_a_line_of_blanks_is_a_short_record(spark, write, blank):
    path = write("h.csv", f"a;b\n1;2\n{blank}\n3;4\n")
    for schema in (None, {"a": T.IntegerType(), "b": T.IntegerType()}):
        with pytest.raises(Exception, match="a line of blanks, where the header has 2 fields"):
            read_delimited(spark, path, schema).collect()
    assert rows(ragged_rows(spark, path).select("record")) == [(blank,)]
    assert read_delimited(spark, write("g.csv", "a;b\n1;2\n\n3;4\n")).count() == 2


def test_a_line_of_blanks_is_a_row_of_one_column(spark, write):
    path = write("h.csv", "a\nx\n   \ny\n")
    assert rows(read_delimited(spark, path)) == [("   ",), ("x",), ("y",)]
    assert rows(ragged_rows(spark, path)) == []


def test_bytes_that_are_not_utf8(spark, tmp_path):
    path = tmp_path / "h.csv"
    path.write_bytes(b"a;b\nx;1\ncaf\xe9;2\n")
    for schema in (None, {"a": T.StringType(), "b": T.IntegerType()}):
        with pytest.raises(Exception, match="h.csv: bytes that are not UTF-8"):
            read_delimited(spark, str(path), schema).collect()


def test_missing_file_and_suffix(spark, write):
    with pytest.raises(Exception, match="nonexistent_file"):
        read_delimited(spark, "nonexistent_file.csv")
    with pytest.raises(TableError, match="not a .csv"):
        read_delimited(spark, write("h.txt", HOUSEHOLD))


def test_format_choice(spark, write):
    path = write("h.csv", HOUSEHOLD)
    assert read_households(spark, path, "csv").count() == 1
    with pytest.raises(TableError, match="format must be"):
        read_households(spark, path, "parquet")


def test_no_rows_and_no_header(spark, write):
    with pytest.raises(TableError, match="no row"):
        read_delimited(spark, write("a.csv", "Age;Revenu\n"))
    with pytest.raises(TableError, match="empty"):
        read_delimited(spark, write("b.csv", ""))


def test_duplicate_header_last_column_wins(spark, write):
    df = read_delimited(spark, write("h.csv", "Age;Ville;Age\n1;x;2\n3;y;4\n"))
    assert df.columns == ["Ville", "Age"]
    assert rows(df) == [("x", 2), ("y", 4)]


def test_names_that_differ_by_case(spark, write):
    path = write("h.csv", "Age;AGE\n1;x\n")
    with pytest.raises(TableError, match="caseSensitive"):
        read_delimited(spark, path)
    spark.conf.set("spark.sql.caseSensitive", "true")
    try:
        df = read_delimited(spark, path)
        assert df.dtypes == [("Age", "int"), ("AGE", "string")]
        assert rows(df) == [(1, "x")]
    finally:
        spark.conf.unset("spark.sql.caseSensitive")


def test_every_file_needs_the_same_header(spark, write, tmp_path):
    write("all.csv/a.csv", "Age;Revenu\n1;2.5\n")
    write("all.csv/b.csv", "Revenu;Age\n2.5;1\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_delimited(spark, str(tmp_path / "all.csv")).collect()


def test_quotes_blanks_and_empty_cells(spark, write):
    df = read_delimited(spark, write("h.csv", 'a;b;c\n"x;""y""";;" z "\nback\\slash;"";w\n'))
    assert rows(df) == [("back\\slash", "", "w"), ('x;"y"', "", " z ")]


def test_line_breaks_in_quotes(spark, write):
    path = write("h.csv", 'a;b\n"x\ny";1\n')
    assert rows(read_delimited(spark, path, multi_line=True)) == [("x\ny", 1)]
    with pytest.raises(Exception):
        read_delimited(spark, path).collect()


def test_odd_names(spark, write):
    df = read_delimited(spark, write("h.csv", "a.b;c d;e`f;été\n1;2.5;x;y\n"))
    assert df.columns == ["a.b", "c d", "e`f", "été"]
    assert rows(df) == [(1, 2.5, "x", "y")]


def test_positions(spark, write):
    df = read_delimited(spark, write("h.csv", HOUSEHOLD), positions=True)
    assert df.columns[-2:] == list(POSITIONS)
    assert df.first()[POSITIONS[0]].endswith("h.csv")


def test_round_trip(spark, tmp_path):
    df = spark.createDataFrame(
        [(1, 500.0, " padded "), (2, 1e21, 'q";'), (3, 0.1, ""), (4, -2.5, "back\\")], "i int, d double, s string"
    )
    path = str(tmp_path / "out.csv")
    write_delimited(df, path)
    back = read_delimited(spark, path)
    assert back.dtypes == df.dtypes
    assert rows(back) == rows(df)


def test_null_results_are_written_empty(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, 3.5)], "i int, d double")
    path = str(tmp_path / "out.csv")
    write_delimited(df.coalesce(1), path)
    text = next(p for p in (tmp_path / "out.csv").iterdir() if p.suffix == ".csv").read_text()
    assert text.splitlines() == ["i;d", "1;", "2;3.5"]


def test_single_column_keeps_empty_text(spark, tmp_path):
    path = str(tmp_path / "out.csv")
    write_delimited(spark.createDataFrame([("",), ("x",)], "s string"), path)
    assert rows(read_delimited(spark, path)) == [("",), ("x",)]


def test_schema_given_means_one_pass(spark, write):
    """Without a schema one more job reads the text; with one the read itself is lazy."""
    path = write("h.csv", HOUSEHOLD)
    tracker = spark.sparkContext.statusTracker()
    schema = {"Age": T.IntegerType(), "Revenu": T.DoubleType(), "TypeLogement": T.StringType()}
    counts = []
    for given in (schema, None):
        group = f"read-{given is None}"
        spark.sparkContext.setJobGroup(group, group)
        read_delimited(spark, path, given)
        counts.append(len(tracker.getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] < counts[1]


def test_filter_on_typed_columns(spark, write):
    df = read_delimited(spark, write("h.csv", "Age;Nom\n35;a\n40;b\n"))
    assert rows(df.where(F.col("Age") > 36).select("Nom")) == [("b",)]


def test_place_of_the_first_type_fault(spark, write, tmp_path):
    write("h.csv/a.csv", "Age;Revenu\n30;100.0\n35;200.5\n")
    write("h.csv/b.csv", "Age;Revenu\n40;300.5\nquarante;300\n")
    path = str(tmp_path / "h.csv")
    with pytest.raises(TableError, match="mix integers, floats or text: Age, Revenu"):
        read_delimited(spark, path)
    assert rows(locate_type_fault(spark, path)) == [(3, "Age")]


def test_line_ends_and_byte_order_mark(spark, write):
    df = read_delimited(spark, write("h.csv", "\ufeffAge;Nom\r\n35;a\r\n40;b\r\n"))
    assert df.columns == ["Age", "Nom"]
    assert rows(df) == [(35, "a"), (40, "b")]
