from __future__ import annotations

import pytest

from levyframe import storage


class _Session:
    """Stands in for a session: its settings are all that counts here."""

    def __init__(self, **settings):
        self.settings = {key.replace("_", "."): value for key, value in settings.items()}
        self.conf = self

    def get(self, key, default=None):
        return self.settings.get(key, default)


def test_folder_comes_from_the_session():
    assert storage.shared_folder(_Session(spark_checkpoint_dir="hdfs://x/y/", spark_master="yarn")) == "hdfs://x/y"


def test_cluster_without_folder_is_an_error():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        storage.shared_folder(_Session(spark_master="yarn"))


def test_local_session_gets_one_folder_of_its_own():
    session = _Session(spark_master="local[2]", spark_app_id="test-app")
    assert storage.shared_folder(session) == storage.shared_folder(session)


def test_paths_are_fresh(spark):
    first, second = storage.fresh_path(spark, "a"), storage.fresh_path(spark, "a")
    assert first != second and first.startswith(storage.shared_folder(spark))


def test_staged_table_is_the_table(spark):
    df = spark.createDataFrame([(1, None, {"a": 1.5}), (2, "x", {})], "i int, `a.b c` string, m map<string,double>")
    staged = storage.stage(df, "odd")
    assert staged.schema == df.schema
    assert sorted(staged.collect(), key=lambda r: r[0]) == df.collect()
