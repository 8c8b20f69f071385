"""Tables written to the cluster's shared folder to cut lineage.

A staged table is read back as plain data: what was computed once (row positions, Python results) keeps its
value when an executor is lost and a task runs again.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_local_folders: dict[str, str] = {}
_watched: list[list[str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; only a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    application = spark.conf.get("spark.app.id", "local")
    if application not in _local_folders:
        _local_folders[application] = tempfile.mkdtemp(prefix="levyframe-")
    return _local_folders[application]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/levyframe/{spark.conf.get('spark.app.id', 'application')}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    folder = f"{_own_folder(spark)}/{uuid.uuid4().hex}"
    for made in _watched:
        made.append(folder)
    return f"{folder}/{name}"


@contextmanager
def temporary_stages(spark: SparkSession) -> Iterator[None]:
    """What is staged within this block is deleted at its end, also after a failure."""
    made: list[str] = []
    _watched.append(made)
    try:
        yield
    finally:
        _watched.remove(made)
        for folder in made:
            _delete(spark, folder)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet and return the written table."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession) -> None:
    """Delete what this application staged; DataFrames made from it cannot be read any more."""
    _delete(spark, _own_folder(spark))


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def qualified(spark: SparkSession, path: str) -> str:
    """``path`` with scheme and authority, as the cluster's default file system completes it."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return place.makeQualified(files.getUri(), files.getWorkingDirectory()).toString()


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
