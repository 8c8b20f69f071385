"""Arrow IPC files as a Spark data source: ``spark.read.format("arrow_ipc")`` and ``df.write.format(...)``.

Spark decides which task reads which record batches and which task writes which rows; pyarrow is the codec
inside the tasks.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any
from weakref import WeakSet

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    StringStartsWith,
    WriterCommitMessage,
)

from levyframe.errors import TableError

SUFFIX = ".arrow"
SPARK_TYPES = {pa.int32(): T.IntegerType(), pa.float64(): T.DoubleType(), pa.string(): T.StringType()}
ARROW_TYPES = {kind: arrow for arrow, kind in SPARK_TYPES.items()}
ROWS_PER_TRANSFER = 65_536
DEFAULT_SPLIT_BYTES = 128 * 1024 * 1024
FILE_OPEN_BYTES = 4 * 1024 * 1024  # what opening one more file counts for when small files share a task
DRIVER_THREADS = 16


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("s3a://"):
        path = "s3://" + path[len("s3a://") :]
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[len("file:") :].lstrip("/")
    if "://" not in path:
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


def _arrow_files(path: str) -> tuple[pafs.FileSystem, list[pafs.FileInfo]]:
    """The files to read, by name: one file, or the ``.arrow`` files of a folder."""
    files, place = _file_system(path)
    info = files.get_file_info(place)
    if info.type == pafs.FileType.NotFound:
        raise TableError(f"{path} does not exist")
    if info.type == pafs.FileType.File:
        if not path.endswith(SUFFIX):
            raise TableError(f"{path} is not a {SUFFIX} file")
        return files, [info]
    entries = files.get_file_info(pafs.FileSelector(place))
    found = [
        entry
        for entry in entries
        if entry.type == pafs.FileType.File
        and entry.base_name.endswith(SUFFIX)
        and not entry.base_name.startswith(("_", "."))
    ]
    if not found:
        raise TableError(f"{path} holds no {SUFFIX} file")
    return files, sorted(found, key=lambda entry: entry.path)


def spark_schema(schema: pa.Schema) -> T.StructType:
    wrong = [f"{field.name} {field.type}" for field in schema if field.type not in SPARK_TYPES]
    if wrong:
        raise TableError(f"columns of an unsupported type: {', '.join(wrong)}")
    return T.StructType([T.StructField(field.name, SPARK_TYPES[field.type]) for field in schema])


def arrow_schema(schema: T.StructType) -> pa.Schema:
    wrong = [f"{field.name} {field.dataType.simpleString()}" for field in schema if field.dataType not in ARROW_TYPES]
    if wrong:
        raise TableError(f"columns of an unsupported type: {', '.join(wrong)}")
    return pa.schema([pa.field(field.name, ARROW_TYPES[field.dataType], nullable=True) for field in schema])


@dataclass
class _Piece:
    """One of ``parts`` equal shares of a file's record batches."""

    path: str
    part: int = 0
    parts: int = 1


class _Pieces(InputPartition):
    def __init__(self, pieces: list[_Piece]) -> None:
        super().__init__(pieces)
        self.pieces = pieces


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: T.StructType, options: dict[str, str]) -> None:
        self.path = path
        self.schema = schema
        self.allow_nulls = options.get("nulls", "error").lower() == "allow"
        self.split_bytes = int(options.get("splitbytes", DEFAULT_SPLIT_BYTES))
        self.parallelism = int(options.get("parallelism", 1))
        self.chosen = "columns" in options

    def partitions(self) -> Sequence[InputPartition]:
        """Tasks of about ``splitBytes``, or less where that keeps ``parallelism`` tasks busy, in file order.

        Small files share a task, a larger one is cut into shares of its record batches.  No file is opened here: a task
        that gets a share reads the footer, which tells how many batches there are.
        """
        _, found = _arrow_files(self.path)
        total = sum(entry.size + FILE_OPEN_BYTES for entry in found)
        split_bytes = min(self.split_bytes, max(FILE_OPEN_BYTES, total // self.parallelism))
        tasks: list[InputPartition] = []
        open_task: list[_Piece] = []
        filled = 0
        for entry in found:
            parts = max(1, -(-entry.size // split_bytes))
            size = entry.size + FILE_OPEN_BYTES
            if open_task and (parts > 1 or filled + size > split_bytes):
                tasks.append(_Pieces(open_task))
                open_task, filled = [], 0
            if parts == 1:
                open_task.append(_Piece(entry.path))
                filled += size
            else:
                tasks += [_Pieces([_Piece(entry.path, part, parts)]) for part in range(parts)]
        if open_task:
            tasks.append(_Pieces(open_task))
        return tasks

    def read(self, partition: _Pieces) -> Iterator[pa.RecordBatch]:
        files, _ = _file_system(self.path)
        target = arrow_schema(self.schema)
        for piece in partition.pieces:
            with _open(files, piece.path) as source:
                names = pa.ipc.open_file(source).schema.names
                self._check(piece.path, names, target.names)
                # Only the columns asked for are decoded; of a mapped file no more of it is paged in.
                wanted = [names.index(name) for name in target.names] if len(set(names)) == len(names) else None
                source.seek(0)
                reader = pa.ipc.open_file(source, options=pa.ipc.IpcReadOptions(included_fields=wanted))
                count = reader.num_record_batches
                for number in range(piece.part * count // piece.parts, (piece.part + 1) * count // piece.parts):
                    batch = reader.get_batch(number)
                    batch = batch.select(target.names) if wanted else batch
                    if batch.schema.types != target.types:
                        raise TableError(f"{piece.path} has columns {batch.schema.names} {[str(t) for t in batch.schema.types]}, not {target}")
                    if not self.allow_nulls:
                        _refuse_nulls(batch, piece.path, number)
                    plain = self._asked(pa.RecordBatch.from_arrays(batch.columns, schema=target))
                    for start in range(0, plain.num_rows, ROWS_PER_TRANSFER):
                        yield plain.slice(start, ROWS_PER_TRANSFER)

    def _asked(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch

    def _check(self, path: str, found: list[str], wanted: list[str]) -> None:
        """Every column of the file is read, in its order, unless some were asked for by name."""
        if (set(wanted) - set(found)) if self.chosen else found != wanted:
            raise TableError(f"{path} has columns {found}, not {wanted}")


_TESTS: dict[type, Callable[[pa.Array, Any], pa.Array]] = {
    EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less,
    LessThanOrEqual: pc.less_equal, In: lambda values, wanted: pc.is_in(values, pa.array(list(wanted), values.type)),
    StringStartsWith: pc.starts_with, IsNotNull: lambda values, _: pc.is_valid(values),
}


class _FilteringReader(_Reader):
    """A reader that applies filters on integers and text before rows leave its task.

    Filters on floats stay with Spark, which orders NaN otherwise than Arrow.
    """

    def __init__(self, path: str, schema: T.StructType, options: dict[str, str]) -> None:
        super().__init__(path, schema, options)
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        simple = {f.name for f in self.schema if isinstance(f.dataType, (T.IntegerType, T.StringType))}
        for one in filters:
            if type(one) in _TESTS and len(one.attribute) == 1 and one.attribute[0] in simple:
                self.filters.append(one)
            else:
                yield one

    def _asked(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        for one in self.filters:
            values = batch.column(one.attribute[0])
            batch = batch.filter(_TESTS[type(one)](values, getattr(one, "value", None)))  # NULL is not true
        return batch


def _open(files: pafs.FileSystem, path: str) -> pa.NativeFile:
    # A mapped local file is paged in as it is read.
    return pa.memory_map(path) if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(path)


def _refuse_nulls(batch: pa.RecordBatch, path: str, number: int) -> None:
    for name, values in zip(batch.schema.names, batch.columns):
        if values.null_count:
            row = values.is_null().index(pa.scalar(True)).as_py() + 1
            raise TableError(f"missing value in column {name}, row {row} of batch {number + 1} of {path}")


@dataclass
class _Written(WriterCommitMessage):
    name: str | None


class _Writer(DataSourceArrowWriter):
    """Tasks write below a folder of their own; commit moves the files of the tasks that count."""

    def __init__(self, path: str, schema: T.StructType, overwrite: bool) -> None:
        self.path = path
        self.schema = arrow_schema(schema)
        self.overwrite = overwrite
        self.job = uuid.uuid4().hex

    def _folders(self) -> tuple[pafs.FileSystem, str, str]:
        files, place = _file_system(self.path)
        place = place.rstrip("/")
        return files, place, posixpath.join(place, f"_temporary-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        task = TaskContext.get()
        files, _, temporary = self._folders()
        batches = (batch for batch in iterator if batch.num_rows)
        first = next(batches, None)
        # The first task writes a file in any case, so that a table without rows keeps its columns.
        if first is None and task.partitionId() != 0:
            return _Written(None)
        name = f"part-{task.partitionId():05d}-{self.job}-{task.taskAttemptId()}{SUFFIX}"
        files.create_dir(temporary, recursive=True)
        with files.open_output_stream(posixpath.join(temporary, name)) as sink:
            with pa.ipc.new_file(sink, self.schema) as writer:
                while first is not None:
                    writer.write_batch(pa.RecordBatch.from_arrays(first.columns, schema=self.schema))
                    first = next(batches, None)
        return _Written(name)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, place, temporary = self._folders()
        files.create_dir(place, recursive=True)
        old = [
            entry.path
            for entry in files.get_file_info(pafs.FileSelector(place))
            if entry.type == pafs.FileType.File and entry.base_name.endswith(SUFFIX)
        ]
        names = [message.name for message in messages if message is not None and message.name]
        with ThreadPoolExecutor(DRIVER_THREADS) as pool:
            moves = pool.map(
                lambda name: files.move(posixpath.join(temporary, name), posixpath.join(place, name)), names
            )
            list(moves)
            if self.overwrite:  # the new files stand
                list(pool.map(files.delete_file, old))
        self._clear(files, temporary)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        files, _, temporary = self._folders()
        self._clear(files, temporary)

    @staticmethod
    def _clear(files: pafs.FileSystem, temporary: str) -> None:
        if files.get_file_info(temporary).type == pafs.FileType.Directory:
            files.delete_dir(temporary)


class ArrowIpcDataSource(DataSource):
    """int32, float64 and text columns in Arrow files.

    Reading takes all record batches of all files.  Options: ``nulls`` = ``error`` (default) or ``allow``;
    ``splitBytes``, the size a reading task aims at; ``parallelism``, the number of tasks to keep busy when
    there is less to read; ``columns``, a JSON list of the columns to decode (all); ``pushFilters``, whether tasks apply
    filters (only where the session allows it to Python sources).  Writing makes one file per task.
    """

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def _path(self) -> str:
        path = self.options.get("path")
        if not path:
            raise TableError("arrow_ipc needs a path")
        return path

    def schema(self) -> T.StructType:
        files, found = _arrow_files(self._path())
        with _open(files, found[0].path) as source:
            schema = pa.ipc.open_file(source).schema
        if "columns" not in self.options:
            return spark_schema(schema)
        names = json.loads(self.options["columns"])
        if lacking := [name for name in names if name not in schema.names]:
            raise TableError(f"{found[0].path} has no column {', '.join(lacking)}")
        return spark_schema(pa.schema([schema.field(name) for name in names]))

    def reader(self, schema: T.StructType) -> DataSourceReader:
        options = dict(self.options)
        filtering = options.get("pushfilters", "false").lower() == "true"
        return (_FilteringReader if filtering else _Reader)(self._path(), schema, options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self._path(), schema, overwrite)


_registered: WeakSet[SparkSession] = WeakSet()


def register(spark: SparkSession) -> None:
    """Make the ``arrow_ipc`` format known to the session."""
    if spark not in _registered:
        spark.dataSource.register(ArrowIpcDataSource)
        _registered.add(spark)
