"""Policy documents (TOML) to tables, many documents in one job, and one of them to a ``Policy``.

Python only turns a document's text into JSON (``_as_json``), whose scalars are texts that begin with a letter for their
kind, so that nothing is lost on the way: no 3 becomes 3.0, and NaN and large integers stay.  Spark parses the JSON to
one variant, and what a policy must look like is said in expressions on it: keys, kinds, ranges, and which fault is first.
"""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable, Iterator, Mapping
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from levyframe.errors import PolicyError
from levyframe.functions.names import column
from levyframe.operators.rules import PYTHON, Component, Policy

SUFFIX = ".toml"

# The keys of the document format.
DOCUMENT_KEYS = ("name", "intitule_long", "composante")
COMPONENT_KEYS = (
    "name",
    "intitule_long",
    "parameters",
    "logical_order",
    "caracteristiques_dependencies",
    "function",
)
PARAMETER_KEYS = ("names", "intitules_long", "values")

DOCUMENT_SCHEMA = (
    "source string, policy string, label string, components array<struct<name: string, label: string,"
    " parameter_names: array<string>, parameter_labels: array<string>, parameter_values: array<double>,"
    " logical_order: int, dependencies: array<string>, function: string>>, error string"
)
_TEXT, _WHOLE, _FLOAT, _OTHER = "s", "i", "f", "o"  # the letters before scalars


def _tagged(value: Any) -> Any:
    """A document's value for JSON."""
    if isinstance(value, dict):
        return {key: _tagged(item) for key, item in value.items()}
    if isinstance(value, list):
        return [_tagged(item) for item in value]
    kinds = {str: _TEXT, int: _WHOLE, float: _FLOAT}
    return kinds.get(type(value), _OTHER) + str(value)


def _as_json(text: str | bytes | None) -> tuple[str | None, str | None]:
    """(JSON, what is wrong) of a document's text."""
    if text is None:
        return None, "no text"
    try:
        table = tomllib.loads(text.decode() if isinstance(text, (bytes, bytearray)) else text)
        return json.dumps(_tagged(table), ensure_ascii=False), None
    except (ValueError, RecursionError) as error:  # not TOML, not UTF-8, a number of too many digits
        return None, str(error)


def _json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_as_json(text) for text in batch.column("text").to_pylist()]
        columns = [batch.column("source"), *(pa.array(x, pa.string()) for x in zip(*found))]
        if found:
            yield pa.RecordBatch.from_arrays(columns, ["source", "json", "fault"])


# What a document must look like ----------------------------------------------------------------------------


def _scalar(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _list(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _table(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>")


def _is_text(value: Column) -> Column:
    return F.coalesce(_scalar(value).startswith(_TEXT), F.lit(False))


def _is_number(value: Column) -> Column:
    return F.coalesce(_scalar(value).startswith(_WHOLE) | _scalar(value).startswith(_FLOAT), F.lit(False))


def _is_short_integer(value: Column) -> Column:
    return F.coalesce(_scalar(value).startswith(_WHOLE), F.lit(False)) & _rest(value).try_cast("int").isNotNull()


def _is_list(fits: Callable[[Column], Column], value: Column) -> Column:
    return F.coalesce(F.forall(_list(value), fits), F.lit(False))


def _is_table(value: Column) -> Column:
    return _table(value).isNotNull()


def _rest(value: Column) -> Column:
    """A scalar without its letter."""
    return F.substring(_scalar(value), 2, 2**31 - 1)


def _texts(value: Column) -> Column:
    return F.transform(_list(value), _rest)


def _faults(table: Column, wanted: Mapping[str, tuple[Callable[[Column], Column], str]], where: Column) -> list[Column]:
    """For each key in order what is wrong with it, NULL where nothing is."""
    found = []
    for key, (fits, kind) in wanted.items():
        lacks, misfits = (F.concat(where, F.lit(f": {key} {text}")) for text in ("is missing", f"is not {kind}"))
        value = table[key]
        found.append(F.when(value.isNull(), lacks).when(~fits(value), misfits))
    return found


_NAME, _LABEL, _PARTS = DOCUMENT_KEYS
_PART_NAME, _PART_LABEL, _PARAMETERS, _ORDER, _DEPENDENCIES, _FUNCTION = COMPONENT_KEYS
_NAMES, _LABELS, _VALUES = PARAMETER_KEYS
_TEXT_KIND, _TEXT_LIST = (_is_text, "text"), (partial(_is_list, _is_text), "a list of texts")


def _opened(entry: Column) -> Column:
    """A component with its table and its table of parameters, each unpacked once."""
    return F.struct(_table(entry).alias("part"))


def _with_inner(opened: Column) -> Column:
    return F.struct(opened["part"].alias("part"), _table(opened["part"][_PARAMETERS]).alias("inner"))


def _component_fault(opened: Column, at: Column) -> Column:
    """The first thing that is wrong with a component."""
    where = F.concat(F.lit("component "), (at + 1).cast("string"))
    part, inner = opened["part"], opened["inner"]
    return F.coalesce(
        F.when(part.isNull(), F.concat(where, F.lit(" is not a table"))),
        *_faults(part, {_PARAMETERS: (_is_table, "a table"), _PART_NAME: _TEXT_KIND, _PART_LABEL: _TEXT_KIND}, where),
        *_faults(inner, {_NAMES: _TEXT_LIST, _LABELS: _TEXT_LIST, _VALUES: (partial(_is_list, _is_number), "a list of numbers")}, where),
        *_faults(part, {_ORDER: (_is_short_integer, "a 32-bit integer"), _DEPENDENCIES: _TEXT_LIST, _FUNCTION: _TEXT_KIND}, where),
    )


def _component(opened: Column) -> Column:
    part, inner = opened["part"], opened["inner"]
    return F.struct(
        _rest(part[_PART_NAME]).alias("name"), _rest(part[_PART_LABEL]).alias("label"), _texts(inner[_NAMES]).alias("parameter_names"),
        _texts(inner[_LABELS]).alias("parameter_labels"),
        F.transform(_list(inner[_VALUES]), lambda x: _rest(x).try_cast("double")).alias("parameter_values"),
        _rest(part[_ORDER]).try_cast("int").alias("logical_order"), _texts(part[_DEPENDENCIES]).alias("dependencies"),
        _rest(part[_FUNCTION]).alias("function"),
    )


def _joined(names: Column, before: str) -> Column:
    """A complaint about names; NULL without any."""
    return F.when(F.size(names) > 0, F.concat(F.lit(before), F.array_join(names, ", ")))


def parse_policies(documents: DataFrame, source: str, text: str) -> DataFrame:
    """Parse a column of TOML texts: one row per document, no shuffle; what is wrong with one goes into ``error``.

    One table of many documents scales better than many small files.
    """
    chosen = documents.select(column(source).cast("string").alias("source"), column(text).alias("text"))
    read = chosen.mapInArrow(_json, "source string, json string, fault string")
    table = F.struct(_table(F.try_parse_json("json")).alias("table"))
    read = read.select("source", "fault", F.inline(F.array(table)))
    keys, known = F.map_keys("table"), F.array(*map(F.lit, DOCUMENT_KEYS))
    opened = F.transform(F.transform(_list(F.col("table")[_PARTS]), _opened), _with_inner)
    read = read.select("source", "fault", "table", F.inline(F.array(F.struct(opened.alias("parts")))))
    parts = F.col("parts")
    document = F.lit("document")
    faults = F.filter(F.transform(parts, _component_fault), lambda x: x.isNotNull())
    error = F.coalesce(
        "fault",
        F.when(F.col("table").isNull(), F.lit("the document is too large")),
        _joined(F.array_except(known, keys), "missing keys: "),
        _joined(F.array_sort(F.array_except(keys, known)), "unknown keys: "),
        F.when(parts.isNull(), F.lit(f"document: {_PARTS} is not a list of tables")),
        F.when(F.size(parts) == 0, F.lit("no component")),
        *_faults(F.col("table"), {_NAME: _TEXT_KIND, _LABEL: _TEXT_KIND}, document),
        F.get(faults, F.lit(0)),
    )
    # Unpacked by a generator, so that the fault is found once, however often it is asked for.
    judged = read.select("source", "table", "parts", F.inline(F.array(F.struct(error.alias("error")))))
    sound = F.col("error").isNull()
    return judged.select(
        "source", F.when(sound, _rest(F.col("table")[_NAME])).alias("policy"), F.when(sound, _rest(F.col("table")[_LABEL])).alias("label"),
        F.when(sound, F.transform(parts, _component)).alias("components"), "error",
    )


def read_policies(spark: SparkSession, path: str) -> DataFrame:
    """Parse a ``.toml`` file, or all of them in a folder; ``source`` is the file's path."""
    last = path.rstrip("/").rsplit("/", 1)[-1]
    if "." in last and not last.endswith(SUFFIX):
        raise PolicyError(f"{path} is not a {SUFFIX} file")
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{SUFFIX}").load(path)
    return parse_policies(files, "path", "content")


def to_policy(
    document: Mapping[str, Any], functions: Mapping[str, Callable[..., Any]] | None = None, kind: str = PYTHON
) -> Policy:
    """A ``Policy`` from one row of the documents table.

    Components named in ``functions`` use that function, of the given ``kind``; the others keep the
    document's Python source, which runs only where ``trust_source=True`` is passed.
    """
    if document["error"] is not None:
        raise PolicyError(f"{document['source']}: {document['error']}")
    given = functions or {}
    parts = []
    for part in document["components"]:
        parts.append(
            Component(
                name=part["name"],
                label=part["label"],
                function=given.get(part["name"]),
                source=part["function"],
                kind=kind if part["name"] in given else PYTHON,
                parameters=dict(zip(part["parameter_names"], part["parameter_values"])),
                parameter_labels=dict(zip(part["parameter_names"], part["parameter_labels"])),
                logical_order=part["logical_order"],
                dependencies=tuple(part["dependencies"]),
            )
        )
    return Policy(document["policy"], parts, document["label"])


def policy_from_text(
    spark: SparkSession, text: str, functions: Mapping[str, Callable[..., Any]] | None = None, kind: str = PYTHON
) -> Policy:
    """The policy in one document's text."""
    given = spark.createDataFrame([("text", text)], "source string, text string")
    (document,) = parse_policies(given, "source", "text").collect()
    return to_policy(document.asDict(recursive=True), functions, kind)


def load_policy(
    spark: SparkSession, path: str, functions: Mapping[str, Callable[..., Any]] | None = None, kind: str = PYTHON
) -> Policy:
    """The policy in one ``.toml`` file."""
    if not path.endswith(SUFFIX):
        raise PolicyError(f"{path} is not a {SUFFIX} file")
    documents = read_policies(spark, path).limit(2).collect()
    if len(documents) != 1:
        raise PolicyError(f"{path} is not exactly one file")
    return to_policy(documents[0].asDict(recursive=True), functions, kind)
