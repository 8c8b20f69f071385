"""License scans: an Aho-Corasick automaton for notice phrases and tag names, a shunting-yard parser for expressions.

A text is lower-cased (A-Z) and cut into words, the runs of ASCII letters, digits and characters beyond ASCII.  One
automaton, made of all phrases with a blank around each, runs over the words joined by blanks; overlapping places count.
Where it finds the name of an identifier tag, the expression behind the tag is read from the original text by a
shunting-yard parser: ``with`` binds before ``and``, ``and`` before ``or``.

``score`` tells how freely a document may be used by its own statements: each licence has a value from 0 to 1, ``or``
takes the larger, ``and`` the smaller value, an exception (``with``) raises it to at least 0.6, and the document gets
the smallest value of its statements, or 0 if it states nothing.

Texts are scanned whole where they are read, without a shuffle.  Null and empty texts have no words and no labels;
repeated rows stay; unreadable expressions end at the last token that can belong to them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from levyframe.llm.text import utf8

# The base phrases and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notice phrases and their labels.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "bsd 2 clause": "bsd",
    "bsd 3 clause": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "isc license": "isc",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc by sa": "cc-by-sa",
    "cc by nc sa": "cc-by-nc",
    "cc by nc nd": "cc-by-nc",
    "cc0": "cc0",
    "public domain": "public-domain",
    "this is free and unencumbered software": "public-domain",
    "all rights reserved": "all-rights-reserved",
    "proprietary and confidential": "proprietary",
}
# How freely a text under a label may be used; what is not listed counts as UNKNOWN.
VALUES = {
    "public-domain": 1.0,
    "cc0": 1.0,
    "mit": 0.9,
    "isc": 0.9,
    "bsd": 0.9,
    "apache": 0.9,
    "cc-by": 0.8,
    "mpl": 0.6,
    "epl": 0.6,
    "lgpl": 0.5,
    "cc-by-sa": 0.4,
    "gpl": 0.3,
    "agpl": 0.2,
    "cc-by-nd": 0.1,
    "cc-by-nc": 0.1,
    "all-rights-reserved": 0.0,
    "proprietary": 0.0,
}
UNKNOWN = 0.2
EXCEPTION = 0.6
# How an identifier begins, and its label; the first that fits counts.
FAMILIES = {
    "agpl-": "agpl",
    "lgpl-": "lgpl",
    "gpl-": "gpl",
    "apache-": "apache",
    "mpl-": "mpl",
    "epl-": "epl",
    "bsd-": "bsd",
    "0bsd": "bsd",
    "mit": "mit",
    "isc": "isc",
    "cc0": "cc0",
    "unlicense": "public-domain",
    "cc-by-nc": "cc-by-nc",
    "cc-by-nd": "cc-by-nd",
    "cc-by-sa": "cc-by-sa",
    "cc-by": "cc-by",
}
TAGS = ("spdx license identifier", "license expression")

_TAG = re.compile(r"(?i:spdx-license-identifier|license-expression)[ \t]*:[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"\s*([()]|[A-Za-z0-9][A-Za-z0-9.+:-]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def label_of(identifier: str) -> str:
    name = identifier.lower().rstrip("+")
    return next((label for start, label in FAMILIES.items() if name.startswith(start)), name)


def expression(text: str) -> list[str]:
    """The longest readable expression at the start of ``text``, in postfix order; empty if there is none."""
    output: list[str] = []
    waiting: list[str] = []
    complete: list[str] = []
    depth, want_operand, at = 0, True, 0
    while match := _TOKEN.match(text, at):
        token, at = match.group(1), match.end()
        word = token.lower()
        if token == "(" and want_operand:
            waiting.append(token)
            depth += 1
        elif token == ")" and not want_operand and depth:
            while (top := waiting.pop()) != "(":
                output.append(top)
            depth -= 1
        elif word in _BINDS and not want_operand:
            while waiting and waiting[-1] != "(" and _BINDS[waiting[-1]] >= _BINDS[word]:
                output.append(waiting.pop())
            waiting.append(word)
            want_operand = True
            continue
        elif want_operand and word not in _BINDS and token not in "()":
            output.append(token.rstrip(".:"))
            want_operand = False
        else:
            break
        if not want_operand and not depth:
            complete = output + waiting[::-1]
    return complete


def evaluate(postfix: list[str]) -> float:
    values: list[float] = []
    for token in postfix:
        if token in _BINDS:
            right, left = values.pop(), values.pop()
            values.append({"or": max(left, right), "and": min(left, right), "with": max(left, EXCEPTION)}[token])
        else:
            values.append(VALUES.get(label_of(token), UNKNOWN))
    return values[0]


def labels_in(postfix: list[str]) -> set[str]:
    """The labels of the licences in an expression; what stands behind ``with`` is an exception, not a licence."""
    stack: list[set[str]] = []
    for token in postfix:
        if token in _BINDS:
            right, left = stack.pop(), stack.pop()
            stack.append(left if token == "with" else left | right)
        else:
            stack.append({label_of(token)})
    return stack[0] if stack else set()


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {**BASE, **NOTICES, **dict.fromkeys(TAGS)}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(text: bytes | None, found: ahocorasick.Automaton) -> tuple:
    """(words, base places, first, last, base labels, all labels, score) of one text."""
    words = (text or b"").translate(_WORDS).split()
    if not words:
        return 0, 0, None, None, "", "", 0.0
    joined = f" {b' '.join(words).decode()} "
    base: set[str] = set()
    noticed: set[str] = set()
    tagged_as: set[str] = set()
    starts: list[int] = []
    values: list[float] = []
    tagged = False
    counted = blanks = 0
    for end, phrase in found.iter(joined):
        start = end - len(phrase) - 1  # of the blank before the phrase
        if phrase in BASE:
            # ends go up, starts may go back a little: count on from the last place, or off
            blanks += joined.count(" ", counted, start) if start >= counted else -joined.count(" ", start, counted)
            counted = start
            starts.append(blanks)
            base.add(BASE[phrase])
        elif phrase in NOTICES:
            noticed.add(NOTICES[phrase])
        else:
            tagged = True
    if tagged:
        for match in _TAG.finditer(text.decode()):
            if postfix := expression(match.group(1)):
                tagged_as |= labels_in(postfix)
                values.append(evaluate(postfix))
    noticed |= base
    stated = noticed | tagged_as
    if {"cc-by-nc", "cc-by-nd", "cc-by-sa"} & noticed:
        noticed.discard("cc-by")  # the same place, read as its beginning alone
    values += [VALUES[x] for x in noticed]
    return (
        len(words),
        len(starts),
        min(starts, default=None),
        max(starts, default=None),
        ",".join(sorted(base)),
        ",".join(sorted(stated)),
        min(values, default=0.0),
    )


_FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_base", T.LongType()),
        T.StructField("first_word", T.LongType()),
        T.StructField("last_word", T.LongType()),
        T.StructField("base_labels", T.StringType()),
        T.StructField("labels", T.StringType()),
        T.StructField("score", T.DoubleType()),
    ]
)


def license_scan(df: DataFrame, text: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, and what its licence statements are."""
    kept = [c for c in df.columns if c != text]
    if clash := set(kept) & set(_FOUND.names):
        raise ValueError(f"columns {sorted(clash)} are there already")
    kinds = to_arrow_schema(_FOUND).types

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = automaton()
        for batch in batches:
            rows = [scan(t, found) for t in utf8(batch.column(text))]
            new = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *new], [*kept, *_FOUND.names])

    types = {f.name: f for f in df.schema.fields}
    return df.select(*(F.col(f"`{c}`") for c in [*kept, text])).mapInArrow(
        run, T.StructType([*(types[c] for c in kept), *_FOUND.fields])
    )
