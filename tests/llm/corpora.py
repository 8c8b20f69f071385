"""Small tables for the tests of the corpus operators, and plain versions of what they compute."""

from __future__ import annotations

import random

FOLDER = "/root/testdata/sf0.001"


def table(spark, folder: str = FOLDER):
    return spark.read.parquet(f"{folder}/documents.parquet")


def texts_of(df) -> dict[int, str]:
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def odd_rows() -> list[tuple]:
    """Rows of (doc_id, text, source, extra): nulls, empty and long texts, ties, repeated rows."""
    random.seed(4)
    words = [f"w{k}" for k in range(400)]
    long = " ".join(random.choice(words) for _ in range(6000))
    base = " ".join(random.choice(words) for _ in range(80))
    return [
        (1, base, "a", 1.0),
        (2, base, "a", 1.0),
        (2, base, "a", 1.0),
        (3, base + " one more", "b", None),
        (4, None, "b", 2.0),
        (5, "", None, 2.0),
        (6, " \t\n", None, 2.0),
        (7, long, None, 2.0),
        (8, long[:-3], "c", 2.0),
        (9, "Five words are one shingle", "c", 2.0),
        (10, "five words are one shingle", "c", 2.0),
        (11, "four words only here", "c", 2.0),
        (12, "é ß 漢字 🙂   end", "c", 2.0),
        (None, base, "a", 3.0),
        (None, None, None, None),
    ]


SCHEMA = "doc_id long, text string, source string, extra double"


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


class Union:
    """Union-find with the smallest element as root."""

    def __init__(self):
        self.parent: dict = {}

    def root(self, x):
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def link(self, a, b):
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
