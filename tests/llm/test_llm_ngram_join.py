from __future__ import annotations

import random

import pytest
from corpora import Union, empty, odd, table

from levyframe.llm.components import components
from levyframe.llm.ngram_join import ngram_components, one_of_each_group
from levyframe.llm.queries import LLM_QUERIES


def sets(text: str | None) -> set:
    words = (text or "").encode().translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))).split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain(rows: list[tuple], percent: int = 80) -> list[tuple]:
    """(doc_id, n_shingles, component_id) by comparing all with all."""
    found = [(doc_id, sets(text)) for doc_id, text in rows]
    union, where = Union(), {}
    for k, (doc_id, s) in enumerate(found):
        union.root(k)
        for j in range(k):
            t = found[j][1]
            if s and t and doc_id is not None and found[j][0] is not None:
                both = len(s & t)
                if 100 * both >= percent * (len(s) + len(t) - both):
                    union.link(j, k)
    for k, (doc_id, _) in enumerate(found):
        if doc_id is not None:
            root = union.root(k)
            where[root] = min(where.get(root, doc_id), doc_id)
    return [(d, len(s), None if d is None else where[union.root(k)]) for k, (d, s) in enumerate(found)]


def near_copies(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    out = []
    for group in range(12):
        base = [f"g{group}w{rng.randint(0, 50)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        for _ in range(rng.randint(1, 14)):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 30))):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 5)}"
            out.append(" ".join(words[: rng.randint(max(1, len(words) * 9 // 10), len(words))]))
    rng.shuffle(out)
    return list(enumerate(out, start=10))


@pytest.mark.parametrize("percent", [80, 50])
def test_groups_of_near_copies(spark, percent):
    rows = near_copies(percent)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_components(df, percent).collect()))
    assert got == sorted(plain(rows, percent))
    assert len({r[2] for r in got}) < len(got)


def test_query(spark):
    rows = [(r.doc_id, r.text) for r in table(spark).collect()]
    got = LLM_QUERIES["op1_ngram_join"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(tuple, got.collect())) == sorted(plain(rows))


def test_odd_rows(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    key = lambda r: (r[0] is None, r)
    assert sorted(map(tuple, ngram_components(odd(spark)).collect()), key=repr) == sorted(plain(rows), key=repr)
    assert ngram_components(empty(spark)).count() == 0
    kept = one_of_each_group(odd(spark))
    assert kept.columns == ["doc_id", "text", "source", "extra"]
    ids = sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0))
    assert ids == [1, 4, 5, 6, 7, 9, 11, 12, None, None], key


def test_components_of_long_paths(spark):
    rng = random.Random(5)
    edges = [(k, k + 1) for k in range(300) if k % 50] + [(1000, k) for k in range(1001, 1300)]
    rng.shuffle(edges)
    union = Union()
    for a, b in edges:
        union.link(a, b)
    df = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges], "x long, y long")
    got = {r.node: r.root for r in components(df.repartition(7), "x", "y").collect()}
    assert got == {x: union.root(x) for x in union.parent}
