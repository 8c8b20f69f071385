from __future__ import annotations

import random
from hashlib import sha256

import pytest
from corpora import Union, empty, odd, table, texts_of

from levyframe.llm.line_dedup import dedup_lines, edit_distance_within, with_kept_lines
from levyframe.llm.queries import LLM_QUERIES


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(new[-1] + 1, row[j] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(rng: random.Random, text: str, edits: int, alphabet: str) -> str:
    letters = list(text)
    for _ in range(edits):
        k, how = rng.randint(0, len(letters)), rng.random()
        if how < 0.35 or not letters:
            letters.insert(k, rng.choice(alphabet))
        elif how < 0.7:
            letters.pop(min(k, len(letters) - 1))
        else:
            letters[min(k, len(letters) - 1)] = rng.choice(alphabet)
    return "".join(letters)


def test_banded_distance():
    rng = random.Random(3)
    for _ in range(6000):
        a = "".join(rng.choice("abc") for _ in range(rng.randint(0, 14)))
        b = changed(rng, a, rng.randint(0, 5), "abc")
        most = rng.randint(1, 4)
        assert edit_distance_within(a, b, most) == (distance(a, b) <= most), (a, b, most)
    assert edit_distance_within("x" * 100_000, "x" * 50_000 + "y" + "x" * 50_000, 1)


def plain(texts: dict[int, str], most: int = 2, least: int = 20) -> dict[int, str]:
    """Kept texts by comparing all lines with all."""
    places: dict[str, list] = {}
    for doc_id in sorted(texts):
        for number, line in enumerate(texts[doc_id].split("\n")):
            if len(line.strip()) >= least:
                places.setdefault(line.strip(), []).append((doc_id, number))
    lines = sorted(places, key=len)
    union = Union()
    for k, a in enumerate(lines):
        for b in lines[k + 1 :]:
            if len(b) - len(a) > most:
                break
            if edit_distance_within(a, b, most):
                union.link(a, b)
    first: dict[str, tuple] = {}
    for line, found in places.items():
        root = union.root(line)
        first[root] = min(first.get(root, found[0]), found[0])
    return {
        doc_id: "\n".join(
            line
            for number, line in enumerate(text.split("\n"))
            if len(line.strip()) < least or first[union.root(line.strip())] == (doc_id, number)
        )
        for doc_id, text in texts.items()
    }


def test_edited_lines(spark):
    rng = random.Random(6)
    lines = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(18, 60))) for _ in range(40)]
    lines += ["common head of many lines " + "".join(rng.choice("uvwxyz") for _ in range(12)) for _ in range(60)]
    texts = {k: "\n".join(changed(rng, rng.choice(lines), rng.randint(0, 3), "abz") for _ in range(rng.randint(1, 6))) for k in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.kept_text for r in with_kept_lines(df).collect()}
    assert got == plain(texts)
    left = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert left == {k: v for k, v in got.items() if v == texts[k] or any(x.strip() for x in v.split("\n"))}


def test_query(spark):
    texts = texts_of(table(spark))
    kept = plain(texts)
    for r in LLM_QUERIES["op3_line_dedup"](spark, "/root/testdata/sf0.001").collect():
        assert r.kept_sha256 == sha256(kept[r.doc_id].encode()).hexdigest()
        assert r.n_lines == len(texts[r.doc_id].split("\n"))


def test_odd_rows(spark):
    rows = with_kept_lines(odd(spark)).collect()
    assert len(rows) == 15
    by_id = {r.doc_id: r for r in rows if r.doc_id}
    assert by_id[1].n_removed == 0 and by_id[2].n_removed == 1 and by_id[4].kept_text is None and by_id[5].kept_text == ""
    assert by_id[9].n_removed == 0 and by_id[10].n_removed == 1 and by_id[8].n_removed == 0
    assert all(r.n_removed == 0 for r in rows if r.doc_id is None)
    assert sorted(r.doc_id for r in dedup_lines(odd(spark)).collect() if r.doc_id) == [1, 3, 4, 5, 6, 7, 8, 9, 11, 12]
    assert dedup_lines(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        with_kept_lines(odd(spark).withColumnRenamed("extra", "gone"))


def test_short_lines_outlive_a_repeated_one(spark):
    footer = "this footer stands on every page"
    rows = [(1, footer), (2, f"a\nb\nshort verse\n{footer}"), (3, f"  \n{footer}\n"), (4, footer)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(df).collect()} == {1: footer, 2: "a\nb\nshort verse"}
