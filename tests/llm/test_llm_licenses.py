from __future__ import annotations

import re

import pytest
from corpora import empty, odd, table, texts_of

from levyframe.llm.licenses import BASE, automaton, evaluate, expression, labels_in, license_scan, scan
from levyframe.llm.queries import LLM_QUERIES


@pytest.mark.parametrize(
    ("text", "postfix"),
    [
        ("MIT OR Apache-2.0", ["MIT", "Apache-2.0", "or"]),
        ("MIT OR Apache-2.0 AND ISC", ["MIT", "Apache-2.0", "ISC", "and", "or"]),
        ("(MIT or ISC) and GPL-2.0-only */", ["MIT", "ISC", "or", "GPL-2.0-only", "and"]),
        ("GPL-2.0-only WITH Classpath-exception-2.0 OR MIT", ["GPL-2.0-only", "Classpath-exception-2.0", "with", "MIT", "or"]),
        ("MIT AND", ["MIT"]),
        ("((MIT)", []),
        ("or MIT", []),
        ("MIT) x", ["MIT"]),
        ("", []),
    ],
)
def test_expressions(text, postfix):
    assert expression(text) == postfix


def test_values():
    assert evaluate(expression("GPL-3.0+ OR MIT")) == 0.9 and evaluate(expression("GPL-3.0+ AND MIT")) == 0.3
    assert evaluate(expression("GPL-2.0-only WITH Classpath-exception-2.0")) == 0.6
    assert labels_in(expression("GPL-2.0-only WITH Classpath-exception-2.0 OR Own-1")) == {"gpl", "own-1"}


def test_tags_and_notices():
    text = b"// SPDX-License-Identifier: GPL-2.0-only OR Own-1 */\nThe MIT License; CC BY CC BY-NC 4.0"
    assert scan(text, automaton()) == (20, 3, 11, 15, "cc-by,mit", "cc-by,cc-by-nc,gpl,mit,own-1", 0.1)
    assert scan(None, automaton()) == scan(b" .,", automaton()) == (0, 0, None, None, "", "", 0.0)


def plain(text: str) -> tuple:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = [(k, label) for phrase, label in BASE.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    labels = ",".join(sorted({label for _, label in places}))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), labels


def test_query(spark):
    for folder in ("sf0.001", "sf0.01"):
        texts = texts_of(table(spark, f"/root/testdata/{folder}"))
        rows = LLM_QUERIES["op2_license_scan"](spark, f"/root/testdata/{folder}").collect()
        assert {r.doc_id for r in rows} == texts.keys()
        for r in rows:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain(texts[r.doc_id])
            assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_odd_rows(spark):
    found = license_scan(odd(spark))
    assert found.columns[:3] == ["doc_id", "source", "extra"] and found.count() == 15
    assert license_scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        license_scan(odd(spark).withColumnRenamed("extra", "score"))
