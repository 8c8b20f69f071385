from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from levyframe.llm import divergence
from levyframe.llm.divergence import shares, source_divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, value double"


def plain(rows: list[tuple], least: int, top: int = 50) -> set[tuple]:
    """The audit by dictionaries and Python's integers."""
    langs: dict = defaultdict(lambda: defaultdict(Counter))
    documents: dict = defaultdict(Counter)
    for _, text, lang, source in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
        langs[lang or ""][source or ""].update(words)
        documents[lang or ""].update(set(words))
    out = set()
    for lang, sources in langs.items():
        kept = [t for t, n in documents[lang].items() if n >= least]
        share = lambda n, of: 1 + 10**9 * (n + 5) // (of + 5 * len(kept))
        held = {s: sum(c[t] for t in kept) for s, c in sources.items()}
        for source, counts in sources.items():
            pairs = [
                (sum(abs(share(counts[t], held[source]) - share(c[t], held[s])) for t in kept), s) for s, c in sources.items() if s != source
            ]
            terms = [(share(counts[t], held[source]) - share(sum(c[t] for c in sources.values()), sum(held.values())), t) for t in kept if counts[t]]
            for part, items, most in (("pair", pairs, None), ("term", [x for x in terms if x[0] > 0], top)):
                ranked = sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, source, part, item, value, k) for k, (value, item) in enumerate(ranked, start=1)}
    return out


def check(spark, rows, least, **options):
    df = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], SCHEMA)
    found = [tuple(r) for r in source_divergence(df, least_documents=least, **options).collect()]
    assert len(found) == len(set(found)) and set(found) == plain(rows, least, options.get("top", 50))


def made(seed: int, n: int, vocabulary: int) -> list[tuple]:
    rng = random.Random(seed)
    words = [rng.choice("abAÉ漢z") + rng.choice("abcdefß") * rng.randint(1, 3) + (f"{k}" if k % 5 == 0 else "") for k in range(vocabulary)]
    rows = []
    for k in range(n):
        text = rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.randint(0, 30)))
        rows.append((k, rng.choice([text, text, text, None, ""]), rng.choice(["en", "de", None]), rng.choice(["a", "b", "ä", None])))
    return rows


@pytest.mark.parametrize(("seed", "least"), [(1, 3), (2, 30), (3, 1)])
def test_against_plain_version(spark, seed, least):
    check(spark, made(seed, 300, 60), least)


def test_buckets_and_few_ranks(spark):
    check(spark, made(4, 200, 200), 2, bucket_counts=7, top=3)


def test_ties_are_in_the_order_of_utf8(spark):
    words = ["z", "é", "漢", "\U0001f642x", "a", "ｚ"] + [f"t{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(120)]
    rows = [(k, " ".join(words), "en", "a") for k in range(3)] + [(9, "other words here", "en", "b")]
    check(spark, rows, 1)
    check(spark, rows, 1, top=5)


def test_groups_without_terms_and_languages_without_kept_terms(spark):
    check(spark, [(1, "one two", "en", "a"), (2, None, "en", "b"), (3, "12 !", "de", "a"), (4, "", "de", "b"), (5, "x", "fr", None)], 2)
    check(spark, [(1, "one two", "en", "a"), (1, "one two", "en", "a"), (None, "one", "en", "b")], 1)


def test_empty_table(spark):
    check(spark, [], 30)


def test_long_texts_are_cut_between_terms(spark, monkeypatch):
    rows = made(6, 40, 50)
    text = " ".join(r[1] or "" for r in rows) + " end" + "é" * 50
    monkeypatch.setattr(divergence, "_PORTION", 97)
    spans = [divergence._long(text.encode(), "en", "a")]
    got = dict(zip(spans[0].column("term").to_pylist(), spans[0].column("n").to_pylist(), strict=True))
    words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text)
    assert got == Counter("".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words)
    assert spans[0].column("documents").to_pylist() == [1] * len(got)


def test_exact_shares():
    rng = random.Random(7)
    for _ in range(2000):
        total = rng.choice([rng.randint(5, 100), rng.randint(5, divergence.MOST)])
        count = rng.randint(0, total - 5)
        assert shares(np.array([count]), total).tolist() == [1 + 10**9 * (count + 5) // total]
