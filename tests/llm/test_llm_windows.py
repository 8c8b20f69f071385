from __future__ import annotations

import random
import re
from hashlib import sha256

import numpy as np
import pytest
from corpora import SCHEMA, empty, odd, odd_rows, table

from levyframe.llm import window_dedup
from levyframe.llm.window_dedup import WINDOW, digest_bytes, window_digests, without_repeated_windows


def plain(rows: list[tuple]) -> list[tuple]:
    """(id, words, spans, kept text) of each (id, text), by a dictionary of windows."""
    split = [re.findall(r"[^\x20\x09-\x0D]+", text or "") for _, text in rows]
    least: dict[tuple, int] = {}
    for (doc, _), words in zip(rows, split, strict=True):
        for k in range(len(words) - WINDOW + 1):
            span = tuple(words[k : k + WINDOW])
            if doc is not None:
                least[span] = min(doc, least.get(span, doc))
    out = []
    for (doc, _), words in zip(rows, split, strict=True):
        gone = set()
        for k in range(len(words) - WINDOW + 1):
            other = least.get(tuple(words[k : k + WINDOW]))
            if other is not None and (doc is None or other < doc):
                gone.update(range(k, k + WINDOW))
        starts = [k for k in sorted(gone) if k - 1 not in gone]
        spans = [(a, next(k for k in range(a, len(words)) if k + 1 not in gone)) for a in starts]
        out.append((doc, len(words), spans, " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


def found(df, **options) -> list[tuple]:
    rows = without_repeated_windows(df, **options).collect()
    assert all(r.n_removed == sum(s.last_word - s.first_word + 1 for s in r.spans) for r in rows)
    return sorted(((r.doc_id, r.n_words, [tuple(s) for s in r.spans], r.kept_text) for r in rows), key=repr)


def test_odd_rows(spark):
    assert found(odd(spark)) == plain([r[:2] for r in odd_rows()])
    assert found(odd(spark).drop("source", "extra"), block_bytes=1) == plain([r[:2] for r in odd_rows()])


def test_empty_and_texts_without_words(spark):
    assert found(empty(spark)) == []
    assert found(spark.createDataFrame([(1, None), (2, " \t")], "doc_id long, text string")) == [(1, 0, [], ""), (2, 0, [], "")]


@pytest.mark.parametrize("block_bytes", [60, 5000, 1 << 22])
def test_shared_passages_in_any_blocks(spark, block_bytes):
    rng = random.Random(block_bytes)
    passages = [[rng.choice("abcde") * rng.randint(1, 3) for _ in range(rng.randint(8, 40))] for _ in range(6)]
    rows = []
    for k in range(80):
        words = [f"{rng.choice('xyzé漢')}{rng.randint(0, 30)}" for _ in range(rng.randint(0, 20))]
        for _ in range(rng.randint(0, 3)):
            words += rng.choice(passages) + [f"u{k}"] * rng.randint(0, 2)
        rows.append((rng.choice([None, *range(60)]), rng.choice([" ", "\n", "\t ", "\x0b"]).join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, block_bytes=block_bytes, bucket_windows=50) == plain(rows)


def test_hot_passage_is_one_entry_a_block(spark):
    passage = " ".join(f"p{k}" for k in range(60))
    rows = [(k, f"{passage} own{k}", "a", 1.0) for k in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    blocks = window_dedup.stage(window_dedup.packed(df, "doc_id", "text"), "blocks")
    entries = window_dedup._entries(blocks, 8, 9, WINDOW).collect()
    digests = sum(len(r.digests) // 9 for r in entries)
    assert digests <= blocks.count() * 50 + 3000
    assert found(df) == plain([r[:2] for r in rows])


def test_other_hash_bits_decide(spark, monkeypatch):
    """Windows whose first 64 bits collide are told apart by the others."""
    real = window_dedup.mixed
    monkeypatch.setattr(window_dedup.Windows, "_rolled", _colliding(window_dedup.Windows._rolled))
    words = window_dedup.Words([" ".join(f"w{k % 17}" for k in range(60)).encode()])
    windows = window_dedup.Windows(words)
    spans = [tuple(f"w{(k + j) % 17}" for j in range(WINDOW)) for k in windows.start]
    assert len(set(zip(windows.entry.tolist(), spans, strict=True))) == len(set(spans)) == len(windows.at)
    assert real is window_dedup.mixed


def _colliding(rolled):
    def one(self, lane, base, inverse, window):
        values = rolled(self, lane, base, inverse, window)
        return np.zeros_like(values) if base == window_dedup._BASES[0] else values

    return one


def test_digests_are_wide_enough():
    for windows in (10, 10**6, 10**9, 10**13):
        buckets = max(32, windows // 2_000_000)
        width = digest_bytes(windows, buckets)
        assert windows**2 / 2 / 2 ** (8 * width) / buckets <= 2**-16 or width == 16
    assert digest_bytes(1, 1) == 8


def test_query_columns(spark):
    docs = table(spark).select("doc_id", "text").limit(60)
    got = {tuple(r) for r in window_digests(docs).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    wanted = {(d, n, sum(b - a + 1 for a, b in spans), sha256(t.encode()).hexdigest()) for d, n, spans, t in plain(rows)}
    assert got == wanted
