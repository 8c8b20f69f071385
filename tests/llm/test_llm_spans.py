from __future__ import annotations

import random
from hashlib import sha256

import numpy as np
import pytest
from corpora import empty, odd, table, texts_of

from levyframe.llm import repeated_spans as module
from levyframe.llm.queries import LLM_QUERIES
from levyframe.llm.repeated_spans import Suffixes, repeated_spans, span_digests


def plain(texts: list[bytes], length: int) -> list[tuple]:
    places: dict[bytes, list] = {}
    for k, text in enumerate(texts):
        for s in range(len(text) - length + 1):
            places.setdefault(text[s : s + length], []).append((k, s))
    covered = [bytearray(len(t)) for t in texts]
    for found in places.values():
        if len(found) > 1:
            for k, s in found:
                covered[k][s : s + length] = b"\1" * length
    out = []
    for text, cover in zip(texts, covered, strict=True):
        kept = bytes(b for b, c in zip(text, cover, strict=True) if not c)
        runs = sum(1 for k, c in enumerate(cover) if c and (not k or not cover[k - 1]))
        out.append((len(text), sum(cover), runs, sha256(kept).hexdigest()))
    return out


def test_suffix_sort():
    rng = random.Random(1)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 30))) for _ in range(500)]
    suffixes = Suffixes(strings)
    order, shared = suffixes.order()
    assert [strings[k] for k in order] == sorted(strings)
    for before, after, common in zip(order, order[1:], shared[1:], strict=False):
        a, b = strings[before], strings[after]
        assert a[:common] == b[:common] and a[common : common + 1] != b[common : common + 1] or common == min(len(a), len(b))
    by_bytes = Suffixes(strings)._by_bytes()
    assert [strings[k] for k in by_bytes[0]] == sorted(strings) and (by_bytes[1] == shared).all()


def test_a_false_hash_is_found_out():
    strings = [b"abcx", b"abcy", b"abd", b"ab"]
    suffixes = Suffixes(strings)
    suffixes.hashes[:] = np.arange(suffixes.hashes.shape[1], dtype=np.uint64)  # every beginning of one length collides
    order, shared = suffixes.order()
    assert [strings[k] for k in order] == sorted(strings) and shared.tolist() == [0, 2, 3, 2]


@pytest.mark.parametrize(("length", "gram"), [(20, 6), (40, 16), (33, 1), (30, 30)])
def test_pieces(spark, length, gram):
    rng = random.Random(length)
    base = ["".join(rng.choice("ab") for _ in range(90)) for _ in range(6)]
    texts: list = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 4)):
            low, high = sorted((rng.randint(0, 90), rng.randint(0, 90)))
            parts.append(rng.choice(base)[low:high] if rng.random() < 0.5 else "".join(rng.choice("abé") for _ in range(rng.randint(0, 60))))
        texts.append("".join(parts))
    texts += ["a" * 100, "a" * 57, "ab" * 40, "", None, "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in span_digests(repeated_spans(df, length, gram)).collect()}
    assert [got[k] for k in range(len(texts))] == plain([(t or "").encode() for t in texts], length)


def test_query(spark):
    texts = texts_of(table(spark))
    got = {r.doc_id: tuple(r)[1:] for r in LLM_QUERIES["op8_repeated_spans"](spark, "/root/testdata/sf0.001").collect()}
    wanted = plain([t.encode() for t in texts.values()], 400)
    assert got == dict(zip(texts, wanted, strict=True)) and sum(w[1] for w in wanted) > 0


def test_odd_rows(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in odd(spark).collect()]
    wanted = plain([t for _, t in rows], 400)
    got = span_digests(repeated_spans(odd(spark))).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((d, *w) for (d, _), w in zip(rows, wanted, strict=True)), key=repr)
    assert span_digests(repeated_spans(empty(spark))).count() == 0


@pytest.mark.parametrize(("length", "gram"), [(20, 6), (40, 16), (30, 30)])
def test_split_anchors(spark, monkeypatch, length, gram):
    monkeypatch.setattr(module, "_CONTEXTS", 3)
    rng = random.Random(length + 1)
    base = ["".join(rng.choice("ab") for _ in range(90)) for _ in range(4)]
    texts: list = []
    for _ in range(150):
        low, high = sorted((rng.randint(0, 90), rng.randint(0, 90)))
        ends = ["".join(rng.choice("abé") for _ in range(rng.randint(0, 50))) for _ in range(2)]
        texts.append(ends[0] + rng.choice(base)[low:high] + ends[1])
    texts += ["a" * 100, "a" * 57, "ab" * 40, "", None, texts[0], texts[1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in span_digests(repeated_spans(df, length, gram)).collect()}
    assert [got[k] for k in range(len(texts))] == plain([(t or "").encode() for t in texts], length)


def test_a_passage_in_many_contexts(spark, monkeypatch):
    most = 500
    monkeypatch.setattr(module, "_CONTEXTS", most)
    edges = module._edges

    def bounded(length):
        sort = edges(length)

        def run(batches):
            anchor, times = None, 0

            def counted():
                nonlocal anchor, times
                for batch in batches:
                    for here in batch.column("anchor").to_pylist():
                        anchor, times = here, times + 1 if here == anchor else 1
                        if times > most:
                            raise ValueError("a task holds too many contexts of one anchor")
                    yield batch

            yield from sort(counted())

        return run

    monkeypatch.setattr(module, "_edges", bounded)
    rng = random.Random(8)
    some = lambda n: "".join(rng.choices("abcdefghijklmnop", k=n))
    passage, right = some(300), some(120)
    texts = [some(500) + passage + some(500) for _ in range(2000)]
    texts += [some(500) + passage + right[: 90 + k] + some(300) for k in range(15)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in span_digests(repeated_spans(df)).collect()}
    assert all(got[k] == 0 for k in range(2010))  # 399 bytes at most are shared
    assert all(got[2000 + k] >= 390 + min(k, 13) for k in range(10, 15))
