from __future__ import annotations

import base64
import random
from hashlib import sha256

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from corpora import empty, odd, odd_rows, table, texts_of

from levyframe.llm import byte_bpe
from levyframe.llm.queries import LLM_QUERIES

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def ranks():
    with open(PATH, "rb") as file:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}


@pytest.fixture(scope="module")
def reference(ranks):
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


def test_queue_gives_the_smallest_rank():
    queue = byte_bpe.RankQueue(50_000)
    rng = random.Random(1)
    waiting = {rank: [rng.randrange(99)] for rank in rng.sample(range(50_000), 300)}
    for rank, positions in waiting.items():
        queue.push(rank, np.array(positions))
    queue.push(min(waiting), np.array([7]))
    assert queue.pop()[1].tolist() == [*waiting.pop(min(waiting)), 7]
    for rank in sorted(waiting):
        got, positions = queue.pop()
        assert got == rank and positions.tolist() == waiting[rank]
    assert not queue


def test_texts_as_the_library(ranks, reference):
    coder = byte_bpe.ByteBpe(ranks, PATTERN)
    rng = random.Random(2)
    texts = [None, "", " ", "  ", "a  b", "a \n b", "\n\n b", "x" * 5000, "ab" * 3000, "aaab" * 999 + "é" * 500,
             "it's 's 'll don't", "²½ Ⅷ _ __a", "\x1c \x1d a", "日本語 テキスト", "🙂 🙂🙂  🙂", "<|endoftext|>",
             "".join(rng.choice("qzxjvkw") for _ in range(30_000))]
    texts += ["".join(rng.choice(" \n\tab'sé1²,_ ") for _ in range(rng.randint(1, 40))) for _ in range(1500)]
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids.tolist() == reference(text or "")
        assert coder.decode(ids) == (text or "").encode()
        assert coder.written(ids) == " ".join(map(str, ids)).encode()


def test_ranks_that_fall(ranks):
    """A vocabulary where a merge makes a pair of lower rank; the plain rule: always the leftmost lowest pair."""
    odd_ranks = {bytes([b]): 300 + b for b in range(256)} | {b"ab": 20, b"aba": 5, b"abab": 3, b"bb": 4, b"ba": 30, b"aa": 19}
    coder = byte_bpe.ByteBpe(odd_ranks, PATTERN)

    def plain(piece: bytes) -> list[int]:
        if piece in odd_ranks:
            return [odd_ranks[piece]]
        parts = [bytes([b]) for b in piece]
        while True:
            pairs = [(odd_ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in odd_ranks]
            if not pairs:
                return [odd_ranks[p] for p in parts]
            k = min(pairs)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    rng = random.Random(3)
    pieces = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(800)]
    for piece, ids in zip(pieces, coder.merge(pieces), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == plain(piece)


def test_query(spark, reference):
    got = {r.doc_id: r for r in LLM_QUERIES["op6_byte_bpe"](spark, "/root/testdata/sf0.001").collect()}
    texts = texts_of(table(spark))
    assert got.keys() == texts.keys()
    for doc_id, text in texts.items():
        ids = reference(text)
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == sha256(text.encode()).hexdigest()


def test_odd_rows(spark, reference):
    coded = byte_bpe.decode(byte_bpe.encode(odd(spark), PATH, PATTERN), PATH, PATTERN)
    assert coded.columns == ["doc_id", "text", "source", "extra", "ids", "data"]
    rows = coded.collect()
    assert len(rows) == len(odd_rows())
    for row in rows:
        assert row.ids == reference(row.text or "") and bytes(row.data) == (row.text or "").encode()
    assert byte_bpe.round_trip(empty(spark), PATH, PATTERN).count() == 0
    assert byte_bpe.tokenized(odd(spark), PATH, PATTERN).count() == len(rows)
    with pytest.raises(ValueError):
        byte_bpe.encode(odd(spark).withColumnRenamed("extra", "ids"), PATH, PATTERN)


@pytest.mark.parametrize("pattern", [r"[A-Z]?[a-z']+|\s+|.", r"\S+\s?|\s+", r"[^ab]+|[ab]"])
def test_other_patterns_cut_whole_texts(ranks, pattern):
    """A pattern that does not cut before blanks, or cuts letters apart."""
    coder = byte_bpe.ByteBpe(ranks, pattern)
    plain = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    texts = ["", " ", "anOther wordWith Capitals", "ab ba  abba\nXyz", "it's 's"]
    for text, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids.tolist() == plain(text)


def test_a_rank_waits_once_for_many_texts(ranks, reference, monkeypatch):
    """Every 4 million characters, and every half a megabyte of new pre-tokens, went through all ranks again."""
    rng = random.Random(3)
    texts = [" ".join("%x" % rng.randrange(1 << 32) for _ in range(500)) for _ in range(8)]
    texts += [" ".join(["again"] * 800_000), *texts, texts[0][::-1]]
    merged = []
    plain = byte_bpe.ByteBpe._merge
    monkeypatch.setattr(byte_bpe.ByteBpe, "_merge", lambda self, pieces: merged.append(len(pieces)) or plain(self, pieces))
    coder = byte_bpe.ByteBpe(ranks, PATTERN)
    found = list(coder.encode_all(texts))
    assert [ids.tolist() for ids in found] == [reference(text) for text in texts]
    assert len(merged) == 1
