from __future__ import annotations

from hashlib import sha256

import numpy as np
from corpora import empty, odd, table

from levyframe.llm import fingerprints
from levyframe.llm.fingerprints import Fingerprinter, edited
from levyframe.llm.queries import LLM_QUERIES
from levyframe.llm.text import Shingler


def test_likeness_is_near_jaccard():
    rng = np.random.default_rng(1)
    made = Fingerprinter()
    errors = []
    for _ in range(200):
        common = rng.integers(0, 2**64, rng.integers(1, 400), np.uint64)
        one, other = (np.unique(np.append(common, rng.integers(0, 2**64, rng.integers(0, 300), np.uint64))) for _ in range(2))
        true = len(np.intersect1d(one, other)) / len(np.union1d(one, other))
        errors.append(made.likeness(made.of_shingles(one), made.of_shingles(other)) - true)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06


def test_few_shingles_fill_all_bins():
    made = Fingerprinter()
    one = made.of("only three words")
    assert len(one) == made.bins * made.bits // 8 and made.likeness(one, made.of("only three words")) == 1
    assert made.likeness(one, made.of("another text here")) < 0.1
    assert made.of("") == made.of(None) == made.of("  ") == b"" and made.likeness(b"", b"") == 1 and made.likeness(b"", one) == 0


def test_query(spark):
    got = {r.doc_id: r for r in LLM_QUERIES["op10_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    docs = sorted(table(spark).collect(), key=lambda r: -r.doc_id)
    known = Shingler()
    errors = []
    for k, row in enumerate(docs):
        after = docs[(k + 1) % len(docs)]
        changed = edited(row.text, after.text)
        found = got[row.doc_id]
        assert found.n_chars == len(row.text) and found.edited_sha256 == sha256(changed.encode()).hexdigest()
        assert found.fingerprint == Fingerprinter().of(row.text).hex()
        assert found.edited_fingerprint == Fingerprinter().of(changed).hex()
        for other, near in ((changed, found.near_edited), (after.text, found.near_next)):
            a, b = (set(known.of(t).tolist()) for t in (row.text, other))
            errors.append(near - (len(a & b) / len(a | b) if a | b else 1))
    assert len(got) == len(docs) and np.mean(np.abs(errors)) < 0.03 and abs(np.mean(errors)) < 0.01


def test_odd_rows(spark):
    rows = fingerprints.with_edits(odd(spark), 3).collect()
    assert len(rows) == 15
    texts = {r.doc_id: r.text or "" for r in odd(spark).collect() if r.doc_id}
    by_id = {r.doc_id: r for r in rows}
    order = sorted(texts, reverse=True)
    for doc_id, after in zip(order, order[1:], strict=False):
        if after != 2:  # of the repeated rows either may follow
            assert by_id[doc_id].edited_sha256 == sha256(edited(texts[doc_id], texts[after]).encode()).hexdigest()
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1
    assert fingerprints.with_edits(empty(spark)).count() == 0
    one = fingerprints.with_edits(odd(spark).where("doc_id = 9")).collect()
    assert one[0].edited_sha256 == sha256(edited(texts[9], texts[9]).encode()).hexdigest()
    assert fingerprints.fingerprints(odd(spark)).where("fingerprint is null").count() == 0
