from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from corpora import empty, odd, table

from levyframe.llm import mixture
from levyframe.llm.mixture import MOST, Mixture, chosen_blocks, mixed, split, targets
from levyframe.llm.queries import LLM_QUERIES
from levyframe.storage import stage


@pytest.mark.parametrize("seed", range(5))
def test_targets_and_tree(seed):
    rng = np.random.default_rng(seed)
    sizes = [int(x) for x in rng.integers(0, 10 ** rng.integers(1, 6, 12))]
    weights = [1 + k % 3 for k in range(12)]
    found = targets(sizes, weights)
    assert abs(sum(found) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
    assert all(f <= MOST * s + 1e-9 for f, s in zip(found, sizes, strict=True))
    rates = {round(f / w, 6) for f, s, w in zip(found, sizes, weights, strict=True) if 0 < f < MOST * s * (1 - 1e-9)}
    assert len(rates) <= 1
    quotas = rng.integers(0, 300, 9)
    counts = split(quotas, 13, seed)
    assert (counts.sum(axis=0) == quotas).all() and np.ptp(counts.sum(axis=1)) <= 1 and counts.min() >= 0


def test_tree_draws_by_the_hypergeometric_law():
    quotas = np.array([30, 70])
    drawn = np.array([split(quotas, 4, seed)[0, 0] for seed in range(800)])
    assert abs(drawn.mean() - 25 * 0.3) < 0.3 and abs(drawn.var() - 25 * 0.3 * 0.7 * 75 / 99) < 0.7


def test_blocks_come_near_the_target():
    rng = np.random.default_rng(2)
    sizes = rng.integers(0, 500, 60)
    for share in (0.0, 0.3, 0.99, 1.0, 1.7, 3.0):
        taken = chosen_blocks(sizes, share * sizes.sum(), rng)
        assert abs((taken * sizes).sum() - share * sizes.sum()) <= 20 and taken.max() <= MOST


def test_query(spark):
    for folder, most in (("sf0.001", 0.05), ("sf0.01", 0.01)):
        docs = {r.doc_id: r for r in table(spark, f"/root/testdata/{folder}").collect()}
        rows = LLM_QUERIES["op5_mixture"](spark, f"/root/testdata/{folder}").collect()
        assert len(rows) == len(docs)
        by_source = defaultdict(list)
        for r in rows:
            assert r.size == len(docs[r.doc_id].text.encode().split()) and 0 <= r.taken <= 3 * r.size
            by_source[docs[r.doc_id].source].append(r)
        names = sorted(by_source)
        wanted = targets([sum(r.size for r in by_source[s]) for s in names], [1 + k % 3 for k in range(len(names))])
        for name, target in zip(names, wanted, strict=True):
            assert {r.source_size for r in by_source[name]} == {sum(r.size for r in by_source[name])}
            assert all(abs(r.target - target) < 1e-6 for r in by_source[name])
            assert abs(sum(r.taken for r in by_source[name]) - target) <= most * target
        again = LLM_QUERIES["op5_mixture"](spark, f"/root/testdata/{folder}").collect()
        assert sorted(map(tuple, again)) == sorted(map(tuple, rows))


def test_what_was_written_is_what_is_told(spark):
    mix = Mixture(table(spark), shards=8)
    told = {r.doc_id: r for r in mix.documents().collect()}
    written = mix.written().collect()
    times, places = defaultdict(int), defaultdict(list)
    for r in written:
        times[r.doc_id] += len(r.text.encode().split())
        places[r.doc_id].append((r.shard, r.position))
    assert {d: r.taken for d, r in told.items() if r.taken} == {d: n for d, n in times.items() if n}
    assert {d: [tuple(p) for p in r.places] for d, r in told.items() if r.places} == {d: sorted(p) for d, p in places.items()}
    by_shard = defaultdict(list)
    for r in written:
        by_shard[r.shard].append(r.position)
    assert sorted(by_shard) == list(range(8)) and all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    # a shard is not in the order of the ids
    first = [r.doc_id for r in sorted(written, key=lambda r: (r.shard, r.position)) if r.shard == 0]
    assert first != sorted(first)
    lazy = sorted((r.doc_id, r.shard) for r in mix.rows().collect())
    assert lazy == sorted((r.doc_id, r.shard) for r in written)


def test_targets_and_blocks_by_a_plain_version(spark):
    """The blocks that the mix takes, and the shard of each, told again from the hashes."""
    mix = Mixture(table(spark), shards=5)
    sizes, sources = defaultdict(lambda: np.zeros(mixture.BLOCKS, np.int64)), {}
    for r in mix.sizes.collect():
        sizes[r.source][r.mix_block] += r.size
    for k, name in enumerate(sorted(sizes)):
        sources[name] = k
    wanted = targets([int(sizes[n].sum()) for n in sources], [1 + k % 3 for k in range(len(sources))])
    quotas, runs = [], {}
    for (name, k), target in zip(sources.items(), wanted, strict=True):
        held = np.flatnonzero(np.isin(np.arange(mixture.BLOCKS), [r.mix_block for r in mix._blocks.where(mix._blocks.source == name).collect()]))
        taken = chosen_blocks(sizes[name][held], target, np.random.default_rng((mixture.SEED, k)))
        runs[name] = np.repeat(held, taken)[np.argsort(np.random.default_rng((mixture.SEED, k, 1)).permutation(taken.sum()))]
        quotas.append(len(runs[name]))
    ends = split(np.array(quotas), 5, mixture.SEED).cumsum(axis=0)
    plain = sorted(
        (name, int(b), int(np.searchsorted(ends[:, k], at, side="right"))) for name, k in sources.items() for at, b in enumerate(runs[name])
    )
    assert sorted((r.source, r.mix_block, r.shard) for r in mix.copies.collect()) == plain


@pytest.mark.parametrize("wrong", ["all in one shard", "half is lost"])
def test_a_wrong_tree_shows(spark, monkeypatch, wrong):
    def tree(quotas, shards, seed=0):
        out = np.zeros((shards, len(quotas)), np.int64)
        out[0] = quotas if wrong == "all in one shard" else quotas // 2
        return out

    right = {r.doc_id: r for r in Mixture(table(spark)).documents().collect()}
    monkeypatch.setattr(mixture, "split", tree)
    told = {r.doc_id: r for r in Mixture(table(spark)).documents().collect()}
    assert {d: r.places for d, r in told.items()} != {d: r.places for d, r in right.items()}
    if wrong == "half is lost":
        assert sum(r.taken for r in told.values()) < 0.7 * sum(r.taken for r in right.values())


def test_clashing_columns_are_refused(spark):
    for name in mixture.OWN:
        with pytest.raises(ValueError, match=name):
            mixed(table(spark).withColumnRenamed("lang", name))


def test_odd_rows(spark):
    rows = Mixture(odd(spark)).documents().collect()
    twice = [r for r in rows if r.doc_id == 2]
    assert len(twice) == 2 and twice[0] == twice[1] and len(twice[0].places) * twice[0].size == 2 * twice[0].taken
    assert len(rows) == 15 and all(r.size == 0 and r.taken == 0 for r in rows if r.doc_id in (4, 5, 6))
    assert mixed(odd(spark)).columns == odd(spark).columns and mixed(odd(spark)).count() > 0
    assert Mixture(empty(spark)).documents().count() == 0 and mixed(empty(spark)).count() == 0


def test_blocks_are_placed_without_python(spark, monkeypatch):
    plans = {}

    def kept(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name)

    monkeypatch.setattr(mixture, "stage", kept)
    mix = Mixture(table(spark), shards=5)
    assert "EvalPython" not in plans["copies"] and "ExistingRDD" not in plans["copies"]
    taken = mix.copies.groupBy("source", "mix_block").count().count()
    assert taken == mix.copies.select("source", "mix_block").distinct().count() > 0
    runs = mix.copies.groupBy("shard").count().collect()
    assert sorted(r.shard for r in runs) == list(range(5)) and np.ptp([r["count"] for r in runs]) <= 1
