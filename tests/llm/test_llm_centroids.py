from __future__ import annotations

import math
import random
from hashlib import sha256

import numpy as np
import pytest

from levyframe.llm.centroids import SIZE, as_integers, cluster_digests, clusters, nearest, sequency_order, walsh_hadamard

SCHEMA = "vec_id long, embedding array<double>, cluster string, distance double"


def plain(rows: list[tuple], rounds: int = 10) -> list[tuple]:
    fits = lambda v: v is not None and len(v) == SIZE and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if fits(v)]
    hashed = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [v for _, v in hashed[:8]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own: dict = {}
        for (_, k), (_, v) in zip(assign(), kept, strict=True):
            own.setdefault(k, []).append(v)
        for k, vectors in own.items():
            centroids[k] = [sum(x) // len(vectors) for x in zip(*vectors, strict=True)]
    final = assign() if kept else []
    inertia = [sum(d for d, k in final if k == c) for c in range(len(centroids))]
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, k, d, inertia[k], sum(inertia), digests[k]) for (i, _), (d, k) in zip(kept, final, strict=True)), key=repr)


def check(spark, rows):
    df = spark.createDataFrame([(i, v, "clash", 0.5) for i, v in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in cluster_digests(df).collect()), key=repr)
    assert got == plain(rows)
    return got


def vectors(seed: int, n: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    centers = rng.normal(size=(5, SIZE))
    return [(k, (centers[k % 5] + 0.4 * rng.normal(size=SIZE)).tolist()) for k in range(n)]


def test_against_plain_version(spark):
    check(spark, vectors(1, 300))


def test_vectors_that_take_no_part(spark):
    rows = vectors(2, 40)
    odd = [(100, None), (101, []), (102, [1.0] * 63), (103, [1.0] * 65), (104, [1.0] * 63 + [None]), (105, [float("nan")] * SIZE)]
    odd += [(106, [float("inf")] + [0.0] * 63), (None, [0.25] * SIZE), (None, [0.5] * SIZE), (3, [-0.1] * SIZE), (3, [-0.1] * SIZE)]
    got = check(spark, rows + odd)
    assert len(got) == 44


@pytest.mark.parametrize("n", [0, 1, 5, 8])
def test_few_vectors(spark, n):
    assert len(check(spark, vectors(3, n))) == n


def test_ties_and_empty_centroids(spark):
    rng = random.Random(4)
    check(spark, [(k, [float(rng.choice([0, 1]))] * SIZE) for k in range(60)])
    check(spark, [(k, [0.0] * SIZE) for k in range(30)])


def test_large_components_are_exact(spark):
    rows = [(k, [float(k * 30000 + j) + 0.3 for j in range(SIZE)]) for k in range(12)]
    assert as_integers(np.array([rows[1][1]])).dtype == object
    check(spark, rows)


def test_a_distance_beyond_64_bits_is_an_error(spark):
    df = spark.createDataFrame([(1, [1e12] * SIZE), (2, [-1e12] * SIZE), *((k, [5e12 * k] * SIZE) for k in range(3, 12))], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        clusters(df)[0].collect()


def test_transform_is_exact_and_coarse_first():
    rng = np.random.default_rng(5)
    a, b = rng.integers(-5000, 5000, (2, 20, SIZE))
    gap = walsh_hadamard(a) - walsh_hadamard(b)
    assert ((gap * gap).sum(axis=1) == SIZE * ((a - b) ** 2).sum(axis=1)).all()
    assert (walsh_hadamard(a)[:, 0] == a.sum(axis=1)).all() and sorted(sequency_order(SIZE)) == list(range(SIZE))


def test_search_by_brute_force():
    rng = np.random.default_rng(6)
    for spread in (3, 100, 4000):
        a, c = rng.integers(-spread, spread, (500, SIZE)), rng.integers(-spread, spread, (8, SIZE))
        c[5] = c[2]
        full = ((a[:, None] - c[None]) ** 2).sum(axis=2)
        k, d = nearest(walsh_hadamard(a), walsh_hadamard(c))
        assert (k == full.argmin(axis=1)).all() and (d == full.min(axis=1)).all()
