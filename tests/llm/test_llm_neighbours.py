from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from levyframe.llm import neighbours
from levyframe.llm.neighbours import CrossPolytope, hadamard, nearest_neighbours
from levyframe.llm.queries import LLM_QUERIES


def test_hadamard_is_orthogonal():
    turned = hadamard(np.eye(16))
    assert np.allclose(turned @ turned.T, np.eye(16)) and np.allclose(np.abs(turned), 0.25)
    near = CrossPolytope(20).rotated(np.eye(20))
    assert near.shape[2] == 64 and np.allclose((near[..., :32] ** 2).sum(axis=2), 1, atol=1e-5)


def recall(rows, ids, vectors, queries, count=20):
    place = {int(i): k for k, i in enumerate(ids)}
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    shares = []
    for q in queries:
        scores = vectors @ vectors[place[q]]
        best = [int(ids[k]) for k in np.lexsort((ids, -scores)) if ids[k] != q][:count]
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, len(got) + 1)) and q not in {g[1] for g in got}
        assert all(abs(g[2] - scores[place[g[1]]]) < 1e-12 for g in got)
        assert [(-g[2], g[1]) for g in got] == sorted((-g[2], g[1]) for g in got)
        shares.append(len(set(best) & {g[1] for g in got}) / len(best))
    return np.mean(shares)


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query(spark, folder):
    table = spark.read.parquet(f"/root/testdata/{folder}/embeddings.parquet").collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    rows = LLM_QUERIES["op9_neighbours"](spark, f"/root/testdata/{folder}").collect()
    assert recall(rows, ids, vectors, [int(i) for i in ids if i % 20 == 0]) >= 0.9


def test_lengths_differ(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(3000, 12)) * rng.uniform(0.5, 2, (3000, 1))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = nearest_neighbours(df, F.col("vec_id") % 100 == 0).collect()
    assert recall(rows, np.arange(3000), vectors, range(0, 3000, 100)) >= 0.9


def test_odd_rows(spark):
    same = [1.0, 0.0, 0.0]
    rows = [(k, same) for k in range(1, 60)] + [(0, same), (0, same), (100, None), (101, [0.0, 0.0, 0.0]), (102, [1.0, None, 0.0])]
    rows += [(103, [float("nan"), 1.0, 0.0]), (104, [float("inf"), 1.0, 0.0]), (105, [1.0, 2.0]), (106, []), (None, same)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, score string")
    got = nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in got} == {0, 20, 40}
    every = sorted([*range(60), 0])  # two rows have the id 0: both are candidates, and each is a query
    for query in (0, 20, 40):
        rest = [k for k in every if k != query] if query else every[1:]
        found = [r.vec_id for r in sorted(got, key=lambda r: r.rank) if r.query_id == query]
        assert found == [k for k in rest[:20] for _ in range(1 if query else 2)]
    assert nearest_neighbours(df.where("vec_id < 0"), F.col("vec_id") % 20 == 0).count() == 0
    assert nearest_neighbours(df.where("vec_id in (1, 2)"), F.col("vec_id") % 20 == 0).count() == 0
    few = nearest_neighbours(df.where("vec_id in (0, 1, 2)"), F.col("vec_id") % 20 == 0).collect()
    assert sorted((r.rank, r.vec_id, r.score) for r in few) == sorted(2 * [(1, 0, 1.0), (2, 1, 1.0), (3, 2, 1.0)])


def test_lengths_of_64_components(spark):
    rng = np.random.default_rng(9)
    unit = rng.normal(size=(3000, 64))
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    one_long = unit.copy()
    one_long[7] *= 100
    for vectors in (unit, one_long, unit * rng.lognormal(0, 0.5, (3000, 1))):
        df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
        rows = nearest_neighbours(df, F.col("vec_id") % 50 == 0).collect()
        assert len(rows) == 20 * 60 and recall(rows, np.arange(3000), vectors, range(0, 3000, 50)) >= 0.97


@pytest.mark.parametrize("n", [10, 21, 60])
def test_small_tables_are_searched_whole(spark, n):
    vectors = np.random.default_rng(n).normal(size=(n, 64))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = nearest_neighbours(df, F.col("vec_id") % 2 == 0).collect()
    assert len(rows) == min(20, n - 1) * len(range(0, n, 2)) and recall(rows, np.arange(n), vectors, range(0, n, 2)) == 1


def test_tiny_and_huge_components(spark):
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(200, 8))
    vectors[:50] *= 1e-200
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    rows = nearest_neighbours(df, F.col("vec_id") % 20 == 0).collect()
    assert {r.query_id for r in rows} == set(range(0, 200, 20)) and len(rows) == 20 * 10
    assert recall([r for r in rows if r.query_id >= 60], np.arange(200), vectors, range(60, 200, 20)) >= 0.9
    vectors[50:60] *= 1e200  # products of these are infinite
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    assert nearest_neighbours(df, F.col("vec_id") % 20 == 0).count() == 20 * 10


def test_rows_of_one_id(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=(6, 5))
    rows = [(int(rng.integers(0, 8)), base[rng.integers(0, 6)].tolist()) for _ in range(90)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in nearest_neighbours(df, F.col("vec_id") % 4 == 0).collect())
    wanted = []
    for k, (i, v) in enumerate(rows):
        if i % 4 == 0:
            scores = [(-round(float(np.dot(v, w)), 9), j) for m, (j, w) in enumerate(rows) if m != k]
            wanted += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(scores)[:20], start=1)]
    assert got == sorted(wanted)


def test_many_copies_are_one_class(spark):
    rows = [(k, [1.0, 2.0, 3.0]) for k in range(5000)] + [(k, [float(k % 7), 1.0, -1.0]) for k in range(5000, 5040)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    classes = neighbours._classes(neighbours.valid_vectors(df, "vec_id", "embedding"), CrossPolytope(3, 2), 20).collect()
    assert len(classes) == 8 and max(len(r.ids) for r in classes) == 21
    got = [r.vec_id for r in sorted(nearest_neighbours(df, F.col("vec_id") == 4000).collect(), key=lambda r: r["rank"])]
    assert got == list(range(20))


@pytest.mark.parametrize(("tile", "group"), [(7, 50), (100, 1), (1 << 20, 1 << 20)])
def test_tiles_do_not_change_the_result(spark, tile, group):
    vectors = np.random.default_rng(6).normal(size=(900, 10))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    options = {"probes": 40, "tables": 4}
    one = nearest_neighbours(df, F.col("vec_id") % 30 == 0, tile=10**6, group=10**6, **options).collect()
    assert sorted(one) == sorted(nearest_neighbours(df, F.col("vec_id") % 30 == 0, tile=tile, group=group, **options).collect())


def test_share_of_vectors_compared():
    """The share that the fitted probes look at, and the recall, on many vectors."""
    rng = np.random.default_rng(7)
    vectors = rng.normal(size=(20_000, 64))
    unit, lengths = neighbours.directions(vectors)
    hashed = CrossPolytope(64, neighbours.TABLES)
    codes = np.concatenate([hashed.codes(unit[k : k + 2000]) for k in range(0, len(unit), 2000)]).astype(np.int64)
    numbers = neighbours.bucket_numbers(codes, lengths, lengths.max(), 128)
    found, inverse, sizes = np.unique(numbers, return_inverse=True, return_counts=True)
    reach = np.full(len(found), -np.inf)
    np.maximum.at(reach, inverse.ravel(), np.repeat(lengths, neighbours.TABLES))
    buckets = neighbours.Buckets(hashed, lengths.max(), list(zip(found.tolist(), sizes.tolist(), reach.tolist(), strict=True)))
    places, queries = buckets.of(codes, lengths), vectors[:60]
    first = np.array([np.argsort(row)[places].min(axis=1) for row in buckets.ranked(queries, len(found))])
    near = np.argsort(-(queries @ vectors.T), axis=1)[:, 1:21]
    needed = int(np.quantile(np.take_along_axis(first, near, axis=1), neighbours.FOUND))
    assert (first <= needed).mean() < 0.5
