"""Approximate nearest neighbours by cross-polytope hashing.

Unit vectors are turned by pseudo-random rotations, three rounds of random signs and a fast Hadamard transform, and
hashed to the nearest of the signed axes; there are ``TABLES`` such rotations.  A bucket is a table, an axis, and a range
of lengths, as the nearest by inner product may be long and at a wide angle.

1. Equal vectors are one class, which keeps its ``count`` + 1 smallest ids, all that can be among the nearest.
2. A query ranks the buckets by how far out it lies on their axis times their longest vector, and probes the first.  How
   many is fitted: for ``SAMPLE`` queries (chosen by a hash) the nearest are found exactly, and as many buckets are probed
   as it takes to meet ``FOUND`` of them, and to meet ``LEAST`` classes.
3. Classes go to their buckets, once for each table, and queries to those that they probe: what is shuffled grows with the
   number of vectors and of queries, not with their product.  Buckets of many classes or queries are cut into tiles, small
   ones share a task.  A task ranks candidates by matrix products and scores the best by the exact inner product in double
   precision; the best of all buckets are ranked for each query, each class once.
4. A query that has found fewer than ``count`` though there are more probes every bucket of one table, which is exact.

Defined cases: rows without an id, and vectors that are null, empty, zero (every component is), not finite, hold a null, or
have another number of components than most, take no part; every row is a candidate, also under an id that stands more
than once, and every marked row is a query, whose own row alone is left out; -0.0 is 0.0.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyframe.storage import stage

TABLES = 12
NEIGHBOURS = 20
ROUNDS = 3
SAMPLE = 128  # queries that fit the number of probes
FOUND = 0.97  # of their nearest that must be met
LEAST = 1000  # classes that a query meets on average at least, each counted for every table
LENGTHS = 16  # ranges of lengths, each a quarter of a power of two; the last has all that is shorter
TILE = 32_768  # classes, and queries, of a bucket in one task
GROUP = 32_768  # classes and queries of small buckets that share a task
_SEED = 9
_AT_ONCE = 1 << 22  # scores held in memory

CLASS_SCHEMA = "h1 long, h2 long, ids array<long>, data binary, codes array<int>, length double"


def hadamard(rows: np.ndarray) -> np.ndarray:
    """The normalised fast Walsh-Hadamard transform of each row; the row length is a power of two."""
    n, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(n, size // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return rows / np.sqrt(size)


class CrossPolytope:
    """``tables`` rotations of vectors of ``size`` components, which are filled up to a power of two."""

    def __init__(self, size: int, tables: int = TABLES, seed: int = 9):
        self.size = 1 << max(1, (size - 1).bit_length())
        self.tables = tables
        signs = np.random.default_rng(seed).integers(0, 2, (tables, ROUNDS, self.size))
        self._signs = (2 * signs - 1).astype(np.float32)

    def rotated(self, rows: np.ndarray) -> np.ndarray:
        """(rows, tables, 2 * size): how far out each row lies on the signed axes."""
        filled = np.zeros((len(rows), self.size), np.float32)
        filled[:, : rows.shape[1]] = rows
        out = np.empty((len(rows), self.tables, 2 * self.size), np.float32)
        for table, signs in enumerate(self._signs):
            turned = filled
            for sign in signs:
                turned = hadamard(turned * sign)
            out[:, table, : self.size], out[:, table, self.size :] = turned, -turned
        return out

    def codes(self, rows: np.ndarray) -> np.ndarray:
        """(rows, tables): the nearest signed axis."""
        return self.rotated(rows).argmax(axis=2).astype(np.uint32)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The vectors of a list column, in double precision."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = array.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def _unpacked(column: pa.ChunkedArray | pa.Array, size: int) -> np.ndarray:
    """The vectors of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, size)


def directions(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit vectors, logarithms of the lengths to base 2), however small or large the components are."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    length = np.linalg.norm(scaled, axis=1, keepdims=True)
    return scaled / length, (np.log2(largest) + np.log2(length)).ravel()


class Buckets:
    """The buckets that hold something: numbers, classes in each, and logarithms of the longest vector's length."""

    def __init__(self, hashed: CrossPolytope, longest: float, rows: list[tuple[int, int, float]]):
        rows = sorted(rows)
        self.hashed, self.longest = hashed, longest
        self.numbers = np.array([r[0] for r in rows], np.int64)
        self.sizes = np.array([r[1] for r in rows], np.int64)
        self.reach = np.exp2(np.array([r[2] for r in rows]) - longest)
        self.axes = self.numbers // LENGTHS

    def ranked(self, queries: np.ndarray, most: int) -> np.ndarray:
        """(queries, most): places of the buckets to probe, the most promising first."""
        spread = self.hashed.rotated(directions(queries)[0]).reshape(len(queries), -1)
        return np.argsort(-(spread[:, self.axes] * self.reach), axis=1, kind="stable")[:, :most]

    def of(self, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(classes, tables): places of the buckets that hold each class."""
        numbers = bucket_numbers(codes, lengths, self.longest, 2 * self.hashed.size)
        return np.searchsorted(self.numbers, numbers)


def bucket_numbers(codes: np.ndarray, lengths: np.ndarray, longest: float, axes: int) -> np.ndarray:
    steps = np.minimum(LENGTHS - 1, np.floor((longest - lengths) * 4)).astype(np.int64)
    return (codes + np.arange(codes.shape[1], dtype=np.int64) * axes) * LENGTHS + steps[:, None]


class Tiles:
    """Which tasks get the classes and the queries of each bucket."""

    def __init__(self, classes: np.ndarray, queries: np.ndarray, tile: int = TILE, group: int = GROUP):
        self.parts, self.chunks = (np.maximum(1, -(-n // tile)) for n in (classes, queries))
        self.base = np.zeros(len(classes), np.int64)
        number, held = 0, 0
        for k, (n, m) in enumerate(zip(classes.tolist(), queries.tolist(), strict=True)):
            apart = self.parts[k] * self.chunks[k] > 1
            if held and (apart or held + n + m > group):
                number, held = number + 1, 0
            self.base[k] = number
            if apart:
                number += int(self.parts[k] * self.chunks[k])
            else:
                held += n + m

    def of_class(self, place: int, order: int) -> range:
        chunks = int(self.chunks[place])
        first = int(self.base[place]) + order % int(self.parts[place]) * chunks
        return range(first, first + chunks)

    def of_query(self, place: int, order: int) -> range:
        chunks = int(self.chunks[place])
        first = int(self.base[place]) + order % chunks
        return range(first, first + int(self.parts[place]) * chunks, chunks)


def valid_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector, h1, h2) of the rows that take part; equal vectors have equal hashes, 128 bits together."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("vector", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & some)
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))  # -0.0 + 0.0 is 0.0
    return rows.select("*", *(F.xxhash64(F.lit(seed), "vector").alias(f"h{seed}") for seed in (1, 2)))


def _classes(rows: DataFrame, hashed: CrossPolytope, count: int) -> DataFrame:
    """One row for each different vector."""
    first = Window.partitionBy("h1", "h2").orderBy("vec_id")
    kept = rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= count + 1)
    distinct = kept.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("vector").alias("vector"))

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2048):  # bounds the rotated vectors in memory
                part = batch.slice(start, 2048)
                vectors = _matrix(part.column("vector"))
                unit, lengths = directions(vectors)
                codes = pa.FixedSizeListArray.from_arrays(pa.array(hashed.codes(unit).astype(np.int32).ravel()), hashed.tables)
                data = pa.array([v.tobytes() for v in vectors], pa.binary())
                columns = [*(part.column(c) for c in ("h1", "h2", "ids")), data, codes.cast(pa.list_(pa.int32())), pa.array(lengths)]
                yield pa.RecordBatch.from_arrays(columns, ["h1", "h2", "ids", "data", "codes", "length"])

    return distinct.mapInArrow(index, CLASS_SCHEMA)


def _buckets(classes: DataFrame, hashed: CrossPolytope) -> Buckets:
    longest = classes.agg(F.max("length")).first()[0]
    axes = 2 * hashed.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, hashed.tables)
            lengths = batch.column("length").to_numpy()
            numbers, inverse, n = np.unique(bucket_numbers(codes, lengths, longest, axes), return_inverse=True, return_counts=True)
            most = np.full(len(numbers), -np.inf)
            np.maximum.at(most, inverse.ravel(), np.repeat(lengths, hashed.tables))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(n), pa.array(most)], ["bucket", "n", "length"])

    parts = classes.select("codes", "length").mapInArrow(count, "bucket long, n long, length double")
    found = parts.groupBy("bucket").agg(F.sum("n").alias("n"), F.max("length").alias("length"))
    return Buckets(hashed, longest, [(r.bucket, r.n, r.length) for r in found.collect()])  # tables x axes x LENGTHS at most


def _fitted_probes(classes: DataFrame, queries: DataFrame, buckets: Buckets, count: int, size: int) -> int:
    """How many buckets meet ``FOUND`` of the nearest of a sample of the queries."""
    order = F.xxhash64(F.lit(_SEED), "vec_id", "h1", "h2")
    sample = queries.orderBy(order, "vec_id", "h1", "h2").limit(SAMPLE).collect()
    vectors = np.array([r.vector for r in sample])
    own = {(r.h1, r.h2, k) for k, r in enumerate(sample)}
    rank = np.empty((len(sample), len(buckets.numbers)), np.int32)
    np.put_along_axis(rank, buckets.ranked(vectors, len(buckets.numbers)), np.arange(len(buckets.numbers), dtype=np.int32)[None], axis=1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = vectors @ _unpacked(batch.column("data"), size).T
            keys = list(zip(batch.column("h1").to_pylist(), batch.column("h2").to_pylist(), strict=True))
            for k in range(len(sample)):
                scores[k, [row for row, key in enumerate(keys) if (*key, k) in own]] = -np.inf
            best = np.argpartition(-scores, min(count, len(keys)) - 1, axis=1)[:, :count]
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, buckets.hashed.tables)
            places = buckets.of(codes, batch.column("length").to_numpy())
            asked = np.repeat(np.arange(len(sample)), best.shape[1])
            first = rank[asked[:, None], places[best.ravel()]].min(axis=1)
            columns = [pa.array(x) for x in (asked, scores[asked, best.ravel()], first.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["q", "score", "rank"])

    top = Window.partitionBy("q").orderBy(F.desc("score"))
    found = classes.mapInArrow(near, "q long, score double, rank long").where("score > double('-inf')")
    ranks = [r[0] for r in found.withColumn("place", F.row_number().over(top)).where(F.col("place") <= count).select("rank").collect()]
    least = int(np.ceil(LEAST / buckets.sizes.mean()))
    return max(least, 1 + int(np.quantile(ranks, FOUND, method="higher")) if ranks else 1)


def _search(classes: DataFrame, probing: DataFrame, buckets: Buckets, count: int, size: int, tile: int, group: int) -> DataFrame:
    """(query_id, q1, q2, h1, h2, score, ids): the best classes of each query in the buckets of each task.

    ``probing`` has the queries with ``probes``, the places of their buckets.
    """
    asked_of = np.zeros(len(buckets.numbers), np.int64)
    for r in probing.select(F.explode("probes").alias("place")).groupBy("place").count().collect():
        asked_of[r.place] = r["count"]
    tiles = Tiles(np.where(asked_of > 0, buckets.sizes, 0), asked_of, tile, group)

    def sent(rows: list[tuple[int, int, int]], batch: pa.RecordBatch, names: tuple[str, ...]) -> pa.RecordBatch:
        """Rows of the batch as often as they are needed: (task, bucket, row)."""
        task, place, at = (pa.array(list(x), pa.int64()) for x in zip(*rows, strict=True)) if rows else (pa.array([], pa.int64()),) * 3
        return pa.RecordBatch.from_arrays([task, place, *(batch.column(c).take(at) for c in names)], ["task", "place", *names])

    def deal_classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("codes").flatten().to_numpy().reshape(-1, buckets.hashed.tables)
            places = buckets.of(codes, batch.column("length").to_numpy())
            rows = [
                (task, place, k)
                for k, (order, own) in enumerate(zip(batch.column("h1").to_pylist(), places.tolist(), strict=True))
                for place in own if asked_of[place]
                for task in tiles.of_class(place, order)
            ]
            yield sent(rows, batch, ("h1", "h2", "ids", "data"))

    def deal_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (task, place, k)
                for k, (order, own) in enumerate(zip(batch.column("h2").to_pylist(), batch.column("probes").to_pylist(), strict=True))
                for place in own
                for task in tiles.of_query(place, order)
            ]
            yield sent(rows, batch, ("vec_id", "h1", "h2", "data"))

    held = classes.mapInArrow(deal_classes, "task long, place long, h1 long, h2 long, ids array<long>, data binary")
    asked = probing.mapInArrow(deal_queries, "task long, place long, vec_id long, h1 long, h2 long, data binary")
    kinds = (pa.int64(),) * 5 + (pa.float64(), pa.list_(pa.int64()))
    names = ("query_id", "q1", "q2", "h1", "h2", "score", "ids")

    def search(key: tuple, held: pa.Table, asked: pa.Table) -> pa.Table:
        if not len(held) or not len(asked):
            return pa.table([pa.array([], t) for t in kinds], names)
        held, asked = held.combine_chunks(), asked.combine_chunks()
        vectors, queries = _unpacked(held["data"], size), _unpacked(asked["data"], size)
        own = {n: held[n].to_numpy() for n in ("place", "h1", "h2")}
        of = {n: asked[n].to_numpy() for n in ("place", "vec_id", "h1", "h2")}
        ids = held["ids"].combine_chunks()
        least = pa.compute.list_element(ids, 0).to_numpy()
        single = pa.compute.list_value_length(ids).to_numpy() == 1
        met: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for place in np.intersect1d(own["place"], of["place"]).tolist():
            rows, all_asked = np.flatnonzero(own["place"] == place), np.flatnonzero(of["place"] == place)
            step = max(1, _AT_ONCE // len(rows))
            for start in range(0, len(all_asked), step):
                q = all_asked[start : start + step]
                met.append(_best(vectors, queries, rows, q, own, of, least, single, count + 1))
        row, q, score = (np.concatenate(x) for x in zip(*met, strict=True))
        # the best of the task for each query; one that probes several buckets here stands for each of them
        same = np.lexsort((of["h2"][q], of["h1"][q], of["vec_id"][q]))
        row, q, score = row[same], q[same], score[same]
        new = np.ones(len(q), bool)
        new[1:] = np.any([np.diff(of[n][q]) != 0 for n in ("vec_id", "h1", "h2")], axis=0)
        number = np.cumsum(new)
        order = np.lexsort((least[row], -score, number))
        starts = np.searchsorted(number[order], number[order])
        order = order[np.arange(len(order)) - starts < (count + 1) * TABLES]  # a class may stand for several tables
        row, q, score = row[order], q[order], score[order]
        values = [of["vec_id"][q], of["h1"][q], of["h2"][q], own["h1"][row], own["h2"][row], score]
        return pa.table([*(pa.array(v, t) for v, t in zip(values, kinds)), ids.take(pa.array(row))], names)

    return held.groupBy("task").cogroup(asked.groupBy("task")).applyInArrow(
        search, "query_id long, q1 long, q2 long, h1 long, h2 long, score double, ids array<long>"
    )


def _best(
    vectors: np.ndarray, queries: np.ndarray, rows: np.ndarray, q: np.ndarray, own: dict, of: dict, least: np.ndarray, single: np.ndarray, most: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, query, score) of the ``most`` best rows of a bucket for each query."""
    with np.errstate(over="ignore", invalid="ignore"):
        near = np.nan_to_num(queries[q] @ vectors[rows].T, nan=-np.inf, posinf=np.inf, neginf=-np.inf)
        itself = (of["h1"][q][:, None] == own["h1"][rows]) & (of["h2"][q][:, None] == own["h2"][rows]) & single[rows]
        # a class of one row that is the query's own; of more rows, that row is left out later
        near[itself & (of["vec_id"][q][:, None] == least[rows])] = -np.inf
        if len(rows) > most:
            # all that may be among the best, whatever the last digits are
            last = np.partition(near, len(rows) - most, axis=1)[:, len(rows) - most, None]
            slack = 1e-12 * np.linalg.norm(queries[q], axis=1)[:, None] * np.linalg.norm(vectors[rows], axis=1).max()
            chosen = near >= last - np.where(np.isfinite(slack), slack, 0)
        else:
            chosen = np.ones(near.shape, bool)
        chosen &= ~(itself & (of["vec_id"][q][:, None] == least[rows]))
        a, b = np.nonzero(chosen)
        score = (vectors[rows[b]] * queries[q[a]]).sum(axis=1)  # the same sum for equal vectors
    order = np.lexsort((least[rows[b]], -score, a))
    a, b, score = a[order], b[order], score[order]
    kept = np.arange(len(a)) - np.searchsorted(a, a) < most
    return rows[b[kept]], q[a[kept]], score[kept]


def _ranked(found: DataFrame, queries: DataFrame, count: int) -> DataFrame:
    """(query_id, rank, vec_id, score, q1, q2): each query's rows in order, for each of its own rows."""
    key = ["query_id", "q1", "q2"]
    once = found.repartition(*key).dropDuplicates([*key, "h1", "h2"])
    at = F.array_position("ids", F.col("query_id")).cast("int")
    cut = F.concat(F.slice("ids", F.lit(1), at - 1), F.slice("ids", at + 1, F.size("ids")))
    itself = (F.col("q1") == F.col("h1")) & (F.col("q2") == F.col("h2")) & (at > 0)
    every = once.select(*key, "score", F.explode(F.when(itself, cut).otherwise(F.col("ids"))).alias("vec_id"))
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")
    best = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    times = queries.select(F.col("vec_id").alias("asked"), F.col("h1").alias("a1"), F.col("h2").alias("a2"), "times")
    same = (F.col("query_id") == F.col("asked")) & (F.col("q1") == F.col("a1")) & (F.col("q2") == F.col("a2"))
    return best.join(times, same).select(*key, "rank", "vec_id", "score", "times")


def nearest_neighbours(
    df: DataFrame, is_query: F.Column, vec_id: str = "vec_id", vector: str = "embedding", count: int = NEIGHBOURS,
    tables: int = TABLES, probes: int | None = None, tile: int = TILE, group: int = GROUP,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``is_query`` (an expression of ``vec_id``) marks, the best
    found among all other rows.  ``probes``: buckets to look at, fitted where it is not given."""
    rows = stage(valid_vectors(df, vec_id, vector), "vectors")
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("rows"), F.count_if(is_query).alias("queries"))
    most = sizes.orderBy(F.desc("rows"), "size").first()
    result = "query_id long, rank int, vec_id long, score double"
    if most is None or not most.queries:
        return df.sparkSession.createDataFrame([], result)
    rows = rows.where(F.size("vector") == most.size)
    hashed = CrossPolytope(most.size, tables)
    classes = stage(_classes(rows, hashed, count), "classes")
    queries = rows.where(is_query).groupBy("vec_id", "h1", "h2").agg(F.count("*").alias("times"), F.first("vector").alias("vector"))
    queries = stage(queries, "queries")
    buckets = _buckets(classes, hashed)
    probes = probes or _fitted_probes(classes, queries, buckets, count, most.size)

    def probing(chosen: DataFrame, every: bool) -> DataFrame:
        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = np.flatnonzero(buckets.axes < 2 * hashed.size)  # the first table's
            for batch in batches:
                for start in range(0, batch.num_rows, 1024):
                    part = batch.slice(start, 1024)
                    vectors = _matrix(part.column("vector"))
                    places = np.tile(whole, (len(vectors), 1)) if every else buckets.ranked(vectors, probes)
                    data = pa.array([v.tobytes() for v in vectors], pa.binary())
                    lists = pa.array(places.astype(np.int32).tolist(), pa.list_(pa.int32()))
                    columns = [*(part.column(c) for c in ("vec_id", "h1", "h2")), data, lists]
                    yield pa.RecordBatch.from_arrays(columns, ["vec_id", "h1", "h2", "data", "probes"])

        return stage(chosen.mapInArrow(choose, "vec_id long, h1 long, h2 long, data binary, probes array<int>"), "probing")

    def found(chosen: DataFrame, every: bool) -> DataFrame:
        return _ranked(_search(classes, probing(chosen, every), buckets, count, most.size, tile, group), queries, count)

    ranked = stage(found(queries, False), "ranked")
    enough = min(count, most.rows - 1)
    full = ranked.where(F.col("rank") == enough).select(F.col("query_id").alias("vec_id"), F.col("q1").alias("h1"), F.col("q2").alias("h2"))
    short = stage(queries.join(full, ["vec_id", "h1", "h2"], "left_anti"), "short")
    if enough and not short.isEmpty():
        missed = short.select(F.col("vec_id").alias("query_id"), F.col("h1").alias("q1"), F.col("h2").alias("q2"))
        ranked = ranked.join(missed, ["query_id", "q1", "q2"], "left_anti").unionByName(found(short, True))
    repeated = ranked.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("again"))
    return repeated.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
