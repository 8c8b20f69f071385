"""Centroid clustering of integer vectors by a progressive search over Walsh-Hadamard coefficients.

Components become the integers ``floor(SCALE * x)``, so all that follows is exact.  The Walsh-Hadamard transform of 64
integers is 64 integers, and the squared distance of two transforms is 64 times that of the vectors.  Coefficients are
taken from coarse to fine (by sequency), in steps of ``STEPS``: what a centroid has gathered after a step can only grow,
so a centroid that already has more than a whole distance of another is strictly worse and is left.  That whole distance
is the one to the centroid with the least after the first step.  Those that are never left finish all 64, and the
least of these wins; of equal ones the smaller number.

Each round is one job over the written integer vectors: tasks search and add up their own vectors, Spark adds the tasks'
sums, and the driver sees one sum for each centroid and component.  Nothing is shuffled but these sums, whatever the
share of a cluster.  The first centroids are found by a top-k over hashes of the ids.

Defined cases: rows whose vector is null, has other than ``SIZE`` components, or holds a null or a value that is not
finite take no part and are not returned; rows of one id, or of no id, are vectors of their own; ids of equal hash start
centroids in the order of their vectors, vectors without an id come last; fewer vectors than centroids give fewer
centroids; an empty centroid stays where it is; an empty table gives an empty one.  Components of 2**24 / ``SCALE`` or
more are searched in Python's integers; a distance or a sum that does not fit in 64 bits is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyframe.storage import stage

SIZE = 64
SCALE = 1024
CENTROIDS = 8
ROUNDS = 10
STEPS = (4, 8, 16, 32, 64)  # coefficients looked at after each step
SEED = 3
_ROWS = 4096  # searched together
_SAFE = 1 << 24  # below it, 64 squared differences of coefficients fit in 64 bits
_SMALLEST, _LARGEST = -(1 << 63), (1 << 63) - 1


def _natural_hadamard(rows: np.ndarray) -> np.ndarray:
    n, size = rows.shape
    half = 1
    while half < size:
        pairs = rows.reshape(n, size // (2 * half), 2, half)
        rows = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    return rows


def sequency_order(size: int) -> np.ndarray:
    """The rows of the transform by their number of sign changes, coarse to fine."""
    signs = _natural_hadamard(np.eye(size, dtype=np.int64))
    return np.argsort((np.diff(signs, axis=1) != 0).sum(axis=1), kind="stable")


_ORDER = sequency_order(SIZE)


def walsh_hadamard(rows: np.ndarray) -> np.ndarray:
    """The exact transform of integer rows of ``SIZE`` components, coefficients coarse to fine."""
    return _natural_hadamard(rows)[:, _ORDER]


def as_integers(vectors: np.ndarray) -> np.ndarray:
    """``floor(SCALE * x)``; Python's integers where 64 bits might not do for distances."""
    with np.errstate(over="ignore"):
        scaled = np.floor(vectors * float(SCALE))
    if len(scaled) == 0 or np.abs(scaled).max() < _SAFE:
        return scaled.astype(np.int64)
    whole = [[int(x) * SCALE if x.is_integer() else int(np.floor(x * SCALE)) for x in row] for row in vectors.tolist()]
    return np.array(whole, object)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centroid, squared distance to it) of each row of coefficients ``vectors``."""
    n, count = len(vectors), len(centroids)
    differences = vectors[:, : STEPS[0], None] - centroids.T[None, : STEPS[0]]
    gathered = (differences * differences).sum(axis=1)
    # a whole distance to compare with: that of the centroid that leads after the first step
    leader = gathered.argmin(axis=1)
    rest = vectors - centroids[leader]
    bound = (rest * rest).sum(axis=1)
    row, centroid = np.nonzero(gathered <= bound[:, None])
    sums = gathered[row, centroid]
    for start, end in zip(STEPS, STEPS[1:]):
        more = vectors[row, start:end] - centroids[centroid, start:end]
        sums = sums + (more * more).sum(axis=1)
        stay = sums <= bound[row]  # what is strictly worse goes; the leader itself stays
        row, centroid, sums = row[stay], centroid[stay], sums[stay]
    order = np.lexsort((centroid, sums, row)) if sums.dtype != object else np.array(
        sorted(range(len(row)), key=lambda k: (row[k], sums[k], centroid[k])), np.int64
    )
    first = order[np.searchsorted(row[order], np.arange(n))]
    return centroid[first].astype(np.int32), sums[first] // SIZE


def _fits(values: np.ndarray) -> np.ndarray:
    """As 64-bit integers, or an error."""
    if values.dtype == object and len(values) and not (_SMALLEST <= min(values) and max(values) <= _LARGEST):
        raise OverflowError("a squared distance does not fit in 64 bits")
    return values.astype(np.int64)


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, _ROWS):
            part = batch.slice(start, _ROWS)
            flat = part.column("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            yield part, as_integers(flat.reshape(part.num_rows, SIZE))


def _together(values: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of vectors and centroids, in one kind of integer."""
    large = values.dtype == object or any(abs(x) >= _SAFE for c in centroids for x in c)
    kind = object if large else np.int64
    return walsh_hadamard(values.astype(kind)), walsh_hadamard(np.array(centroids, kind))


def _sums(vectors: DataFrame, centroids: list[list[int]]) -> dict[int, tuple[int, list[int]]]:
    """(number of vectors, sum of each component) of each cluster that is not empty."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [0] * len(centroids)
        sums: list = [np.zeros(SIZE, object) for _ in centroids]
        for _, values in _batches(batches):
            cluster, _ = nearest(*_together(values, centroids))
            for k in np.unique(cluster).tolist():
                own = values[cluster == k]
                counts[k] += len(own)
                sums[k] = sums[k] + own.sum(axis=0).astype(object)
        held = [k for k, n in enumerate(counts) if n]
        if held:
            cells = [(k, c) for k in held for c in range(-1, SIZE)]  # component -1 stands for the count
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array([k for k, _ in cells], pa.int32()), "component": pa.array([c for _, c in cells], pa.int32()),
                "part": [str(counts[k] if c < 0 else sums[k][c]) for k, c in cells],
            })

    parts = vectors.mapInArrow(add, "cluster int, component int, part string")
    total = parts.groupBy("cluster", "component").agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("total"))
    found = {(r.cluster, r.component): int(r.total) for r in total.collect()}  # centroids x components rows
    held = {k for k, _ in found}
    return {k: (found[k, -1], [found[k, c] for c in range(SIZE)]) for k in held}


def kept_vectors(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """(vec_id, vector) of the rows that take part."""
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vector").isNotNull() & (F.size("vector") == SIZE) & finite)


def first_centroids(vectors: DataFrame, count: int, seed: int) -> list[list[int]]:
    """The vectors whose ids have the smallest hashes."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    chosen = vectors.select(hashed.alias("hash"), "vector").orderBy(F.asc_nulls_last("hash"), "vector").limit(count).collect()
    return [[int(x) for x in as_integers(np.array([r.vector]))[0]] for r in chosen]


def clusters(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> tuple[DataFrame, list[list[int]]]:
    """((vec_id, cluster, distance) of every vector that takes part, the final centroids)."""
    vectors = stage(kept_vectors(df, vec_id, vector), "vectors")
    centroids = first_centroids(vectors, count, seed)
    for _ in range(rounds if centroids else 0):
        for k, (n, sums) in _sums(vectors, centroids).items():
            centroids[k] = [s // n for s in sums]

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, values in _batches(batches):
            cluster, distance = nearest(*_together(values, centroids))
            columns = [part.column("vec_id"), pa.array(cluster), pa.array(_fits(distance))]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    return vectors.mapInArrow(assign, "vec_id long, cluster int, distance long"), centroids


def cluster_digests(
    df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part."""
    assigned, centroids = clusters(df, vec_id, vector, count, rounds, seed)
    assigned = stage(assigned, "assigned")
    sums = {r.cluster: r.inertia for r in assigned.groupBy("cluster").agg(F.sum("distance").alias("inertia")).collect()}
    digests = [sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    per_cluster = F.array(*(F.lit(sums.get(k, 0)).cast("long") for k in range(len(centroids)))).cast("array<long>")
    names = F.array(*(F.lit(d) for d in digests)).cast("array<string>")
    return assigned.select(
        "vec_id", "cluster", "distance", F.get(per_cluster, F.col("cluster")).alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), F.get(names, F.col("cluster")).alias("centroid_sha256"),
    )
