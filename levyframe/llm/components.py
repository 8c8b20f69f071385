"""Connected components of an edge table by large-star and small-star steps (Kiveris et al., 2014).

Each task first joins what its own edges connect, at most ``_NODES_HELD`` nodes and a batch at a time, so that few rounds
are left.  Every round is written to the shared
folder: a lost executor costs no more than the round, and plans stay short.  A node with very many edges is summed up
before it is shuffled, and joined back by a join that adaptive execution can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyframe.storage import stage

_ROWS_A_BATCH = 100_000
_NODES_HELD = 1_000_000  # by a task; it goes on with none when it holds more


def _joined_in_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    def merged() -> Iterator[pa.RecordBatch]:
        nodes = [x for x in parent if parent[x] != x]
        for k in range(0, len(nodes), _ROWS_A_BATCH):
            some = nodes[k : k + _ROWS_A_BATCH]
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array(some, pa.int64()), "b": pa.array([root(x) for x in some], pa.int64())}
            )

    for batch in batches:
        if len(parent) > _NODES_HELD:
            yield from merged()  # what follows is joined with it by the rounds
            parent.clear()
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    yield from merged()


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node with an edge to another node; root is the smallest node it is connected with."""
    links = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b").distinct()
    links = stage(links.mapInArrow(_joined_in_task, "a long, b long"), "links")  # a above b
    while not _is_stars(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.least("a", F.min("b")).alias("least"))
        large = both.where("b > a").join(smallest, "a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        smallest = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(smallest, "a").where("b > least").select(F.col("b").alias("a"), F.col("least").alias("b"))
        links = stage(small.union(smallest.select("a", F.col("least").alias("b"))).distinct(), "links")
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        links.select("b", "b").distinct()
    )


def _is_stars(links: DataFrame) -> bool:
    """Whether every child has one parent and no parent is a child."""
    seen = links.select(F.col("a").alias("node"), F.lit(1).alias("child")).union(links.select("b", F.lit(1 << 40)))
    # a child with two parents counts 2 or more below 2 ** 40; a parent that is a child has both parts
    counted = seen.groupBy("node").agg(F.sum("child").alias("n"))
    bad = (F.col("n") > 1) & (F.col("n") < (1 << 40)) | (F.col("n") >= (1 << 40)) & (F.pmod("n", F.lit(1 << 40)) > 0)
    return counted.where(bad).isEmpty()
