"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a target number of words: its weight's share of all words, but at most ``MOST`` times what it has;
what is over goes to the others by weight.  A source's documents are dealt into ``BLOCKS`` blocks by a hash.  A target
takes each block once for every whole time that it holds the source, and for the rest blocks in a random order as
long as they fit (the best of ``TRIALS`` orders), so a source misses its target by less than its smallest block left.  Those counts of blocks
are the sources' exact quotas.

The quotas are divided among the output shards by a tree: a node draws, by a multivariate hypergeometric law, how many
blocks of each source go to its left half, and so on down to single shards.  A shard then holds its own run of each
source's permuted blocks: runs are disjoint, and all shards together hold every block of the quotas once.  Within a
shard the documents are put in random order: they are dealt into pieces that suit a task, and each piece is sorted by a
hash.  What the mix has taken of a document is told from the rows that were written, each with its shard and its position
there; a block in no shard's run is not in the mix.

A block holds about 1 / ``BLOCKS`` of its source, so a large source is never in one task.  The driver sees one row per
source, and the tree's counts (sources times shards).

Defined cases: null texts have 0 words; a null source is a source of its own, last in order; sources without words get
nothing and nothing is taken of them; rows of one id are dealt by their text too, so each is taken as often as its block,
and of rows equal in id, text and source the positions are shared; input columns of the names in ``OWN`` are an error.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyframe.storage import fresh_path, stage

WEIGHTS = (1, 2, 3)  # of the sources in order, repeating
MOST = 3
BLOCKS = 1024
SHARDS = 64
TRIALS = 64  # random orders of a source's blocks, of which the nearest to the target counts
SEED = 17
PIECE_BYTES = 128 << 20  # of text, sorted by one task
LEAST_PIECES = 4  # of a shard, so that tasks are even
OWN = ("mix_order", "mix_block", "copies", "shard", "piece", "place")


def targets(sizes: list[int], weights: Iterable[float], most: int = MOST) -> list[float]:
    """The total shared by weight, none above ``most`` times its size; the excess is shared again until none is."""
    weights = list(weights)
    left, open_ = float(sum(sizes)), [k for k, s in enumerate(sizes) if s]
    found = [0.0] * len(sizes)
    while open_:
        total = sum(weights[k] for k in open_)
        full = [k for k in open_ if left * weights[k] / total >= most * sizes[k]]
        if not full:
            for k in open_:
                found[k] = left * weights[k] / total
            break
        for k in full:
            found[k] = float(most * sizes[k])
        left -= sum(found[k] for k in full)
        open_ = [k for k in open_ if k not in set(full)]
    return found


def split(quotas: np.ndarray, shards: int, seed: int = SEED) -> np.ndarray:
    """(shards, sources): how many blocks of each source each shard holds; shards differ by one block at most."""
    out = np.zeros((shards, len(quotas)), np.int64)
    total = int(quotas.sum())
    room = np.full(shards, total // shards)
    room[: total % shards] += 1

    def divide(low: int, high: int, left: np.ndarray) -> None:
        if high - low == 1:
            out[low] = left
            return
        middle = (low + high) // 2
        rng = np.random.default_rng((seed, low, high))
        drawn = rng.multivariate_hypergeometric(left, int(room[low:middle].sum()), method="marginals")
        divide(low, middle, drawn)
        divide(middle, high, left - drawn)

    if len(quotas):
        divide(0, shards, quotas.astype(np.int64))
    return out


def chosen_blocks(sizes: np.ndarray, target: float, rng: np.random.Generator) -> np.ndarray:
    """How often each block is taken."""
    total = int(sizes.sum())
    if not total or target <= 0:
        return np.zeros(len(sizes), np.int64)
    whole = int(target // total)
    wanted = target - whole * total
    best, gap = np.zeros(len(sizes), np.int64), wanted
    values = sizes.tolist()
    for _ in range(TRIALS if whole < MOST else 0):
        left, more = wanted, np.zeros(len(sizes), np.int64)
        for k in rng.permutation(len(sizes)).tolist():
            if values[k] and values[k] <= left:
                more[k] = 1
                left -= values[k]
        rest = np.flatnonzero((more == 0) & (sizes > 0))
        if len(rest) and sizes[rest].min() - left < left:
            least = rest[np.argmin(sizes[rest])]
            more[least] = 1
            left = sizes[least] - left
        if left < gap:
            best, gap = more, left
    return best + whole


class Mixture:
    def __init__(
        self, docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED
    ):
        if clash := set(docs.columns) & set(OWN):
            raise ValueError(f"columns {sorted(clash)} are there already")
        self.shards, self.seed = shards, seed
        self._spark = docs.sparkSession
        size = F.coalesce(F.regexp_count("text", F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")
        order = F.xxhash64(F.lit(seed), "doc_id", "text")
        self._columns = docs.columns
        self._keyed = docs.withColumn("mix_order", order).withColumn("mix_block", F.pmod("mix_order", F.lit(blocks)).cast("int"))
        length = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
        sized = self._keyed.select("doc_id", "source", "mix_order", "mix_block", size.alias("size"), length.alias("bytes"))
        self.sizes = stage(sized, "sizes")
        dealt = self.sizes.groupBy("source", "mix_block").agg(F.sum("size").alias("block_size"), F.sum("bytes").alias("bytes"))
        self._blocks = stage(dealt, "blocks")
        totals = self._blocks.groupBy("source").agg(F.sum("block_size").alias("size"), F.sum("bytes").alias("bytes")).collect()
        totals.sort(key=lambda r: (r.source is None, r.source or ""))
        self.pieces = max(LEAST_PIECES, -(-sum(r.bytes for r in totals) // (shards * PIECE_BYTES)))
        wanted = targets([r.size for r in totals], [weights[k % len(weights)] for k in range(len(totals))])
        self.sources = [(r.source, r.size, t) for r, t in zip(totals, wanted, strict=True)]
        self._numbers = self._table(
            source_size=pa.array([size for _, size, _ in self.sources], pa.int64()),
            target=pa.array([target for _, _, target in self.sources], pa.float64()),
        )
        self.copies = stage(self._placed(), "copies")

    def _table(self, **columns: pa.Array) -> DataFrame:
        """A row for each source: its name, its number and ``columns``."""
        names = pa.array([source for source, _, _ in self.sources], pa.string())
        numbers = pa.array(range(len(names)), pa.int32())
        return self._spark.createDataFrame(pa.table({"source": names, "source_no": numbers, **columns}))

    def _named(self, rows: DataFrame) -> DataFrame:
        """With the source's number, size and target."""
        numbers = self._numbers.withColumnRenamed("source", "named")
        return rows.join(numbers, F.col("source").eqNullSafe(F.col("named"))).drop("named")

    def _placed(self) -> DataFrame:
        """(source, mix_block, copy, shard): every block in the run of a shard, once for each time."""
        seed = self.seed

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("mix_block")
            number = int(pdf.source_no.iloc[0])
            rng = np.random.default_rng((seed, number))
            taken = chosen_blocks(pdf.block_size.to_numpy(), float(pdf.target.iloc[0]), rng)
            out = pdf.loc[pdf.index.repeat(taken), ["source_no", "mix_block"]]
            out["copy"] = out.groupby("mix_block").cumcount().astype("int32")
            out["place"] = np.random.default_rng((seed, number, 1)).permutation(len(out))
            return out

        # a source has BLOCKS rows here, however large it is
        named = self._named(self._blocks)
        chosen = stage(named.groupBy("source_no").applyInPandas(choose, "source_no int, mix_block int, copy int, place long"), "chosen")
        quotas = np.zeros(len(self.sources), np.int64)
        for row in chosen.groupBy("source_no").count().collect():
            quotas[row.source_no] = row["count"]
        ends = split(quotas, self.shards, self.seed).cumsum(axis=0)
        runs = self._table(ends=pa.array(ends.T.tolist(), pa.list_(pa.int64())))
        # without Python: a udf in a column that is also filtered by would run twice, in two workers of a task
        shard = F.size(F.filter("ends", lambda end: end <= F.col("place"))).alias("shard")
        dealt = chosen.join(runs, "source_no").select("source", "mix_block", "copy", shard)
        return dealt.where(F.col("shard") < self.shards)

    def _with_copies(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``copies``, the (copy, shard) pairs of each row's block; null where nothing is taken."""
        copies = self.copies.groupBy(F.col("source").alias("named"), F.col("mix_block").alias("named_block")).agg(
            F.collect_list(F.struct("copy", "shard")).alias("copies")
        )
        same = F.col("source").eqNullSafe(F.col("named")) & (F.col("mix_block") == F.col("named_block"))
        return rows.join(copies, same, "left").drop("named", "named_block")

    def _in_order(self, *more: str) -> DataFrame:
        """The mix with ``shard``, ``piece`` and ``more``, sorted by task; a piece is in one task."""
        placed = self._with_copies(self._keyed).select(*self._columns, "mix_order", F.explode("copies").alias("c"))
        order = F.xxhash64(F.lit(self.seed + 1), "c.shard", "c.copy", "mix_order")
        piece = F.pmod(order, F.lit(self.pieces)).cast("int").alias("piece")
        dealt = placed.select(*self._columns, *more, "c.shard", piece, order.alias("place"))
        return dealt.repartition(self.shards * self.pieces, "shard", "piece").sortWithinPartitions("shard", "piece", "place")

    def rows(self) -> DataFrame:
        """The mix: rows of the documents, repeated as often as they are taken, by shard and in random order there."""
        return self._in_order().drop("piece", "place")

    def written(self, path: str | None = None) -> DataFrame:
        """The mix written by shard: rows of the documents with ``shard`` and ``position``, from 0 in each shard."""
        spark = self._spark
        path = path or fresh_path(spark, "mix")
        rows = self._in_order("mix_order").withColumn("place", F.monotonically_increasing_id())
        rows.write.partitionBy("shard").parquet(path)
        found = spark.read.schema(rows.schema).parquet(path)
        pieces = found.groupBy("shard", "piece").agg(F.min("place").alias("first"), F.count("*").alias("rows"))
        before = Window.partitionBy("shard").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
        starts = pieces.select("shard", "piece", (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("start"))
        position = (F.col("place") + F.col("start")).alias("position")
        return found.join(starts, ["shard", "piece"]).select(*self._columns, "mix_order", "shard", position)

    def documents(self) -> DataFrame:
        """(doc_id, size, source_size, target, taken, places) of every document, from the mix as it was written.

        ``places``: (shard, position) of each time that the mix holds it.
        """
        place = F.struct("shard", "position")
        mix = self.written().groupBy("mix_order", F.col("doc_id").alias("mixed_id"), F.col("source").alias("mixed_source")).agg(
            F.sort_array(F.collect_list(place)).alias("places")
        )
        # rows equal in id, text and source are one key here and stand in the mix equally often
        key = ["mix_order", "doc_id", "source"]
        keys = self.sizes.groupBy(*key, "size").agg(F.count("*").alias("rows"))
        same = (keys["mix_order"] == mix["mix_order"]) & F.col("doc_id").eqNullSafe(F.col("mixed_id"))
        met = keys.join(mix, same & F.col("source").eqNullSafe(F.col("mixed_source")), "left")
        places = F.coalesce("places", F.array().cast("array<struct<shard:int,position:bigint>>"))
        times = (F.size(places) / F.col("rows")).cast("long")
        found = met.select("doc_id", "source", "size", (F.col("size") * times).alias("taken"), places.alias("places"), "rows")
        every = found.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
        return self._named(every).select("doc_id", "size", "source_size", "target", "taken", "places")


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of the mix, with the columns of ``docs``."""
    return Mixture(docs).rows().select(*docs.columns)
