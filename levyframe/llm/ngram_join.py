"""Set similarity join of documents on their word shingles: rare-first prefix filtering with length, positional and
suffix filters, joined on prefix shingles, each pair verified once.

Two documents link when the Jaccard similarity of their sets of five-word shingles is at least ``percent`` / 100.
What the join returns is connectivity, so it never lists the pairs of a group of copies:

1. One pass over the texts gives each document its set size, a key of the whole set, parities of the set over hash
   ranges, and, for the corpus, how often shingles occur (a table of ``SKETCH`` counters, whatever the corpus' size).
   Documents of one key are one class from here on.
2. A second pass orders each set rare-first by those counters (any common order is right; a rare-first one makes
   few candidates) and writes out the prefix: the first ``n - ceil(t n) + 1`` shingles with their positions.  They are
   shuffled by shingle and sorted by set size; prefix shingles of one class only are dropped in a streaming pass.
3. Every class takes its best neighbour (next smaller in some prefix shingle's list, by number of such shingles) and
   its commonest list head (the class of the list with the most shared shingles, as an original has among its copies);
   these pairs are verified on the texts, linked classes become one component.  A group of near copies collapses
   here, in pairs that grow with the number of documents, not with its square.
4. What remains is done exactly: shingle lists with two components or more are joined with themselves, under the
   length filter, the prefix of the smaller set (its indexing prefix is shorter), the positional filter and the suffix
   filter, a bound of the sets' difference by parities of ranges of hashes; matches of a pair are counted, the
   positional filter bounds the overlap by all of them once more, and the pairs left are verified, once each.

Defined cases: null and empty texts have no shingles and no links; fewer than five words are one shingle; rows of one
``doc_id`` are each judged by their own text and all get the smallest ``doc_id`` of what they reach; rows without a
``doc_id`` lend their text to no link and have a null component.  Shingles and keys are 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyframe.llm.candidate_lists import POSTING, SHARED, apart, marked, most_common_head, most_common_previous, shared_rows
from levyframe.llm.components import components
from levyframe.llm.text import SHINGLE_WORDS, Shingler, digest64, utf8
from levyframe.storage import stage

PERCENT = 80
SKETCH_BITS = 20  # counters of the frequency table: 2 ** 20, one byte each when broadcast
BLOCK_BITS = 16
LANE_BITS = 4  # the suffix filter has 2 ** 4 lanes of 64 ranges of hashes
_SALTS = 64


def _parities(values: np.ndarray) -> list[int]:
    """Bits that tell of each of ``64 * LANES`` ranges of hashes whether it holds an odd number of them."""
    odd = np.bincount((values >> np.uint64(64 - 6 - LANE_BITS)).astype(np.int64), minlength=64 << LANE_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def _measures(size: int):
    """Rows of documents, and at the end of a task rows of counters."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int32()), ("key", pa.int64()), ("parities", pa.list_(pa.int64())),
         ("block", pa.int32()), ("salt", pa.int32()), ("counts", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            sizes, keys, parities, met = [], [], [], []
            for values in shingler.many(utf8(batch.column("text"))):
                sizes.append(len(values))
                keys.append(digest64(values) if len(values) else None)
                parities.append(_parities(values))
                met.append((values >> np.uint64(64 - SKETCH_BITS)).astype(np.int64))
            if met:
                counts += np.bincount(np.concatenate(met), minlength=len(counts)).astype(np.uint32)
            n = batch.num_rows
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "n": sizes, "key": keys, "parities": parities,
                 "block": [None] * n, "salt": [None] * n, "counts": [None] * n}, schema=schema
            )
        salt = TaskContext.get().partitionId() % _SALTS
        for block, part in enumerate(counts.reshape(-1, 1 << BLOCK_BITS)):
            if part.any():
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": [None], "n": [None], "key": [None], "parities": [None],
                     "block": [block], "salt": [salt], "counts": [part.tobytes()]}, schema=schema
                )

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of counters; rows come sorted by block."""
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
    block, total = None, None
    for batch in batches:
        for here, counts in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            part = np.frombuffer(counts, np.uint32 if len(counts) == 4 << BLOCK_BITS else np.uint64).astype(np.uint64)
            if here == block:
                total += part
                continue
            if block is not None:
                yield pa.RecordBatch.from_pydict({"block": [block], "counts": [total.tobytes()]}, schema=schema)
            block, total = here, part
    if block is not None:
        yield pa.RecordBatch.from_pydict({"block": [block], "counts": [total.tobytes()]}, schema=schema)


def _frequencies(blocks: DataFrame) -> np.ndarray:
    """Each counter's logarithm in a byte; the driver sees one row per block, 2 ** SKETCH_BITS counters in all."""
    once = blocks.repartition("block", "salt").sortWithinPartitions("block").mapInArrow(_added, "block int, counts binary")
    twice = once.repartition("block").sortWithinPartitions("block").mapInArrow(_added, "block int, counts binary")
    found = np.zeros((1 << (SKETCH_BITS - BLOCK_BITS), 1 << BLOCK_BITS))
    for row in twice.toLocalIterator():
        found[row.block] = np.frombuffer(row.counts, np.uint64)
    return np.minimum(8 * np.log2(1 + found.ravel()), 255).astype(np.uint8)


def _prefixes(size: int, percent: int, frequencies):
    schema = pa.schema([("token", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        level = frequencies.value
        for batch in batches:
            tokens, sizes, places, keys = [], [], [], []
            for values in shingler.many(utf8(batch.column("text"))):
                n = len(values)
                if n:
                    length = n - (percent * n + 99) // 100 + 1
                    order = np.argsort(level[values >> np.uint64(64 - SKETCH_BITS)], kind="stable")[:length]
                    tokens.append(values[order].view(np.int64))
                    sizes.append(np.full(length, n, np.int32))
                    places.append(np.arange(length, dtype=np.int32))
                    keys.append(np.full(length, digest64(values), np.int64))
            if tokens:
                columns = [pa.array(np.concatenate(x)) for x in (tokens, sizes, places, keys)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _marked_rows(marks):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = marks.value
        for batch in batches:
            yield batch.filter(pa.array(wanted[batch.column("doc_id").to_numpy() % len(wanted)]))

    return run


def _verifier(size: int, percent: int):
    """Pairs whose texts are as alike as they must be; a text that is not of the pair's class, but of another row with
    the same id, counts for nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            keep = []
            sides = (shingler.many(utf8(batch.column(c))) for c in ("x_text", "y_text"))
            keys = (batch.column(c).to_pylist() for c in ("x", "y"))
            for a, b, x, y in zip(*sides, *keys, strict=True):
                if digest64(a) != x or digest64(b) != y:
                    keep.append(False)
                    continue
                both = np.concatenate([a, b])
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            pairs = pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"])
            yield pairs.filter(pa.array(keep, pa.bool_()))

    return run


class NgramJoin:
    """The join of one table: its classes, and the links between them that connect all that links connect."""

    def __init__(self, docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS):
        self.percent, self.size = percent, size
        docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        spark = docs.sparkSession
        kinds = "doc_id long, n int, key long, parities array<long>, block int, salt int, counts binary"
        measured = stage(docs.mapInArrow(_measures(size), kinds), "measured")
        self.measured = measured.where("block is null").select("doc_id", "n", "key", "parities")
        level = _frequencies(measured.where("block is not null").select("block", "salt", "counts"))
        frequencies = spark.sparkContext.broadcast(level)
        named = docs.where("doc_id is not null and text is not null")
        postings = named.select("text").mapInArrow(_prefixes(size, percent, frequencies), POSTING)
        ordered = postings.repartition("token").sortWithinPartitions("token", "n", "key")
        self.postings = stage(ordered.mapInArrow(shared_rows, SHARED), "postings")
        self.classes = stage(
            self.measured.where("doc_id is not null and key is not null")
            .groupBy("key")
            .agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parities").alias("parities")),
            "classes",
        )
        self.named = named.select("doc_id", "text")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of pairs (x, y) of classes those that link.  Texts are shuffled only of documents that a bitmap marks."""
        pairs = stage(self._suffix_filtered(pairs), "pairs")
        both = pairs.select(F.col("x_doc").alias("key")).union(pairs.select("y_doc"))
        marks = pairs.sparkSession.sparkContext.broadcast(marked(both))
        texts = self.named.mapInArrow(_marked_rows(marks), "doc_id long, text string")
        joined = pairs.join(texts.select(F.col("doc_id").alias("x_doc"), F.col("text").alias("x_text")), "x_doc").join(
            texts.select(F.col("doc_id").alias("y_doc"), F.col("text").alias("y_text")), "y_doc"
        )
        found = joined.select("x", "y", "x_text", "y_text").mapInArrow(_verifier(self.size, self.percent), "x long, y long")
        return found.distinct()

    def _room(self, x: str, y: str, lanes: int = 1 << LANE_BITS) -> str:
        """The suffix filter: two sets differ in a hash at least for each range that only one has an odd number of."""
        differ = " + ".join(f"bit_count({x}.parities[{k}] ^ {y}.parities[{k}])" for k in range(lanes))
        return f"{100 + self.percent} * ({differ}) <= {100 - self.percent} * ({x}.n + {y}.n)"

    def _suffix_filtered(self, pairs: DataFrame) -> DataFrame:
        """(x, y, x_doc, y_doc) of the pairs that the suffix filter leaves."""
        one = pairs.alias("p").join(self.classes.alias("x"), F.expr("p.x = x.key"))
        met = one.join(self.classes.alias("y"), F.expr(f"p.y = y.key and {self._room('x', 'y')}"))
        return met.select("p.x", "p.y", F.col("x.doc_id").alias("x_doc"), F.col("y.doc_id").alias("y_doc"))

    def _near(self) -> DataFrame:
        """For each class at most two candidates: the one before it, and the one at the head, in most of its lists."""
        shared = self.postings.groupBy("key").agg(F.count("*").alias("shared"))
        rows = self.postings.join(shared, "key").select("token", "key", "shared")
        return most_common_previous(self.postings).union(most_common_head(rows, "shared"))

    def _candidates(self, found: DataFrame) -> DataFrame:
        """Every pair of classes of two components that the filters leave."""
        half = 1 << (LANE_BITS - 1)
        folded = F.expr(f"transform(sequence(0, {half - 1}), k -> parities[k] ^ parities[k + {half}])")
        measures = self.classes.select("key", folded.alias("parities"))
        rows = apart(self.postings.select("token", "n", "pos", "key"), found, measures)
        p = self.percent
        a, b = rows.alias("a"), rows.alias("b")
        smaller = F.expr("a.n < b.n or a.n = b.n and a.key < b.key")
        length = F.expr(f"100 * a.n >= {p} * b.n")
        indexed = F.expr(f"a.pos <= a.n - ceil({2 * p} * a.n / {100 + p})")
        room = F.expr(f"{100 + p} * (least(a.pos, b.pos) + least(a.n - a.pos, b.n - b.pos)) >= {p} * (a.n + b.n)")
        same = F.expr("a.token = b.token and a.component <> b.component")
        met = a.join(b, same & smaller & length & indexed & room & F.expr(self._room("a", "b", half))).select(
            F.col("a.key").alias("x"), F.col("b.key").alias("y"), F.expr("a.n - 1 - a.pos").alias("x_rest"),
            F.expr("b.n - 1 - b.pos").alias("y_rest"), F.expr("a.n + b.n").alias("sizes"),
        )
        counted = met.groupBy("x", "y").agg(
            F.count("*").alias("met"), F.min("x_rest").alias("x_rest"), F.min("y_rest").alias("y_rest"),
            F.first("sizes").alias("sizes"),
        )
        return counted.where(f"{100 + p} * (met + least(x_rest, y_rest)) >= {p} * sizes").select("x", "y")

    def components(self) -> DataFrame:
        """(node, root) of classes that link with others."""
        links = stage(self.verified(self._near().distinct()), "links")
        found = components(links, "x", "y")
        rest = stage(self.verified(self._candidates(found)), "links")
        return components(links.union(rest), "x", "y")

    def documents(self) -> DataFrame:
        """(doc_id, n_shingles, component_id) of every row."""
        found = self.components().select(F.col("node").alias("key"), "root")
        rooted = self.classes.join(found, "key", "left").select("key", "doc_id", F.coalesce("root", "key").alias("root"))
        least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        labelled = rooted.join(least, "root").select("key", "component_id")
        n = F.col("n").cast("long").alias("n_shingles")
        filled = self.measured.where("key is not null and doc_id is not null").join(labelled, "key")
        alone = self.measured.where("key is null or doc_id is null")
        return filled.select("doc_id", n, "component_id").union(
            alone.select("doc_id", n, F.col("doc_id").alias("component_id"))
        )


def ngram_components(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    return NgramJoin(docs, percent, size).documents()


def one_of_each_group(docs: DataFrame, percent: int = PERCENT, size: int = SHINGLE_WORDS) -> DataFrame:
    """The rows of ``docs`` whose ``doc_id`` is the smallest of their group; of rows with one ``doc_id`` one stays.
    Rows without a ``doc_id`` and documents without words all stay."""
    groups = ngram_components(docs.select("doc_id", "text"), percent, size)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    stay = docs.where("doc_id is not null").join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.select(*docs.columns).union(docs.where("doc_id is null"))
