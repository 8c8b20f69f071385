"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts somewhere else.

Sorting every suffix of a large corpus against every other is not needed: two equal windows of ``LENGTH`` bytes have
the same smallest ``GRAM``-byte gram (by a rolling hash, the leftmost of equal ones) at the same place.  So:

1. Each text is cut into runs of windows that have one smallest gram, the anchor; about one anchor in 140 bytes.  The
   anchor's context is all that its windows cover, up to ``LENGTH - GRAM`` bytes to its left and ``LENGTH`` to its right.
   Rows (hash of the anchor, hash of the context, place) are shuffled by the anchor's hash and sorted.
2. Anchors that occur once are dropped in a streaming pass.  A context that occurs twice is repeated as a whole.
3. What is left are the edges of repeats: anchors with several contexts.  One text of each such context is fetched, and
   these are suffix-sorted: the suffixes that start at the anchors, and backwards those that end there.  Prefix
   polynomial hashes and a binary search find the common extension of two suffixes, so a comparison in the
   mergesort takes a logarithmic number of steps.  The common extensions of sorted neighbours are verified byte by
   byte; if one proves wrong, the suffixes are sorted by their bytes.
4. Two windows ``d`` bytes left of their anchors are equal if their suffixes share ``LENGTH - d`` bytes to the right
   and ``d`` to the left, which runs of the two sorted orders tell for all contexts together.

Edges of one anchor meet in one task, each different context once, at most ``2 * LENGTH`` bytes of it, if there are at
most ``_CONTEXTS`` of them.  An anchor with more contexts is split: the windows that start ``lo`` to ``hi`` bytes left of it
can only be equal where contexts share ``lo`` bytes to the left and ``LENGTH - hi`` to the right, so contexts are grouped
by a hash of these, no task holding a group.  Contexts that also share ``hi`` bytes to the left and ``LENGTH - lo`` to the
right have all these windows in common and are done; one of them goes on for the sake of the others, with those of its
group, and ``lo .. hi`` is halved until each group is one context.

Defined cases: null texts are empty; texts shorter than ``LENGTH`` lose nothing; equal rows are repeats of each other;
rows are told apart by id and text, so null and repeated ids do no harm.  Matches never cross documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.llm.text import mixed, powers, utf8
from levyframe.storage import stage

LENGTH = 400
GRAM = 128
_TABLE = 1 << 16
_STEP = 1 << 22  # bytes of a text that are hashed at a time
_PLACE_BITS = 23
_CONTEXTS = 8192  # of an anchor that are suffix-sorted in one task
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = mixed(np.arange(256, dtype=np.uint64))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by running minima forwards and backwards in blocks of that width."""
    n = len(values) - width + 1
    blocks = -(-len(values) // width)
    filled = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    filled[: len(values)] = values
    grid = filled.reshape(blocks, width)
    forwards = np.minimum.accumulate(grid, axis=1).ravel()
    backwards = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backwards[:n], forwards[width - 1 : width - 1 + n])


class Anchors:
    """Cuts texts into runs of windows that share their smallest gram."""

    def __init__(self, length: int = LENGTH, gram: int = GRAM):
        self.length, self.gram = length, gram
        self._up, self._down = powers(_BASE, _TABLE), powers(_INVERSE, _TABLE)

    def of(self, text: bytes) -> Iterator[tuple[np.ndarray, ...]]:
        """(anchor hash, anchor place, first window, last window), a part of a long text at a time."""
        length, gram = self.length, self.gram
        for start in range(0, max(1, len(text) - length + 1), _STEP):
            data = np.frombuffer(text, np.uint8)[start : start + _STEP + length - 1]
            n = len(data)
            if n < length:
                return
            up, down = (self._up, self._down) if n <= _TABLE else (powers(_BASE, n), powers(_INVERSE, n))
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
            count = n - gram + 1
            hashes = mixed((sums[gram:] - sums[:-gram]) * down[:count])
            places = np.arange(count, dtype=np.uint64)
            packed = (hashes & ~np.uint64((1 << _PLACE_BITS) - 1)) | places
            least = _sliding_least(packed, length - gram + 1) & np.uint64((1 << _PLACE_BITS) - 1)
            first = np.flatnonzero(np.diff(least, prepend=np.uint64(1 << 40)))
            last = np.append(first[1:] - 1, len(least) - 1)
            at = least[first].astype(np.int64)
            yield hashes[at].view(np.int64), at + start, first + start, last + start


def _places(length: int, gram: int):
    schema = pa.schema([("anchor", pa.int64()), ("context", pa.int64()), ("row_key", pa.int64()), ("at", pa.int64()),
                        ("first", pa.int64()), ("last", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Anchors(length, gram)
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            held = 0
            for key, text in zip(batch.column("row_key").to_pylist(), utf8(batch.column("text")), strict=True):
                if len(text) < length:
                    continue
                for hashes, at, first, last in cutter.of(text):
                    contexts = [
                        int.from_bytes(blake2b(text[f : e + length] + (a - f).to_bytes(8, "little"), digest_size=8).digest(), "little", signed=True)
                        for a, f, e in zip(at.tolist(), first.tolist(), last.tolist(), strict=True)
                    ]
                    for x, values in zip(rows, (hashes, contexts, np.full(len(at), key), at, first, last), strict=True):
                        x.append(values)
                    held += len(at)
                    if held > 1 << 17:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in rows], schema=schema)
                        rows, held = [[] for _ in schema], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in rows], schema=schema)

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (anchor, context): those of anchors that occur twice, with whether their context does
    (``whole``) and whether they are the first of it (``one``)."""
    names = ["anchor", "context", "row_key", "at", "first", "last"]
    held = np.empty((8, 0), np.int64)  # the row before, whether the row before it has its anchor, and its context
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([batch.column(c).to_numpy() for c in names])
        rows = np.concatenate([rows, np.zeros((2, rows.shape[1]), np.int64)])
        rows = np.concatenate([held, rows], axis=1)
        anchor = rows[0][1:] == rows[0][:-1]
        rows[6, 1:] = anchor
        rows[7, 1:] = anchor & (rows[1][1:] == rows[1][:-1])
        yield from _flagged(rows[:, :-1], anchor, rows[7, 1:].astype(bool), names)
        held = rows[:, -1:]
    if held.shape[1]:
        yield from _flagged(held, np.zeros(1, bool), np.zeros(1, bool), names)


def _flagged(rows: np.ndarray, anchor_goes_on: np.ndarray, context_goes_on: np.ndarray, names: list[str]) -> Iterator[pa.RecordBatch]:
    keep = (rows[6] > 0) | anchor_goes_on
    if keep.any():
        whole, one = (rows[7] > 0) | context_goes_on, rows[7] == 0
        columns = [pa.array(x[keep]) for x in rows[:6]]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(whole[keep]), pa.array(one[keep])], [*names, "whole", "one"])


class Suffixes:
    """Byte strings in a table, with prefix hashes; sorted by comparisons of common extensions."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.array([len(s) for s in strings], np.int64)
        self.width = int(self.lengths.max(initial=0))
        self.data = np.zeros((len(strings), self.width + 1), np.uint8)
        for row, s in zip(self.data, strings, strict=True):
            row[: len(s)] = np.frombuffer(s, np.uint8)
        self.hashes = np.zeros((len(strings), self.width + 1), np.uint64)
        for k in range(self.width):
            self.hashes[:, k + 1] = self.hashes[:, k] * _BASE + _BYTES[self.data[:, k]]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many first bytes strings ``a`` and ``b`` share, by binary search over hashes of their beginnings."""
        low = np.zeros(len(a), np.int64)
        high = np.minimum(self.lengths[a], self.lengths[b])
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            same = self.hashes[a, middle] == self.hashes[b, middle]
            low = np.where(open_ & same, middle, low)
            high = np.where(open_ & ~same, middle - 1, high)
        return low

    def before(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether string ``a`` sorts before ``b``; equal strings keep the order of their numbers."""
        common = self.extension(a, b)
        ends_a, ends_b = common == self.lengths[a], common == self.lengths[b]
        smaller = self.data[a, common] < self.data[b, common]
        return np.where(ends_a & ends_b, a < b, np.where(ends_a, True, np.where(ends_b, False, smaller)))

    def order(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted numbers, bytes shared with the one before)."""
        n = len(self.lengths)
        order = np.arange(n)
        width = 1
        while width < n:
            # merge runs two by two: an element's place is its own plus the number of smaller ones in the other run
            at = np.arange(n)
            run = at // width
            other = run ^ 1
            low, high = np.minimum(other * width, n), np.minimum((other + 1) * width, n)
            start = low.copy()
            while (open_ := low < high).any():
                some = np.flatnonzero(open_)
                middle = (low[some] + high[some]) // 2
                less = self.before(order[middle], order[some])
                low[some] = np.where(less, middle + 1, low[some])
                high[some] = np.where(less, high[some], middle)
            place = (run & ~1) * width + (at - run * width) + (low - start)
            merged = np.empty(n, np.int64)
            merged[place] = order
            order = merged
            width *= 2
        shared = np.zeros(n, np.int64)
        if n > 1:
            shared[1:] = self.extension(order[1:], order[:-1])
            if not self._verified(order, shared):
                order, shared = self._by_bytes()
        return order, shared

    def _verified(self, order: np.ndarray, shared: np.ndarray) -> bool:
        """Whether neighbours share just the bytes that the hashes say, and stand in order."""
        one, other = order[:-1], order[1:]
        same = self.data[one] == self.data[other]
        reach = np.where(same.all(axis=1), self.width + 1, same.argmin(axis=1))
        least = np.minimum(self.lengths[one], self.lengths[other])
        right = np.minimum(reach, least) == shared[1:]
        return bool(right.all() and self.before(one, other).all())

    def _by_bytes(self) -> tuple[np.ndarray, np.ndarray]:
        strings = [row[:n].tobytes() for row, n in zip(self.data, self.lengths, strict=True)]
        order = np.array(sorted(range(len(strings)), key=strings.__getitem__), np.int64)
        shared = np.zeros(len(order), np.int64)
        for k in range(1, len(order)):
            a, b = self.data[order[k - 1]], self.data[order[k]]
            least = min(self.lengths[order[k - 1]], self.lengths[order[k]])
            differ = np.flatnonzero(a[:least] != b[:least])
            shared[k] = differ[0] if len(differ) else least
        return order, shared


def repeated_windows(contexts: list[bytes], before: np.ndarray, last: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows of different contexts are equal to another's: rows of contexts, columns of bytes left of the anchor.

    A context's anchor is ``before`` bytes behind its start; its windows start up to ``last`` bytes behind its start.
    """
    n = len(contexts)
    right = Suffixes([c[b:] for c, b in zip(contexts, before.tolist(), strict=True)])
    left = Suffixes([c[:b][::-1] for c, b in zip(contexts, before.tolist(), strict=True)])
    ranks = []
    for side in (right, left):
        order, shared = side.order()
        rank = np.empty(n, np.int64)
        rank[order] = np.arange(n)
        ranks.append((rank, shared))
    least, most = before - last, before
    out = np.zeros((n, int(most.max(initial=0)) + 1), bool)
    for d in range(out.shape[1]):
        rows = np.flatnonzero((least <= d) & (d <= most))
        if len(rows) < 2:
            continue
        groups = [np.cumsum(shared < need)[rank[rows]] for (rank, shared), need in zip(ranks, (length - d, d), strict=True)]
        key = groups[0] * (n + 1) + groups[1]
        _, where, times = np.unique(key, return_inverse=True, return_counts=True)
        out[rows, d] = times[where] > 1
    return out


_SPANS = "row_key long, start long, end long"


def _edges(length: int):
    """Spans of contexts that occur once, from rows sorted by anchor."""

    def spans(rows: list[tuple]) -> pa.RecordBatch:
        before = np.array([r[3] - r[4] for r in rows], np.int64)
        last = np.array([r[5] - r[4] for r in rows], np.int64)
        found = repeated_windows([r[1] for r in rows], before, last, length)
        out: tuple[list, list, list] = ([], [], [])
        for row, hits in zip(rows, found, strict=True):
            if row[6] or not hits.any():
                continue
            ends = np.flatnonzero(np.diff(np.concatenate([[0], hits.view(np.int8), [0]])))
            for low, high in ends.reshape(-1, 2).tolist():  # windows low .. high - 1 bytes left of the anchor
                for x, value in zip(out, (row[2], row[3] - high + 1, row[3] - low + length), strict=True):
                    x.append(value)
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["row_key", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        names = ("anchor", "bytes", "row_key", "at", "first", "last", "whole")
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if len(rows) >= _CONTEXTS and row[0] != rows[-1][0]:
                    yield spans(rows)
                    rows = []
                rows.append(row)
        if rows:
            yield spans(rows)

    return run


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["anchor", "bytes", "row_key", "at", "first", "last", "whole"]
        kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for key, text, wanted in zip(batch.column("row_key").to_pylist(), utf8(batch.column("text")), batch.column("wanted").to_pylist(), strict=True):
                for w in wanted:
                    row = (w["anchor"], text[w["first"] : w["last"] + length], key, w["at"], w["first"], w["last"], w["whole"])
                    for x, value in zip(out, row, strict=True):
                        x.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    return run


_CONTEXT = "anchor long, bytes binary, row_key long, at long, first long, last long, whole boolean"
_NODE = "node long, cover long, full boolean, row_key long, at long, first long, last long, lo int, hi int"


def _halves(length: int):
    """Contexts with a range of windows, ``lo`` to ``hi`` bytes left of the anchor: a row for each half that they have
    windows in, with a hash of what equal windows in it must share (``node``), and of all that it covers (``cover``;
    not ``full`` where the context does not reach that far)."""
    names = ["node", "cover", "full", "row_key", "at", "first", "last", "lo", "hi"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    columns = ("anchor", "bytes", "row_key", "at", "first", "last", "lo", "hi")

    def hashed(data: bytes, *numbers: int) -> int:
        salt = b"".join(x.to_bytes(8, "little", signed=True) for x in numbers)
        return int.from_bytes(blake2b(data + salt, digest_size=8).digest(), "little", signed=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for anchor, data, key, at, first, last, low, high in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                middle, before = (low + high) // 2, at - first
                for lo, hi in ((low, middle), (middle + 1, high)):
                    if lo > hi or hi < at - last or before < lo:
                        continue
                    full = at - last <= lo and hi <= before
                    node = hashed(data[before - lo : before + length - hi], anchor, lo, hi)
                    cover = hashed(data[before - hi : before + length - lo] if full else data, before if not full else -1)
                    for x, value in zip(out, (node, cover, full, key, at, first, last, lo, hi), strict=True):
                        x.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names)

    return run


def _split_edges(contexts: DataFrame, length: int, gram: int) -> list[DataFrame]:
    """Spans of repeats among contexts (a staged table), however many have one anchor."""
    out = []
    rows = contexts.withColumns({"lo": F.lit(0), "hi": F.lit(length - gram)})
    while True:
        nodes = stage(rows.drop("whole").mapInArrow(_halves(length), _NODE), "nodes")
        one = F.struct("row_key", "at", "lo", "hi")
        covers = stage(nodes.groupBy("node", "cover", "full").agg(F.count("*").alias("n"), F.min(one).alias("one")), "covers")
        same = covers.where("full and n > 1").select("node", "cover")
        equal = nodes.where("full").join(same, ["node", "cover"], "left_semi")
        out.append(equal.select("row_key", (F.col("at") - F.col("hi")).alias("start"), (F.col("at") - F.col("lo") + length).alias("end")))
        several = covers.groupBy("node").agg(F.count("*").alias("covers")).where("covers > 1").select("node")
        left = stage(covers.where("one.lo < one.hi").join(several, "node", "left_semi").select("one.*"), "left")
        if left.isEmpty():
            return out
        rows = left.join(contexts, ["row_key", "at"]).select(*contexts.columns, "lo", "hi")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``doc_id``, ``text`` and ``spans``, the byte ranges to remove (null: none), of every row."""
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("row_key", F.xxhash64("doc_id", "text"))
    kinds = "anchor long, context long, row_key long, at long, first long, last long"
    places = keyed.select("row_key", "text").mapInArrow(_places(length, gram), kinds)
    ordered = places.repartition("anchor").sortWithinPartitions("anchor", "context")
    met = stage(ordered.mapInArrow(_repeated, f"{kinds}, whole boolean, one boolean"), "repeated")
    several = stage(met.where("one").groupBy("anchor").agg(F.count("*").alias("contexts")).where("contexts > 1"), "several")
    wanted = met.where("one").join(several.select("anchor"), "anchor", "left_semi")
    asked = wanted.groupBy("row_key").agg(F.collect_list(F.struct("anchor", "at", "first", "last", "whole")).alias("wanted"))
    # of equal rows one is enough, which sorting by the anchor and its place leaves side by side
    contexts = keyed.select("row_key", "text").join(asked, "row_key").mapInArrow(_cut(length), _CONTEXT)
    many = several.where(F.col("contexts") > _CONTEXTS).select("anchor")
    split: list[DataFrame] = []
    if not many.isEmpty():
        contexts = stage(contexts, "contexts")
        split = _split_edges(stage(contexts.join(many, "anchor", "left_semi"), "split"), length, gram)
        contexts = contexts.join(many, "anchor", "left_anti")
    once = contexts.repartition("anchor").sortWithinPartitions("anchor", "row_key", "at").mapInArrow(_edges(length), _SPANS)
    for found in split:
        once = once.union(found)
    covered = met.where("whole").select("row_key", F.col("first").alias("start"), (F.col("last") + length).alias("end"))
    spans = covered.union(once).groupBy("row_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))
    return keyed.join(stage(spans, "spans"), "row_key", "left").select("doc_id", "text", "spans")


_RESULT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("n_bytes", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("n_spans", T.LongType()),
        T.StructField("kept_sha256", T.StringType()),
    ]
)


def span_digests(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of ``repeated_spans``."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [])
            for text, spans in zip(utf8(batch.column("text")), batch.column("spans").to_pylist(), strict=True):
                runs = merged([(s["start"], s["end"]) for s in spans or ()])
                kept, at = sha256(), 0
                for start, end in runs:
                    kept.update(text[at:start])
                    at = end
                kept.update(text[at:])
                for x, value in zip(rows, (len(text), sum(e - s for s, e in runs), len(runs), kept.hexdigest()), strict=True):
                    x.append(value)
            columns = [batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(rows, kinds, strict=True))]
            yield pa.RecordBatch.from_arrays(columns, _RESULT.names)

    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "spans").mapInArrow(run, _RESULT)
