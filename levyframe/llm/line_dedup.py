"""Line dedup by a segment-partition edit join.

Two lines are near copies when at most ``distance`` insertions, deletions or substitutions of characters turn one into
the other.  A line is cut into ``distance + 1`` segments; if another line is that near, one of them stands in it
unchanged, at a place that can differ by little.  So each line is put into lists by its segments (with its length and
the segment's number), and looked for in the lists of lines of the same or a slightly smaller length, by the few
substrings whose places the other edits allow.  Lines that meet in a list are verified by a banded bit-parallel edit
distance.

Only the hashes of segments and substrings are shuffled, and lists of one line alone fall out in a streaming pass.
Groups of near copies are joined as in ``ngram_join``: first neighbours in the lists, then, exactly, every pair of lines
of different components that is left; a histogram of characters is compared within that join.

Lines are cut at line feeds; white space at their ends does not count for the comparison, and lines shorter than
``min_chars`` are not judged and stay.  Of lines that are connected by links the first stays, by (doc_id, line number);
equal lines are one class from the start, however many they are.

Defined cases: a null text stays null, an empty one empty; rows without a ``doc_id`` stay as they are and take no part;
rows with one ``doc_id`` are one document and lose the same lines; extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.llm.candidate_lists import POSTING, SHARED, apart, marked, nearest, shared_rows
from levyframe.llm.components import components
from levyframe.storage import stage

DISTANCE = 2
MIN_CHARS = 20
_SEEN = 1 << 18
_ROWS = 1 << 17

# the histogram's class of a byte: characters count once, by their first byte; 8: not counted
_CLASS = np.array([8 if 128 <= b < 192 else (b * 37 >> 2) % 8 for b in range(256)], np.uint8)


def line_key(line: str) -> int:
    value = xxhash.xxh3_64_intdigest(line.encode())
    return value - (1 << 64) if value >> 63 else value


def _histogram(line: str) -> int:
    counts = np.bincount(_CLASS[np.frombuffer(line.encode(), np.uint8)], minlength=9)[:8].astype(np.uint8)
    return int.from_bytes(counts.tobytes(), "little", signed=True)


def _segments(length: int, pieces: int) -> list[tuple[int, int]]:
    """(start, size) of segments of nearly one size, the longer ones last."""
    size, longer = divmod(length, pieces)
    out, start = [], 0
    for k in range(pieces):
        here = size + (k >= pieces - longer)
        out.append((start, here))
        start += here
    return out


def tokens_of(line: str, distance: int, min_chars: int) -> tuple[list[int], list[int]]:
    """Tokens of a line's own segments, and of the substrings that can be segments of a line as long or shorter."""
    pieces, length = distance + 1, len(line)
    hashed = xxhash.xxh3_64_intdigest
    own: list[int] = []
    other: list[int] = []
    for less in range(distance + 1):
        of = length - less
        if of < max(min_chars, pieces):
            break
        for k, (start, size) in enumerate(_segments(of, pieces)):
            low = max(0, start - k, start + less - (distance - k))
            high = min(length - size, start + k, start + less + (distance - k))
            for at in range(low, high + 1):
                token = hashed(line[at : at + size].encode(), of * pieces + k)
                (own if not less and at == start else other).append(token)
    return own, other


def _common(most: int, same: Callable[[int], bool]) -> int:
    """The largest length that is the same in both."""
    low = 0
    while low < most:
        middle = (low + most + 1) // 2
        if same(middle):
            low = middle
        else:
            most = middle - 1
    return low


def edit_distance_within(one: str, other: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``: bit-parallel columns of a band of ``2 * most + 1`` diagonals."""
    if one == other:
        return True
    if len(one) > len(other):
        one, other = other, one
    if len(other) - len(one) > most:
        return False
    start = _common(len(one), lambda k: one[:k] == other[:k])
    one, other = one[start:], other[start:]
    k = _common(len(one), lambda k: one[len(one) - k :] == other[len(other) - k :])
    # a common end keeps the pattern longer than the band is wide
    tail = "\0" * (most + 1)
    one, other = one[: len(one) - k] + tail, other[: len(other) - k] + tail
    m, n = len(one), len(other)
    width = 2 * most + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    vertical_up, vertical_down = full & ~((1 << most) - 1), 0
    score, limit = most, most + (n - (m - most))
    row = top >> 1
    for j, char in enumerate(other):
        window = 0  # bit b: the pattern's row j - most + b + 1 has this character
        for b in range(max(0, most - j), min(width, m + most - j)):
            if one[j - most + b] == char:
                window |= 1 << b
        diagonal = (((window & vertical_up) + vertical_up) ^ vertical_up | window | vertical_down) & full
        up = (vertical_down | ~(diagonal | vertical_up)) & full
        down = diagonal & vertical_up
        if j < m - most:
            score += not diagonal & top
        else:
            score += bool(up & row) - bool(down & row)
            row >>= 1
        if score > limit:
            return False
        shifted = diagonal >> 1
        vertical_up = (down | ~(shifted | up)) & full
        vertical_down = shifted & up
    return score <= most


_LINES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("key", T.LongType()),
        T.StructField("histogram", T.LongType()),
    ]
)


def _judged(text: str | None, min_chars: int) -> Iterator[tuple[int, str]]:
    for number, line in enumerate((text or "").split("\n")):
        line = line.strip()
        if len(line) >= min_chars:
            yield number, line


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, numbers, keys, histograms = [], [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for number, line in _judged(text, min_chars):
                    ids.append(doc_id)
                    numbers.append(number)
                    keys.append(line_key(line))
                    histograms.append(_histogram(line))
            columns = [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(keys, pa.int64()),
                       pa.array(histograms, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, _LINES.names)

    return run


def _tokens(distance: int, min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # only saves work: repeated lines are told apart by their key later as well
        rows: tuple[list, ...] = ([], [], [], [])

        def made() -> pa.RecordBatch:
            tokens = pa.array(np.array(rows[0], np.uint64).view(np.int64))
            out = [tokens, *(pa.array(x, t) for x, t in zip(rows[1:], (pa.int32(), pa.int32(), pa.int64()), strict=True))]
            for x in rows:
                x.clear()
            return pa.RecordBatch.from_arrays(out, ["token", "n", "pos", "key"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for _, line in _judged(text, min_chars):
                    key = line_key(line)
                    if key in seen:
                        continue
                    if len(seen) >= _SEEN:
                        seen.clear()
                    seen.add(key)
                    own, other = tokens_of(line, distance, min_chars)
                    n = len(own) + len(other)
                    for x, values in zip(rows, (own + other, [len(line)] * n, [0] * len(own) + [1] * len(other), [key] * n), strict=True):
                        x.extend(values)
                if len(rows[0]) >= _ROWS:
                    yield made()
        if rows[0]:
            yield made()

    return run


def _texts(min_chars: int, marks):
    """Lines whose key may be wanted: most others need not be shuffled to find out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = marks.value
        for batch in batches:
            lines = {}
            for text in batch.column("text").to_pylist():
                for _, line in _judged(text, min_chars):
                    key = line_key(line)
                    if wanted[key % len(wanted)]:
                        lines[key] = line
            columns = [pa.array(lines.keys(), pa.int64()), pa.array(lines.values(), pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["key", "line"])

    return run


def _verifier(distance: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("x_line").to_pylist(), batch.column("y_line").to_pylist(), strict=True)
            keep = pa.array([edit_distance_within(a, b, distance) for a, b in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], ["x", "y"]).filter(keep)

    return run


class LineJoin:
    """Near copies among the lines of a table."""

    def __init__(self, docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS):
        self.distance = distance
        docs = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.lines = stage(docs.mapInArrow(_lines(min_chars), _LINES), "lines")
        texts = docs.select("text")
        tokens = texts.mapInArrow(_tokens(distance, min_chars), POSTING)
        ordered = tokens.repartition("token").sortWithinPartitions("token", "n", "key", "pos")
        shared = ordered.mapInArrow(shared_rows, SHARED)
        postings = stage(shared.drop("previous"), "postings")
        keys = stage(postings.select("key").distinct(), "keys")
        histograms = self.lines.join(keys, "key", "left_semi").groupBy("key").agg(F.first("histogram").alias("histogram"))
        self.postings = stage(postings.join(histograms, "key"), "postings")
        marks = docs.sparkSession.sparkContext.broadcast(marked(keys))
        found = texts.mapInArrow(_texts(min_chars, marks), "key long, line string").join(keys, "key", "left_semi")
        self.texts = stage(found.dropDuplicates(["key"]), "texts")

    def _verified(self, pairs: DataFrame) -> DataFrame:
        one = self.texts.select(F.col("key").alias("x"), F.col("line").alias("x_line"))
        other = self.texts.select(F.col("key").alias("y"), F.col("line").alias("y_line"))
        joined = pairs.join(one, "x").join(other, "y")
        return joined.select("x", "y", "x_line", "y_line").mapInArrow(_verifier(self.distance), "x long, y long")

    def _candidates(self, found: DataFrame | None) -> DataFrame:
        """Pairs of lines of two components that meet in a list and have room for a link."""
        rows = stage(apart(self.postings, found), "apart")
        lanes = []
        for k in range(0, 64, 8):
            apart_by = f"abs((shiftright(a.histogram, {k}) & 255) - (shiftright(b.histogram, {k}) & 255))"
            lanes.append(f"least({apart_by}, 256 - {apart_by})")  # counts are kept modulo 256
        alike = F.expr(f"{' + '.join(lanes)} <= {2 * self.distance}")
        order = F.expr("a.n < b.n or a.n = b.n and (b.pos = 1 or a.key < b.key)")
        near = F.expr(f"a.pos = 0 and b.n - a.n <= {self.distance} and a.key <> b.key")
        same = F.expr("a.token = b.token and a.component <> b.component")
        met = rows.alias("a").join(rows.alias("b"), same & near & order & alike)
        return met.select(F.col("a.key").alias("x"), F.col("b.key").alias("y")).distinct()

    def components(self, rounds: int = 2) -> DataFrame:
        """(node, root) of the keys of lines that link with other lines."""
        most = self.distance
        links = found = None
        for step in range(rounds + 1):
            if step < rounds:
                pairs = nearest(apart(self.postings, found), lambda n, _, m, __: abs(n - m) <= most)
            else:
                pairs = self._candidates(found)
            new = stage(self._verified(pairs), "pairs")
            links = new if links is None else links.union(new)
            found = components(links, "x", "y")
        return found

    def removed(self, rounds: int = 2) -> DataFrame:
        """(doc_id, gone): for each document that loses lines their numbers and keys."""
        found = self.components(rounds).select(F.col("node").alias("key"), "root")
        lines = self.lines.join(found, "key", "left").withColumn("root", F.coalesce("root", "key"))
        firsts = lines.groupBy("root").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("times"))
        repeated = lines.join(firsts.where("times > 1"), "root")
        # in the document that has a class' first line the others of the class go too
        place = F.struct("line_no", "key").alias("place")
        elsewhere = repeated.where("doc_id > first_doc").select("doc_id", place)
        at_home = repeated.where("doc_id = first_doc").groupBy("doc_id", "root").agg(
            F.min("line_no").alias("first_line"), F.collect_set(place).alias("places")
        )
        others = F.filter("places", lambda p: p["line_no"] > F.col("first_line"))
        inside = at_home.select("doc_id", F.explode(others).alias("place"))
        return elsewhere.union(inside).groupBy("doc_id").agg(F.collect_set("place").alias("gone"))


def _kept(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, judged, filled, lost = [], [], [], [], []
            for text, gone in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                lines = (text or "").split("\n") if text is not None else []
                drop = {(g["line_no"], g["key"]) for g in gone or ()}
                stays = [(k, len(line.strip()) >= min_chars, line) for k, line in enumerate(lines)]
                if drop:
                    stays = [x for x in stays if not (x[1] and (x[0], line_key(x[2].strip())) in drop)]
                texts.append(None if text is None else "\n".join(x[2] for x in stays))
                counts.append(len(lines))
                judged.append(sum(x[1] for x in stays))
                filled.append(sum(bool(x[2].strip()) for x in stays))
                lost.append(len(lines) - len(stays))
            new = {"kept_text": pa.array(texts, pa.string()), "n_lines": pa.array(counts, pa.int64()),
                   "n_judged_kept": pa.array(judged, pa.int64()), "n_filled_kept": pa.array(filled, pa.int64()), "n_removed": pa.array(lost, pa.int64())}
            names = [c for c in batch.schema.names if c != "gone"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *new.values()], [*names, *new])

    return run


def with_kept_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """All columns of ``docs`` with ``kept_text``, ``n_lines``, ``n_judged_kept`` (kept lines of ``min_chars`` or more),
    ``n_filled_kept`` (kept lines that are not blank) and ``n_removed``."""
    new = [T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()),
           T.StructField("n_judged_kept", T.LongType()), T.StructField("n_filled_kept", T.LongType()),
           T.StructField("n_removed", T.LongType())]
    if clash := {*(f.name for f in new), "gone"} & set(docs.columns):
        raise ValueError(f"columns {sorted(clash)} are there already")
    gone = LineJoin(docs.select("doc_id", "text"), distance, min_chars).removed()
    known = docs.where("doc_id is not null").join(gone, "doc_id", "left").select(*docs.columns, "gone")
    lone = docs.where("doc_id is null").withColumn("gone", F.lit(None).cast(gone.schema["gone"].dataType))
    schema = T.StructType([*docs.schema.fields, *new])
    return known.union(lone).mapInArrow(_kept(min_chars), schema)


def dedup_lines(docs: DataFrame, distance: int = DISTANCE, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``; a document goes when it lost lines and has none
    left that is not blank.  ``n_chars`` is counted anew where there is one."""
    kept = with_kept_lines(docs, distance, min_chars).where("n_removed = 0 or n_filled_kept > 0")
    out = kept.withColumn("text", F.col("kept_text"))
    if "n_chars" in docs.columns:
        count = F.when(F.col("n_removed") > 0, F.char_length("text")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", count.cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)
