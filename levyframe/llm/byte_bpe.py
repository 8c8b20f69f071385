"""Byte-level BPE encoding and decoding with a rank queue under a hierarchical bitmap.

Every pre-token is merged by always taking its pair of the lowest rank, leftmost first.  Waiting pairs stand in one
bucket per rank, as positions in a linked list of tokens; a bitmap of 64-bit words, with a word above each 64 words,
tells which buckets are not empty, so find-first-set gives the next rank in a few steps.  An entry whose pair has
changed since it was queued is stale and skipped.  One queue serves many pre-tokens at a time: they do not touch each
other, so a popped bucket is merged as one array, in all of them at once.  A pre-token of n bytes takes O(n log n) steps
and O(n) memory, however long it is.

What stands between two single blanks always falls into the same pre-tokens, so its ids are remembered; a text with a
blank beside other white space is cut by the pattern as a whole.

Rows are encoded where they are read: no shuffle.  The vocabulary is a table of fixed size that travels as a broadcast.

Defined cases: a null or empty text has no ids; special tokens' strings are ordinary text; repeated rows and all other
columns are kept; an empty table gives an empty table.  A column named like an output is an error.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from hashlib import sha256
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Patterns that cut a text before each single blank and leave letters after it together; texts are cut there first.
CUT_AT_BLANKS = (public_tokenizers.PATTERN,)
_KEPT = 1 << 18  # chunks, and pre-tokens, remembered by a worker
_CHARS = 1 << 24  # of texts that are learnt from at a time: a rank waits once for all of them
_MERGED = 1 << 20  # bytes of pre-tokens that are merged at a time
_LONG = 64  # longer ones are not remembered


class RankQueue:
    """Arrays of positions by rank; ``pop`` gives the smallest rank that has any, and its positions."""

    def __init__(self, ranks: int):
        self._levels: list[list[int]] = []
        while True:
            ranks = (ranks + 63) >> 6
            self._levels.append([0] * max(ranks, 1))
            if ranks <= 1:
                break
        self._buckets: dict[int, list[np.ndarray]] = {}

    def __bool__(self) -> bool:
        return bool(self._buckets)

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self._buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self._buckets[rank] = [positions]
        for level in self._levels:
            word, bit = rank >> 6, 1 << (rank & 63)
            if level[word] & bit:
                break
            level[word] |= bit
            rank = word

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        starts = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for rank, start, end in zip(ranks[starts].tolist(), starts, [*starts[1:], len(ranks)], strict=True):
            self.push(rank, positions[start:end])

    def pop(self) -> tuple[int, np.ndarray]:
        rank = 0
        for level in reversed(self._levels):
            word = level[rank]
            rank = (rank << 6) + (word & -word).bit_length() - 1
        index = rank
        for level in self._levels:
            level[index >> 6] &= ~(1 << (index & 63))
            if level[index >> 6]:
                break
            index >>= 6
        bucket = self._buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class Strings:
    """Byte strings by number, joined by gathering their bytes."""

    def __init__(self, strings: list[bytes]):
        self._lengths = np.array([len(x) for x in strings], np.int64)
        self._starts = np.cumsum(self._lengths) - self._lengths
        self._data = np.frombuffer(b"".join(strings), np.uint8)

    def joined(self, numbers: np.ndarray) -> bytes:
        lengths = self._lengths[numbers]
        ends = np.cumsum(lengths)
        shift = self._starts[numbers] - (ends - lengths)
        return self._data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(shift, lengths)].tobytes()


class ByteBpe:
    """Encoder and decoder for ranks of byte strings; ids are ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self._size = max(ranks.values(), default=-1) + 1
        self._cut = regex.compile(pattern).findall
        self._at_blanks = pattern in CUT_AT_BLANKS
        self._bytes = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                left, right = ranks.get(token[:k]), ranks.get(token[k:])
                if left is not None and right is not None:
                    pairs[left * self._size + right] = rank
        self._pairs = np.array(sorted(pairs), np.int64)
        self._merged = np.array([pairs[p] for p in self._pairs.tolist()], np.int64)
        self._bytes_of_ids = Strings([self.tokens.get(i, b"") for i in range(self._size)])
        self._decimals = Strings([b"%d " % i for i in range(self._size)])
        self._pieces: dict[str, bytes] = {}
        self._chunks: dict[str, bytes] = {}
        self._unsafe: set[str] = set()

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, -1 where a pair is no token; a token of -1 makes no pair."""
        if not len(self._pairs):
            return np.full(len(left), -1, np.int64)
        key = left * self._size + right
        at = np.minimum(np.searchsorted(self._pairs, key), len(self._pairs) - 1)
        return np.where((self._pairs[at] == key) & (left >= 0) & (right >= 0), self._merged[at], -1)

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as 4-byte integers; one that is a token itself is not merged."""
        whole = [self.ranks.get(p) for p in pieces]
        rest = [k for k, rank in enumerate(whole) if rank is None and pieces[k]]
        out = [b"" if rank is None else rank.to_bytes(4, "little") for rank in whole]
        start, size = 0, 0
        for stop, k in enumerate(rest, start=1):
            size += len(pieces[k])
            if size >= _MERGED or stop == len(rest):
                some = rest[start:stop]
                for k, ids in zip(some, self._merge([pieces[k] for k in some]), strict=True):
                    out[k] = ids
                start, size = stop, 0
        return out

    def _merge(self, pieces: list[bytes]) -> list[bytes]:
        if not pieces:
            return []
        data = np.frombuffer(b"".join(pieces), np.uint8)
        n = len(data)
        ends = np.cumsum([len(p) for p in pieces], dtype=np.int64)
        token = np.append(self._bytes[data], -1)  # the last is a place beside the list
        following = np.minimum(np.arange(1, n + 2), n)
        before = np.arange(-1, n)
        following[ends - 1] = n
        before[ends[:-1]] = n
        before[0] = n
        piece = np.repeat(np.arange(len(pieces)), np.diff(ends, prepend=0))
        waiting = self._rank(token[:-1], token[following[:-1]])
        waiting = np.append(waiting, -1)
        queue = RankQueue(self._size)
        first = np.flatnonzero(waiting >= 0)
        queue.push_all(waiting[first], first)
        while queue:
            rank, at = queue.pop()
            at = at[waiting[at] == rank]
            if not len(at):
                continue
            at = np.sort(at)
            # of pairs that overlap in a row, every second one
            row = np.ones(len(at), bool)
            row[1:] = following[at[:-1]] != at[1:]
            start = np.maximum.accumulate(np.where(row, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - start) % 2 == 0]
            first = np.ones(len(at), bool)  # in its pre-token
            first[1:] = piece[at[1:]] != piece[at[:-1]]
            while True:
                gone = following[at]
                after = following[gone]
                was = token[at], token[gone], waiting[gone]
                token[at] = rank
                token[gone] = waiting[gone] = -1
                following[at] = after
                before[after] = at
                changed = np.concatenate([at, before[at]])
                changed.sort()
                changed = changed[np.diff(changed, prepend=-1) > 0]
                now = self._rank(token[changed], token[following[changed]])
                good = now >= 0
                if first.all() or not (now[good] <= rank).any():
                    break
                # a new pair goes before the others of this rank: undo, and take each pre-token's first alone
                token[at], token[gone], waiting[gone] = was
                following[at] = gone
                before[after] = gone
                queue.push(rank, at[~first])
                at = at[first]
                first = first[first]
            waiting[changed] = now
            waiting[n] = -1
            if good.any():
                queue.push_all(now[good], changed[good])
        alive = token[:-1] >= 0
        ids = token[:-1][alive].astype("<u4").tobytes()
        stops = (4 * np.cumsum(alive)[ends - 1]).tolist()
        return [ids[start:stop] for start, stop in zip([0, *stops], stops)]

    def _split(self, text: str) -> tuple[list[str], list[str]]:
        """The pre-tokens before a text's first blank, and the chunks after blanks; all pre-tokens and no chunk if a
        blank stands beside other white space, or the pattern is not known to cut before blanks, as the text must be cut
        as a whole then."""
        if not self._at_blanks:
            return self._cut(text), []
        head, *chunks = text.split(" ")
        if chunks and head[-1:].isspace() or not self._unsafe.isdisjoint(chunks):
            return self._cut(text), []
        return self._cut(head), chunks

    def _learn(self, texts: list[str]) -> None:
        """Cut what is new in the texts, and merge all new pre-tokens together."""
        if len(self._chunks) > _KEPT:
            self._chunks.clear()
        if len(self._pieces) > _KEPT:
            self._pieces.clear()
        known, pieces = self._chunks, self._pieces
        new: set[str] = set()
        for text in texts if self._at_blanks else ():
            new.update(set(text.split(" ")[1:]).difference(known))
        # letters alone are one pre-token
        cut = {c: (" " + c,) for c in new if c.isalpha()}
        new.difference_update(cut)
        self._unsafe = {c for c in new if not c or c[0].isspace() or c[-1].isspace()}
        cut.update((c, self._cut(" " + c)) for c in new - self._unsafe)
        wanted = set(chain.from_iterable(cut.values()))
        for text in texts:
            wanted.update(self._split(text)[0])
        fresh = list(wanted.difference(pieces))
        pieces.update(zip(fresh, self.merge([p.encode() for p in fresh]), strict=True))
        ids = pieces.__getitem__
        known.update((c, ids(parts[0]) if len(parts) == 1 else b"".join(map(ids, parts))) for c, parts in cut.items())
        self._passing = [c for c in cut if len(c) > _LONG], [p for p in fresh if len(p) > _LONG]

    def encode_all(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text."""
        start, size = 0, 0
        for stop, text in enumerate(texts, start=1):
            size += len(text or "")
            if size >= _CHARS or stop == len(texts):
                yield from self._encode(texts[start:stop])
                start, size = stop, 0

    def _encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        self._learn([t or "" for t in texts])
        known, pieces = self._chunks, self._pieces
        for text in texts:
            parts, chunks = self._split(text or "")
            ids = b"".join(chain(map(pieces.__getitem__, parts), map(known.__getitem__, chunks)))
            yield np.frombuffer(ids, "<u4")
        for c in self._passing[0]:
            known.pop(c, None)
        for p in self._passing[1]:
            pieces.pop(p, None)

    def encode(self, text: str | None) -> list[int]:
        (ids,) = self.encode_all([text])
        return ids.tolist()

    def decode(self, ids: Iterable[int] | np.ndarray) -> bytes:
        return self._bytes_of_ids.joined(np.asarray(ids, np.int64))

    def written(self, ids: np.ndarray) -> bytes:
        """Decimal ids, joined by one blank."""
        return self._decimals.joined(ids)[:-1]


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """The ranks in a vocabulary file of lines ``base64 rank``; a path without a scheme is a file of the driver."""
    if "://" in path:
        lines: Iterable[bytes] = (row.value.encode() for row in spark.read.text(path).toLocalIterator())
    else:
        with open(path, "rb") as file:
            lines = file.read().splitlines()
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def _coder(spark: SparkSession, path: str, pattern: str):
    shared = spark.sparkContext.broadcast({"ranks": read_ranks(spark, path)})

    def make() -> ByteBpe:
        # what a worker has learnt stays with its copy of the vocabulary, for its next task
        kept = shared.value
        if "coder" not in kept:
            kept["coder"] = ByteBpe(kept["ranks"], pattern)
        return kept["coder"]

    return make


def _appended(df: DataFrame, fields: list[T.StructField]) -> T.StructType:
    taken = {c.lower() for c in df.columns} & {f.name.lower() for f in fields}
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    return T.StructType(df.schema.fields + fields)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)], dtype=np.int64).astype(np.int32)
    values = np.concatenate([*rows, np.empty(0, "<u4")]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """All columns of ``df`` and the ids of each whole text as ``array<int>``."""
    make = _coder(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            new = _lists(list(coder.encode_all(batch.column(text).to_pylist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, ids])

    return df.mapInArrow(run, _appended(df, [T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", data: str = "data") -> DataFrame:
    """All columns of ``df`` and the bytes that the ids stand for; null ids have no bytes."""
    make = _coder(df.sparkSession, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            new = pa.array([coder.decode(x or []) for x in batch.column(ids).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, new], [*batch.schema.names, data])

    return df.mapInArrow(run, _appended(df, [T.StructField(data, T.BinaryType())]))


def tokenized(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """All columns of ``df`` but the text, with ``ids`` and ``n_tokens``; fails where the ids don't decode to the text."""
    make = _coder(df.sparkSession, path, pattern)
    kept = [c for c in df.columns if c != text]
    new = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            texts = batch.column(text).to_pylist()
            ids = list(coder.encode_all(texts))
            for one, value in zip(ids, texts, strict=True):
                if coder.decode(one) != (value or "").encode():
                    raise ValueError("ids do not decode to their text")
            counts = pa.array([len(one) for one in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), _lists(ids), counts], [*kept, "ids", "n_tokens"])

    return df.mapInArrow(run, _appended(df.select(*(F.col(f"`{c}`") for c in kept)), new))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """Encode and decode in one pass; instead of the text, the count of ids and digests of the ids and decoded bytes."""
    make = _coder(df.sparkSession, path, pattern)
    kept = [c for c in df.columns if c != text]
    schema = _appended(
        df.select(*(F.col(f"`{c}`") for c in kept)),
        [
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            counts, shas, decoded = [], [], []
            for ids in coder.encode_all(batch.column(text).to_pylist()):
                counts.append(len(ids))
                shas.append(sha256(coder.written(ids)).hexdigest())
                decoded.append(sha256(coder.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(counts, pa.int64()), pa.array(shas), pa.array(decoded)],
                [*kept, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.mapInArrow(run, schema)
