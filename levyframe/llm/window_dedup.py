"""Substring dedup: words covered by a window of ``WINDOW`` words that also starts in a document of a smaller id.

1. Documents are packed, where they are read, into blocks of text that suit an executor's memory (``BLOCK_SHARE``), in
   order of the id, and the blocks are written compressed; a block's number stays the same whatever executor reads it later.
2. Every window of a block gets a Rabin-Karp hash of its words: running sums of the words' 128-bit hashes times the powers
   of a base, two lanes of 64 bits.  Equal windows of one block are one entry, that of the smallest id.  Entries are
   dealt into buckets by some bits of the hash and shuffled, one row for each block and bucket, as a digest of the hash
   and a run-length coded id.  The digest is wide enough for all windows of the corpus (``digest_bytes``): the expected
   number of pairs of different windows with one bucket and digest is below 2 ** -``MARGIN`` in the whole corpus.
3. A bucket counts: it sorts its digests, finds the smallest id of each, and answers one bit for each entry, whether
   the window also starts in a document of a smaller id.
4. The bits come back to their blocks.  There the repeated windows are merged into maximal intervals of words, which go.

A window that stands in any number of documents is one entry for each block, and buckets are even as hashes are, so
copies make no task long.  What a bucket holds follows from an executor's memory (``BUCKET_SHARE``), the number of buckets
from the number of windows.  Texts are shuffled once, compressed, to meet their bits.

Defined cases: null texts have no words; documents with fewer than ``WINDOW`` words lose nothing; a null id is larger than
every other, and equal to another null id, so nothing is removed for its sake; rows of one id do not remove each
other's words; rows are told apart by their block, so repeated rows are each returned; an empty table gives an empty one;
no other column is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from levyframe.llm.sizing import share_of_executor
from levyframe.llm.text import mixed, powers, utf8
from levyframe.storage import stage

WINDOW = 13
BLOCK_SHARE = 1536  # a block's text is this part of an executor's heap: a task takes some 60 times as much
BUCKET_SHARE = 900  # a bucket has one window for so many bytes of heap
LEAST_BLOCK, LEAST_BUCKET = 1 << 20, 1 << 20
MARGIN = 16
_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95))
_INVERSES = tuple(np.uint64(pow(int(b), -1, 1 << 64)) for b in _BASES)
_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_FIRST, _NO_ID = -(1 << 63), (1 << 63) - 1
_CODEC = "zstd"

BLOCK_SCHEMA = "block long, n_windows long, ids array<long>, lengths array<long>, n_bytes long, data binary"
ENTRY_SCHEMA = "block long, bucket long, digests binary, ids binary, counts binary, without_id long"
ANSWER_SCHEMA = "block long, bucket long, bits binary"
RESULT_SCHEMA = "doc_id long, n_words long, n_removed long, spans array<struct<first_word: long, last_word: long>>, kept_text string"


def digest_bytes(windows: int, buckets: int, margin: int = MARGIN) -> int:
    """Bytes of a digest, 8 to 16: with the bits that choose the bucket, enough to tell ``windows`` windows apart."""
    bits = 2 * math.log2(max(windows, 2)) - 1 + margin - math.log2(buckets)
    return min(16, max(8, math.ceil(bits / 8)))


class Words:
    """The words of a block's texts; a document is a run of words, a word a run of bytes of ``data``."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b" ".join([*texts, b""]), np.uint8)  # every text ends with a blank
        edges = np.diff(_BLANKS[self.data].view(np.int8), prepend=np.int8(1), append=np.int8(1))
        self.starts, self.ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
        self.bytes_before = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.first = np.searchsorted(self.starts, self.bytes_before)  # word with which each document starts
        self.count = np.diff(self.first)

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """128 bits of each word; each different word is hashed once."""
        lengths = self.ends - self.starts
        offsets = np.zeros(len(lengths) + 1, np.int64)
        np.cumsum(lengths, out=offsets[1:])
        solid = self.data[~_BLANKS[self.data]]
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(solid)]
        ).dictionary_encode()
        digests = b"".join(xxhash.xxh3_128_digest(w) for w in words.dictionary.to_pylist())
        lanes = np.frombuffer(digests, np.uint64).reshape(-1, 2)
        at = words.indices.to_numpy()
        return lanes[at, 0], lanes[at, 1]


class Windows:
    """The windows of a block: ``start`` is each one's first word, ``entry`` the entry that stands for it.

    Entries are the different windows; ``least`` is the document (place in the block) with the smallest id that has it.
    """

    def __init__(self, words: Words, window: int = WINDOW):
        document = np.repeat(np.arange(len(words.count)), words.count)
        n = max(0, len(document) - window + 1)
        self.start = np.flatnonzero(document[:n] == document[window - 1 : window - 1 + n])
        self.document = document[self.start]
        lanes = words.hashes() if len(self.start) else (np.empty(0, np.uint64),) * 2
        self.low, self.high = (
            mixed(self._rolled(lane, base, inverse, window)) for lane, base, inverse in zip(lanes, _BASES, _INVERSES, strict=True)
        )
        order = np.argsort(self.low, kind="stable")  # equal windows stay in the order of their documents
        low, high = self.low[order], self.high[order]
        same = low[1:] == low[:-1]
        if (same & (high[1:] != high[:-1])).any():
            order = np.lexsort((np.arange(len(order)), self.high, self.low))
            low, high = self.low[order], self.high[order]
            same = low[1:] == low[:-1]
        new = np.ones(len(order), bool)
        new[1:] = ~(same & (high[1:] == high[:-1]))
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.at = order[new]  # the window that stands for each entry
        self.least = self.document[self.at]

    def _rolled(self, lane: np.ndarray, base: np.uint64, inverse: np.uint64, window: int) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        sums = np.zeros(len(lane) + 1, np.uint64)
        np.cumsum(lane * powers(base, len(lane)), out=sums[1:])
        return (sums[self.start + window] - sums[self.start]) * powers(inverse, len(lane))[self.start]

    def dealt(self, buckets: int) -> tuple[np.ndarray, np.ndarray]:
        """(entries by bucket and place, bucket of each)."""
        place = np.argsort(self.at, kind="stable")
        bucket = ((self.high[self.at[place]] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
        order = np.argsort(bucket, kind="stable")
        return place[order], bucket[order].astype(np.int64)


def _block_row(number: int, rows: list[tuple[int | None, bytes]], window: int) -> dict:
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0))
    texts = [t for _, t in rows]
    words = Words(texts)
    data = b"".join(texts)
    return {
        "block": number, "n_windows": int(np.maximum(words.count - window + 1, 0).sum()), "ids": [i for i, _ in rows],
        "lengths": [len(t) for t in texts], "n_bytes": len(data), "data": pa.compress(data, codec=_CODEC, asbytes=True),
    }


def packed(docs: DataFrame, doc_id: str, text: str, window: int = WINDOW, block_bytes: int = LEAST_BLOCK) -> DataFrame:
    """Blocks of whole documents, numbered by task; to be written before they are used twice."""
    schema = pa.schema([
        ("block", pa.int64()), ("n_windows", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())),
        ("n_bytes", pa.int64()), ("data", pa.binary()),
    ])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 32
        held: list[tuple[int | None, bytes]] = []
        size = number = 0
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                held.append((key, value or b""))
                size += len(held[-1][1]) + 1
                if size >= block_bytes:
                    yield pa.RecordBatch.from_pylist([_block_row(task + number, held, window)], schema)
                    held, size, number = [], 0, number + 1
        if held:
            yield pa.RecordBatch.from_pylist([_block_row(task + number, held, window)], schema)

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return chosen.mapInArrow(pack, BLOCK_SCHEMA)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    for batch in batches:
        for k in range(batch.num_rows):
            row = {name: batch.column(name)[k] for name in batch.schema.names}
            data = pa.decompress(row["data"].as_py(), row["n_bytes"].as_py(), codec=_CODEC, asbytes=True)
            ends = np.cumsum([0, *row["lengths"].as_py()]).tolist()
            yield row, [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _ids(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """(id, has none) of each document of a block."""
    ids = row["ids"].values
    return ids.fill_null(_NO_ID).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)


def _entries(blocks: DataFrame, buckets: int, width: int, window: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in _blocks(batches):
            windows = Windows(Words(texts), window)
            ids, without = _ids(row)
            entries, bucket = windows.dealt(buckets)
            if not len(entries):
                continue
            at = windows.at[entries]
            digests = np.empty((len(at), 16), np.uint8)
            digests[:, :8] = windows.low[at].view(np.uint8).reshape(-1, 8)
            digests[:, 8:] = windows.high[at].view(np.uint8).reshape(-1, 8)  # its lowest bytes first
            digests = np.ascontiguousarray(digests[:, :width])
            document = windows.least[entries]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
            out: dict[str, list] = {name: [] for name in ("block", "bucket", "digests", "ids", "counts", "without_id")}
            for low, high in zip(cuts, [*cuts[1:], len(at)], strict=True):
                own = document[low:high]
                missing = int(without[own].sum())  # the last ones
                named = ids[own[: len(own) - missing]]
                runs = np.flatnonzero(np.diff(named) != 0) + 1 if len(named) else np.empty(0, np.int64)
                heads = np.concatenate([[0], runs]) if len(named) else runs
                for name, value in (
                    ("block", row["block"].as_py()), ("bucket", int(bucket[low])), ("digests", digests[low:high].tobytes()),
                    ("ids", np.diff(named[heads], prepend=np.int64(0)).tobytes()),
                    ("counts", np.diff(np.concatenate([heads, [len(named)]])).astype(np.int32).tobytes()), ("without_id", missing),
                ):
                    out[name].append(value)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_pydict({n: pa.array(v, t) for (n, v), t in zip(out.items(), kinds, strict=True)})

    return blocks.mapInArrow(send, ENTRY_SCHEMA)


def _entry_ids(ids: bytes, counts: bytes, without: int) -> np.ndarray:
    named = np.repeat(np.cumsum(np.frombuffer(ids, np.int64)), np.frombuffer(counts, np.int32))
    return np.concatenate([named, np.full(without, _NO_ID, np.int64)])


def _answers(entries: DataFrame, width: int) -> DataFrame:
    def answer(table: pa.Table) -> pa.Table:
        digests = np.frombuffer(b"".join(table["digests"].to_pylist()), np.uint8).reshape(-1, width)
        columns = (table[name].to_pylist() for name in ("ids", "counts", "without_id"))
        ids_of_rows = [_entry_ids(*row) for row in zip(*columns, strict=True)]
        sizes = [len(x) for x in ids_of_rows]
        ids = np.concatenate(ids_of_rows)
        without = np.concatenate([
            np.arange(n) >= n - missing for n, missing in zip(sizes, table["without_id"].to_pylist(), strict=True)
        ])
        filled = np.zeros((len(digests), 16), np.uint8)
        filled[:, :width] = digests
        low, high = (np.ascontiguousarray(filled[:, k : k + 8]).view(np.uint64).ravel() for k in (0, 8))
        order = np.argsort(low)
        same = low[order][1:] == low[order][:-1]
        if (same & (high[order][1:] != high[order][:-1])).any():
            order = np.lexsort((high, low))
            same = (low[order][1:] == low[order][:-1]) & (high[order][1:] == high[order][:-1])
        heads = np.concatenate([[0], np.flatnonzero(~same) + 1])
        group = np.zeros(len(order), np.int64)
        group[heads[1:]] = 1
        group = np.cumsum(group)
        least = np.minimum.reduceat(ids[order], heads)[group]
        named = np.logical_or.reduceat(~without[order], heads)[group]
        hit = np.empty(len(order), bool)
        hit[order] = named & ((least < ids[order]) | without[order])
        ends = np.cumsum([0, *sizes])
        kept = [k for k in range(len(sizes)) if hit[ends[k] : ends[k + 1]].any()]
        return pa.table({
            "block": table["block"].take(pa.array(kept, pa.int64())), "bucket": table["bucket"].take(pa.array(kept, pa.int64())),
            "bits": pa.array([np.packbits(hit[ends[k] : ends[k + 1]]).tobytes() for k in kept], pa.binary()),
        })

    return entries.groupBy("bucket").applyInArrow(answer, ANSWER_SCHEMA)


def _covered(starts: np.ndarray, words: int, window: int) -> np.ndarray:
    """Whether each word is covered by a window that starts at one of ``starts``."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + window, -1)
    return np.cumsum(steps[:-1]) > 0


def _results(words: Words, ids: pa.Array, gone: np.ndarray) -> pa.RecordBatch:
    documents = len(words.count)
    # maximal runs of removed words that do not pass the end of a document
    edge = np.zeros(len(gone) + 1, bool)
    edge[words.first] = True
    beside = np.concatenate([[False], gone, [False]])
    opened = np.flatnonzero(gone & (edge[:-1] | ~beside[:-2]))
    closed = np.flatnonzero(gone & (edge[1:] | ~beside[2:]))
    owner = np.searchsorted(words.first, opened, side="right") - 1
    offsets = np.searchsorted(owner, np.arange(documents + 1)).astype(np.int32)
    spans = pa.StructArray.from_arrays(
        [pa.array(opened - words.first[owner]), pa.array(closed - words.first[owner])], ["first_word", "last_word"]
    )
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
    # kept words with the byte after them, which is made a blank; the last of a document goes
    steps = np.zeros(len(words.data) + 1, np.int8)
    steps[words.starts[~gone]] += 1
    steps[words.ends[~gone] + 1] -= 1
    keep = np.cumsum(steps[:-1], dtype=np.int8).astype(bool)
    data = words.data.copy()
    data[words.ends] = 32
    lengths = np.diff(np.concatenate([[0], np.cumsum(keep)])[words.bytes_before])
    text, ends = data[keep].tobytes(), np.cumsum(lengths).tolist()
    texts = [text[end - n : max(end - n, end - 1)] for end, n in zip(ends, lengths.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [
            ids, pa.array(words.count.astype(np.int64)), pa.array(removed.astype(np.int64)),
            pa.ListArray.from_arrays(pa.array(offsets), spans), pa.array(texts, pa.binary()).cast(pa.string(), safe=False),
        ],
        ["doc_id", "n_words", "n_removed", "spans", "kept_text"],
    )


def _removed(blocks: DataFrame, answers: DataFrame, buckets: int, window: int) -> DataFrame:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, texts in _blocks(batches):
            words = Words(texts)
            windows = Windows(words, window)
            entries, bucket = windows.dealt(buckets)
            hit = np.zeros(len(entries), bool)
            for answer in row["answers"].as_py() or ():
                low, high = np.searchsorted(bucket, [answer["bucket"], answer["bucket"] + 1])
                bits = np.unpackbits(np.frombuffer(answer["bits"], np.uint8), count=high - low)
                hit[entries[low:high]] = bits.astype(bool)
            ids, without = _ids(row)
            own, least = windows.document, windows.least[windows.entry]
            # a smaller id in the block itself, or one elsewhere
            smaller = ~without[least] & ((ids[least] < ids[own]) | without[own])
            gone = _covered(windows.start[smaller | hit[windows.entry]], len(words.starts), window)
            yield _results(words, row["ids"].values, gone)

    collected = answers.groupBy(F.col("block").alias("answered")).agg(F.collect_list(F.struct("bucket", "bits")).alias("answers"))
    joined = blocks.join(collected, blocks["block"] == collected["answered"], "left")
    return joined.select("ids", "lengths", "n_bytes", "data", "answers").mapInArrow(remove, RESULT_SCHEMA)


def without_repeated_windows(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, block_bytes: int | None = None,
    bucket_windows: int | None = None,
) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text) of every document.

    ``spans`` are the maximal removed runs of words, counted from 0; ``kept_text`` joins the kept words by one blank.
    """
    spark = docs.sparkSession
    block_bytes = block_bytes or share_of_executor(spark, BLOCK_SHARE, LEAST_BLOCK)
    bucket_windows = bucket_windows or share_of_executor(spark, BUCKET_SHARE, LEAST_BUCKET)
    blocks = stage(packed(docs, doc_id, text, window, block_bytes), "blocks")
    windows = blocks.agg(F.sum("n_windows")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(4 * tasks, -(-windows // bucket_windows))  # several a task, so that tasks are even
    width = digest_bytes(windows, buckets)
    answers = stage(_answers(_entries(blocks, buckets, width, window), width), "answers")
    return _removed(blocks, answers, buckets, window)


def window_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document."""
    digest = F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256")
    return without_repeated_windows(docs, doc_id, text).select("doc_id", "n_words", "n_removed", digest)
