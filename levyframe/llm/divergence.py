"""Source divergence audit: how far the terms of each (lang, source) group are from other sources and from their language.

Terms are runs of ASCII letters and of characters beyond ASCII, A-Z lower-cased.  A language keeps the terms that at least
``LEAST_DOCUMENTS`` of its documents have.  A count c of N kept terms stands for the share
``p = 1 + floor(10**9 * (c + 5) / (N + 5 * V))``, where V is the number of kept terms; every difference is one of integers.

1. Tasks count the terms of their documents, Spark adds these counts by (lang, source, term), and each kept term becomes one
   row with its counts by source.
2. Count-cell ranking: a term's difference from its language depends on its two counts alone, so a group's terms are
   counted by cell (count in the group, count in the language) and the difference is evaluated once for each cell.  Cells
   of one value are merged, values are ranked by how many terms come before them, and only values that begin within
   the first ``TOP`` are expanded to their terms, in UTF-8 order.
3. The distance of two sources sums over all kept terms: tasks get a bucket of a language's terms and the totals of
   its sources, and return one partial sum for each pair of sources, which Spark adds.

No term, group or language is a task of its own: counts are added before and after they are shuffled, a group's ranking
sees at most ``TOP`` values, and languages are cut into buckets of terms.  The result has a row for each pair of sources of
one language, so what a task returns grows with the square of a language's sources, as the result does.

Defined cases: null texts, langs and sources are ''; groups without terms are ranked like others, a language without kept
terms has distances of 0 and no ranked terms; repeated rows count as often as they stand; an empty table gives an empty
one; other columns, also of clashing names, are not read.  Of N + 5 * V more than ``MOST`` is an error.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from levyframe.llm.text import utf8
from levyframe.storage import stage

LEAST_DOCUMENTS = 30
TOP = 50
SHARES = 1_000_000_000
ADDED = 5
MOST = (1 << 63) // 1000 - 1
BUCKET_COUNTS = 250_000  # counts of terms by source that one task gets
_PORTION = 6 << 20  # bytes of text counted together
_CELLS = 4 << 20

_LETTER = np.ones(256, bool)
_LETTER[:0x41] = _LETTER[0x5B:0x61] = _LETTER[0x7B:0x80] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32

COUNT_SCHEMA = "lang string, source string, term string, n long, documents long"


def _terms(data: np.ndarray) -> tuple[np.ndarray, pa.DictionaryArray]:
    """(start, term) of every term in a buffer of UTF-8."""
    letters = _LETTER[data]
    edges = np.diff(letters.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(_LOWER[data[letters]])]
    return starts, pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), buffers).dictionary_encode()


def _batch(lang: pa.Array, source: pa.Array, term: pa.Array, n: np.ndarray, documents: np.ndarray) -> pa.RecordBatch:
    columns = [lang, source, term.cast(pa.large_string()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(documents, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "documents"])


def _counted(texts: list[bytes], group: np.ndarray, groups: pa.StructArray) -> pa.RecordBatch:
    """Counts of a portion's terms by group."""
    starts, terms = _terms(np.frombuffer(b" ".join(texts), np.uint8))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    document = np.searchsorted(bounds, starts, side="right") - 1
    words = max(1, len(terms.dictionary))
    # first the terms of each document, then those of each group
    pairs, n = np.unique(document * words + terms.indices.to_numpy().astype(np.int64), return_counts=True)
    key, inverse, documents = np.unique(group[pairs // words] * words + pairs % words, return_inverse=True, return_counts=True)
    total = np.bincount(inverse, weights=n, minlength=len(key)).astype(np.int64)  # far below 2 ** 53
    of = groups.take(pa.array(key // words))
    return _batch(of.field("lang"), of.field("source"), terms.dictionary.take(pa.array(key % words)), total, documents)


def _long(text: bytes, lang: str, source: str) -> pa.RecordBatch:
    """Counts of one text that is longer than a portion, cut between terms."""
    data = np.frombuffer(text, np.uint8)
    found: Counter[bytes] = Counter()
    at = 0
    while at < len(data):
        end = min(len(data), at + _PORTION)
        while end < len(data) and _LETTER[data[end - 1]] and _LETTER[data[end]]:
            end += 1
        terms = _terms(data[at:end])[1]
        found.update(dict(zip(terms.dictionary.to_pylist(), np.bincount(terms.indices.to_numpy()).tolist(), strict=True)))
        at = end
    names = pa.array(list(found), pa.large_binary())
    one = [pa.array([x] * len(found), pa.string()) for x in (lang, source)]
    return _batch(*one, names, np.array(list(found.values()), np.int64), np.ones(len(found), np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        coded = pa.StructArray.from_arrays([batch.column("lang"), batch.column("source")], ["lang", "source"])
        codes = {key: k for k, key in enumerate(dict.fromkeys((g["lang"], g["source"]) for g in coded.to_pylist()))}
        names = [list(x) for x in zip(*codes, strict=True)] or [[], []]
        groups = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in names], ["lang", "source"])
        held: list[bytes] = []
        owners: list[int] = []
        size = 0
        rows = zip(utf8(batch.column("text")), batch.column("lang").to_pylist(), batch.column("source").to_pylist(), strict=True)
        for text, lang, source in rows:
            if len(text) >= _PORTION:
                yield _long(text, lang, source)
                continue
            held.append(text)
            owners.append(codes[lang, source])
            size += len(text) + 1
            if size >= _PORTION:
                yield _counted(held, np.array(owners), groups)
                held, owners, size = [], [], 0
        if held:
            yield _counted(held, np.array(owners), groups)


def shares(counts: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """``1 + floor(SHARES * (counts + ADDED) / total)`` in 64 bits, three digits at a time."""
    left, found = counts + ADDED, np.zeros_like(counts)
    for _ in range(3):
        left = left * 1000
        found = found * 1000 + left // total
        left = left % total
    return found + 1


def _pair_sums(key: tuple, terms: pa.Table, sources: pa.Table) -> pa.Table:
    """Sums of differences over a bucket's terms, for each ordered pair of a language's sources."""
    names = sources["source"].combine_chunks()
    width = len(names)
    totals = (sources["total"].to_numpy() + ADDED * sources["terms"].to_numpy()).astype(np.int64)
    if width and totals.max() > MOST:
        raise OverflowError("more terms than exact shares allow")
    sums = np.zeros((width, width), np.int64)
    lists = terms["counts"].combine_chunks()
    height = max(1, _CELLS // max(1, width))
    for start in range(0, len(lists), height):
        part = lists.slice(start, height)
        row = np.repeat(np.arange(len(part)), pc.list_value_length(part).to_numpy())
        cells = part.flatten()
        column = pc.index_in(cells.field("source"), names).to_numpy()
        table = np.zeros((len(part), width), np.int64)
        table[row, column] = cells.field("n").to_numpy()
        table = shares(table, totals[None, :])
        for k in range(width - 1):
            sums[k, k + 1 :] += np.abs(table[:, k + 1 :] - table[:, k : k + 1]).sum(axis=0)
    sums += sums.T
    one, other = np.nonzero(~np.eye(width, dtype=bool))
    lang = pa.array([key[0].as_py()] * len(one), pa.string())
    return pa.table([lang, names.take(pa.array(one)), names.take(pa.array(other)), pa.array(sums[one, other])], ["lang", "source", "item", "value"])


def _share(count: str, total: str, terms: str):
    """``shares`` as an expression."""
    return F.expr(f"1 + cast({SHARES} * cast({count} + {ADDED} as decimal(20, 0)) as decimal(38, 0)) div ({total} + {ADDED} * {terms})")


def source_divergence(
    docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP, bucket_counts: int = BUCKET_COUNTS,
) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its distance to every other source of its language
    (``pair``), and the terms that it has oftenest beyond its language's share (``term``)."""
    filled = docs.select(*(
        F.coalesce(F.col(c).cast("string"), F.lit("")).alias(name) for name, c in (("lang", lang), ("source", source), ("text", text))
    ))
    counts = filled.mapInArrow(_count, COUNT_SCHEMA).groupBy("lang", "term", "source").agg(
        F.sum("n").alias("n"), F.sum("documents").alias("documents")
    )
    kept = counts.groupBy("lang", "term").agg(
        F.sum("documents").alias("documents"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("counts")
    )
    kept = stage(kept.where(F.col("documents") >= least_documents).drop("documents"), "terms")
    single = kept.select("lang", "term", "lang_n", F.inline("counts"))

    groups = filled.select("lang", "source").distinct()
    of_lang = kept.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("lang_n").alias("lang_total"))
    of_group = single.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    totals = groups.join(of_lang, "lang", "left").join(of_group, ["lang", "source"], "left").fillna(0)
    totals = stage(totals, "totals")

    # terms, by cells of two counts
    group = ["lang", "source"]
    cells = single.groupBy(*group, "n", "lang_n").agg(F.count("*").alias("many")).join(totals, group)
    value = _share("n", "total", "terms") - _share("lang_n", "lang_total", "terms")
    cells = stage(cells.select(*group, "n", "lang_n", "many", value.cast("long").alias("value")).where("value > 0"), "cells")
    by_value = Window.partitionBy(*group).orderBy(F.desc("value"))
    merged = cells.groupBy(*group, "value").agg(F.sum("many").alias("many"))
    merged = merged.withColumn("place", F.row_number().over(by_value)).where(F.col("place") <= top)
    before = F.coalesce(F.sum("many").over(by_value.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = merged.select(*group, "value", before.alias("before")).where(F.col("before") < top)
    wanted = cells.join(chosen, [*group, "value"]).select(*group, "n", "lang_n", "value", "before")
    expanded = single.join(wanted, [*group, "n", "lang_n"])
    in_value = Window.partitionBy(*group, "value", "before").orderBy("term")
    expanded = expanded.withColumn("place", F.row_number().over(in_value)).where(F.col("place") <= top)
    rank = (F.col("before") + F.col("place")).cast("int")
    terms = expanded.select(*group, F.lit("term").alias("part"), F.col("term").alias("item"), "value", rank.alias("rank"))
    terms = terms.where(F.col("rank") <= top)

    # pairs of sources, by buckets of terms
    held = totals.agg(F.sum("held")).first()[0] or 0
    buckets = max(1, -(-held // bucket_counts))
    bucket = F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket")
    every = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket")
    dealt = kept.select("lang", bucket, "counts").groupBy("lang", "bucket")
    sums = dealt.cogroup(totals.select(*group, "total", "terms", every).groupBy("lang", "bucket")).applyInArrow(
        _pair_sums, "lang string, source string, item string, value long"
    )
    pairs = sums.groupBy(*group, "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy(*group).orderBy(F.desc("value"), "item")
    pairs = pairs.select(*group, F.lit("pair").alias("part"), "item", "value", F.row_number().over(order).alias("rank"))
    return pairs.unionByName(terms)
