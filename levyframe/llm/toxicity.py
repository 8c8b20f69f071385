"""Toxicity by non-negative positive-unlabelled learning (Kiryo et al., 2017).

A linear classifier over hashed words and word beginnings is trained in NumPy from confirmed toxic documents and
unlabelled text.  With the class prior ``p``, the share of toxic documents, the risk of scores ``f`` is

    p * E_toxic[loss(f)] + max(0, E_unlabelled[loss(-f)] - p * E_toxic[loss(-f)])

with the logistic loss; where the second part of a step's batch is below zero, the step goes up that part instead.
The prior is the toxic share of the labelled training documents.

The classifier is fitted on a bounded sample, ``MAX_POSITIVE`` and about ``MAX_UNLABELLED`` documents (chosen by hashes
of the ids), in one task; all documents are scored where they are read.  The model that travels is a table of
``2 ** FEATURE_BITS`` weights.

Defined cases: null and empty texts get the score of the bias alone; documents without an id are never sampled and are
not held out; of several labels of an id the largest counts; without a toxic document every score is 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from levyframe.llm.text import utf8

MAX_POSITIVE = 20_000
MAX_UNLABELLED = 40_000
FEATURE_BITS = 20
MIN_Z = 5.0
BEGINNINGS = (4, 5, 6)  # bytes of a word that make a feature beside the whole word
FOLDS = 5

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_KEPT = 1 << 17


class _Features(dict):
    """A word's feature numbers as bytes."""

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= _KEPT:
            self.clear()
        parts = [b"=" + word, *(b"%d" % k + word[:k] for k in BEGINNINGS if len(word) >= k)]
        numbers = [int.from_bytes(blake2b(x, digest_size=4).digest(), "little") >> (32 - FEATURE_BITS) for x in parts]
        value = self[word] = np.array(numbers, np.uint32).tobytes()
        return value


def features(text: bytes | None, known: _Features) -> np.ndarray:
    """Distinct feature numbers of a whole text."""
    words = set((text or b"").translate(_WORDS).split())
    return np.unique(np.frombuffer(b"".join(map(known.__getitem__, words)), np.uint32)).astype(np.int32)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


class Sparse:
    """Rows of sets of columns."""

    def __init__(self, rows: list[np.ndarray]):
        self.lengths = np.array([len(r) for r in rows], np.int64)
        self.columns = np.concatenate([*rows, np.empty(0, np.int32)]).astype(np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(columns, number of the row among ``rows``) of all entries of these rows."""
        lengths = self.lengths[rows]
        shift = np.repeat(self.starts[rows] - (np.cumsum(lengths) - lengths), lengths)
        return self.columns[np.arange(len(shift)) + shift], np.repeat(np.arange(len(rows)), lengths)


def fit(
    positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int,
    epochs: int = 40, batch: int = 1024, rate: float = 0.1, decay: float = 1e-3, seed: int = 5,
) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk: the mean over the second half of Adam's steps."""
    weights, bias = np.zeros(size), 0.0
    if not positive or not unlabelled:
        return weights, -60.0
    rng = np.random.default_rng(seed)
    sets = Sparse(positive), Sparse(unlabelled)
    bias = float(np.log(prior / (1 - prior)))
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    step = 0
    mean = np.zeros(size + 1)
    batches = max(1, len(unlabelled) // batch)
    for _ in range(epochs):
        deals = [np.array_split(rng.permutation(len(s.lengths)), batches) for s in sets]
        for toxic, plain in zip(*deals, strict=True):
            if not len(toxic):
                toxic = rng.integers(0, len(positive), 64)
            step += 1
            (pc, pr), (uc, ur) = sets[0].take(toxic), sets[1].take(plain)
            pz = bias + np.bincount(pr, weights[pc], len(toxic))
            uz = bias + np.bincount(ur, weights[uc], len(plain))
            # loss(z) = log(1 + exp(-z)); d loss(z) = -s(-z), d loss(-z) = s(z)
            below = np.logaddexp(0, uz).mean() - prior * np.logaddexp(0, pz).mean()
            up_u = _logistic(uz) / len(plain)
            up_p = -prior * _logistic(pz) / len(toxic)
            if below >= 0:
                slope_p, slope_u = up_p - prior * _logistic(-pz) / len(toxic), up_u
            else:
                slope_p, slope_u = -up_p, -up_u
            slope = np.bincount(np.concatenate([pc, uc]), np.concatenate([slope_p[pr], slope_u[ur]]), size)
            slope = np.append(slope + decay * weights, slope_p.sum() + slope_u.sum())
            first = 0.9 * first + 0.1 * slope
            second = 0.999 * second + 0.001 * slope**2
            move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
            weights -= move[:-1]
            bias -= float(move[-1])
            if 2 * step > epochs * batches:
                mean += np.append(weights, bias)
    mean /= step - epochs * batches // 2
    return mean[:-1], float(mean[-1])


def enriched(toxic: np.ndarray, n_toxic: int, plain: np.ndarray, n_plain: int, least: int) -> np.ndarray:
    """Features of ``least`` toxic documents or more whose share among them is ``MIN_Z`` standard errors above that
    among all; ``toxic`` and ``plain`` count the documents of each feature."""
    if not n_toxic or not n_plain:
        return np.empty(0, np.int64)
    share = np.clip(plain / n_plain, 1 / n_plain, 0.999)
    z = (toxic / n_toxic - plain / n_plain) / np.sqrt(share * (1 - share) / n_toxic)
    return np.flatnonzero((z >= MIN_Z) & (toxic >= least))


def boundary(unlabelled: list[np.ndarray], weights: np.ndarray, bias: float, prior: float) -> float:
    """Where to decide: the risk is cautious, as toxic documents are among the unlabelled ones, so half way down to the
    score that the prior's share of them exceeds, if that is below 0."""
    if not unlabelled:
        return 0.0
    scores = np.array([weights[x].sum() for x in unlabelled]) + bias
    return min(0.0, float(np.quantile(scores, 1 - prior))) / 2


def _trainer(prior: float, least: int):
    """One task: all sampled rows in, (feature, weight) out; the bias is feature -1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []  # order, toxic, number of features, features
        counts = {kind: np.zeros(1 << FEATURE_BITS, np.int64) for kind in (True, False)}
        for b in batches:
            order, toxic = b.column("row_order").to_numpy(), b.column("toxic").to_numpy(zero_copy_only=False)
            lengths = pc.binary_length(b.column("features")).to_numpy() // 4
            flat = np.frombuffer(b"".join(b.column("features").to_pylist()), np.int32)
            parts.append((order.copy(), toxic, lengths, flat))
            for kind in counts:
                counts[kind] += np.bincount(flat[np.repeat(toxic == kind, lengths)], minlength=1 << FEATURE_BITS)
        n = {kind: sum(int((p[1] == kind).sum()) for p in parts) for kind in counts}
        kept = enriched(counts[True], n[True], counts[False], n[False], least)
        number = np.full(1 << FEATURE_BITS, -1, np.int32)
        number[kept] = np.arange(len(kept), dtype=np.int32)
        rows: list[tuple[int, bool, np.ndarray]] = []
        while parts:  # features that do not count go, part by part
            order, toxic, lengths, flat = parts.pop()
            numbers = number[flat]
            ends = np.cumsum(np.concatenate([[0], numbers >= 0]))[np.cumsum(lengths)]
            rows += zip(order.tolist(), toxic.tolist(), np.split(numbers[numbers >= 0], ends[:-1]), strict=True)
        rows.sort(key=lambda r: r[:2])  # the same model whatever order the rows came in
        sets = {kind: [r[2] for r in rows if r[1] == kind] for kind in counts}
        weights, bias = fit(sets[True], sets[False], prior, len(kept))
        bias -= boundary(sets[False], weights, bias, prior)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, *kept.tolist()], pa.int32()), pa.array([bias, *weights.tolist()], pa.float64())],
            ["feature", "weight"],
        )

    return run


def held_out(doc_id) -> F.Column:
    """Whether a document's labels are kept from training."""
    fold = F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS))
    return F.coalesce(fold == 0, F.lit(False))


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED, least: int = 4
) -> ToxicityModel:
    """Train on documents and labels outside the held-out fold; ``least``: documents of the sample that a feature needs."""
    training = labels.where("doc_id is not null and toxic is not null").where(~held_out("doc_id"))
    known = training.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = known.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    usable = docs.where("doc_id is not null").where(~held_out("doc_id"))
    order = F.xxhash64(F.lit(11), "doc_id")
    chosen = known.where("toxic = 1").select("doc_id", F.lit(True).alias("toxic")).orderBy(order, "doc_id").limit(max_positive)
    rows = usable.count()
    if not share or not rows:
        return ToxicityModel(np.zeros(1 << FEATURE_BITS, np.float32), -60.0)
    taken = F.pmod(F.xxhash64(F.lit(12), "doc_id"), F.lit(1 << 30)) < int(min(1.0, max_unlabelled / rows) * (1 << 30))

    # chosen has at most max_positive ids
    marked = usable.select(F.col("doc_id"), "text").join(F.broadcast(chosen), "doc_id", "left")
    marked = marked.select("text", order.alias("row_order"), F.coalesce("toxic", F.lit(False)).alias("toxic"), taken.alias("taken"))
    sample = marked.where("toxic or taken")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = _Features()
        for b in batches:
            out: tuple[list, ...] = ([], [], [])
            columns = (b.column(c).to_pylist() for c in ("row_order", "toxic", "taken"))
            for place, toxic, plain, text in zip(*columns, utf8(b.column("text")), strict=True):
                data = features(text, seen).tobytes()
                for kind in (True,) * toxic + (False,) * plain:
                    for x, value in zip(out, (place, kind, data), strict=True):
                        x.append(value)
            kinds = (pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["row_order", "toxic", "features"])

    rows = sample.mapInArrow(run, "row_order long, toxic boolean, features binary").repartition(1)
    prior = min(max(float(share), 1e-4), 0.9)
    model = rows.mapInArrow(_trainer(prior, least), "feature int, weight double").toPandas()
    weights = np.zeros(1 << FEATURE_BITS, np.float32)
    real = model[model.feature >= 0]
    weights[real.feature.to_numpy()] = real.weight.to_numpy()
    return ToxicityModel(weights, float(model[model.feature < 0].weight.iloc[0]))


def with_score(docs: DataFrame, model: ToxicityModel, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and the toxicity of each whole text, from 0 to 1."""
    if name in docs.columns:
        raise ValueError(f"a column {name} is there already")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        seen = _Features()
        for b in batches:
            sums = np.array([weights[features(t, seen)].sum(dtype=np.float64) for t in utf8(b.column("text"))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_logistic(sums + bias), pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    scored = with_score(docs.select("doc_id", "text"), fit_toxicity(docs, labels))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic."""
    scored = with_score(docs, fit_toxicity(docs, labels), "toxicity_score")
    return scored.where("toxicity_score < 0.5").select(*docs.columns)
