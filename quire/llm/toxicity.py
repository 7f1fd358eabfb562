"""Toxicity scores by FTRL-proximal logistic regression.

Features are hashed words, adjacent word pairs and skip pairs (one word left
out), each counted once per text.  Training runs online over a bounded sample
of labelled rows with per-coordinate learning rates, on an executor; the L1 term
keeps most weights at zero, and the model that tasks receive is its non-zero
weights (a few kilobytes, never more than ``2**bits`` entries).

Null and empty texts have no feature and get the intercept's score.  Null
labels and null doc_ids are not learned from; of a doc_id labelled twice the
larger label counts.  With nothing to learn from every score is 0.5.  Repeated
rows are scored alike; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, packed, small
from .training import least_by_hash, remainder, texts_of

BITS, PASSES = 20, 4
#: At most so many training rows with label 0 and with label 1.
SAMPLE = (8_000, 4_000)
ALPHA, BETA, L1, L2 = 5.0, 1.0, 4.0, 0.0
THRESHOLD = 0.7

_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed word, pair and skip-pair indices of a text, with repeats."""
    if not text:
        return np.empty(0, np.int64)
    words = text.encode("utf-8", "surrogatepass").translate(_LETTERS).split()
    h = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
    parts = [h * np.uint64(0x9E3779B97F4A7C15)]
    for gap, odd in ((1, 0xC2B2AE3D27D4EB4F), (2, 0x165667B19E3779F9)):
        if len(h) > gap:
            parts.append((h[:-gap] * np.uint64(odd) + h[gap:]) * np.uint64(0x9E3779B97F4A7C15))
    return (np.concatenate(parts) >> np.uint64(64 - bits)).astype(np.int64)


def _featurise(batches):
    for b in small(batches):
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("label"), pa.array([np.unique(features(t)).astype(np.int32) for t in b.column("text").to_pylist()], pa.list_(pa.int32()))],
            names=["doc_id", "label", "x"],
        )


class Ftrl:
    """FTRL-proximal state: gradient sums ``z`` and squared gradient sums ``n``
    of ``2**bits`` weights and, last, the intercept."""

    def __init__(self, bits: int = BITS):
        self.size = 1 << bits
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, i: np.ndarray) -> np.ndarray:
        z = self.z[i]
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[i])) / ALPHA + L2)
        return np.where(np.abs(z) <= L1, 0.0, w)

    def learn(self, x: np.ndarray, y: int) -> None:
        """One row: its distinct feature indices and label."""
        x = np.append(np.asarray(x, np.int32), np.int32(self.size))
        w = self.weights(x)
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        root = np.sqrt(self.n[x])
        self.n[x] += g * g
        self.z[x] += g - (np.sqrt(self.n[x]) - root) / ALPHA * w

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        """(indices, weights, intercept), zero weights left out."""
        w = self.weights(np.arange(self.size + 1))
        kept = np.nonzero(w[: self.size])[0]
        return kept.astype(np.int32), w[kept], float(w[self.size])


def fit_ftrl(rows, labels, bits: int = BITS, passes: int = PASSES) -> tuple[np.ndarray, np.ndarray, float]:
    """Model from lists of index arrays and 0/1 labels."""
    state = Ftrl(bits)
    for _ in range(passes):
        for x, y in zip(rows, labels):
            state.learn(x, y)
    return state.model()


def _learned(batches):
    """Every row of the (only) partition, in turn, to the model: non-zero weights, the intercept last."""
    state = Ftrl()
    for b in batches:
        lists, y = b.column("x"), b.column("label").to_numpy()
        values, offsets = lists.values.to_numpy(), lists.offsets.to_numpy()
        for i in range(b.num_rows):
            state.learn(values[offsets[i] : offsets[i + 1]], y[i])
    index, weight, intercept = state.model()
    yield pa.RecordBatch.from_arrays([pa.array(np.append(index, np.int32(state.size))), pa.array(np.append(weight, intercept))], names=["i", "w"])


def train(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE):
    """Model from at most ``sample`` rows of each label outside the held-out
    fold (those of least id hash).  One executor task streams the sample ``PASSES``
    times; only the model's non-zero weights come back."""
    known = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (remainder(3) != 1))
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
    )
    chosen = least_by_hash(known, dict(enumerate(sample)))
    featured = texts_of(docs, chosen).mapInArrow(_featurise, "doc_id long, label int, x array<int>")
    # An order that has nothing to do with time or label.
    rows = cut(featured.repartition(1).sortWithinPartitions(F.xxhash64("doc_id", F.lit("order")), "doc_id"))
    # Copies of one partition are read one after another, in whichever order: the passes.
    passes = reduce(DataFrame.union, [rows] * PASSES).coalesce(1)
    told = passes.mapInArrow(_learned, "i int, w double").toArrow()
    if not told.num_rows:
        return Ftrl().model()
    i, w = told.column("i").to_numpy(), told.column("w").to_numpy()
    return i[:-1], w[:-1], float(w[-1])


def _scores(model):
    """A function from a text to its score, with the weights laid out as a table."""
    index, weight, intercept = model
    table = np.zeros(1 << BITS)
    table[index] = weight

    def score_of(text):
        x = features(text)
        hit = np.unique(x[table[x] != 0])
        return 1.0 / (1.0 + np.exp(-np.clip(intercept + table[hit].sum(), -35, 35)))

    return score_of


def score(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    model = train(docs, labels, sample)

    def rows(batches):
        score_of = _scores(model)
        for b in small(batches):
            scores = pa.array([score_of(t) for t in b.column("text").to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), scores], names=["doc_id", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double").select(
        "doc_id",
        F.coalesce(remainder(3) == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the model does not reject, columns unchanged."""
    model = train(docs, labels, sample)

    def rows(batches):
        score_of = _scores(model)
        for b in small(batches):
            stay = [bool(score_of(t) < THRESHOLD) for t in b.column("_row").field("text").to_pylist()]
            yield b.filter(pa.array(stay, pa.bool_()))

    whole = packed(docs)
    return whole.mapInArrow(rows, whole.schema).select("_row.*")
