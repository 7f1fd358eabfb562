"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed letter 1- to 3-grams
(letters lower-cased, everything else one gap).  Every language has several
centroids from spherical k-means over a bounded training sample; the language
of the most similar centroid wins, and a text whose best cosine is under
``min_cosine`` (too far from all of them) is rejected as ``und``.

Null texts and texts without a letter are ``und`` with score 0.  Null lang or
doc_id are not learned from; a null doc_id counts as not held out.  Ties go to
the language that sorts first.  With nothing to learn from all is ``und``.
Repeated rows are predicted alike; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small
from .training import least_by_hash, remainder, texts_of

DIMENSIONS, PER_LANGUAGE, SAMPLE, CENTROIDS = 4096, 400, 4_000, 4
UNKNOWN = "und"


def letter_table() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(1 << 16)), bool, 1 << 16)


def ngram_counts(text: str | None, letters: np.ndarray, dimensions: int = DIMENSIONS) -> np.ndarray | None:
    """Counts of hashed letter n-grams, or None for a text without a letter."""
    if not text:
        return None
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    low = letters[np.minimum(c, 0xFFFF)]
    if len(far := np.nonzero(c > 0xFFFF)[0]):
        low = low.copy()
        low[far] = [chr(x).isalpha() for x in c[far]]
    if not low.any():
        return None
    c = np.where(low, c, 0).astype(np.uint32)
    stay = np.ones(len(c), bool)
    stay[1:] = (c[1:] != 0) | (c[:-1] != 0)
    c = np.concatenate(([0], c[stay], [0])).astype(np.uint32)
    one = c * np.uint32(0x9E3779B1)
    two = (one[:-1] ^ (c[1:] + np.uint32(0x7F4A7C15))) * np.uint32(0x85EBCA6B)
    three = (two[:-1] ^ (c[2:] + np.uint32(0x165667B1))) * np.uint32(0xC2B2AE35)
    shift = np.uint32(32 - int(dimensions).bit_length() + 1)
    counts = np.bincount(three >> shift, minlength=dimensions)
    counts += np.bincount(two >> shift, minlength=dimensions)
    counts += np.bincount(one >> shift, minlength=dimensions)
    return counts


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(counts) * idf
    return v / np.linalg.norm(v, axis=-1, keepdims=True)


def _clusters(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the mean's farthest rows in turn."""
    centres = [x[np.argmin(x @ x.mean(axis=0))]]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.argmin(np.max(x @ np.array(centres).T, axis=1))])
    c = np.array(centres)
    for _ in range(rounds):
        of = np.argmax(x @ c.T, axis=1)
        for i in range(len(c)):
            if (own := of == i).any():
                m = x[own].mean(axis=0)
                c[i] = m / np.linalg.norm(m)
    return c


def fit(counts: np.ndarray, langs: list[str], centroids: int = CENTROIDS):
    """(idf, centroids, language of each centroid)."""
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))) + 1
    x = _weigh(counts, idf)
    found, names = [], []
    for lang in sorted(set(langs)):
        c = _clusters(x[[i for i, l in enumerate(langs) if l == lang]], centroids)
        found.append(c)
        names += [lang] * len(c)
    return idf, np.concatenate(found), names


def _count_rows(batches):
    letters = letter_table()
    for b in small(batches):
        for d, lang, text in zip(b.column("doc_id").to_pylist(), b.column("label").to_pylist(), b.column("text").to_pylist()):
            if (c := ngram_counts(text, letters)) is not None:
                yield pa.RecordBatch.from_arrays([pa.array([d]), pa.array([lang]), pa.array([c.astype(np.int32).tobytes()])], names=["doc_id", "label", "x"])


def train(docs: DataFrame, per_language: int = PER_LANGUAGE, sample: int = SAMPLE, centroids: int = CENTROIDS):
    """Model from at most ``per_language`` rows of a language and ``sample``
    rows in all, outside the held-out fold (those of least id hash)."""
    known = (
        docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.col("lang").alias("label"), "text")
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & F.col("text").isNotNull() & (remainder(4) != 2))
        .select("doc_id", "label")
    )
    n = known.select("label").distinct().count()
    chosen = least_by_hash(known, min(per_language, max(1, sample // max(1, n)))).groupBy("doc_id").agg(F.min("label").alias("label"))
    rows = texts_of(docs, chosen).mapInArrow(_count_rows, "doc_id long, label string, x binary").toArrow()
    if not rows.num_rows:
        return None
    order = np.argsort(rows.column("doc_id").to_numpy(), kind="stable")
    x, y = rows.column("x").to_pylist(), rows.column("label").to_pylist()
    return fit(np.array([np.frombuffer(x[i], np.int32) for i in order]), [y[i] for i in order], centroids)


def predict(docs: DataFrame, model, min_cosine: float = 0.0) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` of every row of ``docs``."""

    def rows(batches):
        letters = letter_table()
        if model is not None:
            idf, centres, names = model
            table = np.ascontiguousarray(centres.T)
        for b in small(batches):
            lang, score = [], []
            for text in b.column("text").to_pylist():
                c = None if model is None else ngram_counts(text, letters)
                if c is None:
                    lang.append(UNKNOWN)
                    score.append(0.0)
                    continue
                i = np.nonzero(c)[0]
                v = np.log1p(c[i]) * idf[i]
                s = v @ table[i] / np.sqrt(v @ v)
                best = int(np.argmax(s))
                near = min(1.0, max(0.0, float(s[best])))
                lang.append(names[best] if near >= min_cosine else UNKNOWN)
                score.append(near)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, lang_pred string, score double").select(
        "doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def identify(docs: DataFrame, min_cosine: float = 0.0) -> DataFrame:
    """Train on the learnable rows of ``docs`` and predict every row."""
    return predict(docs, train(docs), min_cosine)
