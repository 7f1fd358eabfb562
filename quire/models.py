"""Hooks for outside models: batch functions run over Arrow batches.

A hook takes a list of texts and returns a list of the same length.  The
stand-ins are deterministic, for tests and offline use.
"""

from __future__ import annotations

import hashlib
import logging
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


_LOG = logging.getLogger(__name__)


def apply_batches(
    df: DataFrame, text: str, out: str, kind: str, model: Callable[[list], list], batch: int = 10, tries: int = 3, wait: float = 1.0,
    passing: tuple[type[Exception], ...] = (OSError, RuntimeError), failures: Accumulator | None = None,
) -> DataFrame:
    """``df`` with ``out`` from ``model``; a batch whose tries all fail gets null
    (and so stays pending for the next run).

    Only errors of ``passing`` kinds are tried again, logged, and counted by row
    in ``failures``; any other is a fault of the hook and fails the job, as does
    an answer of another length than its batch."""
    pa_type = to_arrow_type(T.StructType.fromDDL(f"{out} {kind}")[0].dataType)

    def call(texts):
        for attempt in range(tries):
            try:
                answers = model(texts)
                break
            except passing as error:
                _LOG.warning("batch of %d failed, try %d of %d: %r", len(texts), attempt + 1, tries, error)
                if attempt + 1 < tries:
                    time.sleep(wait * 2**attempt)
        else:
            if failures is not None:
                failures.add(len(texts))
            return [None] * len(texts)
        if len(answers) != len(texts):
            raise ValueError(f"{len(answers)} answers to {len(texts)} texts")
        return answers

    def rows(batches):
        for b in batches:
            for i in range(0, b.num_rows, batch):
                part = b.slice(i, batch)
                values = call(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(values, pa_type)], names=[*part.schema.names, out])

    return df.mapInArrow(rows, T.StructType([*df.schema.fields, *T.StructType.fromDDL(f"{out} {kind}").fields]))


def hash_embedder(dimensions: int) -> Callable[[list], list]:
    """Stand-in embedder: components from a digest of the text."""

    def embed(texts):
        out = []
        for t in texts:
            d = b"".join(hashlib.sha256(f"{i}:{t}".encode()).digest() for i in range(-(-dimensions // 32)))
            out.append([x / 127.5 - 1 for x in d[:dimensions]])
        return out

    return embed


def first_sentence(limit: int = 4500) -> Callable[[list], list]:
    """Stand-in summariser."""
    return lambda texts: [(t or "")[:limit].split(".")[0] for t in texts]
