"""Bounded, repeatable training samples for the classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Labels that a sample can have, and the bits of a doc_id's hash looked at in turn.
LABELS, STEPS = 1000, (16, 8, 0)


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo ``n`` (null for a null doc_id)."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def least_by_hash(rows: DataFrame, limit: int | dict, labels: int = LABELS) -> DataFrame:
    """Up to ``limit`` rows (a number, or one for each label) of each ``label``,
    those of least doc_id hash: ``doc_id, label``.  Only the ``labels`` most
    frequent labels are taken.

    No task gathers a label: counts of the hash's leading bits, eight at a time,
    give each label a hash below which it has ``limit`` rows at most.  It may
    fall short by the rows that share 24 bits of hash with the next one.  The
    driver sees ``labels`` times 256 counts.
    """
    spark, kind = rows.sparkSession, rows.schema["label"].dataType
    rows = cut(rows.select("doc_id", "label", F.shiftrightunsigned(F.xxhash64("doc_id"), 40).alias("_h")))
    known = rows.groupBy("label").count().orderBy(F.col("count").desc(), "label").limit(labels).select("label").collect()
    left = {r["label"]: limit if isinstance(limit, int) else limit[r["label"]] for r in known}
    below = dict.fromkeys(left, 1 << 24)
    prefix = dict.fromkeys(left, 0)
    for shift in STEPS:
        if not prefix:
            break
        some = rows.join(F.broadcast(_table(spark, kind, prefix, "_prefix")), "label").where(F.shiftright("_h", shift + 8) == F.col("_prefix"))
        found: dict = {}
        for r in some.groupBy("label", F.shiftright("_h", shift).alias("at")).count().collect():
            found.setdefault(r["label"], []).append((r["at"], r["count"]))
        prefix = {}
        for label, counts in found.items():
            for at, n in sorted(counts):
                if n > left[label]:
                    below[label], prefix[label] = at << shift, at
                    break
                left[label] -= n
    return rows.join(F.broadcast(_table(spark, kind, below, "_below")), "label").where("_h < _below").select("doc_id", "label")


def _table(spark, kind, values: dict, name: str) -> DataFrame:
    return spark.createDataFrame(list(values.items()), T.StructType([T.StructField("label", kind), T.StructField(name, T.LongType())]))


def texts_of(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """``chosen`` (doc_id, label; one row per doc_id, at most a few thousand as
    ``least_by_hash`` bounds them) with the whole text of each document.  Of
    rows that repeat a doc_id the one with the least text hash counts, so a
    repeated id cannot pass the bound."""
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return (
        texts.join(F.broadcast(chosen), "doc_id")
        .groupBy("doc_id", "label")
        .agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text"))["text"].alias("text"))
    )
