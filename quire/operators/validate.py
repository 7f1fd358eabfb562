"""Structural checks of a parsed document against its lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import text as X
from quire.operators import evaluate


def dropped_content(raw: DataFrame, kept: DataFrame, keys: list[str]) -> DataFrame:
    """Raw lines (``line_id, text``) that ``kept`` lacks and whose letters and
    digits occur nowhere in the document's kept text."""
    corpus = kept.groupBy(*keys).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line_id", "text"))), lambda x: X.alnum_fold(x["text"])), "").alias("_all"))
    missing = raw.join(kept.select(*keys, "line_id"), [*keys, "line_id"], "left_anti")
    folded = missing.withColumn("_fold", X.alnum_fold(F.col("text"))).where("_fold <> ''").join(corpus, keys, "left")
    return folded.where(~F.coalesce(F.contains("_all", "_fold"), F.lit(False))).drop("_all", "_fold")


def accounted(raw: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, line_id, state`` of every id that is not exactly once in the
    output or absorbed: ``lost``, ``twice`` or ``invented``."""
    out = merged.select(*keys, "line_id").unionAll(merged.select(*keys, F.explode("absorbed").alias("line_id"))).groupBy(*keys, "line_id").agg(F.count("*").alias("_n"))
    both = raw.select(*keys, "line_id", F.lit(True).alias("_raw")).distinct().join(out, [*keys, "line_id"], "full_outer")
    state = F.when(F.col("_raw").isNull(), "invented").when(F.col("_n").isNull(), "lost").when(F.col("_n") > 1, "twice")
    return both.withColumn("state", state).where("state is not null").select(*keys, "line_id", "state")


def report(raw: DataFrame, merged: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, check, n``: how often each check fails in each document."""
    order = evaluate.monotone(merged, keys, "ord", "line_id").where("not non_decreasing").select(*keys)
    spread = merged.select(*keys, "line_id").unionAll(merged.select(*keys, F.explode("absorbed").alias("line_id")))
    texts = spread.join(raw.select(*keys, "line_id", "text"), [*keys, "line_id"])
    found = {
        "order": order,
        "ids": accounted(raw, merged, keys).select(*keys),
        "dropped": dropped_content(raw, texts, keys).select(*keys),
    }
    parts = [df.groupBy(*keys).agg(F.count("*").alias("n")).withColumn("check", F.lit(name)) for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts).select(*keys, "check", "n")
