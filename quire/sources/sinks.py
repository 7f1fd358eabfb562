"""Writers: versioned outputs, write-if-absent, text outlines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_build(df: DataFrame, path: str, build_id: str, fmt: str = "parquet") -> None:
    """One build beside the earlier ones, under ``build_id=``."""
    df.write.mode("errorifexists").format(fmt).save(f"{path}/build_id={build_id}")


def append_absent(df: DataFrame, existing: DataFrame | None, path: str, keys: list[str]) -> None:
    """Append the rows whose key ``existing`` lacks, once per key.  Null is a key like any other."""
    fresh = df.dropDuplicates(keys)
    if existing is not None:
        known = existing.select(*[F.col(k).alias(f"_known_{k}") for k in keys]).distinct()
        fresh = fresh.join(known, [fresh[k].eqNullSafe(known[f"_known_{k}"]) for k in keys], "left_anti")
    fresh.write.mode("append").parquet(path)


def write_json_records(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("errorifexists").text(path)


def write_outline(outline: DataFrame, path: str) -> None:
    """Outline lines in pre-order, as text."""
    outline.orderBy("path").select("line").write.mode("errorifexists").text(path)
