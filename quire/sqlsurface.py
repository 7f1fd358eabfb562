"""The library from SQL: tables as views, column functions as SQL functions.

The functions are SQL expressions, so the optimiser sees through them and
nothing leaves the JVM.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

from quire.sources import table

#: name -> (parameters, result, body).
FUNCTIONS = {
    "normal_title": ("t STRING", "STRING", r"trim(regexp_replace(lower(t), '(?U)\\s+', ' '))"),
    "title_hash": ("t STRING", "STRING", r"sha2(trim(regexp_replace(lower(t), '(?U)\\s+', ' ')), 256)"),
    "alnum_fold": ("t STRING", "STRING", r"regexp_replace(lower(t), '[^\\p{L}\\p{N}]', '')"),
    "word_tokens": ("t STRING", "ARRAY<STRING>", r"regexp_extract_all(lower(t), '([\\p{L}\\p{N}]+)', 1)"),
    "reference_number": ("t STRING", "STRING", "split_part(trim(t), '.', 1)"),
    "token_estimate": ("t STRING", "BIGINT", "CAST(floor(length(t) / 3) AS BIGINT)"),
    "dot_product": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x)"),
    "cosine": (
        "a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "DOUBLE",
        "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / nullif(sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x)), 0D)",
    ),
}


def register_functions(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create the functions as temporary ones; returns their names."""
    for name, (parameters, result, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {result} RETURN {body}")
    return [prefix + n for n in FUNCTIONS]


def register_tables(spark: SparkSession, sf_dir: str, names: list[str]) -> None:
    """Views over the Parquet tables of a folder."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(os.path.basename(name))
