"""Catalogue, incremental and versioning operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions.text import tokens


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """``table_name, n``: one row for each table."""
    rows = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    return reduce(DataFrame.unionAll, rows)


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``work`` that ``done`` lacks."""
    return work.select(*keys).distinct().join(done.select(*keys), keys, "left_anti")


def insert_if_absent(target: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``target`` with the rows of ``new`` whose key it lacks, once per key."""
    fresh = new.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh)


def supersede(versions: DataFrame, key: str, *latest: Column) -> DataFrame:
    """Adds ``is_current``: true for the first row of each key in ``latest`` order."""
    order = Window.partitionBy(key).orderBy(*latest)
    return versions.withColumn("is_current", F.row_number().over(order) == 1)


def with_counts(parents: DataFrame, children: DataFrame, parent_key: str, child_key: str, **aggregates: Column) -> DataFrame:
    """``parents`` with aggregates of their children (0 where there is none)."""
    found = children.groupBy(F.col(child_key).alias(parent_key)).agg(*[a.alias(n) for n, a in aggregates.items()])
    return parents.join(found, parent_key, "left").fillna(0, list(aggregates))


def first_alias(texts: DataFrame, text: str, aliases: list[tuple[str, str]], name: str = "target") -> DataFrame:
    """Target of the first alias pattern (in list order) that occurs in the text."""
    hit = reduce(lambda c, p: c.when(F.col(text).rlike(p[0]), p[1]), aliases[1:], F.when(F.col(text).rlike(aliases[0][0]), aliases[0][1]))
    return texts.withColumn(name, hit)


def scope_filter(documents: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """Case-insensitive LIKE over any of ``columns``; wildcards in ``pattern`` hold."""
    return documents.where(reduce(lambda a, b: a | b, [F.col(c).ilike(f"%{pattern}%") for c in columns]))


def coalesce_update(rows: DataFrame, updates: DataFrame, key: str, column: str) -> DataFrame:
    """``rows`` with ``column`` replaced where ``updates`` has a value."""
    new = updates.select(key, F.col(column).alias("_new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("_new", column)).drop("_new")


def best_match(left: DataFrame, right: DataFrame, name: str = "name") -> DataFrame:
    """``name, match, score``: for every name of ``left`` the name of ``right``
    that shares most of its words, ties to the one that sorts first; null if
    none shares any.  The join is by word, so nothing is paired that shares none."""
    words = lambda df, alias: df.select(F.col(name).alias(alias)).distinct().select(alias, F.explode(F.array_distinct(tokens(F.col(alias)))).alias("_word"))
    shared = words(left, "name").join(words(right, "match"), "_word").groupBy("name", "match").agg(F.count("*").alias("score"))
    order = Window.partitionBy("name").orderBy(F.col("score").desc(), "match")
    best = shared.withColumn("_place", F.row_number().over(order)).where("_place = 1").drop("_place")
    return left.select(F.col(name).alias("name")).distinct().join(best, "name", "left")


def first_per_key(rows: DataFrame, key: Column, *order: str) -> DataFrame:
    """The first row of each key in ``order``; rows with an empty key stay out."""
    ranked = rows.withColumn("_key", key).where("_key <> ''").withColumn("_place", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))
    return ranked.where("_place = 1").drop("_place").withColumnRenamed("_key", "key")


def alias_lookup(wanted: DataFrame, documents: DataFrame, aliases: DataFrame, key: str = "key") -> DataFrame:
    """Rows of ``documents`` for each wanted key: by the key itself, else by
    what ``aliases`` (key, target) says it stands for; null if neither is there."""
    own = documents.select(F.col(key).alias("_own"), F.struct(*documents.columns).alias("_row"))
    other = own.select(F.col("_own").alias("_target"), F.col("_row").alias("_other"))
    names = aliases.select(F.col(key).alias("_alias"), F.col("target").alias("_target")).dropDuplicates(["_alias"])
    found = wanted.join(own, F.col(key) == F.col("_own"), "left").join(names, F.col(key) == F.col("_alias"), "left").join(other, "_target", "left")
    return found.select(F.col(key).alias("wanted"), F.coalesce("_row", "_other").alias("_hit")).select("wanted", "_hit.*")


def collected(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Distinct values of each group as an ordered array."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.sort_array(F.collect_set(value)).alias(name))
