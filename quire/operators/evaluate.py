"""Retrieval metrics, stability, diagnostics, build diffs and validation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import vector

#: Keys of two builds that one task compares.
KEYS = 1 << 19


def gold_condition() -> Column:
    """Every field that a gold entry states must match (title: part of it)."""
    return (
        (F.col("g.document_id").isNull() | (F.col("g.document_id") == F.col("r.document_id")))
        & (F.col("g.condition").isNull() | (F.col("g.condition") == F.col("r.condition")))
        & (F.col("g.title").isNull() | F.contains(F.lower("r.title"), F.lower("g.title")))
    )


def gold_ranks(results: DataFrame, gold: DataFrame) -> DataFrame:
    """``query_id, first_rank``: the best rank of a gold item, null if none."""
    hits = results.alias("r").join(gold.alias("g"), (F.col("r.query_id") == F.col("g.query_id")) & gold_condition(), "left_semi")
    first = hits.groupBy("query_id").agg(F.min("rank").alias("first_rank"))
    return gold.select("query_id").distinct().join(first, "query_id", "left")


def collapsed_rank(results: DataFrame, group: str) -> DataFrame:
    """Rank after keeping only the first result of each group per query."""
    first = results.groupBy("query_id", group).agg(F.min("rank").alias("rank"))
    return first.withColumn("group_rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))


def metrics(ranks: DataFrame, cuts: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """hit@k, MRR and recall over queries (a missing rank counts as a miss)."""
    r = F.col("first_rank")
    return ranks.agg(
        F.count("*").alias("n_queries"),
        *[F.avg(F.when(r <= k, 1.0).otherwise(0.0)).alias(f"hit_at_{k}") for k in cuts],
        F.avg(F.coalesce(1.0 / r, F.lit(0.0))).alias("mrr"),
        F.avg(r.isNotNull().cast("double")).alias("recall"),
    )


def outcome(pool_rank: Column, final_rank: Column) -> Column:
    return (
        F.when(pool_rank.isNull(), "not_retrieved").when(final_rank == 1, "hit").when(final_rank <= 5, "top5_not_first").otherwise("outside_top5")
    )


def run_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Queries whose rank differs between two runs, nulls compared as values."""
    b, a = before.select("query_id", F.col("first_rank").alias("rank_before")), after.select("query_id", F.col("first_rank").alias("rank_after"))
    return a.join(b, "query_id", "left").where(~F.col("rank_before").eqNullSafe(F.col("rank_after")))


def overlap(full: DataFrame, other: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, overlap, mean_shift`` of two top-k lists (query_id, item_id, rank)."""
    both = full.alias("a").join(other.alias("b"), ["query_id", "item_id"], "full_outer").select("query_id", F.col("a.rank").alias("ra"), F.col("b.rank").alias("rb"))
    shared = F.col("ra").isNotNull() & F.col("rb").isNotNull()
    return both.groupBy("query_id").agg((F.count_if(shared) / k).alias("overlap"), F.avg(F.when(shared, F.abs(F.col("ra") - F.col("rb")))).alias("mean_shift"))


def centroid_sums(items: DataFrame, group: str) -> DataFrame:
    """``group, place, s, n``: component sums of unit vectors per group (vec)."""
    unit = items.select(group, F.posexplode(vector.normalize(F.col("vec"))).alias("place", "x"))
    return unit.groupBy(group, "place").agg(F.sum("x").alias("s"), F.count("*").alias("n"))


def type_stats(items: DataFrame, group: str) -> DataFrame:
    """Per group: count, mean cosine of its pairs and centroid drift (one minus
    the mean cosine to the centroid).  Exact over all pairs without listing
    any: the pair sum of unit vectors is (|sum|^2 - n) / 2."""
    s = centroid_sums(items, group).groupBy(group).agg(F.sum(F.col("s") * F.col("s")).alias("q"), F.max("n").alias("n"))
    n = F.col("n")
    return s.select(
        group, n.alias("n_items"),
        F.when(n > 1, (F.col("q") - n) / (n * (n - 1))).alias("mean_cosine"),
        F.when(n > 1, 1 - F.sqrt("q") / n).otherwise(0.0).alias("centroid_drift"),
    )


def similarity_matrix(items: DataFrame, group: str) -> DataFrame:
    """``type_a, type_b, mean_cosine`` of all pairs between different groups,
    from group sums alone."""
    s = centroid_sums(items, group)
    a = s.select(F.col(group).alias("type_a"), "place", F.col("s").alias("sa"), F.col("n").alias("na"))
    b = s.select(F.col(group).alias("type_b"), "place", F.col("s").alias("sb"), F.col("n").alias("nb"))
    pairs = a.join(b, "place").where("type_a < type_b")
    return pairs.groupBy("type_a", "type_b").agg((F.sum(F.col("sa") * F.col("sb")) / (F.max("na") * F.max("nb"))).alias("mean_cosine"))


def capacity(items: DataFrame, group: str, limit: int) -> DataFrame:
    """Per group: count, characters, floor average, share of the limit, items over it, token estimate."""
    n = F.length("text")
    return items.groupBy(group).agg(
        F.count("*").alias("n_items"), F.sum(n).alias("total_chars"), F.floor(F.sum(n) / F.count("*")).alias("avg_chars"),
        F.round(100.0 * F.sum(n) / F.count("*") / limit, 4).alias("usage_pct"), F.count_if(n > limit).alias("n_over"), F.floor(F.sum(n) / 3).alias("token_estimate"),
    )


def diff(previous: DataFrame, current: DataFrame, key: str, content: str) -> DataFrame:
    """``key, status`` for every key of either build: added, removed, mutated or same."""
    p, c = previous.select(key, F.col(content).alias("_p"), F.lit(True).alias("_in_p")), current.select(key, F.col(content).alias("_c"), F.lit(True).alias("_in_c"))
    status = F.when(F.col("_in_p").isNull(), "added").when(F.col("_in_c").isNull(), "removed").when(~F.col("_p").eqNullSafe(F.col("_c")), "mutated").otherwise("same")
    return p.join(c, key, "full_outer").select(key, status.alias("status"))


def vertical_holes(boxes: DataFrame, keys: list[str], minimum: float = 60.0) -> DataFrame:
    """Gaps between a box's bottom and the top of the next one down that pass ``minimum``."""
    order = Window.partitionBy(*keys).orderBy(F.col("t").desc(), F.col("box_id"))
    return boxes.withColumn("gap", F.col("b") - F.lead("t").over(order)).where(F.col("gap") > minimum)


def monotone(rows: DataFrame, keys: list[str], order_by: str, value: str) -> DataFrame:
    """Per group: does ``value`` never fall in the order of ``order_by``?"""
    step = F.col(value) - F.lag(value).over(Window.partitionBy(*keys).orderBy(order_by))
    return rows.withColumn("_step", step).groupBy(*keys).agg(F.every(F.coalesce(F.col("_step") >= 0, F.lit(True))).alias("non_decreasing"))


def missing(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only, with ``side``: expected or actual.  A key with a
    null is on neither other side.  Keys are dealt to as many tasks as their
    number asks for: adaptive execution judges by bytes, of which keys in order have few."""
    parts = max(1, -(-(expected.count() + actual.count()) // KEYS))
    both = expected.select(*keys, F.lit(True).alias("_e")).unionByName(actual.select(*keys, F.lit(False).alias("_e")))
    found = both.repartition(parts, *keys).groupBy(*keys).agg(F.bool_or("_e").alias("_a"), F.bool_or(~F.col("_e")).alias("_b"))
    unknown = reduce(Column.__or__, [F.col(k).isNull() for k in keys])
    sides = F.array(F.when(F.col("_a") & (~F.col("_b") | unknown), "expected"), F.when(F.col("_b") & (~F.col("_a") | unknown), "actual"))
    return found.select(*keys, F.explode(F.array_compact(sides)).alias("side"))


def build_sums(previous: DataFrame, current: DataFrame, content: str) -> DataFrame:
    """One row: nodes and characters of either build and their differences."""
    a, b = (df.agg(F.count("*").alias(f"nodes_{name}"), F.coalesce(F.sum(F.length(content)), F.lit(0)).alias(f"chars_{name}")) for name, df in (("before", previous), ("after", current)))
    return a.join(F.broadcast(b)).withColumns({"nodes_delta": F.col("nodes_after") - F.col("nodes_before"), "chars_delta": F.col("chars_after") - F.col("chars_before")})


def baseline_distribution(items: DataFrame, steps: int = 5) -> DataFrame:
    """Mean, population deviation and range of the cosine of ``steps`` pairs
    per item (``item_id, vec``), each with the items that many ids further."""
    each = items.select("item_id", F.col("vec").alias("_other"), F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("_step"))
    ahead = each.select((F.col("item_id") + F.col("_step")).alias("item_id"), "_other")
    c = items.join(ahead, "item_id").select(vector.cosine(F.col("vec"), F.col("_other")).alias("c"))
    return c.agg(F.count("c").alias("n_pairs"), F.avg("c").alias("mean"), F.stddev_pop("c").alias("deviation"), F.min("c").alias("low"), F.max("c").alias("high"))
