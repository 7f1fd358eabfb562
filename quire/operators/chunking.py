"""Size-bounded chunks from ordered pieces of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUND = 40_000


def pack(pieces: DataFrame, bound: int = BOUND) -> DataFrame:
    """``source_id, part, total_parts, n_pieces, char_length, label, text``.

    ``pieces``: source_id, ord, label, text.  Greedy: a part closes when the
    next piece would take it past ``bound``; a piece longer than that is alone.
    The fold runs over each source's ordered array inside the JVM.
    """
    ordered = pieces.groupBy("source_id").agg(F.sort_array(F.collect_list(F.struct("ord", "label", "text"))).alias("p"))
    start = F.struct(F.lit(0).alias("part"), F.lit(0).alias("size"), F.array().cast("array<int>").alias("parts"))

    def step(s, x):
        n = F.length(x["text"])
        opens = (s["size"] + n > bound) & (s["size"] > 0)
        part = s["part"] + opens.cast("int")
        return F.struct(part.alias("part"), F.when(opens, n).otherwise(s["size"] + n).alias("size"), F.concat(s["parts"], F.array(part)).alias("parts"))

    rows = ordered.select("source_id", F.explode(F.arrays_zip(F.aggregate("p", start, step)["parts"].alias("part"), F.col("p"))).alias("z"))
    grouped = rows.groupBy("source_id", F.col("z.part").alias("part")).agg(F.sort_array(F.collect_list("z.p")).alias("p"))
    total = grouped.groupBy("source_id").agg(F.count("*").alias("total_parts"))
    first, last = F.col("p")[0]["label"], F.element_at("p", -1)["label"]
    text = F.array_join(F.transform("p", lambda x: x["text"]), "\n\n")
    return grouped.join(total, "source_id").select(
        "source_id", (F.col("part") + 1).alias("part"), "total_parts", F.size("p").alias("n_pieces"),
        F.aggregate("p", F.lit(0), lambda s, x: s + F.length(x["text"])).alias("char_length"),
        F.when(F.size("p") > 1, F.concat(F.lit("Clauses "), first, F.lit(" to "), last)).otherwise(F.concat(F.lit("Clause "), first)).alias("label"),
        text.alias("text"),
    )


def with_header(chunks: DataFrame, titles: DataFrame) -> DataFrame:
    """Chunks (of ``pack``) under their context line, hashed: ``chunk_uid,
    text_sha256, char_length, text``.  ``titles``: source_id, title, breadcrumb."""
    part = F.when(F.col("total_parts") > 1, F.concat(F.lit(" (Part "), F.col("part").cast("string"), F.lit("/"), F.col("total_parts").cast("string"), F.lit(": "), F.col("label"), F.lit(")"))).otherwise(F.lit(""))
    head = F.concat(F.lit("["), F.col("title"), F.lit("] > "), F.col("breadcrumb"), part, F.lit("\n\n"))
    full = F.concat(head, F.col("text"))
    uid = F.when(F.col("total_parts") > 1, F.concat(F.col("source_id").cast("string"), F.lit(":part_"), F.col("part").cast("string"))).otherwise(F.col("source_id").cast("string"))
    return chunks.join(titles, "source_id").select("source_id", uid.alias("chunk_uid"), F.sha2(full, 256).alias("text_sha256"), F.length(full).alias("char_length"), full.alias("text"))


def oversize_advice(items: DataFrame, limit: int) -> DataFrame:
    """Items (length, n_children) over ``limit`` with what to do about them."""
    over = items.where(F.col("length") > limit)
    return over.withColumn("advice", F.when(F.col("n_children") > 0, "structured summary").otherwise("overlapping chunks")).withColumn(
        "n_chunks", F.when(F.col("n_children") > 0, F.lit(1)).otherwise(F.floor(F.col("length") / max(1, limit - 5000)) + 1).cast("long")
    )


def chunk_text(chunks: DataFrame, cache: DataFrame) -> DataFrame:
    """Text of each chunk (``text_sha256, breadcrumb, text_full``): the cached
    one, else breadcrumb and full text, else the empty string."""
    fallback = F.concat("breadcrumb", F.lit("\n\n"), "text_full")
    found = chunks.join(cache.select("text_sha256", F.col("text").alias("_text")).dropDuplicates(["text_sha256"]), "text_sha256", "left")
    return found.withColumn("text", F.coalesce("_text", fallback, F.lit(""))).drop("_text")


def text_cache(chunks: DataFrame) -> DataFrame:
    """``text_sha256, text``: every distinct text once."""
    return chunks.where("text is not null").select(F.sha2("text", 256).alias("text_sha256"), "text").dropDuplicates(["text_sha256"])


def segmentation_report(chunks: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """Per group: sources, how many were cut, and their parts (``chunks`` of
    ``pack``; ``groups``: source_id and the group)."""
    sources = chunks.groupBy("source_id").agg(F.max("total_parts").alias("_parts"))
    return groups.join(sources, "source_id").groupBy(group).agg(
        F.count("*").alias("n_sources"), F.count_if(F.col("_parts") > 1).alias("n_cut"), F.sum(F.when(F.col("_parts") > 1, F.col("_parts")).otherwise(0)).alias("n_fragments")
    )
