"""Contiguous shards of near equal bytes from global prefix sums.

Rows are ranged by ``(doc_id, size, text_crc32)``, nulls last.  Each range
partition sums its own sizes as it streams by; only one total per partition
meets on the driver, whose exclusive prefix sums place every row at a global
byte offset.  A row goes to the shard in which the middle of its bytes falls,
so every cut is within half a row of its target.

Null text counts as empty: size 1, checksum 0.  Null doc_id sorts last.
Repeated rows each take their own slot, side by side.  An empty table gives an
empty result; a table smaller than the shard count leaves shards empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions

_RUNNING = "doc_id long, size long, text_crc32 long, _part int, _end long, _nth long"


def _running(batches):
    part, end, nth = TaskContext.get().partitionId(), 0, 0
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        ends = end + np.cumsum(b.column("size").to_numpy(), dtype=np.int64)
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("size"), b.column("text_crc32"), pa.array(np.full(n, part, np.int32)), pa.array(ends), pa.array(np.arange(nth, nth + n, dtype=np.int64))],
            names=["doc_id", "size", "text_crc32", "_part", "_end", "_nth"],
        )
        end, nth = int(ends[-1]), nth + n


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``slot`` counts from 0 within a shard, without gaps, in range order.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit("")).cast("binary")
    rows = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.monotonically_increasing_id().alias("_row"),
    )
    order = [F.col("doc_id").asc_nulls_last(), F.col("size"), F.col("text_crc32"), F.col("_row")]
    placed = cut(
        rows.repartitionByRange(shuffle_partitions(spark), *order)
        .sortWithinPartitions(*order)
        .drop("_row")
        .mapInArrow(_running, _RUNNING)
    )
    # One row per range partition: bounded by the partition count, not by the data.
    totals = placed.groupBy("_part").agg(F.max("_end").alias("b"), F.count("*").alias("n")).orderBy("_part").collect()
    before, at_byte, at_row = [], 0, 0
    for t in totals:
        before.append((t["_part"], at_byte, at_row))
        at_byte, at_row = at_byte + t["b"], at_row + t["n"]
    offsets = spark.createDataFrame(before, "_part int, _byte0 long, _row0 long")
    middle = 2 * (F.col("_byte0") + F.col("_end")) - F.col("size")
    # decimal(38): twice the total times the shard count passes 2**63 for huge tables
    shard = F.least(F.lit(n_shards - 1), F.floor(middle.cast("decimal(38,0)") * n_shards / F.lit(2 * max(at_byte, 1)).cast("decimal(20,0)")).cast("int"))
    spread = placed.join(F.broadcast(offsets), "_part").select(
        "doc_id", "size", "text_crc32", shard.alias("shard"), (F.col("_row0") + F.col("_nth")).alias("_at")
    )
    first = spread.groupBy("shard").agg(F.min("_at").alias("_first"))
    return spread.join(F.broadcast(first), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_at") - F.col("_first")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
