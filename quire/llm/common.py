"""Shared plumbing: checkpoints, document keys, Arrow helpers, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.lineage import bounded, cut, ensure_checkpoint_dir  # noqa: F401

NULL_ID = 2**63 - 1
#: Edges of a block that a task connects at a time, and edges that one task may gather.
FOREST_EDGES, GATHERED = 1 << 18, 1 << 20


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def document_key() -> list[Column]:
    """``_d`` (doc_id, null ranks last) and ``_t`` (hash of the text).

    Two rows agree on both only if they are the same document repeated, so
    decisions joined back on the pair never mix different texts of one id.
    """
    return [
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("_d"),
        F.xxhash64(F.coalesce(F.col("text"), F.lit("")), F.col("text").isNull()).alias("_t"),
    ]


def column(name: str) -> Column:
    """A column by its exact name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, *more: Column | str) -> DataFrame:
    """``docs`` as one struct column ``_row``, so that no name of its columns
    can clash with ours, and ``more`` columns."""
    return docs.select(F.struct(*map(column, docs.columns)).alias("_row"), *more)


def small(batches, size: int = 4 << 20):
    """Slices of Arrow batches with about ``size`` bytes of text (column ``text``,
    or that of ``_row``) or one row each, so that what Python makes of a batch
    stays small whatever a batch holds."""
    for b in batches:
        text = b.column("text") if "text" in b.schema.names else b.column("_row").field("text")
        ends = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy().astype(np.int64))
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
            yield b.slice(at, to - at)
            at = to


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that never is broadcast: it grows with the
    corpus, and adaptive execution would gather what falls under a threshold on
    the driver, where it takes several times that as a hash table."""
    return df.hint("merge")


def _least_nodes(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component) of edges held in memory."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        a, b = root[a], root[b]
        apart = a != b
        a, b = a[apart], b[apart]
        # Every root with a smaller neighbour hangs itself on the least one: half of the roots go in two rounds at least.
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    return nodes, nodes[root]


def _forest(batches):
    """Edges to stars that connect the same nodes, fewer than there are nodes, for each block."""
    held, n = [], 0
    for b in batches:
        held.append((b.column("u").to_numpy(), b.column("v").to_numpy()))
        n += b.num_rows
        if n >= FOREST_EDGES:
            yield _stars(held)
            held, n = [], 0
    if n:
        yield _stars(held)


def _stars(held: list) -> pa.RecordBatch:
    nodes, least = _least_nodes(*map(np.concatenate, zip(*held)))
    hung = nodes != least
    return pa.RecordBatch.from_arrays([pa.array(nodes[hung]), pa.array(least[hung])], names=["u", "v"])


def _labels(batches):
    """All edges, in one task, to ``node, label``."""
    held = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, least = _least_nodes(*map(np.concatenate, zip(*held)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(least)], names=["node", "label"])


def connected_components(edges: DataFrame, max_rounds: int = 60, gathered: int = GATHERED) -> DataFrame:
    """Components of ``edges`` (u long, v long): returns ``(node, label)`` with
    label the least node of the component, for every node that has an edge.

    Tasks first turn their edges into stars that connect the same nodes.  At most
    ``gathered`` of those (16 bytes each) are joined up by one task; more, by
    alternating large and small stars until few enough are left or nothing
    changes.  Every such round is an aggregation and a join on the executors; the
    driver only sees counts, and a checksum per round.
    """
    e = cut(edges.select("u", "v").where("u <> v").mapInArrow(_forest, "u long, v long"))
    if e.count() <= gathered:
        return e.coalesce(1).mapInArrow(_labels, "node long, label long")
    e = cut(e.distinct())
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        e = both.join(shuffled(least), "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        met = down.join(shuffled(least), "u")
        e = cut(
            met.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or now[0] == 0:
            break
        if now[0] <= gathered:
            return e.coalesce(1).mapInArrow(_labels, "node long, label long")
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    )
