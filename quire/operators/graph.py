"""Cross-reference graphs from annotated character spans."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.lineage import cut


#: Rows that a task sweeps at a time, at the least.
SWEPT = 1 << 16


def _least_before(group: np.ndarray, end: np.ndarray, point: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """For rows in order: the least weight of the points of a row's group that
    stand before it and end no earlier, or the number of rows if there is none.

    Blocks of rows are halved again and again; the points of each left half, in
    the order of their ends, hand their least weight on to the right half.
    """
    n = len(end)
    at, least = np.arange(n), np.full(n, n)
    order = np.lexsort((~point, np.negative(end), group))
    for level in reversed(range(int(n - 1).bit_length())):
        start = order >> level + 1 << level + 1
        right = (order >> level & 1).astype(bool)
        run = np.ones(n, np.int64)
        run[1:] = (start[1:] != start[:-1]) | (group[order[1:]] != group[order[:-1]])
        drop = np.cumsum(run) * (n + 1)  # every run lies below the one before, so one pass takes the minima of all
        low = np.minimum.accumulate(np.where(point[order] & ~right, weight[order], n) - drop) + drop
        least[order[right]] = np.minimum(least[order[right]], low[right])
        before = np.cumsum(right) - right - (start >> 1)  # of the right half, so far in the block
        halves = np.empty(n, np.int64)
        halves[np.where(right, start + (1 << level) + before, at - before)] = order
        order = halves
    return least


def _swept(keys: list[str], names: list[str], step: int):
    """Segments and spans in order of group and start to spans with ``seg_ord``.

    Of the open group's segments only those are held that no other outdoes in
    both end and shortness, so nothing is paired and a group may have any size.
    """

    def sweep(batches: list) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        b = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
        new = np.zeros(b.num_rows, bool)
        for k in keys:
            code = b.column(k).dictionary_encode(null_encoding="encode").indices.to_numpy()
            new[1:] |= code[1:] != code[:-1]
        group, point = np.cumsum(new), ~b.column("_span").to_numpy(zero_copy_only=False)
        start, end = (pc.fill_null(b.column(c), 0).to_numpy(zero_copy_only=False) for c in "se")
        segments = np.nonzero(point)[0]
        best = segments[np.lexsort((b.column("seg_ord").take(pa.array(segments)).to_numpy(zero_copy_only=False), (end - start)[segments]))]
        weight = np.full(b.num_rows, b.num_rows)
        weight[best] = np.arange(len(best))
        spans = np.nonzero(~point)[0]
        least = _least_before(group, end, point, weight)[spans]
        found = pa.array(np.append(best, 0)[np.minimum(least, len(best))], mask=least == b.num_rows)
        out = [b.column(c).take(pa.array(spans)) for c in names[:-1]] + [b.column("seg_ord").take(found)]
        last = segments[group[segments] == group[-1]]
        last = last[np.lexsort((weight[last], np.negative(end[last])))]
        kept = np.ones(len(last), bool)
        kept[1:] = weight[last[1:]] < np.minimum.accumulate(weight[last])[:-1]
        return pa.RecordBatch.from_arrays(out, names=names), b.take(pa.array(last[kept]))

    def rows(batches):
        held, n, most = [], 0, step
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= most:
                done, open_ = sweep(held)
                yield done
                held, n, most = [open_], open_.num_rows, max(step, 2 * open_.num_rows)
        if n:
            yield sweep(held)[0]

    return rows


def smallest_containing(segments: DataFrame, spans: DataFrame, keys: list[str], cell: int = 4096, step: int = SWEPT) -> DataFrame:
    """Each span (``s, e``) with the shortest segment that contains it, ties to
    the first (``seg_ord``); spans that none contains keep nulls.

    Both sides are dealt to cells of ``cell`` units: a segment to every cell
    from its start's on, a span to its start's.  Each cell is swept once in the
    order of starts, so spans are never paired with the segments around them.
    """
    dealt = [*keys, "_cell"]
    known = reduce(Column.__and__, [F.col(c).isNotNull() for c in (*keys, "e")])
    seg = segments.select(*keys, "seg_ord", "s", "e").where(known & (F.col("e") >= F.col("s")))
    seg = seg.withColumns({"_cell": F.explode(F.sequence(F.floor(F.col("s") / cell), F.floor(F.col("e") / cell))), "_span": F.lit(False)})
    both = spans.withColumns({"_cell": F.when(known, F.floor(F.col("s") / cell)), "_span": F.lit(True)}).unionByName(seg, allowMissingColumns=True)
    names = [*spans.columns, "seg_ord"]
    swept = both.repartition(*dealt).sortWithinPartitions(*dealt, "s", "_span")
    return swept.mapInArrow(_swept(dealt, names, step), T.StructType([T.StructField(n, both.schema[n].dataType) for n in names]))


def resolve_up(nodes: DataFrame) -> DataFrame:
    """``node_id, code``: a node's own code or that of its nearest ancestor with
    one, by pointer doubling; a cycle without a code is an error."""
    state = cut(nodes.select("node_id", F.when(F.col("code").isNull(), F.col("parent_id")).alias("at"), "code"))
    before = None
    while left := state.where("at is not null").count():
        if left == before:
            raise ValueError(f"{left} nodes are on or below a cycle")
        before = left
        up = state.select(F.col("node_id").alias("at"), F.col("at").alias("_at"), F.col("code").alias("_code"))
        going = state.where("at is not null").join(up, "at").select("node_id", F.col("_at").alias("at"), F.col("_code").alias("code"))
        state = cut(state.where("at is null").unionByName(going))
    return state.where("code is not null").select("node_id", "code")


def edge_counts(citations: DataFrame) -> DataFrame:
    """``source, target, n`` of resolved citations between different nodes."""
    return citations.where(F.col("source").isNotNull() & F.col("target").isNotNull() & (F.col("source") != F.col("target"))).groupBy("source", "target").agg(F.count("*").alias("n"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "n")


def top_edges(edges: DataFrame, k: int = 20) -> DataFrame:
    """Each source's ``k`` heaviest edges, ties by target."""
    order = Window.partitionBy("source").orderBy(F.col("n").desc(), F.col("target"))
    return edges.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def counters(citations: DataFrame) -> DataFrame:
    """Resolved, self and unresolved citations of the whole frame, in one row."""
    s, t = F.col("source"), F.col("target")
    return citations.agg(
        F.count_if(s.isNotNull() & t.isNotNull() & (s != t)).alias("resolved"),
        F.count_if(s.isNotNull() & (s == t)).alias("self_citations"),
        F.count_if(s.isNull()).alias("unresolved_sources"),
        F.count_if(s.isNotNull() & t.isNull()).alias("unresolved_targets"),
    )


def node_records(nodes: DataFrame, edges: DataFrame, k: int = 20) -> DataFrame:
    """Per node: its outgoing and incoming edges after the cap, and their total."""
    out = top_edges(edges, k).groupBy("source").agg(F.count("*").alias("n_out"), F.sum("n").alias("weight_out"))
    back = top_edges(transpose(edges), k).groupBy("source").agg(F.count("*").alias("n_in"), F.sum("n").alias("weight_in"))
    joined = nodes.join(out.withColumnRenamed("source", "node"), "node", "left").join(back.withColumnRenamed("source", "node"), "node", "left")
    return joined.fillna(0, ["n_out", "weight_out", "n_in", "weight_in"]).withColumn("total_links", F.col("n_out") + F.col("n_in"))


def citations_in(texts: DataFrame, pattern: str = r"(?i)\bcondition\s+(\d+[A-Za-z]?)") -> DataFrame:
    """``node, target``: every citation that the pattern's first group finds."""
    return texts.select("node", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("target"))


def page_range(items: DataFrame, overrides: DataFrame, offsets: DataFrame) -> DataFrame:
    """PDF pages of items (doc, number, page_start, page_end): a fixed range
    where ``overrides`` has one, else shifted by the document's offset."""
    o = overrides.select("doc", "number", F.col("start").alias("_os"), F.col("end").alias("_oe"))
    joined = items.join(o, ["doc", "number"], "left").join(offsets, "doc", "left").fillna(0, ["offset"])
    low = F.greatest(F.lit(1), F.col("page_start") + F.col("offset"))
    high = F.greatest(F.lit(1), F.coalesce("page_end", "page_start") + F.col("offset"))
    known = F.col("page_start").isNotNull()
    return joined.select(
        "doc", "number", "page_start",
        F.when(known, F.coalesce("_os", low)).alias("pdf_start"), F.when(known, F.coalesce("_oe", high)).alias("pdf_end"),
    )


def page_lookup(pages: DataFrame, items: DataFrame, cell: int = 64) -> DataFrame:
    """Item of each page (doc, page): the first (``ord``) that contains it, else
    the nearest that starts before it.  Containment is a join by equality on
    cells of ``cell`` pages, the nearest start one ordered pass over both sides."""
    cells = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor(F.col("end") / cell)))
    spread = items.where("end >= start").select("doc", "start", "end", "ord", "item", cells.alias("_cell"))
    inside = pages.select("doc", "page", F.floor(F.col("page") / cell).alias("_cell")).distinct().join(spread, ["doc", "_cell"]).where("start <= page and page <= end")
    first = inside.groupBy("doc", "page").agg(F.min(F.struct("ord", "item")).alias("in"))
    starts = items.select("doc", F.col("start").alias("at"), F.struct("start", (-F.col("ord")).alias("o"), "item").alias("s"))
    both = starts.unionByName(pages.select("doc", F.col("page").alias("at")), allowMissingColumns=True)
    # Of items that start on the page itself all come before it.
    order = Window.partitionBy("doc").orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    near = both.withColumn("near", F.max("s").over(order)).where("s is null").select("doc", F.col("at").alias("page"), F.col("near.item").alias("near"))
    return near.join(first, ["doc", "page"], "left").select("doc", "page", F.coalesce(F.col("in.item"), F.col("near")).alias("item"))
