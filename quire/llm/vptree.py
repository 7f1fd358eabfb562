"""Approximate nearest neighbours by cosine over vantage-point trees.

Equal vectors are one point with its few smallest ids.  Points are dealt to
cells around vantage points, vectors of least hash, by the nearest of them; a
cell of over ``shard_rows`` points is split in shards.  A query first searches
the cell that it falls into, which bounds its ``k``-th distance, and then only
the cells whose ball (vantage point and greatest distance in it) the bound
reaches, by the triangle inequality.

A shard keeps its unit vectors in a vantage-point tree (median balls of
Euclidean distance, which orders unit vectors as cosine does) and searches a
block of queries at once: of a node's two sides each query visits the nearer
first and the other only if the triangle inequality cannot rule it out.  Both
margins are multiplied by ``relax``: 1 is exact search; larger factors prune
more and may miss.  Leaves are compared by matrix product with a rounding
margin, and what remains is scored once more in double precision over the
original vectors, so equal vectors get equal scores.

Vectors stay where their shard is; they are sent again only to a shard that over
``BLOCK_ROWS`` queries reach, once for each block of so many.

Vectors that are null, empty, zero or hold null or non-finite components take
no part, nor do those of a length other than the query's.  Rows with a null
vec_id are ignored.  A query's own row is every row of its vec_id; a query id
that has several vectors gets each candidate's largest score over them.  Ties
go to the smaller vec_id.  Rows repeated with id and vector count once.  With
fewer candidates than ``k`` all are returned; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

K, QUERY_MODULUS, RELAX = 5, 50, 1.0
SHARD_ROWS, BLOCK_ROWS, LEAF = 32_768, 4_096, 256
#: Vantage points that the driver and every task hold at most.
CELLS = 16_384
_MARGIN = 1e-7


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` of the rows that take part, each id and vector once."""
    v = F.col("embedding").cast("array<double>")
    return (
        vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), v.alias("v"))
        .where(
            F.col("vec_id").isNotNull()
            & (F.size("v") > 0)
            & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
            & F.exists("v", lambda x: x != 0)
        )
    )


class Tree:
    """Vantage-point tree over rows of unit vectors."""

    def __init__(self, unit: np.ndarray, leaf: int = LEAF):
        self.unit, self.leaf = unit, leaf
        self.root = self._build(np.arange(len(unit)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            return rows
        x = self.unit[rows]
        # The vantage point: the row farthest from the rows' mean, so that distances spread.
        vantage = x[np.argmin(x @ x.mean(axis=0))]
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ vantage)))
        radius = float(np.median(d))
        inside = d <= radius
        if inside.all():
            inside = d < radius
        if inside.all() or not inside.any():
            return rows
        return vantage, radius, self._build(rows[inside]), self._build(rows[~inside])

    def search(self, queries: np.ndarray, k: int, relax: float = 1.0):
        """Row numbers of the ``k`` nearest (and all as near, to rounding) of each query."""
        self.bound = np.full(len(queries), np.inf)  # distance of the k-th best so far
        self.best = np.full((len(queries), k), np.inf)
        self.found: list = []
        self._visit(self.root, queries, np.arange(len(queries)), k, relax)
        out = [[] for _ in range(len(queries))]
        if self.found:
            q, r, d = (np.concatenate(c) for c in zip(*self.found))
            keep = d <= self.bound[q] + _MARGIN
            q, r = q[keep], r[keep]
            order = np.argsort(q, kind="stable")
            for i, part in zip(*_runs(q[order], r[order])):
                out[i] = part
        return out

    def _visit(self, node, queries, active, k, relax):
        if not len(active):
            return
        if isinstance(node, np.ndarray):
            for i in range(0, len(active), 1024):
                a = active[i : i + 1024]
                d = np.sqrt(np.maximum(0.0, 2 - 2 * (queries[a] @ self.unit[node].T)))
                near = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
                merged = np.sort(np.concatenate((self.best[a], near), axis=1), axis=1)[:, :k]
                self.best[a] = merged
                self.bound[a] = merged[:, -1]
                q, r = np.nonzero(d <= self.bound[a][:, None] + _MARGIN)
                self.found.append((a[q], node[r], d[q, r]))
            return
        vantage, radius, inner, outer = node
        d = np.sqrt(np.maximum(0.0, 2 - 2 * (queries[active] @ vantage)))
        first_in = d <= radius
        self._visit(inner, queries, active[first_in], k, relax)
        self._visit(outer, queries, active[~first_in], k, relax)
        gap = np.abs(d - radius) * relax <= self.bound[active] + _MARGIN
        self._visit(outer, queries, active[first_in & gap], k, relax)
        self._visit(inner, queries, active[~first_in & gap], k, relax)


def _runs(keys: np.ndarray, values: np.ndarray):
    cuts = np.nonzero(np.diff(keys))[0] + 1
    return keys[np.concatenate(([0], cuts))] if len(keys) else keys, np.split(values, cuts)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component to the last."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of rows in double precision, the same whatever else is compared."""
    return _dot(a, b) / (np.sqrt(_dot(a, a)) * np.sqrt(_dot(b, b)))


def search_shard(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, relax: float):
    """(query_id, vec_id, score) of the ``k`` nearest rows of a shard to each query."""
    order = np.lexsort((ids,))
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    # Equal vectors are one point of the tree; of their ids the k + 1 smallest can count.
    distinct, of = np.unique(vectors.view(np.dtype((np.void, vectors.shape[1] * 8))).ravel(), return_inverse=True)
    members = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[members], np.arange(len(distinct)))
    ends = np.append(starts[1:], len(ids))
    point = vectors[members[starts]]
    tree = Tree(point / np.linalg.norm(point, axis=1, keepdims=True))
    unit = queries / np.linalg.norm(queries, axis=1, keepdims=True)
    out_q, out_v, out_s = [], [], []
    smallest: dict[int, list[int]] = {}
    for i, rows in enumerate(tree.search(unit, k + 1, relax)):
        if not len(rows):
            continue
        rows = np.asarray(rows)
        score = cosine(point[rows], np.broadcast_to(queries[i], point[rows].shape))
        found = []
        for s, r in sorted(zip(score.tolist(), rows.tolist()), reverse=True):
            if r not in smallest:
                smallest[r] = np.unique(ids[members[starts[r] : ends[r]]])[: k + 1].tolist()
            found += [(-s, v) for v in smallest[r] if v != query_ids[i]]
        for s, v in sorted(set(found))[:k]:
            out_q.append(query_ids[i])
            out_v.append(v)
            out_s.append(-s)
    return out_q, out_v, out_s


class Cells:
    """Vantage points by vector length, and the ball of each cell."""

    def __init__(self, pivots: list[list[float]]):
        self.of, self.radius = {}, {}
        for width in sorted({len(p) for p in pivots}):
            x = np.array([p for p in pivots if len(p) == width])
            self.of[width] = x / np.linalg.norm(x, axis=1, keepdims=True)

    def distances(self, width: int, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 - 2 * ((x / np.linalg.norm(x, axis=1, keepdims=True)) @ self.of[width].T)))

    def _by_width(self, b: pa.RecordBatch, at: np.ndarray):
        widths = np.array([len(v) for v in b.column("v").to_pylist()]) if b.num_rows else np.empty(0, int)
        for width in np.unique(widths[at]).tolist():
            here = at[widths[at] == width]
            for i in range(0, len(here), 1024):
                part = here[i : i + 1024]
                yield width, part, b.column("v").take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

    def assign(self, batches):
        """Adds each vector's nearest vantage point and the distance to it."""
        for b in batches:
            cell, far = np.full(b.num_rows, -1, np.int32), np.zeros(b.num_rows)
            for width, part, x in self._by_width(b, np.arange(b.num_rows)):
                if width in self.of:
                    d = self.distances(width, x)
                    cell[part] = np.argmin(d, axis=1)
                    far[part] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], names=[*b.schema.names, "cell", "far"])

    def reached(self, relax: float):
        """Queries with their bound to the other cells that it reaches."""

        def rows(batches):
            for b in batches:
                own, bound = b.column("cell").to_numpy(), b.column("bound").to_numpy()
                for width, part, x in self._by_width(b, np.arange(b.num_rows)):
                    radius = self.radius[width]
                    if width in self.of:
                        d = self.distances(width, x)
                        open_ = (d - radius[None, :]) * relax <= bound[part][:, None] + _MARGIN
                        open_ &= radius[None, :] >= 0  # cells with a point
                        open_[np.arange(len(part)), own[part]] = False
                        q, c = np.nonzero(open_)
                        some = b.take(pa.array(part[q]))
                        yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("v"), pa.array(np.full(len(q), width, np.int32)), pa.array(c.astype(np.int32))], names=["vec_id", "v", "width", "cell"])

        return rows


def _search(points: DataFrame, asked: DataFrame, k: int, relax: float) -> DataFrame:
    """``query_id, vec_id, score`` of the best in each shard that a query is sent to."""
    loads = asked.groupBy("shard").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    left = points.join(loads, "shard").select("vec_id", "v", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = asked.join(loads, "shard").select("vec_id", "v", "shard", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")).cast("int").alias("block"))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], []]
        if len(left) and len(right):
            out = search_shard(left["vec_id"].to_numpy(), np.stack(left["v"].to_numpy()), right["vec_id"].to_numpy(), np.stack(right["v"].to_numpy()), k, relax)
        return pd.DataFrame({"query_id": np.array(out[0], np.int64), "vec_id": np.array(out[1], np.int64), "score": np.array(out[2], np.float64)})

    return left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInPandas(search, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, k: int = K, query_modulus: int = QUERY_MODULUS, relax: float = RELAX, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest rows of every row
    whose vec_id is divisible by ``query_modulus``."""
    if relax < 1:
        raise ValueError("relax below 1 never prunes more than exact search needs")
    spark = vectors.sparkSession
    points = cut(usable(vectors).dropDuplicates())
    # Of equal vectors the k + 1 smallest ids can count: the query's own may be one of them.
    few = points.withColumn("_nth", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("_nth") <= k + 1).drop("_nth")
    n = points.count()
    wanted = min(CELLS // 2, max(1, 2 * math.ceil(n / shard_rows)))
    share = F.shiftrightunsigned(F.xxhash64("v"), 11) <= F.lit(int(min(1.0, wanted / max(1, n)) * (1 << 53)))
    pivots = points.where(share).select("v").distinct().limit(CELLS).collect() or points.select("v").limit(1).collect()
    cells = Cells([r["v"] for r in pivots])
    dealt = cut(few.mapInArrow(cells.assign, "vec_id long, v array<double>, cell int, far double").withColumn("width", F.size("v")))
    stats = dealt.groupBy("width", "cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()  # a row for each cell
    kinds = "width int, cell int, first int, parts int"
    table, at = [], 0
    for r in sorted(stats):
        parts = math.ceil(r["n"] / shard_rows)
        table.append((r["width"], r["cell"], at, parts))
        at += parts
        radius = cells.radius.setdefault(r["width"], np.full(len(cells.of.get(r["width"], ())), -1.0))
        if r["cell"] >= 0:
            radius[r["cell"]] = r["far"]
    layout = F.broadcast(spark.createDataFrame(table, kinds))
    shards = dealt.join(layout, ["width", "cell"]).select("vec_id", "v", (F.col("first") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int").alias("shard"))

    def sent(asked):
        return asked.join(layout, ["width", "cell"]).select("vec_id", "v", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("parts") - 1)).alias("shard"))

    queries = points.where(F.col("vec_id") % query_modulus == 0).mapInArrow(cells.assign, "vec_id long, v array<double>, cell int, far double").withColumn("width", F.size("v"))
    queries = cut(queries)
    near = cut(_search(shards, sent(queries), k, relax))
    best = near.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    kth = best.withColumn("_r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc()))).where(F.col("_r") == k)
    bound = kth.select(F.col("query_id").alias("vec_id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))).alias("bound"))
    # A query id with several vectors is bounded by none of them alone.
    alone = queries.groupBy("vec_id").agg(F.count("*").alias("_n"))
    further = queries.join(alone, "vec_id").join(bound, "vec_id", "left").select("vec_id", "v", "cell", F.when(F.col("_n") == 1, F.coalesce("bound", F.lit(float("inf")))).otherwise(float("inf")).alias("bound"))
    asked = further.mapInArrow(cells.reached(relax), "vec_id long, v array<double>, width int, cell int")
    found = near.union(_search(shards, sent(cut(asked)), k, relax))
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
