"""Retrieval: dense and lexical top-k, rank fusion, reranking, judging.

Every ranked list is per query: a frame with ``query_id``, an item id, a rank
from 1 and a score, so one plan serves a batch of queries.  Query sides are
broadcast only up to a counted number of rows (``QUERY_ROWS``, ``TERM_ROWS``);
beyond it the same joins shuffle.

Vectors that are null, zero or hold null or non-finite components take no part,
nor do vectors of another length than the query's.  Items without text have no
word; a query without a word but stop words finds nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire import models
from quire.functions.text import lexemes, question_route, tokens
from quire.lineage import bounded, cut

QUERY_ROWS, TERM_ROWS, RANKED_ROWS = 100_000, 2_000_000, 500_000
#: Terms of queries that every Python task is told; tokens or pairs of item and query that it takes at a time.
TOLD_TERMS, SLICE = 500_000, 1 << 20
#: Vectors of a pack; packs of queries that are broadcast (40 MB at 64 components).
PACK, PACK_ROWS = 4_096, 20
#: Vectors of queries that every Python task is told.
TOLD_BYTES = 48 << 20
_TIE = 1e-9


def _top(df: DataFrame, k: int, *order: Column, rank: str = "rank") -> DataFrame:
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    return ranked.where(F.col(rank) <= k)


def _few(ranked: DataFrame) -> DataFrame:
    """A ranked list, worked out once, that is sent to the texts it is joined with rather than shuffled with them."""
    return bounded(cut(ranked), RANKED_ROWS)


def _blocks(batches):
    """Ids and matrices of up to ``PACK`` vectors (columns id, vector) of one width, without those that take no part."""
    for b in batches:
        for i in range(0, b.num_rows, PACK):
            ids, lists = (c.slice(i, PACK) for c in b.columns)
            widths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            for width in np.unique(widths[widths > 0]).tolist():
                at = np.nonzero(widths == width)[0]
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                fine = np.isfinite(x).all(axis=1) & x.any(axis=1)
                if fine.any():
                    yield ids.take(pa.array(at[fine])), x[fine]


def _packs(df: DataFrame, id_: str, vector: str, prefix: str) -> DataFrame:
    """Rows (ids, width, vectors as one block of doubles) of up to ``PACK`` vectors each."""
    kind = T.StructType([T.StructField(f"{prefix}_ids", T.ArrayType(df.schema[id_].dataType)), T.StructField(f"{prefix}_width", T.IntegerType()), T.StructField(f"{prefix}_block", T.BinaryType())])

    def rows(batches):
        for ids, x in _blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([x.shape[1]], pa.int32()), pa.array([x.tobytes()], pa.binary())], names=kind.names)

    return df.select(id_, F.col(vector).cast("array<double>").alias(vector)).mapInArrow(rows, kind)


def _dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dot products of rows, summed from the first component to the last, whatever else is compared."""
    return np.add.accumulate(a * b, axis=1)[:, -1]


class _Kept:
    """The ``k`` best items of each of ``n`` queries so far, ties by id: by score,
    rounded to ``digits`` if there are any.  What is held is bounded by ``n * k``."""

    def __init__(self, n: int, k: int, digits: int | None = None):
        self.k, self.digits, self.held, self.most = k, digits, 0, max(SLICE // 4, 2 * k * n)
        self.query, self.score, self.ids = [], [], []
        self.least = np.full(n, -np.inf)

    def order_of(self, score: np.ndarray) -> np.ndarray:
        return score if self.digits is None else np.floor(score * 10.0**self.digits + 0.5)

    def add(self, query: np.ndarray, score: np.ndarray, ids: pa.Array) -> None:
        fine = self.order_of(score) >= self.least[query]
        self.query.append(query[fine])
        self.score.append(score[fine])
        self.ids.append(ids.take(pa.array(np.nonzero(fine)[0])))
        self.held += int(fine.sum())
        if self.held > self.most:
            self.settle()

    def settle(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        query, score, ids = np.concatenate(self.query), np.concatenate(self.score), pa.concat_arrays(self.ids)
        value = self.order_of(score)
        order = np.lexsort((pc.rank(ids, "ascending", null_placement="at_start").to_numpy(), -value, query))
        place = np.arange(len(order)) - np.searchsorted(query[order], query[order])
        last = order[place == self.k - 1]
        self.least[query[last]] = value[last]
        order = order[place < self.k]
        self.query, self.score, self.ids, self.held = [query[order]], [score[order]], [ids.take(pa.array(order))], len(order)
        return self.query[0], self.score[0], self.ids[0]


class _Nearest:
    """The ``k`` nearest items of blocks of queries, over all packs of items that they meet."""

    def __init__(self, k: int):
        self.k, self.kept = k, {}

    def meet(self, block: int, queries: pa.Array, q: np.ndarray, ids: pa.Array, x: np.ndarray) -> None:
        if block not in self.kept:
            # Copied, so that no batch stays for its ids.
            self.kept[block] = queries.take(pa.array(np.arange(len(q)))), _Kept(len(q), self.k), np.full(len(q), -np.inf)
        _, best, floor = self.kept[block]
        nx, nq = np.sqrt(_dot(x, x)), np.sqrt(_dot(q, q))
        unit = x / nx[:, None]
        for j in range(0, len(q), 512):
            near = (q[j : j + 512] / nq[j : j + 512, None]) @ unit.T
            least = np.partition(near, max(0, near.shape[1] - self.k), axis=1)[:, max(0, near.shape[1] - self.k)]
            if near.shape[1] >= self.k:  # as many at hand already, so no worse one is among the best
                least = floor[j : j + 512] = np.maximum(floor[j : j + 512], least)
            a, c = np.nonzero(near >= least[:, None] - _TIE)
            best.add(j + a, _dot(q[j + a], x[c]) / (nq[j + a] * nx[c]), ids.take(pa.array(c)))

    def batches(self):
        for queries, best, _ in self.kept.values():
            query, score, ids = best.settle()
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(query)), ids, pa.array(score)], names=["query_id", "item_id", "score"])


def _best_pairs(k: int):
    """Pairs of packs to the best items of each query."""

    def rows(batches):
        nearest = _Nearest(k)
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i] for c in b.schema.names}
                x, q = (np.frombuffer(r[c].as_buffer(), np.float64).reshape(-1, r["i_width"].as_py()) for c in ("i_block", "q_block"))
                nearest.meet(r["q_block_no"].as_py(), r["q_ids"].values, q, r["i_ids"].values, x)
        yield from nearest.batches()

    return rows


def _best_items(k: int, told):
    """Items (item_id, vec) to the best of each query of ``told``, the packs of all queries."""

    def rows(batches):
        nearest, packs = _Nearest(k), told.value
        for ids, x in _blocks(batches):
            for n, (queries, width, block) in enumerate(packs):
                if width == x.shape[1]:
                    nearest.meet(n, queries, np.frombuffer(block, np.float64).reshape(-1, width), ids, x)
        yield from nearest.batches()

    return rows


def dense_topk(queries: DataFrame, items: DataFrame, k: int = 25) -> DataFrame:
    """``query_id, item_id, score, rank`` of the ``k`` items of largest cosine.

    ``queries``: query_id, qvec.  ``items``: item_id, vec.  Exact: blocks of the
    query set meet packs of items as matrix products, scored once more in
    component order; each task hands on its ``k`` best of each query alone.
    Queries up to ``TOLD_BYTES`` are told to every task, more are cross-joined.
    """
    blocks = _packs(queries.coalesce(8), "query_id", "qvec", "q")
    kinds = [queries.schema["query_id"].dataType, items.schema["item_id"].dataType, T.DoubleType()]
    kind = T.StructType([T.StructField(n, t) for n, t in zip(["query_id", "item_id", "score"], kinds)])
    if (blocks.agg(F.sum(F.length("q_block"))).first()[0] or 0) <= TOLD_BYTES:
        packs = blocks.toArrow().combine_chunks()
        packs = [(packs.column("q_ids").combine_chunks()[i].values, packs.column("q_width")[i].as_py(), packs.column("q_block")[i].as_py()) for i in range(packs.num_rows)]
        told = queries.sparkSession.sparkContext.broadcast(packs)
        scored = items.select("item_id", F.col("vec").cast("array<double>").alias("vec")).mapInArrow(_best_items(k, told), kind)
    else:
        blocks = bounded(blocks.withColumn("q_block_no", F.monotonically_increasing_id()), PACK_ROWS)
        scored = _packs(items, "item_id", "vec", "i").crossJoin(blocks).where("i_width = q_width").mapInArrow(_best_pairs(k), kind)
    return _top(scored, k, F.col("score").desc(), F.col("item_id"))


def query_terms(queries: DataFrame, stemmed: bool = False) -> DataFrame:
    """Distinct lexemes of each query (query_id, text)."""
    return queries.select("query_id", F.explode(F.array_distinct(lexemes(F.col("text"), stemmed))).alias("token"))


def postings(items: DataFrame, only: DataFrame, stemmed: bool = False) -> DataFrame:
    """``item_id, token, tf, dl``: how often the text of an item holds each token
    of ``only`` (token), and the length of the text in tokens.  A token that stands in the
    ``header`` alone (if there is that column) has ``tf`` 0.  Every item with
    text has a row of the empty token as well, so that one pass tells lengths
    too.  Other tokens are dropped before anything is shuffled."""
    def analysed(text):
        # Without stems no query term is a stop word, so the join drops those.
        return lexemes(text, True) if stemmed else tokens(text)

    none = F.array().cast("array<string>")
    words = items.where("text is not null").select("item_id", analysed(F.col("text")).alias("words"), F.coalesce(analysed(F.col("header")), none).alias("heads") if "header" in items.columns else none.alias("heads"))
    # An inner explode would have its input's size tested first, tokenising every text again.
    rows = words.select("item_id", F.size("words").alias("dl"), F.posexplode_outer(F.concat(F.array(F.lit("")), "words", "heads")).alias("at", "token"))
    wanted = bounded(only.select("token").union(only.sparkSession.sql("SELECT ''")).distinct(), TERM_ROWS)
    return rows.join(wanted, "token", "left_semi").groupBy("item_id", "dl", "token").agg(F.count_if((F.col("at") > 0) & (F.col("at") <= F.col("dl"))).alias("tf"))


class _Terms:
    """Lexemes of a set of queries (query_id, token), numbered, and who holds each."""

    def __init__(self, rows: pa.Table):
        rows = rows.combine_chunks()
        words, queries = (rows.column(c).combine_chunks().dictionary_encode(null_encoding="encode") for c in ("token", "query_id"))
        self.words, self.queries = words.dictionary, queries.dictionary
        term = words.indices.to_numpy()
        order = np.argsort(term, kind="stable")
        self.holders = queries.indices.to_numpy()[order].astype(np.int64)
        self.ends = np.searchsorted(term[order], np.arange(len(self.words)), "right")
        self.starts = np.append(0, self.ends)[: len(self.ends)]


def _told(terms: DataFrame):
    """``terms`` as a broadcast value for Python, None if there are more than ``TOLD_TERMS``."""
    if terms.limit(TOLD_TERMS + 1).count() > TOLD_TERMS:
        return None
    return terms.sparkSession.sparkContext.broadcast(_Terms(terms.toArrow()))


def _counted(batches, terms: _Terms):
    """Slices of items (words, heads) of bounded size with three arrays: row, number
    of a term and how often the text has it, in that order; a term of the header alone has 0."""
    for b in batches:
        ends = np.cumsum(pc.list_value_length(b.column("words")).to_numpy())
        at = 0
        while at < b.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, "right")))
            part, at = b.slice(at, to - at), to
            codes = []
            for c in ("words", "heads"):
                term = pc.index_in(part.column(c).flatten(), value_set=terms.words)
                row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column(c)).to_numpy())
                codes.append(row[term.is_valid().to_numpy(zero_copy_only=False)] * len(terms.words) + term.drop_null().to_numpy())
            code, n = np.unique(codes[0], return_counts=True)
            more = np.setdiff1d(codes[1], code)
            code, n = np.append(code, more), np.append(n, np.zeros(len(more), n.dtype))
            order = np.argsort(code, kind="stable")
            yield part, *np.divmod(code[order], max(1, len(terms.words))), n[order]


def _scores(row: np.ndarray, term: np.ndarray, weight: np.ndarray, terms: _Terms):
    """Rows, numbers of queries and sums of weights, a bounded number of pairs at a time."""
    many = terms.ends[term] - terms.starts[term]
    ends = np.cumsum(many)
    at = 0
    while at < len(row):
        to = int(np.searchsorted(ends, ends[at] - many[at] + SLICE, "right"))
        to = len(row) if to == len(row) else int(np.searchsorted(row, row[to]))
        to = to if to > at else int(np.searchsorted(row, row[at], "right"))
        part, first = many[at:to], ends[at:to] - many[at:to]
        holder = terms.holders[np.repeat(terms.starts[term[at:to]] - (first - first[0]), part) + np.arange(part.sum())]
        key, back = np.unique(np.repeat(row[at:to], part) * len(terms.queries) + holder, return_inverse=True)
        yield *np.divmod(key, len(terms.queries)), np.bincount(back, np.repeat(weight[at:to], part), len(key))
        at = to


def _best(slices, terms: _Terms, k: int, digits: int | None):
    """The ``k`` best items of each query over all that a task reads (ties by id).
    Items that other rows go on with (``_again``) all pass on, as their scores are parts."""
    best = _Kept(len(terms.queries), k, digits)

    def batch(query, score, ids):
        return pa.RecordBatch.from_arrays([terms.queries.take(pa.array(query)), ids, pa.array(score)], names=["query_id", "item_id", "score"])

    for part, row, term, weight in slices:
        ids, again = part.column("item_id"), part.column("_again").to_numpy(zero_copy_only=False)
        for at, query, score in _scores(row, term, weight, terms):
            a = again[at]
            if a.any():
                yield batch(query[a], score[a], ids.take(pa.array(at[a])))
            best.add(query[~a], score[~a], ids.take(pa.array(at[~a])))
    if best.query:
        yield batch(*best.settle())


def _analysed(items: DataFrame, stemmed: bool, headers: bool = True) -> tuple[DataFrame, bool]:
    """``item_id, words, heads, _again`` of items with text, and whether any id has
    several rows (``_again``), whose scores are to be added up."""

    def analysed(text):
        # Without stems no query term is a stop word, so nothing looks those up.
        return lexemes(text, True) if stemmed else tokens(text)

    none = F.array().cast("array<string>")
    heads = F.coalesce(analysed(F.col("header")), none) if headers and "header" in items.columns else none
    words = items.where("text is not null").select("item_id", analysed(F.col("text")).alias("words"), heads.alias("heads"))
    twice = items.groupBy(F.col("item_id").alias("_id")).agg(F.count("*").alias("_n")).where("_n > 1").select("_id", F.lit(True).alias("_again"))
    if not (n := twice.limit(QUERY_ROWS + 1).count()):
        return words.withColumn("_again", F.lit(False)), False
    twice = F.broadcast(twice) if n <= QUERY_ROWS else twice
    flagged = words.join(twice, F.col("item_id").eqNullSafe(F.col("_id")), "left")
    return flagged.select("item_id", "words", "heads", F.coalesce("_again", F.lit(False)).alias("_again")), True


def _scored(items: DataFrame, terms: DataFrame) -> T.StructType:
    return T.StructType([T.StructField("query_id", terms.schema["query_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType), T.StructField("score", T.DoubleType())])


def _added_up(best: DataFrame, repeated: bool) -> DataFrame:
    return best.groupBy("query_id", "item_id").agg(F.sum("score").alias("score")) if repeated else best


def lexical_topk(queries: DataFrame, items: DataFrame, k: int = 25, stemmed: bool = False) -> DataFrame:
    """OR-match of any query lexeme in text or header, scored a tenth for each
    matching position of the text (the cover density of single lexemes).

    Each task counts, scores and ranks what it reads and hands on its ``k`` best
    items of each query; more terms than ``TOLD_TERMS`` are joined and shuffled."""
    terms = cut(query_terms(queries, stemmed).distinct())
    if (told := _told(terms)) is None:
        hits = postings(items, terms, stemmed).join(bounded(terms, TERM_ROWS), "token")
        scored = hits.groupBy("query_id", "item_id").agg(F.sum("tf").alias("score"))
    else:
        words, repeated = _analysed(items, stemmed)
        scored = _added_up(words.mapInArrow(lambda batches: _best(_counted(batches, told.value), told.value, k, None), _scored(items, terms)), repeated)
    return _top(scored.withColumn("score", F.col("score") * 0.1), k, F.col("score").desc(), F.col("item_id"))


def bm25_topk(queries: DataFrame, items: DataFrame, k: int = 25, k1: float = 1.2, b: float = 0.75, stemmed: bool = False) -> DataFrame:
    """Okapi BM25 over texts with the non-negative idf.  Texts are tokenised once;
    scores are ranked as in ``lexical_topk``."""
    terms = cut(query_terms(queries, stemmed).distinct())
    order = F.floor(F.col("score") * 1e9 + 0.5).desc()
    if (told := _told(terms)) is None:
        rows = cut(postings(items, terms, stemmed))
        stats = rows.where("token = ''").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))  # one row
        df = rows.where("tf > 0").groupBy("token").agg(F.count("*").alias("df"))
        weighed = bounded(terms.join(df, "token"), TERM_ROWS)
        weight = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)) * F.col("tf") * (k1 + 1)
        weight = weight / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
        hits = rows.where("tf > 0").join(weighed, "token").join(F.broadcast(stats))
        return _top(hits.groupBy("query_id", "item_id").agg(F.sum(weight).alias("score")), k, order, F.col("item_id"))

    def count(batches):
        for part, row, term, n in _counted(batches, told.value):
            offsets = pa.array(np.searchsorted(row, np.arange(part.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x, pa.int32())) for x in (term, n)]
            yield pa.RecordBatch.from_arrays([part.column("item_id"), part.column("_again"), pc.list_value_length(part.column("words")), *lists], names=kind.names)

    words, repeated = _analysed(items, stemmed, headers=False)
    kind = T.StructType([items.schema["item_id"], *T.StructType.fromDDL("_again boolean, dl int, terms array<int>, tf array<int>").fields])
    rows = cut(words.mapInArrow(count, kind))
    total = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
    if repeated:  # texts of one item and length count as one
        each = rows.where("_again").select("item_id", "dl", F.explode(F.arrays_zip("terms", "tf")).alias("x")).groupBy("item_id", "dl", F.col("x.terms").alias("t")).agg(F.sum("x.tf").cast("int").alias("f"))
        each = each.groupBy("item_id", "dl").agg(F.collect_list(F.struct("t", "f")).alias("x")).select("item_id", F.lit(True).alias("_again"), "dl", F.col("x.t").alias("terms"), F.col("x.f").alias("tf"))
        rows = cut(rows.where("not _again").unionByName(each))
    df = np.zeros(len(told.value.words))
    found = rows.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toArrow()  # a row for each term at most
    df[found.column("t").to_numpy()] = found.column("df").to_numpy()
    avgdl, idf = total["avgdl"], np.log(1 + (total["n"] - df + 0.5) / (df + 0.5))

    def weigh(batches):
        for part in batches:
            row = np.repeat(np.arange(part.num_rows), pc.list_value_length(part.column("terms")).to_numpy())
            term, tf = (part.column(c).flatten().to_numpy() for c in ("terms", "tf"))
            yield part, row, term, idf[term] * tf * (k1 + 1) / (tf + k1 * (1 - b + b * part.column("dl").to_numpy()[row] / avgdl))

    best = rows.mapInArrow(lambda batches: _best(weigh(batches), told.value, k, 9), _scored(items, terms))
    return _top(_added_up(best, repeated), k, order, F.col("item_id"))


def rrf(dense: DataFrame, lexical: DataFrame, k: int = 60, limit: int = 20, w_dense: float = 1.0, w_lexical: float = 1.0) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists; ties keep dense order first."""
    d = dense.select("query_id", "item_id", F.col("rank").alias("dense_rank"))
    x = lexical.select("query_id", "item_id", F.col("rank").alias("lexical_rank"))

    def share(weight, rank):
        return F.coalesce(F.lit(weight) / (k + F.col(rank)), F.lit(0.0))

    fused = d.join(x, ["query_id", "item_id"], "full_outer").withColumn("rrf_score", share(w_dense, "dense_rank") + share(w_lexical, "lexical_rank"))
    return _top(fused, limit, F.col("rrf_score").desc(), F.col("dense_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), rank="rrf_rank")


def overlap_rerank(queries: DataFrame, candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Stand-in reranker: Jaccard of query and item tokens; adds ``rerank_rank,
    rerank_score``.  Only texts of candidates are tokenised."""
    candidates = cut(candidates)
    q = queries.select("query_id", F.array_distinct(tokens(F.col("text"))).alias("_q"))
    some = items.join(bounded(candidates.select("item_id").distinct(), RANKED_ROWS), "item_id", "left_semi")
    t = some.select("item_id", F.array_distinct(tokens(F.left(F.col("text"), F.lit(6000)))).alias("_t"))
    score = F.size(F.array_intersect("_q", "_t")) / F.greatest(F.size(F.array_union("_q", "_t")), F.lit(1))
    scored = candidates.join(bounded(q, QUERY_ROWS), "query_id").join(t, "item_id").withColumn("rerank_score", score).drop("_q", "_t")
    return scored.withColumn("rerank_rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("rerank_score").desc(), "rrf_rank")))


def rank_fusion(reranked: DataFrame, k: int = 60, missing: int = 100, limit: int = 10) -> DataFrame:
    """Fuse rerank and dense ranks; an item without a dense rank counts as rank ``missing``."""
    score = 1 / (k + F.col("rerank_rank")) + 1 / (k + F.coalesce("dense_rank", F.lit(missing)))
    return _top(reranked.withColumn("final_score", score), limit, F.col("final_score").desc(), F.col("rerank_rank"), rank="final_rank")


def move_to_front(ranked: DataFrame, picks: DataFrame, pool: int = 5) -> DataFrame:
    """A judge's pick (query_id, best: zero-based place in the pool) first; a
    pick that is missing or out of range changes nothing."""
    joined = ranked.join(bounded(picks, QUERY_ROWS), "query_id", "left")
    front = F.col("best").isNotNull() & F.col("best").between(0, pool - 1) & (F.col("final_rank") == F.col("best") + 1)
    order = Window.partitionBy("query_id").orderBy(F.when(front, 0).otherwise(1), "final_rank")
    return joined.withColumn("judged_rank", F.row_number().over(order)).drop("best")


def nearest_scoped(queries: DataFrame, items: DataFrame, scope: Column, k: int = 25) -> DataFrame:
    """Dense top-k over the items that ``scope`` admits."""
    return dense_topk(queries, items.where(scope), k)


def evidence(ranked: DataFrame, items: DataFrame, limit: int = 3500) -> DataFrame:
    """``query_id, evidence``: numbered sources with text up to ``limit`` characters."""
    rows = items.join(_few(ranked), "item_id").select("query_id", "rank", F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), F.left(F.col("text"), F.lit(limit))).alias("block"))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "block"))), lambda r: r["block"]), "\n\n---\n\n").alias("evidence"))


def answers(queries: DataFrame, evidence: DataFrame, model, batch: int = 10) -> DataFrame:
    """``query_id, route, status, answer``: queries (query_id, text) that ask
    for an explanation go to ``model`` (a batch function of prompts) with their
    evidence; the others and those without evidence get no answer, and an empty
    or failed one is ``empty_response``."""
    rows = queries.select("query_id", "text", question_route(F.col("text")).alias("route")).join(evidence, "query_id", "left")
    asks = (F.col("route") == "synthesis") & F.col("evidence").isNotNull()
    prompts = rows.where(asks).select("query_id", F.concat(F.col("text"), F.lit("\n\n"), F.col("evidence")).alias("prompt"))
    told = models.apply_batches(prompts, "prompt", "answer", "string", model, batch).select("query_id", "answer")
    status = (
        F.when(F.col("evidence").isNull(), "no_evidence").when(F.col("route") == "retrieval", "sources_only")
        .when(F.coalesce(F.trim("answer"), F.lit("")) == "", "empty_response").otherwise("answered")
    )
    return rows.join(told, "query_id", "left").select("query_id", "route", status.alias("status"), "answer")


def response_rows(ranked: DataFrame, items: DataFrame, preview: int = 350) -> DataFrame:
    """What a caller shows of a ranking (query_id, item_id, final_rank,
    rerank_score, rrf_score): topic (subtitle, else title), scores to four and
    six places, the start of the text.  ``items``: item_id, title, subtitle, text."""
    shown = items.join(_few(ranked), "item_id")
    return shown.select(
        "query_id", "item_id", "final_rank", F.coalesce(F.nullif("subtitle", F.lit("")), "title").alias("topic"), F.bround("rerank_score", 4).alias("rerank_score"),
        F.bround("rrf_score", 6).alias("rrf_score"), F.left("text", F.lit(preview)).alias("preview"),
    )
