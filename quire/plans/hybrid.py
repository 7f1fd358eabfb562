"""Hybrid retrieval from queries to a final ranking, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame

from quire.operators import search


def hybrid(queries: DataFrame, items: DataFrame, vectors: DataFrame | None = None, pool: int = 25, fused: int = 20) -> DataFrame:
    """Dense and lexical top-k fused by reciprocal rank.

    ``queries``: query_id, text, qvec.  ``items``: item_id, text, vec, of which
    those without a vector (null) take part in the lexical side alone.  Where
    ``vectors`` (item_id, vec) come apart, texts need not be joined with them.
    """
    vectors = items if vectors is None else vectors
    dense = search.dense_topk(queries.select("query_id", "qvec"), vectors.select("item_id", "vec").where("vec is not null"), pool)
    lexical = search.lexical_topk(queries.select("query_id", "text"), items.select("item_id", "text"), pool)
    return search.rrf(dense, lexical, limit=fused)


def reranked(queries: DataFrame, items: DataFrame, vectors: DataFrame | None = None, limit: int = 10) -> DataFrame:
    """``hybrid`` and the stand-in reranker, fused with the dense ranks."""
    texts = items.select("item_id", "text")
    scored = search.overlap_rerank(queries.select("query_id", "text"), hybrid(queries, items, vectors), texts)
    return search.rank_fusion(scored, limit=limit)
