"""Registered queries over the driver's tables, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.functions import fixed
from quire.functions import text as X
from quire.functions import vector as V
from quire.operators import chunking, evaluate, graph, lines, relational, search, tree
from quire.plans import hybrid
from quire.sources import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function under its name, with its SQL if there is one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# ---------------------------------------------------------------- retrieval

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"
_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_LEXEMES = f"list_filter({_TOKENS}, lambda x: x NOT IN ({_STOP}))"
_E = "SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings"
_COS = "list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v)))"


def _dense_sql(where: str = "TRUE", k: int = 25) -> str:
    return f"""
    WITH e AS ({_E}), s AS (
      SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_COS} AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND {where}
    ), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, item_id, round(score, 6) AS score, rank FROM r WHERE rank <= {k}"""


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    items = e.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vec"), "label")
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), items


@query(_dense_sql())
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    q, items = _vectors(spark, d)
    return search.dense_topk(q, items).withColumn("score", F.round("score", 6))


@query(_dense_sql("e.label < 5"))
def dense_topk_scoped(spark: SparkSession, d: str) -> DataFrame:
    q, items = _vectors(spark, d)
    return search.nearest_scoped(q, items, F.col("label") < 5).withColumn("score", F.round("score", 6))


@query(f"""
WITH e AS ({_E}), s AS (SELECT vec_id, v[1:32] AS v FROM e), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM s)
SELECT vec_id, CAST(place AS INTEGER) AS place, round(CASE WHEN n = 0 THEN v[place + 1] ELSE v[place + 1] / n END, 6) AS x FROM n, range(0, 32) t(place)""")
def truncate_normalize(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select("vec_id", F.posexplode(V.truncate_normalize(F.col("embedding"), 32)).alias("place", "x")).withColumn("x", F.round("x", 6))


@query(f"""
WITH e AS ({_E}), t AS (SELECT vec_id, v[1:32] AS v FROM e),
a AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_COS} AS s FROM e q, e WHERE q.vec_id % 20 = 0),
b AS (SELECT q.vec_id AS query_id, e.vec_id AS item_id, {_COS} AS s FROM t q, t e WHERE q.vec_id % 20 = 0),
ra AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS r FROM a),
rb AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS r FROM b),
x AS (SELECT query_id, item_id, r AS ra FROM ra WHERE r <= 10), y AS (SELECT query_id, item_id, r AS rb FROM rb WHERE r <= 10)
SELECT query_id, round(count(*) FILTER (WHERE ra IS NOT NULL AND rb IS NOT NULL) / 10.0, 6) AS overlap, round(avg(abs(ra - rb)), 6) AS mean_shift
FROM x FULL JOIN y USING (query_id, item_id) GROUP BY query_id""")
def recall_stability(spark: SparkSession, d: str) -> DataFrame:
    q, items = _vectors(spark, d)
    short = search.dense_topk(q.withColumn("qvec", V.truncate_normalize(F.col("qvec"), 32)), items.withColumn("vec", V.truncate_normalize(F.col("vec"), 32)), 10)
    return evaluate.overlap(search.dense_topk(q, items, 10), short).select("query_id", F.round("overlap", 6).alias("overlap"), F.round("mean_shift", 6).alias("mean_shift"))


def _texts(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    header = F.concat_ws(" ", "lang", "source").alias("header")
    return q, table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text", header)


_POST = f"""
w AS (SELECT doc_id AS item_id, {_TOKENS.format('text')} AS ws, {_TOKENS.format("concat_ws(' ', lang, source)")} AS hs FROM documents WHERE text IS NOT NULL),
p AS (SELECT item_id, dl, token, sum(x) AS tf FROM (SELECT item_id, len(ws) AS dl, unnest(ws) AS token, 1 AS x FROM w UNION ALL SELECT item_id, len(ws), unnest(hs), 0 FROM w) GROUP BY ALL),
t AS (SELECT DISTINCT item_id AS query_id, unnest({_LEXEMES.format('text')}) AS token FROM benchmark)"""


@query(f"""
WITH {_POST}, s AS (SELECT query_id, item_id, sum(tf) * 0.1 AS score FROM p JOIN t USING (token) GROUP BY ALL),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS INTEGER) AS rank FROM s)
SELECT query_id, item_id, round(CAST(score AS DOUBLE), 6) AS score, rank FROM r WHERE rank <= 25""")
def lexical_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.lexical_topk(*_texts(spark, d)).select("query_id", "item_id", F.round("score", 6).cast("double").alias("score"), "rank")


@query(f"""
WITH {_POST}, st AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM w), df AS (SELECT token, count(*) AS df FROM p WHERE tf > 0 GROUP BY token),
s AS (SELECT query_id, item_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
      FROM p JOIN t USING (token) JOIN df USING (token), st WHERE tf > 0 GROUP BY query_id, item_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, item_id) AS INTEGER) AS rank FROM s)
SELECT query_id, item_id, round(score, 5) AS score, rank FROM r WHERE rank <= 25""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_topk(*_texts(spark, d)).withColumn("score", F.round("score", 5))


@query()
def stemmed_topk(spark: SparkSession, d: str) -> DataFrame:
    """``lexical_topk`` over English stems, which the checker's SQL lacks."""
    q, items = _texts(spark, d)
    return search.lexical_topk(q, items, stemmed=True).withColumn("score", F.round("score", 6).cast("double"))


def _hybrid_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Benchmark items as queries and documents as items, each with the vector of the same id if there is one.
    Vectors come apart from the texts, unless an id has several, which then stand for as many items."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = table(spark, d, "benchmark").join(e, F.col("item_id") == F.col("id"), "left").select(F.col("item_id").alias("query_id"), "text", F.col("vec").alias("qvec"))
    items = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("item_id"), "text")
    if e.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 and id is not null").limit(1).count():
        return q, items.join(e, F.col("item_id") == F.col("id"), "left").select("item_id", "text", "vec"), None
    return q, items, items.select("item_id").join(e, F.col("item_id") == F.col("id")).select("item_id", "vec")


_FUSED = rf"""
WITH e AS ({_E}), i AS (SELECT doc_id AS item_id, text, v FROM documents LEFT JOIN e ON doc_id = vec_id WHERE text IS NOT NULL), q AS (SELECT item_id AS query_id, text, v FROM benchmark LEFT JOIN e ON item_id = vec_id),
ds AS (SELECT query_id, e.item_id, {_COS} AS s FROM q, i e WHERE q.v IS NOT NULL AND e.v IS NOT NULL),
d AS (SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS dense_rank FROM ds) WHERE dense_rank <= 25),
p AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest({_TOKENS.format('text')}) AS token FROM i) GROUP BY ALL),
t AS (SELECT DISTINCT query_id, unnest({_LEXEMES.format('text')}) AS token FROM q),
ls AS (SELECT query_id, item_id, sum(tf) AS s FROM p JOIN t USING (token) GROUP BY ALL),
l AS (SELECT * FROM (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, item_id) AS lexical_rank FROM ls) WHERE lexical_rank <= 25),
f AS (SELECT query_id, item_id, dense_rank, lexical_rank, coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) AS rrf_score FROM d FULL JOIN l USING (query_id, item_id)),
r AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, dense_rank NULLS LAST, lexical_rank NULLS LAST) AS INTEGER) AS rrf_rank FROM f) WHERE rrf_rank <= 20)"""
_RERANK = rf"""{_FUSED},
qt AS (SELECT query_id, list_distinct({_TOKENS.format('text')}) AS a FROM q), it AS (SELECT item_id, list_distinct({_TOKENS.format('left(text, 6000)')}) AS b FROM i),
j AS (SELECT r.*, len(list_intersect(a, b)) / greatest(len(list_distinct(list_concat(a, b))), 1) AS rerank_score FROM r JOIN qt USING (query_id) JOIN it USING (item_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rrf_rank) AS rerank_rank FROM j),
m AS (SELECT *, 1.0::DOUBLE / (60 + rerank_rank) + 1.0::DOUBLE / (60 + coalesce(dense_rank, 100)) AS final_score FROM k),
z AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, rerank_rank) AS INTEGER) AS final_rank FROM m) WHERE final_rank <= 10)"""


@query(f"{_FUSED} SELECT query_id, item_id, CAST(dense_rank AS INTEGER) AS dense_rank, CAST(lexical_rank AS INTEGER) AS lexical_rank, round(rrf_score, 9) AS rrf_score, rrf_rank FROM r")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    return hybrid.hybrid(*_hybrid_inputs(spark, d)).withColumn("rrf_score", F.round("rrf_score", 9))


@query(f"{_RERANK} SELECT query_id, item_id, CAST(rerank_rank AS INTEGER) AS rerank_rank, round(rerank_score, 6) AS rerank_score, round(final_score, 9) AS final_score, final_rank FROM z")
def rerank_fusion(spark: SparkSession, d: str) -> DataFrame:
    r = hybrid.reranked(*_hybrid_inputs(spark, d))
    return r.select("query_id", "item_id", "rerank_rank", F.round("rerank_score", 6).alias("rerank_score"), F.round("final_score", 9).alias("final_score"), "final_rank")


@query(f"""{_RERANK}, o AS (SELECT *, query_id % 7 AS best FROM z)
SELECT query_id, item_id, final_rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN best < 5 AND final_rank = best + 1 THEN 0 ELSE 1 END, final_rank) AS INTEGER) AS judged_rank FROM o""")
def judge_move_to_front(spark: SparkSession, d: str) -> DataFrame:
    q, items, vectors = _hybrid_inputs(spark, d)
    picks = q.select("query_id", (F.col("query_id") % 7).alias("best"))
    return search.move_to_front(hybrid.reranked(q, items, vectors), picks).select("query_id", "item_id", "final_rank", "judged_rank")


@query(rf"""
WITH {_POST}, s AS (SELECT query_id, item_id, sum(tf) AS score FROM p JOIN t USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s)
SELECT query_id, string_agg('[' || rank || '] ' || left(text, 3500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS evidence
FROM r JOIN documents ON doc_id = item_id WHERE rank <= 5 GROUP BY query_id""")
def evidence_blocks(spark: SparkSession, d: str) -> DataFrame:
    q, items = _texts(spark, d)
    return search.evidence(search.lexical_topk(q, items, 5), items)


# ------------------------------------------------------- catalogue, increments

_TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _TABLES))
def load_counts(spark: SparkSession, d: str) -> DataFrame:
    return relational.counts({t: table(spark, d, t) for t in _TABLES})


@query("SELECT DISTINCT source AS scheme FROM documents WHERE source <> ''")
def scheme_list(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("source <> ''").select(F.col("source").alias("scheme")).distinct().orderBy("scheme")


@query("SELECT upper(source) AS scheme, count(*) AS n FROM documents GROUP BY 1")
def scheme_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").groupBy(F.upper("source").alias("scheme")).agg(F.count("*").alias("n"))


@query("""
SELECT n_nationkey, n_name, coalesce(c.n_customers, 0) AS n_customers, coalesce(s.n_suppliers, 0) AS n_suppliers, round(coalesce(c.max_balance, 0), 2) AS max_balance
FROM nation LEFT JOIN (SELECT c_nationkey, count(*) AS n_customers, max(c_acctbal) AS max_balance FROM customer GROUP BY 1) c ON c_nationkey = n_nationkey
LEFT JOIN (SELECT s_nationkey, count(*) AS n_suppliers FROM supplier GROUP BY 1) s ON s_nationkey = n_nationkey""")
def catalogue(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    n = relational.with_counts(n, table(spark, d, "customer"), "n_nationkey", "c_nationkey", n_customers=F.count("*"), max_balance=F.max("c_acctbal"))
    n = relational.with_counts(n, table(spark, d, "supplier"), "n_nationkey", "s_nationkey", n_suppliers=F.count("*"))
    return n.select("n_nationkey", "n_name", "n_customers", "n_suppliers", F.round("max_balance", 2).alias("max_balance"))


@query("""SELECT r_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_name ILIKE '%a_i%' OR n_name ILIKE '%a_i%' GROUP BY ALL""")
def scope_like(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    hit = relational.scope_filter(n, "a_i", "r_name", "n_name")
    return table(spark, d, "customer").join(hit, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_name", "c_mktsegment").agg(F.count("*").alias("n"))


_ALIASES = [
    (rf"(?i)(^|[^\p{{L}}\p{{N}}])({words})([^\p{{L}}\p{{N}}]|$)", target)
    for words, target in (("apache|mit|gnu", "LICENSE"), (r"rights\s+reserved", "RIGHTS"), ("version|release", "VERSION"), ("the", "ENGLISH"), ("der|die|das", "GERMAN"))
]


@query("SELECT doc_id, CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{t}'" for p, t in _ALIASES) + " END AS target FROM documents")
def alias_detect(spark: SparkSession, d: str) -> DataFrame:
    return relational.first_alias(table(spark, d, "documents").select("doc_id", "text"), "text", _ALIASES).drop("text")


@query(r"""
WITH c AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM conversations)
SELECT conv_id, turn, CASE WHEN regexp_matches(q, '(?i)\b(explain|describe|outline|summari[sz]e|compare|contrast|why|in practice|overall|walk me through|implications?|relationship)\b')
  OR regexp_matches(q, '(?i)\bhow\s+(does|do|are|is|would|can)\b') OR regexp_matches(q, '(?i)\bwhat\s+(are|is)\b.*\b(work|process|effect|implication|requirements?)\b') THEN 'synthesis' ELSE 'retrieval' END AS route FROM c""")
def question_router(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").select("conv_id", "turn", X.question_route(F.col("text")).alias("route"))


@query(r"""SELECT sha256(trim(regexp_replace(lower(text), '\s+', ' ', 'g'))) AS title_hash, count(*) AS n, min(doc_id) AS first_id FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def title_hash_groups(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy(X.title_hash(F.col("text")).alias("title_hash")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


@query("SELECT DISTINCT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def pending_anti(spark: SparkSession, d: str) -> DataFrame:
    return relational.pending(table(spark, d, "documents"), table(spark, d, "labels"), ["doc_id"])


@query("""SELECT doc_id, quality FROM labels UNION ALL SELECT doc_id, -1 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)""")
def insert_if_absent(spark: SparkSession, d: str) -> DataFrame:
    new = table(spark, d, "documents").select("doc_id", F.lit(-1).alias("quality"))
    return relational.insert_if_absent(table(spark, d, "labels").select("doc_id", "quality"), new, ["doc_id"])


@query("""SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current FROM orders""")
def supersede_current(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return relational.supersede(o, "o_custkey", F.col("o_orderdate").desc(), F.col("o_orderkey").desc()).drop("o_orderdate")


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality = 1 THEN 'reviewed' END, d.source) AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def update_by_key(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "documents").select("doc_id", F.col("source").alias("status"))
    new = table(spark, d, "labels").select("doc_id", F.when(F.col("quality") == 1, "reviewed").alias("status"))
    return relational.coalesce_update(rows, new, "doc_id", "status")


@query("""SELECT conv_id, turn, left(text, 350) AS preview, CAST(floor(length(text) / 3) AS BIGINT) AS tokens FROM conversations WHERE role = 'assistant' OR text IS NULL OR text = ''""")
def summaries_pending(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role = 'assistant' or text is null or text = ''")
    return c.select("conv_id", "turn", F.left("text", F.lit(350)).alias("preview"), X.token_estimate(F.col("text")).alias("tokens"))


# ---------------------------------------------------------------------- trees


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as one tree."""
    r = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("node_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"), F.col("r_regionkey").cast("long").alias("ordinal"), F.lit("part").alias("kind"), F.lit(None).cast("double").alias("value"))
    n = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("node_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title"), F.col("n_nationkey").cast("long").alias("ordinal"), F.lit("condition").alias("kind"), F.lit(None).cast("double").alias("value"))
    c = table(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("node_id"), F.concat(F.lit("n"), "c_nationkey").alias("parent_id"), F.col("c_name").alias("title"), F.col("c_custkey").alias("ordinal"), F.lit("clause").alias("kind"), F.col("c_acctbal").alias("value"))
    return r.unionByName(n).unionByName(c)


_N = """n AS (
  SELECT 'r' || r_regionkey AS node_id, CAST(NULL AS VARCHAR) AS parent_id, r_name AS title, CAST(r_regionkey AS BIGINT) AS ordinal, 'part' AS kind, CAST(NULL AS DOUBLE) AS value FROM region
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name, n_nationkey, 'condition', NULL FROM nation
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, c_name, c_custkey, 'clause', c_acctbal FROM customer)"""
_WALK = f"""WITH RECURSIVE {_N}, w AS (
  SELECT node_id, parent_id, title, 0 AS depth, title AS breadcrumb, [ordinal] AS path FROM n WHERE parent_id IS NULL
  UNION ALL SELECT n.node_id, n.parent_id, n.title, w.depth + 1, w.breadcrumb || ' › ' || n.title, list_append(w.path, n.ordinal) FROM n JOIN w ON n.parent_id = w.node_id)"""
_UP = f"""WITH RECURSIVE {_N}, u AS (
  SELECT node_id AS ancestor, node_id AS descendant, 0 AS distance FROM n
  UNION ALL SELECT n.parent_id, u.descendant, u.distance + 1 FROM u JOIN n ON n.node_id = u.ancestor WHERE n.parent_id IS NOT NULL)"""


@query(f"{_WALK} SELECT node_id, depth, breadcrumb FROM w")
def tree_descend(spark: SparkSession, d: str) -> DataFrame:
    return tree.descend(_nodes(spark, d)).select("node_id", "depth", "breadcrumb")


@query(f"{_UP} SELECT ancestor AS node_id, round(min(value), 2) AS low, round(max(value), 2) AS high, count(*) AS subtree_size FROM u JOIN n ON n.node_id = descendant GROUP BY 1")
def tree_rollup(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d).withColumns({"page_min": F.col("value"), "page_max": F.col("value")})
    return tree.rollup_pages(nodes).select("node_id", F.round("page_start", 2).alias("low"), F.round("page_end", 2).alias("high"), "subtree_size")


@query(f"{_WALK} SELECT array_to_string(path, '.') AS place, repeat(chr(9), depth) || trim(title) AS line FROM w WHERE trim(title) <> ''")
def outline_text(spark: SparkSession, d: str) -> DataFrame:
    return tree.outline(_nodes(spark, d)).select(F.array_join("path", ".").alias("place"), "line")


@query(f"""{_WALK}, u AS (SELECT node_id AS a, node_id AS b FROM n UNION ALL SELECT n.parent_id, u.b FROM u JOIN n ON n.node_id = u.a WHERE n.parent_id IS NOT NULL)
SELECT a AS node_id, md5(string_agg(title, chr(10) ORDER BY path)) AS text_md5, count(*) AS n_lines FROM u JOIN w ON w.node_id = b GROUP BY 1""")
def subtree_text(spark: SparkSession, d: str) -> DataFrame:
    t = tree.full_text(_nodes(spark, d))
    return t.select("node_id", F.md5("text_full").alias("text_md5"), F.size(F.split("text_full", "\n")).cast("long").alias("n_lines"))


@query(f"""WITH {_N}, k AS (SELECT parent_id, count(*) AS c, string_agg(title, ',' ORDER BY ordinal) AS kids FROM n WHERE kind = 'condition' GROUP BY 1)
SELECT node_id, 'PT ' || (ordinal + 1) || ' · ' || title AS display_title, CAST(ordinal % 12 AS INTEGER) AS colour, CAST(coalesce(c, 0) AS INTEGER) AS n_children, coalesce(kids, '') AS kids
FROM n LEFT JOIN k ON k.parent_id = node_id WHERE kind = 'part'""")
def hierarchy_nested(spark: SparkSession, d: str) -> DataFrame:
    h = tree.hierarchy(_nodes(spark, d))
    return h.select("node_id", "display_title", "colour", "n_children", F.coalesce(F.array_join(F.transform("children", lambda c: c["title"]), ","), F.lit("")).alias("kids"))


@query("""SELECT r_regionkey AS doc_id, '0' AS node_id, r_name AS title, 0 AS depth FROM region UNION ALL
SELECT n_regionkey, '0.' || (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1), n_name, 1 FROM nation""")
def tree_flatten_json(spark: SparkSession, d: str) -> DataFrame:
    kids = table(spark, d, "nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.struct(x["n_name"].alias("title"))).alias("children"))
    docs = table(spark, d, "region").join(kids, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_regionkey").alias("doc_id"), F.to_json(F.struct(F.col("r_name").alias("title"), "children")).alias("j"))
    return tree.flatten_json(docs, "j").select("doc_id", "node_id", "title", "depth")


# ---------------------------------------------------------------------- lines


@query(r"""SELECT doc_id, trim(regexp_replace(translate(text, '“”‘’`–—' || chr(61485) || chr(61480) || chr(61481) || chr(61501) || chr(61483) || chr(61620) || chr(61623) || chr(61669) || chr(61520) || chr(61653), '"\"''''''---()=+×•∑PΠ'), '\s+', ' ', 'g')) AS text FROM documents""".replace('\\"', '"'))
def clean_symbols(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", X.clean_symbols(F.col("text")).alias("text"))


#: Headings made of order lines: the documents have no numbered ones.
_HEADING = "CASE l_linenumber % 7 WHEN 0 THEN 'Part ' || l_linenumber || ' of it' WHEN 1 THEN l_orderkey % 90 || '. Heading' WHEN 2 THEN l_orderkey % 90 || '.' || l_linenumber || ' Clause text' WHEN 3 THEN '(' || {upper} || ') limb' WHEN 4 THEN '(' || {lower} || ') limb' WHEN 5 THEN '(' || l_suppkey % 30 || ') limb' ELSE 'SOME TITLE ' || {upper} END"


def _heading() -> F.Column:
    return F.expr(_HEADING.format(upper="substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(l_partkey % 26 + 1 AS INT), 1)", lower="element_at(array('a', 'i', 'ii', 'iv', 'b', 'x', 'xiv', 'aa', 'vi', 'z'), CAST(l_partkey % 10 + 1 AS INT))"))


_HEADING_SQL = _HEADING.format(upper="substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ', CAST(l_partkey % 26 + 1 AS INT), 1)", lower="['a', 'i', 'ii', 'iv', 'b', 'x', 'xiv', 'aa', 'vi', 'z'][CAST(l_partkey % 10 + 1 AS INT)]")
#: The checker's SQL has no look-ahead: the same numerals spelt out.
_NUMERALS = r"^\((x{1,3}(ix|iv|v?i{0,3})|ix|iv|vi{0,3}|i{1,3})\)"
_CLASS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(t, '{p.replace(fixed.ROMAN_LIMB, _NUMERALS)}') THEN '{k}'" for k, p in X.body_patterns()) + " ELSE 'text' END"


@query(f"SELECT kind, count(*) AS n, count(DISTINCT t) AS n_texts FROM (SELECT t, {_CLASS_SQL} AS kind FROM (SELECT {_HEADING_SQL} AS t FROM lineitem)) GROUP BY 1")
def classify_lines(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(_heading().alias("t"))
    return t.groupBy(X.classify(F.col("t")).alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("t").alias("n_texts"))


_ROMAN_SQL = "map {" + ", ".join(f"'{k}': {v}" for k, v in X.ROMAN.items()) + "}"


@query(f"""
WITH t AS (SELECT {_HEADING_SQL} AS t FROM lineitem), e AS (SELECT t, {_CLASS_SQL} AS kind, nullif(regexp_extract(t, '^\\(([A-Za-z0-9]+)\\)', 1), '') AS e FROM t)
SELECT e, kind, CASE WHEN kind IN ('condition', 'clause') THEN 'dotted' WHEN e IS NULL THEN 'none' WHEN regexp_matches(e, '^[0-9]+$') THEN 'numeric' WHEN regexp_matches(e, '^[A-Z]$') THEN 'upper_alpha'
    WHEN kind = 'sub_sub_clause' THEN 'lower_roman' WHEN kind = 'sub_sub_sub_clause' THEN 'lower_alpha' WHEN {_ROMAN_SQL}[lower(e)] IS NOT NULL THEN 'lower_roman' ELSE 'lower_alpha' END AS series,
  CASE WHEN regexp_matches(lower(e), '^[a-z]$') THEN ascii(lower(e)) - 96 WHEN length(e) = 2 AND lower(e)[1] = lower(e)[2] AND regexp_matches(lower(e), '^[a-z]') THEN ascii(lower(e)) - 70 END AS alpha,
  {_ROMAN_SQL}[lower(e)] AS roman, count(*) AS n FROM e GROUP BY ALL""")
def enumerator_values(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "lineitem").select(_heading().alias("t"))
    e = X.enumerator(F.col("t"))
    kind = X.classify(F.col("t"))
    return t.groupBy(e.alias("e"), kind.alias("kind"), X.series(kind, F.col("t")).alias("series"), X.alpha_value(e).alias("alpha"), X.roman_value(e).alias("roman")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, l_linenumber AS val FROM lineitem),
b AS (SELECT *, coalesce(lag(val) OVER (PARTITION BY l_orderkey ORDER BY ord) + 1, 1) AS expected_val FROM s)
SELECT l_orderkey, CAST(ord AS INTEGER) AS ord, val, expected_val FROM b WHERE val <> expected_val AND val <> 1""")
def sequence_check(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("ord"), F.col("l_linenumber").alias("val"))
    return lines.sequence_breaks(items, ["l_orderkey"])


def _doc_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of all documents, labelled by length."""
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_id", "text"))
    return rows.withColumn("label", F.when(F.length("text") % 11 == 0, "page_header").when(F.length("text") % 13 == 0, "section_header").otherwise("text"))


_LINES = """x AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS line_id, unnest(parts) AS text FROM x),
t AS (SELECT *, CASE WHEN length(text) % 11 = 0 THEN 'page_header' WHEN length(text) % 13 = 0 THEN 'section_header' ELSE 'text' END AS label FROM l)"""
_JUNK = r"regexp_matches(text, '(?i)^DRAFT:|^\d+$|Note to Reader:|^\[.*\]$|^OFFICIAL\s*$')"
_STRUCT = r"regexp_matches(text, '(?i)^\s*(\d+\.\d+(\s|$)|Condition\s+\d+|\d+\s+Condition|\([A-Za-z0-9]{1,5}\)(\s|$))')"


@query(f"WITH {_LINES} SELECT doc_id, label, count(*) AS n, CAST(sum(length(trim(regexp_replace(text, '\\s+', ' ', 'g')))) AS BIGINT) AS chars FROM t WHERE (label NOT IN ('page_header', 'page_footer') OR {_STRUCT}) AND NOT {_JUNK} GROUP BY ALL")
def junk_rescue_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = lines.keep_lines(_doc_lines(spark, d))
    return kept.groupBy("doc_id", "label").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


_WORDS_SQL = ", ".join(f"'{w}'" for w in lines.FUNCTION_WORDS)


@query(rf"""
WITH {_LINES}, a AS (SELECT *, lag(text) OVER w AS p, lag(label) OVER w AS pl, trim(text) AS b, trim(lag(text) OVER w) AS a,
    coalesce(last_value(nullif(regexp_extract(trim(text), '^(\d+)\.(\s|$)', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '1') AS c
  FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY line_id)),
f AS (SELECT *, regexp_replace(regexp_extract(lower(a), '(\S*)$', 1), '^[.,;:()'']+|[.,;:()'']+$', '', 'g') IN ({_WORDS_SQL}) AS open_end,
    regexp_matches(b, '(?i)^Part\s+\d+') OR regexp_matches(b, '^\d+\.(\s|$)') OR regexp_matches(b, '^\([A-Za-z0-9]{{1,5}}\)(\s|$)') OR regexp_matches(b, '{X.DEFINITION[0].replace("'", "''")}') OR regexp_matches(b, '{X.DEFINITION[1].replace("'", "''")}')
      OR (regexp_matches(b, '^\d+[A-Z]?\.\d+[A-Z]?(\s|$)') AND upper(split_part(b, '.', 1)) = c) AS header FROM a),
j AS (SELECT *, coalesce(pl IN ('text', 'list_item', 'footnote', 'formula') AND label IN ('text', 'list_item', 'footnote', 'formula') AND (a = '' OR b = '' OR (NOT header AND (
    (regexp_matches(lower(a), '(is|as|formula):$') AND regexp_matches(b, '[=+/*]'))
    OR (NOT (regexp_matches(b, '^\([A-Za-z0-9]+\)\s') AND NOT open_end) AND (NOT regexp_matches(a, '[.;:]$') OR regexp_matches(b, '^\p{{Ll}}') OR regexp_matches(b, '^[(),=+\-*/]') OR length(a) < 20 OR length(b) < 20 OR open_end))))), FALSE) AS joins FROM f),
g AS (SELECT *, sum(CASE WHEN joins THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line_id) AS grp FROM j)
SELECT doc_id, min(line_id) AS line_id, CAST(count(*) - 1 AS INTEGER) AS n_absorbed FROM g GROUP BY doc_id, grp""")
def fragment_merge(spark: SparkSession, d: str) -> DataFrame:
    return lines.merge_fragments(_doc_lines(spark, d)).select("doc_id", "line_id", F.size("absorbed").alias("n_absorbed"))


@query("""
WITH u AS (SELECT user_id, event_id, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN event_id END AS h FROM events)
SELECT event_id, user_id, last_value(h IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heading_id FROM u""")
def gap_assign(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", "event_type")
    first = e.agg(F.min("event_type").alias("m"))
    heads = e.join(F.broadcast(first), F.col("event_type") == F.col("m")).select("user_id", "event_id")
    return lines.assign_headings(e.select("user_id", "event_id"), heads, ["user_id"], "event_id").select("event_id", "user_id", "heading_id")


@query("""
WITH k AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ord, CAST(l_partkey % 5 AS INTEGER) AS depth FROM lineitem)
SELECT a.l_orderkey, CAST(a.ord AS INTEGER) AS ord, a.depth, CAST((SELECT max(b.ord) FROM k b WHERE b.l_orderkey = a.l_orderkey AND b.ord < a.ord AND b.depth < a.depth) AS INTEGER) AS parent_ord FROM k a""")
def stack_parents(spark: SparkSession, d: str) -> DataFrame:
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    rows = table(spark, d, "lineitem").select("l_orderkey", F.row_number().over(order).alias("ord"), (F.col("l_partkey") % 5).cast("int").alias("depth"))
    return lines.parents_by_depth(rows, ["l_orderkey"])


@query()
def stack_tree(spark: SparkSession, d: str) -> DataFrame:
    """Stacked limbs with context-dependent enumerators: a sequential rule, tested against goldens."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    content = table(spark, d, "lineitem").select(
        F.lit("orders").alias("doc_id"), F.col("l_orderkey").cast("string").alias("condition"), F.lit("Heading").alias("heading"), F.row_number().over(order).alias("line_id"), _heading().alias("text")
    )
    return lines.stack(content)


@query(r"""SELECT p_partkey, trim(regexp_extract(t, '^(.*?)\s*\.*\s*(\d+)?\s*$', 1)) AS title, TRY_CAST(nullif(regexp_extract(t, '^(.*?)\s*\.*\s*(\d+)?\s*$', 2), '') AS INTEGER) AS page,
  regexp_replace(trim(lower(p_name)), '[^a-z0-9 ]', '', 'g') AS key FROM (SELECT *, p_name || ' ..... ' || p_size AS t FROM part)""")
def toc_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.concat(F.col("p_name"), F.lit(" ..... "), F.col("p_size").cast("string"))
    return table(spark, d, "part").select("p_partkey", F.trim(X.toc_title(t)).alias("title"), X.toc_page(t).alias("page"), X.title_key(F.col("p_name")).alias("key"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[ -]', '_', 'g'), '[^\p{L}\p{N}_]', '', 'g'), '_+', '_', 'g'), '^_|_$', '', 'g') AS slug,
  CASE WHEN regexp_matches(lower(url), 'lcha|hydrogen') THEN 'LCHA' WHEN contains(lower(url), 'icc') THEN 'ICC' WHEN contains(lower(url), 'dpa') THEN 'DPA' ELSE 'CfD' END AS scheme, split_part(trim(url), '.', 1) AS reference FROM pages""")
def metadata_infer(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", X.slug(u).alias("slug"), X.scheme_of(u).alias("scheme"), X.reference_number(u).alias("reference"))


@query()
def split_definitions(spark: SparkSession, d: str) -> DataFrame:
    """Definitions run together are cut by look-around, which the checker's SQL lacks; tested against goldens."""
    t = F.concat(F.lit('"'), F.col("p_name"), F.lit('" means '), F.col("p_brand"), F.lit('; "'), F.col("p_type"), F.lit('" means a type;'))
    return table(spark, d, "part").select("p_partkey", F.posexplode(X.split_definitions(t)).alias("place", "definition"))


# --------------------------------------------------------------------- chunks


@query(f"""
WITH RECURSIVE {_LINES}, r AS (
  SELECT doc_id, line_id, length(text) AS size, 0 AS part FROM t WHERE line_id = 0
  UNION ALL SELECT t.doc_id, t.line_id, CASE WHEN r.size + length(t.text) > 1500 AND r.size > 0 THEN length(t.text) ELSE r.size + length(t.text) END, r.part + CASE WHEN r.size + length(t.text) > 1500 AND r.size > 0 THEN 1 ELSE 0 END
  FROM r JOIN t ON t.doc_id = r.doc_id AND t.line_id = r.line_id + 1),
g AS (SELECT doc_id, part, count(*) AS n_pieces, sum(length(text)) AS char_length, string_agg(text, chr(10) || chr(10) ORDER BY line_id) AS text FROM r JOIN t USING (doc_id, line_id) GROUP BY ALL)
SELECT doc_id AS source_id, part + 1 AS part, count(*) OVER (PARTITION BY doc_id) AS total_parts, CAST(n_pieces AS INTEGER) AS n_pieces, CAST(char_length AS INTEGER) AS char_length, sha256(text) AS text_sha256 FROM g""")
def chunk_pack(spark: SparkSession, d: str) -> DataFrame:
    pieces = _doc_lines(spark, d).select(F.col("doc_id").alias("source_id"), F.col("line_id").alias("ord"), F.left("text", F.lit(15)).alias("label"), "text")
    return chunking.pack(pieces, 1500).select("source_id", "part", "total_parts", "n_pieces", "char_length", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT doc_id, length(text) AS length, CAST(length(text) % 3 AS INTEGER) AS n_children, CASE WHEN length(text) % 3 > 0 THEN 'structured summary' ELSE 'overlapping chunks' END AS advice,
  CAST(CASE WHEN length(text) % 3 > 0 THEN 1 ELSE floor(length(text) / 3000) + 1 END AS BIGINT) AS n_chunks FROM documents WHERE length(text) > 8000""")
def oversize_advice(spark: SparkSession, d: str) -> DataFrame:
    n = F.length("text")
    return chunking.oversize_advice(table(spark, d, "documents").select("doc_id", n.cast("long").alias("length"), (n % 3).cast("int").alias("n_children")), 8000)


# --------------------------------------------------------------------- graphs


def _links(spark: SparkSession, d: str) -> DataFrame:
    found = F.regexp_extract_all("html", F.lit(r'href="/([^"]*)"'), F.lit(1))
    host = F.regexp_extract("url", r"^https?://([^/]*)", 1)
    return table(spark, d, "pages").select(host.alias("source"), F.explode(found).alias("target"))


_LINKS = r"""c AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS source, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS target FROM pages),
e AS (SELECT source, target, count(*) AS n FROM c WHERE source <> target GROUP BY ALL)"""


@query(f"WITH {_LINKS} SELECT * FROM e")
def edge_counts(spark: SparkSession, d: str) -> DataFrame:
    return graph.edge_counts(_links(spark, d))


@query(f"WITH {_LINKS} SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS INTEGER) AS place FROM e) WHERE place <= 3")
def edge_topk(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_edges(graph.edge_counts(_links(spark, d)), 3)


@query(f"WITH {_LINKS} SELECT * FROM (SELECT target AS source, source AS target, n, CAST(row_number() OVER (PARTITION BY target ORDER BY n DESC, source) AS INTEGER) AS place FROM e) WHERE place <= 3")
def edge_inbound(spark: SparkSession, d: str) -> DataFrame:
    return graph.top_edges(graph.transpose(graph.edge_counts(_links(spark, d))), 3)


_CITES = """c AS (SELECT CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 40 END AS source, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 40 END AS target FROM orders)"""


def _citations(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.expr("CASE WHEN o_orderkey % 7 > 0 THEN o_custkey % 40 END").alias("source"), F.expr("CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 40 END").alias("target"))


@query(f"""WITH {_CITES} SELECT count(*) FILTER (WHERE source <> target) AS resolved, count(*) FILTER (WHERE source = target) AS self_citations,
count(*) FILTER (WHERE source IS NULL) AS unresolved_sources, count(*) FILTER (WHERE source IS NOT NULL AND target IS NULL) AS unresolved_targets FROM c""")
def citation_counters(spark: SparkSession, d: str) -> DataFrame:
    return graph.counters(_citations(spark, d))


@query(f"""WITH {_CITES}, e AS (SELECT source, target, count(*) AS n FROM c WHERE source <> target GROUP BY ALL),
o AS (SELECT source AS node, count(*) AS n_out, CAST(sum(n) AS BIGINT) AS weight_out FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, target) AS p FROM e) WHERE p <= 20 GROUP BY 1),
i AS (SELECT target AS node, count(*) AS n_in, CAST(sum(n) AS BIGINT) AS weight_in FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY n DESC, source) AS p FROM e) WHERE p <= 20 GROUP BY 1),
k AS (SELECT CAST(x AS BIGINT) AS node FROM range(0, 45) t(x))
SELECT node, coalesce(n_out, 0) AS n_out, coalesce(weight_out, 0) AS weight_out, coalesce(n_in, 0) AS n_in, coalesce(weight_in, 0) AS weight_in, coalesce(n_out, 0) + coalesce(n_in, 0) AS total_links
FROM k LEFT JOIN o USING (node) LEFT JOIN i USING (node)""")
def citation_records(spark: SparkSession, d: str) -> DataFrame:
    return graph.node_records(spark.range(45).select(F.col("id").alias("node")), graph.edge_counts(_citations(spark, d)))


@query("""
WITH s AS (SELECT o_custkey % 500 AS doc, o_orderkey AS seg_ord, CAST(floor(o_totalprice) AS BIGINT) AS s, CAST(floor(o_totalprice) AS BIGINT) + o_orderkey % 5000 AS e FROM orders),
p AS (SELECT l_partkey % 500 AS doc, l_orderkey * 1000003 + l_linenumber * 1009 + l_partkey AS span_id, CAST(floor(min(l_extendedprice)) AS BIGINT) AS s FROM lineitem GROUP BY 1, 2),
m AS (SELECT p.doc, span_id, seg_ord, row_number() OVER (PARTITION BY p.doc, span_id ORDER BY s.e - s.s, seg_ord) AS r FROM p JOIN s ON s.doc = p.doc AND s.s <= p.s AND p.s + 10 <= s.e)
SELECT p.doc, p.span_id, m.seg_ord FROM p LEFT JOIN m ON m.doc = p.doc AND m.span_id = p.span_id AND r = 1""")
def containment_smallest(spark: SparkSession, d: str) -> DataFrame:
    low = F.floor("o_totalprice")
    seg = table(spark, d, "orders").select((F.col("o_custkey") % 500).alias("doc"), F.col("o_orderkey").alias("seg_ord"), low.alias("s"), (low + F.col("o_orderkey") % 5000).alias("e"))
    spans = (
        table(spark, d, "lineitem").groupBy((F.col("l_partkey") % 500).alias("doc"), (F.col("l_orderkey") * 1000003 + F.col("l_linenumber") * 1009 + F.col("l_partkey")).alias("span_id"))
        .agg(F.floor(F.min("l_extendedprice")).alias("s")).withColumn("e", F.col("s") + 10)
    )
    return graph.smallest_containing(seg, spans, ["doc"]).select("doc", "span_id", "seg_ord")


@query(f"""WITH RECURSIVE {_N}, x AS (SELECT node_id, parent_id, CASE WHEN ordinal % 3 = 0 OR parent_id IS NULL THEN title END AS code FROM n),
u AS (SELECT node_id, parent_id AS at_node, code, 0 AS dist FROM x UNION ALL SELECT u.node_id, x.parent_id, x.code, u.dist + 1 FROM u JOIN x ON x.node_id = u.at_node WHERE u.code IS NULL)
SELECT node_id, code FROM u WHERE code IS NOT NULL""")
def segment_resolve(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d).select("node_id", "parent_id", F.expr("CASE WHEN ordinal % 3 = 0 OR parent_id IS NULL THEN title END").alias("code"))
    return graph.resolve_up(nodes)


@query("""
WITH i AS (SELECT CAST(s_nationkey AS BIGINT) AS doc, s_suppkey AS number, CASE WHEN s_suppkey % 9 > 0 THEN CAST(s_suppkey % 50 AS INTEGER) END AS page_start FROM supplier)
SELECT doc, number, page_start, CASE WHEN page_start IS NOT NULL THEN CASE WHEN number % 10 = 3 THEN 700 ELSE greatest(1, page_start + CASE WHEN doc < 10 THEN doc - 5 ELSE 0 END) END END AS pdf_start,
  CASE WHEN page_start IS NOT NULL THEN CASE WHEN number % 10 = 3 THEN 705 ELSE greatest(1, page_start + CASE WHEN doc < 10 THEN doc - 5 ELSE 0 END) END END AS pdf_end FROM i""")
def page_range(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("doc"), F.col("s_suppkey").alias("number"), F.expr("CASE WHEN s_suppkey % 9 > 0 THEN CAST(s_suppkey % 50 AS INT) END").alias("page_start")).withColumn("page_end", F.lit(None).cast("int"))
    overrides = items.where("number % 10 = 3").select("doc", "number", F.lit(700).alias("start"), F.lit(705).alias("end"))
    offsets = spark.range(10).select(F.col("id").alias("doc"), (F.col("id") - 5).alias("offset"))
    r = graph.page_range(items, overrides, offsets)
    return r.withColumns({c: F.col(c).cast("long") for c in ("pdf_start", "pdf_end")})


@query("""
WITH i AS (SELECT p_brand AS doc, p_partkey AS ord, p_partkey AS item, p_size * 10 AS s, p_size * 10 + CAST(p_partkey % 25 AS INTEGER) AS e FROM part),
g AS (SELECT DISTINCT p_brand AS doc, CAST(x AS INTEGER) AS page FROM part, range(0, 520, 13) t(x)),
a AS (SELECT g.doc, page, item, row_number() OVER (PARTITION BY g.doc, page ORDER BY CASE WHEN page <= e THEN 0 ELSE 1 END, CASE WHEN page <= e THEN ord END, s DESC, ord) AS r FROM g JOIN i ON i.doc = g.doc AND s <= page)
SELECT g.doc, g.page, item FROM g LEFT JOIN a ON a.doc = g.doc AND a.page = g.page AND r = 1""")
def page_lookup(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    items = p.select(F.col("p_brand").alias("doc"), F.col("p_partkey").alias("ord"), F.col("p_partkey").alias("item"), (F.col("p_size") * 10).alias("start"), (F.col("p_size") * 10 + F.col("p_partkey") % 25).cast("int").alias("end"))
    pages = p.select(F.col("p_brand").alias("doc")).distinct().select("doc", F.explode(F.sequence(F.lit(0), F.lit(519), F.lit(13))).alias("page"))
    return graph.page_lookup(pages, items)


# ----------------------------------------------------------------- evaluation

_RANKED = f"""WITH e AS ({_E}), s AS (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id AS item_id, e.label, {_COS} AS score FROM e q, e WHERE q.vec_id % 20 = 0 AND q.vec_id <> e.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s), t AS (SELECT * FROM r WHERE rank <= 25),
g AS (SELECT vec_id AS query_id, g.first_rank FROM e LEFT JOIN (SELECT query_id, min(rank) AS first_rank FROM t WHERE label = ql GROUP BY 1) g ON g.query_id = vec_id WHERE vec_id % 20 = 0)"""


def _results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Neighbours of every query with their label as document; gold is the query's own label."""
    q, items = _vectors(spark, d)
    top = search.dense_topk(q, items, 26).where("query_id <> item_id")
    top = top.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("rank <= 25")
    labels = items.select("item_id", F.col("label").alias("document_id"))
    results = top.join(labels, "item_id").select("query_id", "item_id", "rank", "document_id", F.lit(None).cast("string").alias("condition"), F.lit(None).cast("string").alias("title"))
    gold = q.select("query_id").join(labels.withColumnRenamed("item_id", "query_id"), "query_id").select("query_id", "document_id", F.lit(None).cast("string").alias("condition"), F.lit(None).cast("string").alias("title"))
    return results, gold


@query(f"""{_RANKED} SELECT count(*) AS n_queries, round(avg(CASE WHEN first_rank <= 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, round(avg(CASE WHEN first_rank <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_3,
round(avg(CASE WHEN first_rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5, round(avg(coalesce(1.0::DOUBLE / first_rank, 0)), 6) AS mrr, round(avg(CASE WHEN first_rank IS NULL THEN 0.0 ELSE 1.0 END), 6) AS recall FROM g""")
def eval_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = evaluate.metrics(evaluate.gold_ranks(*_results(spark, d)))
    return m.select("n_queries", *[F.round(c, 6).alias(c) for c in m.columns[1:]])


@query(f"{_RANKED} SELECT CASE WHEN first_rank IS NULL THEN 'not_retrieved' WHEN first_rank = 1 THEN 'hit' WHEN first_rank <= 5 THEN 'top5_not_first' ELSE 'outside_top5' END AS outcome, count(*) AS n FROM g GROUP BY 1")
def eval_outcomes(spark: SparkSession, d: str) -> DataFrame:
    r = evaluate.gold_ranks(*_results(spark, d))
    return r.groupBy(evaluate.outcome(F.col("first_rank"), F.col("first_rank")).alias("outcome")).agg(F.count("*").alias("n"))


@query(f"""{_RANKED}, f AS (SELECT query_id, label AS document_id, CAST(min(rank) AS INTEGER) AS rank FROM t GROUP BY ALL)
SELECT query_id, document_id, rank, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank) AS INTEGER) AS group_rank FROM f""")
def collapsed_ranks(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.collapsed_rank(_results(spark, d)[0], "document_id").select("query_id", "document_id", "rank", "group_rank")


@query("SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id AND d.lang = 'en')")
def gold_validate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select("doc_id").join(table(spark, d, "documents").where("lang = 'en'"), "doc_id", "left_anti")


def _builds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    old = o.where("o_orderkey % 11 <> 0").select("o_orderkey", F.col("o_orderpriority").alias("content"))
    new = o.where("o_orderkey % 13 <> 0").select("o_orderkey", F.expr("CASE WHEN o_orderkey % 17 = 0 THEN o_orderstatus ELSE o_orderpriority END").alias("content"))
    return old, new


_BUILDS = """p AS (SELECT o_orderkey, o_orderpriority AS c FROM orders WHERE o_orderkey % 11 <> 0),
c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN o_orderstatus ELSE o_orderpriority END AS c FROM orders WHERE o_orderkey % 13 <> 0)"""


@query(f"""WITH {_BUILDS} SELECT o_orderkey, CASE WHEN p.o_orderkey IS NULL THEN 'added' WHEN c.o_orderkey IS NULL THEN 'removed' WHEN p.c IS DISTINCT FROM c.c THEN 'mutated' ELSE 'same' END AS status
FROM p FULL JOIN c USING (o_orderkey)""")
def build_diff(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.diff(*_builds(spark, d), "o_orderkey", "content")


@query(f"WITH {_BUILDS} SELECT o_orderkey, 'expected' AS side FROM p WHERE o_orderkey NOT IN (SELECT o_orderkey FROM c) UNION ALL SELECT o_orderkey, 'actual' FROM c WHERE o_orderkey NOT IN (SELECT o_orderkey FROM p)")
def validation_sets(spark: SparkSession, d: str) -> DataFrame:
    old, new = _builds(spark, d)
    return evaluate.missing(old, new, ["o_orderkey"])


@query("""WITH a AS (SELECT event_id, user_id, value - 20 - lead(value) OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS gap FROM events)
SELECT event_id, user_id, round(gap, 6) AS gap FROM a WHERE gap > 0""")
def vertical_holes(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "events").select(F.col("event_id").alias("box_id"), "user_id", F.col("value").alias("t"), (F.col("value") - 20).alias("b"))
    return evaluate.vertical_holes(boxes, ["user_id"], 0.0).select(F.col("box_id").alias("event_id"), "user_id", F.round("gap", 6).alias("gap"))


@query("""SELECT user_id, bool_and(coalesce(s >= 0, TRUE)) AS non_decreasing FROM (SELECT user_id, event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events) GROUP BY 1""")
def monotone_check(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("place"))
    return evaluate.monotone(e, ["user_id"], "place", "event_id")


@query("""SELECT lang, count(*) AS n_items, CAST(sum(length(text)) AS BIGINT) AS total_chars, CAST(floor(sum(length(text)) / count(*)) AS BIGINT) AS avg_chars, round(100.0::DOUBLE * sum(length(text)) / count(*) / 8000, 4) AS usage_pct,
count(*) FILTER (WHERE length(text) > 8000) AS n_over, CAST(floor(sum(length(text)) / 3) AS BIGINT) AS token_estimate FROM documents GROUP BY 1""")
def capacity_by_lang(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.capacity(table(spark, d, "documents"), "lang", 8000)


_UNIT = f"WITH e AS ({_E}), u AS (SELECT vec_id, label, v, sqrt(list_dot_product(v, v)) AS n FROM e)"


@query(f"""{_UNIT}, p AS (SELECT a.label, avg(list_dot_product(a.v, b.v) / (a.n * b.n)) AS m FROM u a JOIN u b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY 1),
c AS (SELECT label, place, sum(x / n) AS s FROM (SELECT label, n, generate_subscripts(v, 1) AS place, unnest(v) AS x FROM u) GROUP BY ALL), k AS (SELECT label, count(*) AS n_items FROM u GROUP BY 1),
q AS (SELECT label, sqrt(sum(s * s)) AS q FROM c GROUP BY 1)
SELECT k.label, n_items, round(m, 6) AS mean_cosine, round(CASE WHEN n_items > 1 THEN 1 - q / n_items ELSE 0 END, 6) AS centroid_drift FROM k LEFT JOIN p ON p.label = k.label JOIN q ON q.label = k.label""")
def type_stats(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.type_stats(_vectors(spark, d)[1], "label").select("label", "n_items", F.round("mean_cosine", 6).alias("mean_cosine"), F.round("centroid_drift", 6).alias("centroid_drift"))


@query(f"{_UNIT} SELECT a.label AS type_a, b.label AS type_b, round(avg(list_dot_product(a.v, b.v) / (a.n * b.n)), 6) AS mean_cosine FROM u a JOIN u b ON a.label < b.label GROUP BY ALL")
def similarity_matrix(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.similarity_matrix(_vectors(spark, d)[1], "label").withColumn("mean_cosine", F.round("mean_cosine", 6))


@query(_dense_sql(k=5).replace("SELECT query_id, item_id, round(score, 6) AS score, rank FROM r", "SELECT CASE WHEN score >= 0.7 THEN 'EXCELLENT' WHEN score >= 0.6 THEN 'GOOD' WHEN score >= 0.5 THEN 'MODERATE' ELSE 'WEAK' END AS band, count(*) AS n FROM r") + " GROUP BY 1")
def quality_bands(spark: SparkSession, d: str) -> DataFrame:
    q, items = _vectors(spark, d)
    return search.dense_topk(q, items, 5).groupBy(X.quality_band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query("""SELECT event_type, date_trunc('hour', ts) AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL""")
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """The batch form of the streaming aggregation."""
    e = table(spark, d, "events")
    return e.groupBy("event_type", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("start")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


# ----------------------------------------------------- functions by themselves


@query(f"WITH e AS ({_E}) SELECT vec_id, CAST(len(v) AS INTEGER) AS width, round(list_sum(v), 4) AS total FROM e")
def vector_literals(spark: SparkSession, d: str) -> DataFrame:
    """Vectors written as text literals and read back."""
    e = table(spark, d, "embeddings").select("vec_id", F.concat(F.lit("["), F.array_join("embedding", ","), F.lit("]")).alias("t"))
    v = e.select("vec_id", V.parse_vector(F.col("t")).alias("v"))
    return v.select("vec_id", F.size("v").alias("width"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 4).alias("total"))


@query("SELECT doc_id, substr(text, CAST(doc_id % 50 + 1 AS BIGINT), 20) AS piece FROM documents")
def text_spans(spark: SparkSession, d: str) -> DataFrame:
    at = (F.col("doc_id") % 50).cast("int")
    return table(spark, d, "documents").select("doc_id", X.span(F.col("text"), at, at + 20).alias("piece"))


@query(f"SELECT t, count(*) AS n FROM (SELECT trim(regexp_replace({_HEADING_SQL}, '^[0-9]+[A-Z]?\\.\\s*', '')) AS t FROM lineitem) GROUP BY 1")
def stripped_numbers(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.trim(X.strip_number(_heading())).alias("t")).groupBy("t").agg(F.count("*").alias("n"))


@query(f"""WITH {_LINES}, p AS (SELECT doc_id, 0 AS line_id, substr(text, 1, 1) AS pattern FROM documents WHERE doc_id % 3 = 0)
SELECT t.doc_id, t.line_id, md5(CASE WHEN pattern IS NOT NULL AND contains(text, pattern) THEN '> ' || replace(text, pattern, '#') ELSE text END) AS text_md5 FROM t LEFT JOIN p USING (doc_id, line_id)""")
def patched_lines(spark: SparkSession, d: str) -> DataFrame:
    """First lines of every third document with their first character replaced throughout."""
    docs = table(spark, d, "documents").where("doc_id % 3 = 0")
    patches = docs.select("doc_id", F.lit(0).alias("line_id"), F.left("text", F.lit(1)).alias("pattern"), F.lit("#").alias("replacement"), F.lit("> ").alias("prepend"))
    return lines.patch_lines(_doc_lines(spark, d), patches).select("doc_id", "line_id", F.md5("text").alias("text_md5"))
