"""Registered queries on parsing, references, chunks and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire import models
from quire.functions import text as X
from quire.functions import vector as V
from quire.operators import chunking, evaluate, lines, parsing, references, relational, search, tree, validate
from quire.plans import hybrid
from quire.plans import queries as Q
from quire.plans.queries import query
from quire.sources import table

# ------------------------------------------------------------ headings as lines

_TEXT = "CASE WHEN l_partkey % 11 = 0 THEN 'Annex ' || l_suppkey % 9 || ' Forms' ELSE {} END"
_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
_H = f"""h AS (SELECT CAST(l_orderkey // 64 AS VARCHAR) AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey // 64 ORDER BY {_ORDER}) AS INTEGER) AS line_id,
  {_TEXT.format(Q._HEADING_SQL)} AS text FROM lineitem)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """Numbered headings of 64 orders each, as lines of documents."""
    rows = table(spark, d, "lineitem").withColumn("_h", Q._heading()).withColumn("doc_id", F.expr("CAST(l_orderkey div 64 AS STRING)"))
    return rows.selectExpr("doc_id", f"row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}) AS line_id", f"{_TEXT.format('_h')} AS text")


_KIND = Q._CLASS_SQL.replace("(t,", "(text,")
_ANNEX = parsing.ANNEX
_TOC = f"""k AS (SELECT *, CASE WHEN regexp_matches(text, '{_ANNEX}') THEN 'annex' ELSE {_KIND} END AS kind FROM h),
t AS (SELECT *, CASE kind WHEN 'annex' THEN regexp_extract(text, '{_ANNEX}', 2) WHEN 'part' THEN regexp_extract(text, '^Part\\s+(\\d+[A-Z]?)', 1) ELSE split_part(trim(text), '.', 1) END AS number
  FROM k WHERE kind IN ('part', 'annex', 'condition'))"""


@query(f"""WITH {_H}, {_TOC} SELECT doc_id, line_id AS ord, kind, number,
CASE WHEN kind = 'condition' THEN last_value(CASE WHEN kind <> 'condition' THEN line_id END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) END AS parent_ord FROM t""")
def toc_tree(spark: SparkSession, d: str) -> DataFrame:
    return parsing.toc_tree(_lines(spark, d).withColumnRenamed("line_id", "ord"), ["doc_id"]).drop("text")


@query(f"""WITH {_H}, {_TOC}, b AS (SELECT doc_id, split_part(trim(text), '.', 1) AS number, min(line_id) AS first_line FROM h WHERE {_KIND} = 'condition' AND line_id % 2 = 0 GROUP BY ALL)
SELECT t.doc_id, t.line_id AS ord, t.number, first_line AS line_id FROM t LEFT JOIN b ON b.doc_id = t.doc_id AND b.number = t.number WHERE kind = 'condition'""")
def toc_join(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    toc = parsing.toc_tree(rows.withColumnRenamed("line_id", "ord"), ["doc_id"])
    return parsing.body_lines(toc, rows.where("line_id % 2 = 0"), ["doc_id"]).select("doc_id", "ord", "number", "line_id")


@query()
def annex_match(spark: SparkSession, d: str) -> DataFrame:
    """A cursor that moves through each document: tested against worked results."""
    rows = _lines(spark, d)
    return parsing.annex_lines(rows.where("line_id % 3 = 0").withColumnRenamed("line_id", "ord"), rows, ["doc_id"])


@query(rf"""WITH {_H}, k AS (SELECT *, {_KIND} AS kind, split_part(trim(text), '.', 1) AS number FROM h)
SELECT doc_id, line_id, doc_id || ':' || CASE WHEN line_id % 4 > 0 THEN CAST(line_id AS VARCHAR) ELSE kind || ':' || coalesce(number, '') END AS node_uid,
  CASE kind WHEN 'part' THEN 'Part ' || number WHEN 'condition' THEN 'Condition ' || number WHEN 'clause' THEN nullif(regexp_extract(text, '^(\d+[A-Z]?\.\d+[A-Z]?)', 1), '') ELSE nullif(regexp_extract(text, '^(\([A-Za-z0-9]+\))', 1), '') END AS label,
  CASE WHEN regexp_matches(kind, '^(def_)?sub_') THEN 'subclause' ELSE kind END AS kind FROM k""")
def node_fields(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d).withColumns({"k": X.classify(F.col("text")), "number": X.reference_number(F.col("text"))})
    known = F.when(F.col("line_id") % 4 > 0, F.col("line_id"))
    return rows.select(
        "doc_id", "line_id", parsing.node_uid(F.col("doc_id"), known, F.col("k"), F.col("number")).alias("node_uid"),
        parsing.label_of(F.col("k"), F.col("number"), F.col("text")).alias("label"), parsing.collapse_kind(F.col("k")).alias("kind"),
    )


_LABELLED = "g AS (SELECT *, CASE WHEN regexp_matches(text, '^\\d+\\.(\\s|$)') THEN 'section_header' ELSE 'text' END AS label, line_id // 100 AS page FROM h)"


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    rows = _lines(spark, d)
    return rows.withColumns({"label": F.when(F.col("text").rlike(r"^\d+\.(\s|$)"), "section_header").otherwise("text"), "page": F.expr("CAST(line_id div 100 AS INT)"), "annex_page": F.lit(1)})


@query(f"""WITH {_H}, {_LABELLED}, b AS (SELECT doc_id, coalesce(min(CASE WHEN label = 'section_header' AND regexp_matches(text, '^2\\.(\\s|$)') THEN line_id END), min(CASE WHEN regexp_matches(text, '(?i)^2\\.1?\\s+TERM') THEN line_id END)) AS second_id,
  min(CASE WHEN page = 1 THEN line_id END) AS annex_id FROM g GROUP BY 1)
SELECT doc_id, line_id, CASE WHEN line_id < second_id THEN 'definitions' WHEN line_id >= annex_id THEN 'annex' ELSE 'body' END AS section FROM g JOIN b USING (doc_id)""")
def sections(spark: SparkSession, d: str) -> DataFrame:
    return lines.segment(_labelled(spark, d)).select("doc_id", "line_id", "section")


@query()
def flatten_text(spark: SparkSession, d: str) -> DataFrame:
    """Filter, clean, patch, cut and merge in one plan: its steps have their own SQL, the whole is tested on hand-made lines."""
    patches = spark.createDataFrame([("0", 1, "Heading", "HEADING", None)], "doc_id string, line_id int, pattern string, replacement string, prepend string")
    return lines.flatten_text(_labelled(spark, d), patches).withColumn("n_absorbed", F.size("absorbed")).drop("absorbed")


@query()
def definition_merge(spark: SparkSession, d: str) -> DataFrame:
    """Greedy look-ahead: tested against worked results."""
    return parsing.merge_definitions(_labelled(spark, d)).withColumn("n_absorbed", F.size("absorbed")).drop("absorbed")


@query(f"""WITH {_H}, n AS (SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '^Part\\s+(\\d+)', 1), '') AS INTEGER) AS number FROM h),
w AS (SELECT doc_id, CAST(unnest(generate_series(1, max(number))) AS INTEGER) AS number FROM n WHERE number IS NOT NULL GROUP BY doc_id HAVING max(number) >= 1)
SELECT w.* FROM w WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.doc_id = w.doc_id AND n.number = w.number)""")
def missing_markers(spark: SparkSession, d: str) -> DataFrame:
    return lines.missing_markers(_lines(spark, d), ["doc_id"])


_FURNITURE = {"short": "^.{0,20}$", "sentence": r"\.$", "question": r"\?", "word_is": r"\bis\b"}


@query(f"WITH {Q._LINES}, f AS (" + " UNION ALL ".join(f"SELECT '{n}' AS pattern, doc_id FROM t WHERE label IN ('page_header', 'page_footer') AND regexp_matches(text, '{p}')" for n, p in _FURNITURE.items()) + ") SELECT pattern, count(*) AS n_lines, count(DISTINCT doc_id) AS n_documents FROM f GROUP BY 1")
def furniture_scan(spark: SparkSession, d: str) -> DataFrame:
    return lines.furniture_scan(Q._doc_lines(spark, d), _FURNITURE)


# --------------------------------------------------------------------- trees


@query(f"""WITH {Q._N}, k AS (SELECT node_id, parent_id, title FROM n WHERE kind = 'condition' AND contains(lower(title), '_1'))
SELECT * FROM k UNION ALL SELECT node_id, parent_id, title FROM n WHERE kind = 'part' AND (contains(lower(title), '_1') OR node_id IN (SELECT parent_id FROM k))""")
def tree_filter(spark: SparkSession, d: str) -> DataFrame:
    return tree.filter_parts(Q._nodes(spark, d), "_1")


@query(f"""WITH {Q._N}, m AS (SELECT * REPLACE (CASE WHEN kind = 'part' AND ordinal % 2 = 0 THEN 'annex' ELSE kind END AS kind) FROM n)
SELECT a.node_id, a.title FROM m a LEFT JOIN m p ON p.node_id = a.parent_id WHERE a.kind = 'condition' AND (p.kind IS NULL OR p.kind <> 'annex')""")
def part_filter(spark: SparkSession, d: str) -> DataFrame:
    nodes = Q._nodes(spark, d).withColumn("kind", F.when((F.col("kind") == "part") & (F.col("ordinal") % 2 == 0), "annex").otherwise(F.col("kind")))
    return tree.without_parent_kind(nodes, "condition", "annex").select("node_id", "title")


@query(f"WITH {Q._N} SELECT node_id, CAST(row_number() OVER (PARTITION BY parent_id ORDER BY title, node_id) - 1 AS INTEGER) AS place FROM n")
def sibling_ordinals(spark: SparkSession, d: str) -> DataFrame:
    return tree.sibling_ordinals(Q._nodes(spark, d), "title", "node_id").select("node_id", "place")


# --------------------------------------------------------------------- chunks


@query("""SELECT doc_id, md5(coalesce(c.text, source || chr(10) || chr(10) || d.text, '')) AS text_md5 FROM documents d LEFT JOIN (SELECT sha256(text) AS h, any_value(text) AS text FROM benchmark GROUP BY 1) c ON c.h = sha256(d.text)""")
def chunk_text_lookup(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("text_sha256"), F.col("source").alias("breadcrumb"), F.col("text").alias("text_full"))
    return chunking.chunk_text(chunks, chunking.text_cache(table(spark, d, "benchmark"))).select("doc_id", F.md5("text").alias("text_md5"))


@query("SELECT DISTINCT sha256(text) AS text_sha256, length(text) AS n_chars FROM documents WHERE text IS NOT NULL")
def text_cache(spark: SparkSession, d: str) -> DataFrame:
    return chunking.text_cache(table(spark, d, "documents")).select("text_sha256", F.length("text").cast("long").alias("n_chars"))


_PACKED = f"""{Q._LINES}, r AS (
  SELECT doc_id, line_id, length(text) AS size, 0 AS part FROM t WHERE line_id = 0
  UNION ALL SELECT t.doc_id, t.line_id, CASE WHEN r.size + length(t.text) > 1500 AND r.size > 0 THEN length(t.text) ELSE r.size + length(t.text) END, r.part + CASE WHEN r.size + length(t.text) > 1500 AND r.size > 0 THEN 1 ELSE 0 END
  FROM r JOIN t ON t.doc_id = r.doc_id AND t.line_id = r.line_id + 1),
g AS (SELECT doc_id, part + 1 AS part, count(*) AS n, string_agg(text, chr(10) || chr(10) ORDER BY line_id) AS text, first(left(text, 15) ORDER BY line_id) AS a, last(left(text, 15) ORDER BY line_id) AS b FROM r JOIN t USING (doc_id, line_id) GROUP BY ALL),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM g)"""


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return chunking.pack(Q._doc_lines(spark, d).select(F.col("doc_id").alias("source_id"), F.col("line_id").alias("ord"), F.left("text", F.lit(15)).alias("label"), "text"), 1500)


@query(f"""WITH RECURSIVE {_PACKED}, f AS (SELECT c.doc_id, total, part, '[' || d.lang || '] > ' || d.source || CASE WHEN total > 1 THEN ' (Part ' || part || '/' || total || ': ' || CASE WHEN n > 1 THEN 'Clauses ' || a || ' to ' || b ELSE 'Clause ' || a END || ')' ELSE '' END || chr(10) || chr(10) || c.text AS text
  FROM c JOIN documents d USING (doc_id))
SELECT doc_id AS source_id, CAST(doc_id AS VARCHAR) || CASE WHEN total > 1 THEN ':part_' || part ELSE '' END AS chunk_uid, sha256(text) AS text_sha256, CAST(length(text) AS INTEGER) AS char_length FROM f""")
def condition_chunks(spark: SparkSession, d: str) -> DataFrame:
    titles = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), F.col("lang").alias("title"), F.col("source").alias("breadcrumb"))
    return chunking.with_header(_packed(spark, d), titles).drop("text")


@query(f"""WITH RECURSIVE {_PACKED}, s AS (SELECT doc_id, max(total) AS parts FROM c GROUP BY 1)
SELECT source, count(*) AS n_sources, count(*) FILTER (WHERE parts > 1) AS n_cut, CAST(sum(CASE WHEN parts > 1 THEN parts ELSE 0 END) AS BIGINT) AS n_fragments FROM s JOIN documents USING (doc_id) GROUP BY 1""")
def segmentation_report(spark: SparkSession, d: str) -> DataFrame:
    groups = table(spark, d, "documents").select(F.col("doc_id").alias("source_id"), "source")
    return chunking.segmentation_report(_packed(spark, d), groups, "source")


@query()
def embed_pending(spark: SparkSession, d: str) -> DataFrame:
    """Vectors for the texts that have none yet, by the stand-in model: tested for key, length and norm."""
    work = table(spark, d, "documents").where("text is not null").select(F.sha2("text", 256).alias("text_sha256"), "text").dropDuplicates(["text_sha256"])
    done = table(spark, d, "benchmark").select(F.sha2("text", 256).alias("text_sha256"))
    pending = work.join(done, "text_sha256", "left_anti")
    vectors = models.apply_batches(pending, "text", "vec", "array<double>", models.hash_embedder(48))
    return vectors.select("text_sha256", F.posexplode(V.truncate_normalize(F.col("vec"), 32)).alias("place", "x"))


@query("SELECT conv_id, turn, split_part(left(coalesce(text, ''), 4500), '.', 1) AS summary FROM conversations WHERE role = 'assistant'")
def summaries(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'").select("conv_id", "turn", "text")
    return models.apply_batches(rows, "text", "summary", "string", models.first_sentence()).drop("text")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN s IS NULL THEN 'page unknown' WHEN e IS NULL OR s = e THEN 'p. ' || s ELSE 'pp. ' || s || '–' || e END AS label, greatest(1, s + greatest(0, q - 5)) AS printed
FROM (SELECT *, CASE WHEN l_partkey % 9 > 0 THEN CAST(l_partkey % 50 AS INTEGER) END AS s, CASE WHEN l_partkey % 4 > 0 THEN CAST(l_partkey % 50 + l_suppkey % 3 AS INTEGER) END AS e, CAST(l_quantity AS INTEGER) AS q FROM lineitem) WHERE s IS NOT NULL OR e IS NOT NULL""")
def page_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "CASE WHEN l_partkey % 9 > 0 THEN CAST(l_partkey % 50 AS INT) END AS s",
        "CASE WHEN l_partkey % 4 > 0 THEN CAST(l_partkey % 50 + l_suppkey % 3 AS INT) END AS e", "CAST(l_quantity AS INT) AS q",
    ).where("s is not null or e is not null")
    printed = F.when(F.col("s").isNotNull(), X.printed_page(F.col("s"), F.col("q"), F.lit(5))).otherwise(F.lit(1))
    return rows.withColumns({"label": X.page_label(F.col("s"), F.col("e")), "printed": printed}).drop("s", "e", "q")


# ----------------------------------------------------------------- references


@query(r"""WITH m AS (SELECT regexp_extract(url, '^https?://([^/]*)', 1) AS doc_id, unnest(regexp_extract_all(html, 'href="/([^"]*)"', 1)) AS name FROM pages)
SELECT doc_id, name, CASE WHEN length(name) % 2 = 0 THEN 'page' ELSE 'statute' END AS type, count(*) AS n FROM m WHERE length(name) >= 3 GROUP BY ALL""")
def mention_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = Q._links(spark, d).select(F.col("source").alias("doc_id"), F.col("target").alias("name"), F.when(F.length("target") % 2 == 0, "page").alias("type"))
    return references.mention_counts(rows)


@query("""
WITH n AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
x AS (SELECT a.n_regionkey, a.n_nationkey AS source, coalesce(CASE WHEN b.n_regionkey = a.n_regionkey THEN b.n_nationkey END, CASE WHEN k.n_regionkey = a.n_regionkey THEN k.n_nationkey END) AS target
  FROM orders JOIN n a ON a.c_custkey = o_custkey LEFT JOIN n b ON b.c_custkey = o_orderkey % 97 + 1 LEFT JOIN nation k ON k.n_nationkey = o_orderkey % 30)
SELECT CAST(n_regionkey AS VARCHAR) AS doc_id, CAST(source AS VARCHAR) AS source, CAST(target AS VARCHAR) AS target, count(*) AS n FROM x GROUP BY ALL""")
def cross_references(spark: SparkSession, d: str) -> DataFrame:
    """Regions as documents, nations as their conditions, customers as segments
    below them; an order cites another customer's segment, else a nation by number."""
    nation = table(spark, d, "nation")
    nations = nation.selectExpr("CAST(n_regionkey AS STRING) AS doc_id", "CAST(n_nationkey AS STRING) AS number", "n_name AS title", "CAST(NULL AS STRING) AS part", "n_nationkey AS ord")
    tops = nation.selectExpr("CAST(n_regionkey AS STRING) AS doc_id", "CAST(n_nationkey AS LONG) AS seg_ord", "concat('n', n_nationkey) AS id", "CAST(NULL AS STRING) AS parent", "0L AS s", "0L AS e", "CAST(NULL AS STRING) AS title_text", "concat(n_nationkey, '.') AS code_text")
    placed = table(spark, d, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    leaves = placed.selectExpr("CAST(n_regionkey AS STRING) AS doc_id", "c_custkey + 1000 AS seg_ord", "concat('c', c_custkey) AS id", "concat('n', n_nationkey) AS parent", "c_custkey * 10 + 1 AS s", "c_custkey * 10 + 9 AS e", "'Customer' AS title_text", "CAST(NULL AS STRING) AS code_text")
    segments = tops.unionByName(leaves).withColumn("children", F.array().cast("array<string>"))
    cites = table(spark, d, "orders").join(placed, F.col("o_custkey") == F.col("c_custkey")).selectExpr(
        "CAST(n_regionkey AS STRING) AS doc_id", "o_orderkey AS xref_ord", "o_custkey * 10 + 2 AS s", "o_custkey * 10 + 5 AS e", "concat('see Condition ', o_orderkey % 30) AS span_text", "concat('c', o_orderkey % 97 + 1) AS start_seg", "concat('c', o_orderkey % 97 + 1) AS end_seg"
    )
    return references.citations(cites, segments, nations).groupBy("doc_id", "source", "target").agg(F.count("*").alias("n"))


@query(r"""WITH a AS (SELECT DISTINCT p_name AS name FROM part), b AS (SELECT DISTINCT lower(p_type) || ' ' || split_part(p_name, ' ', 2) AS match FROM part WHERE p_size % 2 = 0),
w AS (SELECT DISTINCT name, unnest(regexp_extract_all(lower(name), '[\p{L}\p{N}]+')) AS word FROM a), v AS (SELECT DISTINCT match, unnest(regexp_extract_all(lower(match), '[\p{L}\p{N}]+')) AS word FROM b),
s AS (SELECT name, match, count(*) AS score FROM w JOIN v USING (word) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY score DESC, match) AS k FROM s)
SELECT a.name, match, score FROM a LEFT JOIN r ON r.name = a.name AND k = 1""")
def name_match(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    right = p.where("p_size % 2 = 0").selectExpr("concat(lower(p_type), ' ', split_part(p_name, ' ', 2)) AS name")
    return relational.best_match(p.select(F.col("p_name").alias("name")), right)


@query(r"""WITH k AS (SELECT doc_id, regexp_replace(trim(lower(split_part(text, chr(10), 1))), '[^a-z0-9 ]', '', 'g') AS key FROM documents)
SELECT key, min(doc_id) AS doc_id FROM k WHERE key <> '' GROUP BY 1""")
def schedules_dedup(spark: SparkSession, d: str) -> DataFrame:
    first = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    return relational.first_per_key(table(spark, d, "documents"), X.title_key(first), "doc_id").select("key", "doc_id")


# ----------------------------------------------------------------- evaluation


def _gold_ranks_sql(name: str, cut: str) -> str:
    return f"""{name}_e AS (SELECT vec_id, label, {cut} AS v FROM e),
{name}_s AS (SELECT q.vec_id AS query_id, q.label AS ql, e.vec_id AS item_id, e.label, {Q._COS} AS score FROM {name}_e q, {name}_e e WHERE q.vec_id % 20 = 0),
{name}_r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) - 1 AS rank FROM {name}_s),
{name} AS (SELECT query_id, min(rank) AS first_rank FROM {name}_r WHERE rank BETWEEN 1 AND 10 AND label = ql AND query_id <> item_id GROUP BY 1)"""


@query(f"""WITH e AS ({Q._E}), {_gold_ranks_sql('full_v', 'v')}, {_gold_ranks_sql('short_v', 'v[1:16]')}, ids AS (SELECT vec_id AS query_id FROM e WHERE vec_id % 20 = 0)
SELECT query_id, CAST(a.first_rank AS INTEGER) AS rank_before, CAST(b.first_rank AS INTEGER) AS rank_after FROM ids LEFT JOIN full_v a USING (query_id) LEFT JOIN short_v b USING (query_id) WHERE a.first_rank IS DISTINCT FROM b.first_rank""")
def run_changes(spark: SparkSession, d: str) -> DataFrame:
    """Queries whose first neighbour of their own label moves when vectors are cut short."""
    q, items = Q._vectors(spark, d)
    labels = items.select("item_id", F.col("label").alias("document_id"))
    gold = labels.where("item_id % 20 = 0").withColumnRenamed("item_id", "query_id")
    none = {c: F.lit(None).cast("string") for c in ("condition", "title")}

    def ranks(cut):
        top = search.dense_topk(q.withColumn("qvec", cut(F.col("qvec"))), items.withColumn("vec", cut(F.col("vec"))), 11)
        found = top.where("query_id <> item_id and rank > 1").withColumn("rank", F.col("rank") - 1).join(labels, "item_id").withColumns(none)
        return evaluate.gold_ranks(found, gold.withColumns(none))

    changed = evaluate.run_changes(ranks(lambda v: v), ranks(lambda v: F.slice(v, 1, 16)))
    return changed.select("query_id", "rank_before", "rank_after")


@query(f"""WITH e AS ({Q._E}), c AS (SELECT {Q._COS} AS c FROM e q JOIN range(1, 6) t(k) ON TRUE JOIN e ON e.vec_id = q.vec_id + k)
SELECT count(*) AS n_pairs, round(avg(c), 6) AS mean, round(stddev_pop(c), 6) AS deviation, round(min(c), 6) AS low, round(max(c), 6) AS high FROM c""")
def baseline_distribution(spark: SparkSession, d: str) -> DataFrame:
    b = evaluate.baseline_distribution(Q._vectors(spark, d)[1])
    return b.select("n_pairs", *[F.round(c, 6).alias(c) for c in b.columns[1:]])


@query(f"""{Q._UNIT}, g AS (SELECT label || '/' || vec_id % 3 AS grp, n, v FROM u), c AS (SELECT grp, place, sum(x / n) AS s FROM (SELECT grp, n, generate_subscripts(v, 1) AS place, unnest(v) AS x FROM g) GROUP BY ALL)
SELECT k.grp, k.m AS n_items, round(CASE WHEN k.m > 1 THEN 1 - sqrt(sum(s * s)) / k.m ELSE 0 END, 6) AS centroid_drift FROM c JOIN (SELECT grp, count(*) AS m FROM g GROUP BY 1) k ON k.grp = c.grp GROUP BY k.grp, k.m""")
def centroid_drift(spark: SparkSession, d: str) -> DataFrame:
    items = Q._vectors(spark, d)[1].withColumn("grp", F.concat_ws("/", F.col("label").cast("string"), (F.col("item_id") % 3).cast("string")))
    return evaluate.type_stats(items, "grp").select("grp", "n_items", F.round("centroid_drift", 6).alias("centroid_drift"))


@query(f"""WITH {Q._BUILDS}, a AS (SELECT count(*) AS nodes_before, CAST(sum(length(c)) AS BIGINT) AS chars_before FROM p), b AS (SELECT count(*) AS nodes_after, CAST(sum(length(c)) AS BIGINT) AS chars_after FROM c)
SELECT *, nodes_after - nodes_before AS nodes_delta, chars_after - chars_before AS chars_delta FROM a, b""")
def build_sums(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.build_sums(*Q._builds(spark, d), "content")


@query(r"""WITH k AS (SELECT conv_id, turn, regexp_replace(lower(text), '[^\p{L}\p{N}]', '', 'g') AS fold FROM conversations WHERE text IS NOT NULL),
c AS (SELECT conv_id, string_agg(fold, '' ORDER BY turn) AS whole FROM k WHERE turn % 2 = 1 GROUP BY 1)
SELECT k.conv_id AS conv_id, turn AS line_id FROM k LEFT JOIN c ON c.conv_id = k.conv_id WHERE turn % 2 = 0 AND fold <> '' AND NOT coalesce(contains(whole, fold), FALSE)""")
def dropped_content(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "conversations").where("text is not null").select("conv_id", F.col("turn").alias("line_id"), "text")
    return validate.dropped_content(raw, raw.where("line_id % 2 = 1"), ["conv_id"]).select("conv_id", "line_id")


@query("SELECT user_id, event_id AS line_id, CASE WHEN event_id % 10 = 7 THEN 'twice' ELSE 'lost' END AS state FROM events WHERE event_id % 10 IN (3, 7)")
def accounted_lines(spark: SparkSession, d: str) -> DataFrame:
    raw = table(spark, d, "events").select("user_id", F.col("event_id").alias("line_id"))
    merged = raw.where("line_id % 10 <> 3").withColumn("absorbed", F.expr("CASE WHEN line_id % 10 = 7 THEN array(line_id) ELSE CAST(array() AS ARRAY<BIGINT>) END"))
    return validate.accounted(raw, merged, ["user_id"])


# -------------------------------------------------------------------- answers

_ROUTE = r"""CASE WHEN regexp_matches(q, '(?i)\b(explain|describe|outline|summari[sz]e|compare|contrast|why|in practice|overall|walk me through|implications?|relationship)\b')
  OR regexp_matches(q, '(?i)\bhow\s+(does|do|are|is|would|can)\b') OR regexp_matches(q, '(?i)\bwhat\s+(are|is)\b.*\b(work|process|effect|implication|requirements?)\b') THEN 'synthesis' ELSE 'retrieval' END"""


@query(rf"""
WITH b AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'Explain ' || text ELSE text END AS text FROM benchmark),
w AS (SELECT doc_id AS item_id, {Q._TOKENS.format('text')} AS ws FROM documents WHERE text IS NOT NULL),
p AS (SELECT item_id, token, count(*) AS tf FROM (SELECT item_id, unnest(ws) AS token FROM w) GROUP BY ALL),
t AS (SELECT DISTINCT item_id AS query_id, unnest({Q._TOKENS.format('text')}) AS token FROM b),
s AS (SELECT query_id, item_id, sum(tf) AS score FROM p JOIN t USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, item_id) AS rank FROM s),
v AS (SELECT query_id, string_agg('[' || rank || '] ' || left(text, 3500), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS evidence FROM r JOIN documents ON doc_id = item_id WHERE rank <= 3 GROUP BY 1),
x AS (SELECT item_id AS query_id, {_ROUTE.replace('(q,', "(trim(regexp_replace(text, '\\s+', ' ', 'g')),")} AS route, text, evidence FROM b LEFT JOIN v ON v.query_id = item_id)
SELECT query_id, route, CASE WHEN evidence IS NULL THEN 'no_evidence' WHEN route = 'retrieval' THEN 'sources_only' ELSE 'answered' END AS status,
  CASE WHEN route = 'synthesis' THEN left(text || chr(10) || chr(10) || evidence, 100) END AS answer FROM x""")
def answers(spark: SparkSession, d: str) -> DataFrame:
    """Routed questions over their evidence; the stand-in model gives back the start of its prompt."""
    q, items = Q._texts(spark, d)
    q = q.withColumn("text", F.when(F.col("query_id") % 2 == 0, F.concat(F.lit("Explain "), "text")).otherwise(F.col("text")))
    return search.answers(q, search.evidence(search.lexical_topk(q, items, 3), items), lambda prompts: [p[:100] for p in prompts])


@query(f"""{Q._RERANK} SELECT z.query_id, z.item_id, final_rank, CASE WHEN d.doc_id % 3 = 0 THEN d.lang ELSE d.source END AS topic, left(d.text, 350) AS preview FROM z JOIN documents d ON d.doc_id = z.item_id""")
def response_rows(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("item_id"), F.col("source").alias("title"), F.when(F.col("doc_id") % 3 == 0, F.col("lang")).otherwise(F.when(F.col("doc_id") % 3 == 1, "")).alias("subtitle"), "text")
    return search.response_rows(hybrid.reranked(*Q._hybrid_inputs(spark, d)), items).drop("rerank_score", "rrf_score")


@query("""WITH w AS (SELECT DISTINCT o_custkey * 2 AS key FROM orders)
SELECT w.key AS wanted, coalesce(a.c_name, b.c_name) AS c_name, coalesce(a.c_custkey, b.c_custkey) AS key FROM w LEFT JOIN customer a ON a.c_custkey = w.key LEFT JOIN customer b ON b.c_custkey = w.key - 100 AND w.key % 3 = 0""")
def alias_lookup(spark: SparkSession, d: str) -> DataFrame:
    wanted = table(spark, d, "orders").select((F.col("o_custkey") * 2).alias("key")).distinct()
    documents = table(spark, d, "customer").select("c_name", F.col("c_custkey").alias("key"))
    aliases = wanted.where("key % 3 = 0").withColumn("target", F.col("key") - 100)
    return relational.alias_lookup(wanted, documents, aliases)


@query(f"""WITH {Q._N}, k AS (SELECT parent_id, string_agg(left(title, 12), '|' ORDER BY ordinal, left(title, 12)) AS c FROM n WHERE kind = 'clause' GROUP BY 1)
SELECT node_id, title, coalesce(c, '') AS clauses FROM n LEFT JOIN k ON k.parent_id = node_id WHERE kind = 'condition'""")
def direct_clauses(spark: SparkSession, d: str) -> DataFrame:
    return tree.direct_clauses(Q._nodes(spark, d), width=12).withColumn("clauses", F.array_join("clauses", "|"))


@query("SELECT l_returnflag, l_linestatus, string_agg(DISTINCT CAST(CAST(l_quantity AS INTEGER) AS VARCHAR), ',' ORDER BY CAST(CAST(l_quantity AS INTEGER) AS VARCHAR)) AS pages FROM lineitem GROUP BY ALL")
def condition_pages(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", F.col("l_quantity").cast("int").cast("string").alias("page"))
    return relational.collected(rows, ["l_returnflag", "l_linestatus"], "page", "pages").withColumn("pages", F.array_join("pages", ","))


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def indexed_conditions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber").distinct()
