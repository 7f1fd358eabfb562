"""Production runs of the operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytededup, decontam, htmltext, langid, linededup, sentencepiece, sharding, simhash, toxicity, vptree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(_table(spark, sf_dir, "documents"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, text`` (what stays) and the offsets of the units removed as ``spans``."""
    done = linededup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    span = F.transform("removed_spans", lambda s: F.concat_ws("-", s["start"], s["end"]))
    return done.select("doc_id", "text", F.coalesce(F.array_join(span, ","), F.lit("")).alias("spans"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_vantage_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vptree.nearest(_table(spark, sf_dir, "embeddings"))


def op7_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytededup.dedup_bytes(_table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(_table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_language_id, op3_line_dedup, op4_decontamination, op5_simhash, op6_vantage_point, op7_suffix_array, op8_sharding, op9_html_extraction, op10_toxicity)}


_LINES_SQL = r"""
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS line, unnest(parts) AS body
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents WHERE text IS NOT NULL)
), plain AS (
  SELECT doc_id, line, trim(regexp_replace(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\x0b\x0c]+', ' ', 'g')) AS norm FROM lines
), old_lines AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line) > 1 AS old FROM plain WHERE norm <> ''
), pieces AS (
  SELECT doc_id, line, generate_subscripts(ps, 1) AS piece, unnest(ps) AS unit
  FROM (SELECT doc_id, line, regexp_extract_all(body, '.*?[.!?]+["'')\]]*(?:[ \t\r\x0b\x0c]+|$)|.+') AS ps FROM lines WHERE body <> '')
), placed AS (
  SELECT doc_id, line, piece, unit,
         CAST(coalesce(sum(length(unit)) OVER (PARTITION BY doc_id ORDER BY line, piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + line - 1 AS BIGINT) AS first_char,
         trim(regexp_replace(translate(unit, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\r\x0b\x0c]+', ' ', 'g')) AS norm
  FROM pieces
), ranked AS (
  SELECT *, length(norm) - length(replace(norm, ' ', '')) + 1 AS words, row_number() OVER (PARTITION BY norm ORDER BY doc_id, line, piece) > 1 AS again FROM placed WHERE norm <> ''
), runs AS (
  SELECT *, sum(CASE WHEN again THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY line, piece) AS run FROM ranked
), judged AS (
  SELECT doc_id, line, piece, again AND sum(CASE WHEN again THEN words ELSE 0 END) OVER (PARTITION BY doc_id, run) >= 10 AS gone FROM runs
), marked AS (
  SELECT p.*, coalesce(j.gone, FALSE) OR coalesce(o.old, FALSE) AS gone, j.gone IS NOT NULL AND NOT j.gone AND NOT coalesce(o.old, FALSE) AS holds
  FROM placed p LEFT JOIN judged j USING (doc_id, line, piece) LEFT JOIN old_lines o USING (doc_id, line)
), by_line AS (
  SELECT doc_id, line, coalesce(string_agg(unit, '' ORDER BY piece) FILTER (WHERE NOT gone), '') AS body, bool_or(gone) AND NOT bool_or(holds) AS emptied,
         string_agg(first_char || '-' || (first_char + length(unit)), ',' ORDER BY piece) FILTER (WHERE gone) AS spans
  FROM marked GROUP BY doc_id, line
), kept AS (
  SELECT l.doc_id, coalesce(string_agg(coalesce(b.body, ''), chr(10) ORDER BY line) FILTER (WHERE NOT coalesce(emptied, FALSE)), '') AS text,
         coalesce(string_agg(spans, ',' ORDER BY line) FILTER (WHERE spans IS NOT NULL), '') AS spans
  FROM lines l LEFT JOIN by_line b USING (doc_id, line) GROUP BY l.doc_id
)
SELECT d.doc_id, k.text, coalesce(k.spans, '') AS spans
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_NEAREST_SQL = """
WITH e AS (
  SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), c AS (
  SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))) AS score
  FROM e q JOIN e ON q.vec_id <> e.vec_id AND len(q.v) = len(e.v) WHERE q.vec_id % 50 = 0
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM c
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": _LINES_SQL, "op6_vantage_point": _NEAREST_SQL}
