"""Readers for the document formats, with explicit schemas so that no read infers one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import tree

OCR = """
texts array<struct<self_ref:string,label:string,text:string,orig:string,
  prov:array<struct<page_no:int,bbox:struct<l:double,t:double,r:double,b:double>>>>>,
tables array<struct<label:string,data:struct<table_cells:array<struct<start_row_offset_idx:int,text:string>>>>>
"""
ENRICHED = """
results array<struct<document:struct<text:string,
  segments:array<struct<id:string,kind:string,parent:string,children:array<string>,
    span:struct<start:int,`end`:int>,title:struct<start:int,`end`:int>,code:struct<start:int,`end`:int>>>,
  crossreferences:array<struct<span:struct<start:int,`end`:int>,start:string,`end`:string>>,
  terms:array<struct<name:struct<start:int,`end`:int>,meaning:struct<start:int,`end`:int>>>,
  external_documents:array<struct<name:struct<start:int,`end`:int>,type:string,mentions:array<struct<start:int,`end`:int>>>>>>>
"""
GOLD = "queries array<struct<id:string,query:string,gold:array<struct<document_id:string,condition:string,title:string>>,reviewed:boolean>>, scheme string"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """Multi-line JSON files under ``path``, each with ``doc_id`` from its name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", pattern).json(path)
    name = F.element_at(F.split(F.input_file_name(), "/"), -1)
    return rows.withColumn("doc_id", F.regexp_replace(name, r"(_docling_export|_stacked|_enriched)?\.json$", ""))


def read_ocr(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, OCR)


def read_enriched(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Relations ``segment, xref, term, ext_mention`` of annotated documents."""
    docs = read_json(spark, path, ENRICHED).select("doc_id", F.explode("results.document").alias("d"))
    seg = docs.select("doc_id", "d.text", F.posexplode("d.segments").alias("seg_ord", "s"))
    text = lambda span: F.when(span.isNotNull(), F.substring(F.col("text"), span["start"] + 1, span["end"] - span["start"]))
    segment = seg.select(
        "doc_id", "seg_ord", "s.id", "s.kind", "s.parent", "s.children", F.col("s.span.start").alias("s"), F.col("s.span.end").alias("e"),
        text(F.col("s.title")).alias("title_text"), text(F.col("s.code")).alias("code_text"),
    )
    x = docs.select("doc_id", "d.text", F.posexplode("d.crossreferences").alias("xref_ord", "x"))
    xref = x.select("doc_id", "xref_ord", F.col("x.span.start").alias("s"), F.col("x.span.end").alias("e"), text(F.col("x.span")).alias("span_text"), F.col("x.start").alias("start_seg"), F.col("x.end").alias("end_seg"))
    t = docs.select("doc_id", "d.text", F.explode("d.terms").alias("t"))
    term = t.select("doc_id", text(F.col("t.name")).alias("name"), text(F.col("t.meaning")).alias("meaning"))
    e = docs.select("doc_id", "d.text", F.explode("d.external_documents").alias("e")).select("*", F.explode("e.mentions").alias("m"))
    mention = e.select("doc_id", text(F.col("e.name")).alias("name"), F.coalesce("e.type", F.lit("statute")).alias("type"), F.col("m.start").alias("s"), F.col("m.end").alias("e"))
    return {"segment": segment, "xref": xref, "term": term, "ext_mention": mention}


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """``query_id, query, document_id, condition, title`` rows of a gold set."""
    rows = spark.read.schema(GOLD).option("multiLine", True).json(path).select(F.explode("queries").alias("q"))
    return rows.select(F.col("q.id").alias("query_id"), "q.query", F.explode_outer("q.gold").alias("g")).select("query_id", "query", "g.document_id", "g.condition", "g.title")


def read_stacked(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Relations ``document, node, annex_item`` of stacked documents, whose tree
    is of any depth.  Nodes come with a path of ordinals (pre-order when
    sorted), their parent's path, and ``text_full`` where the file has it."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.parse_json("value").alias("j"))

    def at(name: str, kind: str = "string") -> F.Column:
        return F.try_variant_get("j", f"$.document.{name}", kind)

    document = rows.select(at("id").alias("document_id"), *[at(c).alias(c) for c in "title scheme round version source_file source_sha256 parser_version".split()], at("page_count", "int").alias("page_count"))
    view = f"stacked_{uuid.uuid4().hex}"
    rows.createOrReplaceTempView(view)
    fields = {"kind": "string", "number": "string", "title": "string", "page": "int", "line_id": "int", "text_full": "string"}

    def picks(v: str) -> str:
        return ", ".join(f"try_variant_get({v}, '$.{n}', '{k}') AS {n}" for n, k in fields.items())

    body = "try_variant_get(j, '$.main_body', 'variant')"
    first = rows.selectExpr(
        "try_variant_get(j, '$.document.id', 'string') AS document_id", "array(0) AS path", "CAST(NULL AS ARRAY<INT>) AS parent_path", "0 AS depth",
        *[f"try_variant_get({body}, '$.{n}', '{k}') AS {n}" for n, k in fields.items()], "try_variant_get(j, '$.main_body.children', 'variant') AS children",
    )
    node = tree.levels(first, f"""
        SELECT w.document_id, concat(w.path, array(c.pos)) AS path, w.path AS parent_path, w.depth + 1 AS depth, {picks("c.value")}, try_variant_get(c.value, '$.children', 'variant') AS children
        FROM {{level}} w, LATERAL variant_explode(w.children) c""")
    annex = spark.sql(f"""
        SELECT variant_get(j, '$.document.id', 'string') AS document_id, CAST(a.key AS INT) AS annex_id, try_variant_get(a.value, '$.text', 'string') AS text, try_variant_get(a.value, '$.label', 'string') AS label
        FROM {view}, LATERAL variant_explode(try_variant_get(j, '$.annexes', 'variant')) a""")
    return {"document": document, "node": node, "annex_item": annex}
