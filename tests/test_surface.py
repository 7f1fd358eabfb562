"""Readers, the SQL surface and answers on small inputs."""

import json

from pyspark.sql import functions as F

from quire import sqlsurface
from quire.functions import text as X
from quire.operators import search
from quire.sources import read_stacked


def test_stacked_reader(spark, tmp_path):
    leaf = {"kind": "clause", "title": "1.1 Deep", "line_id": 7, "page": 3, "children": []}
    body = {"kind": "root", "title": "", "children": [{"kind": "part", "number": "1", "title": "Part 1", "children": [{"kind": "condition", "number": "1", "title": "One", "children": [leaf]}]}, {"kind": "part", "number": "2", "title": "Part 2"}]}
    (tmp_path / "a_stacked.json").write_text(json.dumps({"document": {"id": "a", "title": "T", "page_count": 9}, "main_body": body, "annexes": {"5": {"id": 5, "text": "annex line", "label": "text"}}}, indent=1))
    (tmp_path / "b_stacked.json").write_text(json.dumps({"document": {"id": "b"}, "main_body": {"kind": "root"}}))
    r = read_stacked(spark, str(tmp_path))
    assert {(x["document_id"], x["title"], x["page_count"]) for x in r["document"].collect()} == {("a", "T", 9), ("b", None, None)}
    nodes = r["node"].where("document_id = 'a'").orderBy("path").collect()
    assert [(x["kind"], x["depth"], x["path"], x["parent_path"], x["line_id"]) for x in nodes] == [
        ("root", 0, [0], None, None), ("part", 1, [0, 0], [0], None), ("condition", 2, [0, 0, 0], [0, 0], None), ("clause", 3, [0, 0, 0, 0], [0, 0, 0], 7), ("part", 1, [0, 1], [0], None),
    ]
    assert [tuple(x) for x in r["annex_item"].collect()] == [("a", 5, "annex line", "text")]


def test_sql_functions_agree_with_columns(spark, sf_dir):
    sqlsurface.register_functions(spark, "q_")
    sqlsurface.register_tables(spark, sf_dir, ["documents", "embeddings"])
    got = spark.sql("SELECT doc_id, q_title_hash(text) AS h, q_alnum_fold(text) AS f, size(q_word_tokens(text)) AS n, q_token_estimate(text) AS t, q_reference_number(text) AS r, q_normal_title(text) AS m FROM documents")
    t = F.col("text")
    want = spark.table("documents").select("doc_id", X.title_hash(t).alias("h"), X.alnum_fold(t).alias("f"), F.size(X.tokens(t)).alias("n"), X.token_estimate(t).alias("t"), X.reference_number(t).alias("r"), X.normal_title(t).alias("m"))
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0
    row = spark.sql("SELECT q_cosine(array(3D, 4D), array(4D, 3D)) AS c, q_cosine(array(0D), array(1D)) AS z, q_dot_product(array(1D, 2D), array(3D, 4D)) AS d").first()
    assert (row["c"], row["z"], row["d"]) == (0.96, None, 11.0)


def test_answers(spark):
    q = spark.createDataFrame([(1, "Explain the fee"), (2, "fee cap"), (3, "why so"), (4, "why not")], "query_id int, text string")
    e = spark.createDataFrame([(1, "[1] text"), (2, "[1] x"), (4, "[1] y")], "query_id int, evidence string")
    got = {r["query_id"]: (r["route"], r["status"], r["answer"]) for r in search.answers(q, e, lambda p: ["A " + x[:7] if "fee" in x else " " for x in p]).collect()}
    assert got == {1: ("synthesis", "answered", "A Explain"), 2: ("retrieval", "sources_only", None), 3: ("synthesis", "no_evidence", None), 4: ("synthesis", "empty_response", " ")}
