"""Trees past a million rows, deep chains, cycles, orphans."""

import pytest
from pyspark.sql import functions as F

from quire.operators import graph, tree

NODE = "node_id string, parent_id string, title string, ordinal int"


def test_over_a_million_nodes(spark):
    n = 1_200_000
    parent = F.when(F.col("id") > 0, ((F.col("id") - 1) / 20).cast("long"))
    nodes = spark.range(n).select(F.col("id").alias("node_id"), parent.alias("parent_id"), F.col("id").cast("string").alias("title"), F.col("id").alias("ordinal"), F.col("id").alias("page_min"), F.col("id").alias("page_max"))
    got = tree.descend(nodes).agg(F.count("*"), F.max("depth"), F.sum("depth")).first()
    depth, total, level, first = 0, 0, 1, 0
    while first < n:
        size = min(level, n - first)
        total, first, level, depth = total + depth * size, first + size, level * 20, depth + 1
    assert tuple(got) == (n, depth - 1, total)
    roll = {r["node_id"]: r for r in tree.rollup_pages(nodes).where("node_id < 3 or node_id = 1199999").collect()}
    assert (roll[0]["page_start"], roll[0]["page_end"], roll[0]["subtree_size"]) == (0, n - 1, n)
    assert roll[1199999]["subtree_size"] == 1 and roll[1]["page_start"] == 1
    codes = nodes.select("node_id", "parent_id", F.when(F.col("node_id") < 2, F.col("title")).alias("code"))
    assert {r["code"]: r["n"] for r in graph.resolve_up(codes).groupBy("code").agg(F.count("*").alias("n")).collect()}["1"] == roll[1]["subtree_size"]


def test_a_deep_chain(spark):
    n = 203
    nodes = spark.range(n).select(
        F.col("id").cast("string").alias("node_id"), F.when(F.col("id") > 0, (F.col("id") - 1).cast("string")).alias("parent_id"), F.col("id").cast("string").alias("title"), F.lit(0).alias("ordinal"), F.col("id").alias("page_min"), F.col("id").alias("page_max")
    )
    last = tree.descend(nodes).where(F.col("node_id") == str(n - 1)).first()
    assert last["depth"] == n - 1 and last["breadcrumb"] == tree.SEPARATOR.join(map(str, range(n)))
    assert tree.closure(nodes).count() == n * (n + 1) // 2
    assert sorted((int(r["node_id"]), r["page_end"], r["subtree_size"]) for r in tree.rollup_pages(nodes).collect()) == [(i, n - 1, n - i) for i in range(n)]
    assert tree.full_text(nodes).where("node_id = '200'").first()["text_full"] == "200\n201\n202"
    assert tree.outline(nodes).count() == n


def test_cycles_orphans_and_nothing(spark):
    rows = [("a", None, "A", 0), ("b", "a", None, 0), ("c", "b", "C", 0), ("x", "gone", "X", 0), ("y", "x", "Y", 0)]
    nodes = spark.createDataFrame([(*r, i, i) for i, r in enumerate(rows)], NODE + ", page_min int, page_max int")
    assert {r["node_id"]: r["breadcrumb"] for r in tree.descend(nodes).collect()} == {"a": "A", "b": None, "c": None}
    assert sorted((r["ancestor"], r["descendant"], r["distance"]) for r in tree.closure(nodes).collect() if r["distance"]) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1), ("x", "y", 1)]
    assert {r["node_id"]: r["subtree_size"] for r in tree.rollup_pages(nodes).collect()} == {"a": 3, "b": 2, "c": 1, "x": 2, "y": 1}
    none = nodes.where("false")
    assert tree.descend(none).count() == tree.rollup_pages(none).count() == tree.closure(none).count() == 0
    loop = spark.createDataFrame([("a", None, "A", 0, None), ("p", "q", "P", 0, None), ("q", "r", "Q", 0, None), ("r", "p", "R", 0, None)], NODE + ", code string").withColumns({"page_min": F.lit(1), "page_max": F.lit(1)})
    for f in (tree.descend, tree.closure, tree.rollup_pages, graph.resolve_up):
        with pytest.raises(ValueError, match="cycle"):
            f(loop)


def test_deep_json(spark):
    import json

    t = {"title": "t0"}
    for i in range(1, 120):
        t = {"title": f"t{i}", "children": [t, {"title": "leaf"}]}
    rows = spark.createDataFrame([(1, json.dumps(t)), (2, '{"title": "one"}'), (3, None)], "doc_id long, j string")
    got = tree.flatten_json(rows, "j")
    assert got.where("doc_id = 1").count() == 1 + 2 * 119 and got.where("doc_id = 2").count() == 1 and got.where("doc_id = 3").count() == 0
    assert got.where("doc_id = 1").agg(F.max("depth")).first()[0] == 119


def test_page_lookup(spark):
    items = spark.createDataFrame([("d", 0, "a", 5, 7), ("d", 1, "b", 5, 300), ("d", 2, "c", 90, 80), ("e", 0, "z", 9, 9)], "doc string, ord int, item string, start int, end int")
    pages = spark.createDataFrame([("d", p) for p in (4, 5, 7, 8, 95, 299, 301)] + [("f", 1)], "doc string, page int")
    got = {(r["doc"], r["page"]): r["item"] for r in graph.page_lookup(pages, items).collect()}
    assert got == {("d", 4): None, ("d", 5): "a", ("d", 7): "a", ("d", 8): "b", ("d", 95): "b", ("d", 299): "b", ("d", 301): "c", ("f", 1): None}
