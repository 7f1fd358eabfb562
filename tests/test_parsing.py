"""Parsing, references and checks on hand-made documents."""

import pytest
from pyspark.sql import functions as F

from quire.operators import chunking, evaluate, lines, parsing, references, relational, tree, validate


def rows(spark, texts, kind="doc_id string, line_id int, text string, label string"):
    return spark.createDataFrame([("d", i, t, "text") for i, t in enumerate(texts)], kind)


def test_toc_tree(spark):
    toc = spark.createDataFrame([("d", i, t) for i, t in enumerate(["Contents", "Part 1 General", "1. Term", "2A. Fee", "Annex B Forms", "3. Form one"])], "doc_id string, ord int, text string")
    got = [(r["kind"], r["number"], r["parent_ord"]) for r in parsing.toc_tree(toc, ["doc_id"]).orderBy("ord").collect()]
    assert got == [("part", "1", None), ("condition", "1", 1), ("condition", "2A", 1), ("annex", "B", None), ("condition", "3", 4)]
    body = rows(spark, ["x", "2A. Fee", "1. Term", "2A. again"])
    found = {r["number"]: r["line_id"] for r in parsing.body_lines(parsing.toc_tree(toc, ["doc_id"]), body, ["doc_id"]).collect()}
    assert found == {"1": 2, "2A": 1, "3": None}


def test_annexes_move_forward(spark):
    toc = spark.createDataFrame([("d", 0, "Annex 1 A"), ("d", 1, "Annex 2 B"), ("d", 2, "Annex 1 C"), ("d", 3, "Schedule 9"), ("d", 4, "ANNEX 2"), ("e", 0, "Annex 1")], "doc_id string, ord int, text string")
    body = rows(spark, ["Annex 2 early", "Annex 1 A", "text", "annex 2 B", "Annex 1 C", "Schedule 8", "Annex 2 again"])
    got = {(r["doc_id"], r["ord"]): r["line_id"] for r in parsing.annex_lines(toc, body, ["doc_id"]).collect()}
    assert got == {("d", 0): 1, ("d", 1): 3, ("d", 2): 4, ("d", 3): None, ("d", 4): 6, ("e", 0): None}


def test_definition_merge(spark):
    got = parsing.merge_definitions(rows(spark, ['"Strike', 'Price" means', "the price.", '"Fee" means money;', "plain", "text"])).orderBy("line_id").collect()
    assert [(r["line_id"], r["text"], r["absorbed"]) for r in got] == [
        (0, '"Strike Price" means', [1]), (2, "the price.", []), (3, '"Fee" means money;', []), (4, "plain", []), (5, "text", []),
    ]


def test_merge_variants(spark):
    def merged(a, b, variant):
        return lines.merge_fragments(rows(spark, [a, b]), variant).count() == 1

    long = "The parties have agreed upon the following terms and"
    assert merged(long, "Signed by the director of the company here", "body") and not merged(long, "Signed by the director of the company here", "annex")
    assert not merged(long, "3.1 The clause that follows is another one", "annex")
    assert not merged(long, "x = y plus something that is quite long here", "definitions") and merged(long, "x = y plus something that is quite long here", "body")
    with pytest.raises(ValueError):
        lines.merge_fragments(rows(spark, [long]), "other")


def test_flatten_text(spark):
    raw = [("1. DEFINITIONS", "section_header", 1), ("These are the words that the parties use throughout the", "text", 1), ("whole document.", "text", 1), ("page 3", "page_footer", 1), ("2. TERM", "section_header", 2), ("It runs for fifteen years as is set out in the", "text", 2), ("schedule below.", "text", 2), ("Annex 1", "section_header", 9), ("Forms of every kind are here.", "text", 9)]
    docs = spark.createDataFrame([("d", i, t, k, p, 9) for i, (t, k, p) in enumerate(raw)], "doc_id string, line_id int, text string, label string, page int, annex_page int")
    patches = spark.createDataFrame([("d", 4, "TERM", "TERMS", None)], "doc_id string, line_id int, pattern string, replacement string, prepend string")
    got = [(r["line_id"], r["section"], r["text"]) for r in lines.flatten_text(docs, patches).orderBy("line_id").collect()]
    assert got == [
        (0, "definitions", "1. DEFINITIONS"), (1, "definitions", "These are the words that the parties use throughout the whole document."), (4, "body", "2. TERMS"),
        (5, "body", "It runs for fifteen years as is set out in the schedule below."), (7, "annex", "Annex 1"), (8, "annex", "Forms of every kind are here."),
    ]


SEGMENT = "doc_id string, seg_ord long, id string, parent string, children array<string>, s long, e long, title_text string, code_text string"


def test_references(spark):
    segments = spark.createDataFrame(
        [
            ("d", 0, "root", None, ["a", "b", "c"], 0, 1000, None, None), ("d", 1, "a", "root", [], 0, 100, None, "1."), ("d", 2, "b", "root", ["b1"], 100, 200, " Payment Terms ", "x"),
            ("d", 3, "b1", "b", [], 120, 150, None, None), ("d", 4, "c", "root", ["c1"], 200, 300, None, None), ("d", 5, "c1", "c", [], 210, 220, None, "3.4"),
            ("e", 0, "r", None, [], 0, 10, None, None),
        ],
        SEGMENT,
    )
    conditions = spark.createDataFrame([("d", "1", "Definitions", "1", 0), ("d", "2", "Payment terms", "2", 1), ("d", "3", "Other", "2", 2), ("e", "7", "Seven", None, 0)], "doc_id string, number string, title string, part string, ord int")
    number = {r["id"]: r["number"] for r in references.resolve_segments(segments, conditions).collect()}
    assert number == {"root": "1", "a": "1", "b": "2", "b1": "2", "c": "3", "c1": "3"}
    titles = {r["number"]: r["titles"] for r in references.container_titles(segments, conditions).collect()}
    assert titles == {"1": ["Payment Terms"]}
    xref = spark.createDataFrame(
        [("d", 1, 130, 140, "see 3.4", "c1", "c1"), ("d", 2, 130, 140, "this one", "b", "b1"), ("d", 3, 10, 20, "see Part 2", "nowhere", None), ("d", 4, 10, 20, "the Act", None, None), ("d", 5, 500, 510, "see Condition 3", "a", "c"), ("d", 6, 500, 510, "unknown", "a", "a"), ("e", 7, 1, 2, "unknown", "r", "r"), ("e", 8, 1, 2, "under 7.2", "r", "r")],
        "doc_id string, xref_ord long, s long, e long, span_text string, start_seg string, end_seg string",
    )
    cited = references.citations(xref, segments, conditions)
    got = sorted((r["xref_ord"], r["source"] or "", r["target"] or "") for r in cited.collect())
    assert got == [(1, "2", "3"), (2, "2", "2"), (3, "1", "2"), (4, "1", ""), (5, "1", "1"), (5, "1", "3"), (6, "1", "1"), (7, "", ""), (8, "7", "7")]
    terms = spark.createDataFrame([("d", "Fee", "what Condition 2 and condition 9 and Condition 1 say"), ("d", None, "Condition 3")], "doc_id string, name string, meaning string")
    edges = references.term_edges(terms, conditions)
    assert [tuple(r) for r in edges.collect()] == [("d", "1", "2")]
    records = {r["number"]: (r["n_out"], r["weight_out"], r["n_in"], r["total_links"]) for r in references.records(conditions, cited, edges).collect()}
    assert records == {"1": (2, 3, 0, 2), "2": (1, 1, 1, 2), "3": (0, 0, 2, 2), "7": (0, 0, 0, 0)}
    mentions = spark.createDataFrame([("d", "The Act", None), ("d", "The Act", None), ("d", "EU", None), ("d", "Code", "rule")], "doc_id string, name string, type string")
    assert sorted(tuple(r) for r in references.mention_counts(mentions).collect()) == [("d", "Code", "rule", 1), ("d", "The Act", "statute", 2)]


def test_validation(spark):
    raw = rows(spark, ["Alpha", "beta", "gamma!", "delta", "epsilon"])
    merged = spark.createDataFrame([("d", 0, 0, "Alpha beta", [1]), ("d", 1, 4, "epsilon GAMMA", [4, 9])], "doc_id string, ord int, line_id int, text string, absorbed array<int>")
    assert sorted((r["line_id"], r["state"]) for r in validate.accounted(raw, merged, ["doc_id"]).collect()) == [(2, "lost"), (3, "lost"), (4, "twice"), (9, "invented")]
    assert [r["line_id"] for r in validate.dropped_content(raw, merged.drop("absorbed", "ord"), ["doc_id"]).orderBy("line_id").collect()] == [3]
    assert {r["check"]: r["n"] for r in validate.report(raw, merged, ["doc_id"]).collect()} == {"ids": 4, "dropped": 2}


def test_small_operators(spark):
    nodes = spark.createDataFrame([("p", None, "Part A", "part"), ("q", None, "Part B fee", "part"), ("x", "p", "The Fee", "condition"), ("y", "p", "Other", "condition"), ("z", "q", "None", "condition")], "node_id string, parent_id string, title string, kind string")
    assert sorted(r["node_id"] for r in tree.filter_parts(nodes, "FEE").collect()) == ["p", "q", "x"]
    assert {r["node_id"]: r["place"] for r in tree.sibling_ordinals(nodes, "title").collect()} == {"p": 0, "q": 1, "x": 1, "y": 0, "z": 0}
    cut = spark.createDataFrame([("h1", "b", "t"), ("h2", None, "t"), ("h3", "b", "t")], "text_sha256 string, breadcrumb string, text_full string")
    cache = spark.createDataFrame([("h1", "cached"), ("h1", "cached")], "text_sha256 string, text string")
    assert {r["text_sha256"]: r["text"] for r in chunking.chunk_text(cut, cache).collect()} == {"h1": "cached", "h2": "", "h3": "b\n\nt"}
    a, b = (spark.createDataFrame([(x,) for x in v], "name string") for v in (["AR3 standard terms", "none"], ["standard terms ar3 v2", "standard", "terms"]))
    assert {r["name"]: (r["match"], r["score"]) for r in relational.best_match(a, b).collect()} == {"AR3 standard terms": ("standard terms ar3 v2", 3), "none": (None, None)}
    marks = rows(spark, ["Part 1", "Part 4 x", "no"])
    assert sorted(r["number"] for r in lines.missing_markers(marks, ["doc_id"]).collect()) == [2, 3]
    sums = evaluate.build_sums(spark.createDataFrame([("ab",)], "c string"), spark.createDataFrame([("abcd",), (None,)], "c string"), "c").first()
    assert (sums["nodes_delta"], sums["chars_delta"]) == (1, 2)
    vectors = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0])], "item_id long, vec array<double>")
    d = evaluate.baseline_distribution(vectors, 2).first()
    assert (d["n_pairs"], round(d["mean"], 6), d["low"], d["high"]) == (3, 0.333333, 0.0, 1.0)
    assert parsing.collapse_kind(F.lit("x")) is not None
