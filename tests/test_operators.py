"""Operators on hand-made rows with results worked out by hand."""

import json

import pytest
from pyspark.sql import functions as F

from quire import models, streaming
from quire.functions import text as X
from quire.functions import vector as V
from quire.operators import chunking, evaluate, graph, lines, parsing, relational, tree
from quire.sources import read_enriched, read_gold, read_ocr, sinks


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


def test_text_functions(spark):
    assert one(spark, " “a”  – b ", X.clean_symbols) == '"a" - b'
    assert one(spark, "My  File-name (v2)", X.slug) == "My_File_name_v2"
    assert one(spark, "(iv) then", X.enumerator) == "iv"
    assert one(spark, "none", X.enumerator) is None
    assert [one(spark, x, X.alpha_value) for x in ("a", "z", "aa", "ab", "1")] == [1, 26, 27, None, None]
    assert [one(spark, x, X.roman_value) for x in ("i", "xiv", "lix", "lx")] == [1, 14, 59, None]
    assert [one(spark, x, X.classify) for x in ("Part 2", "3. X", "3.1 Y", "(A) z", "(iv) z", "(c) z", "(12) z", "SOME TITLE HERE", "plain", "() z")] == [
        "part", "condition", "clause", "sub_clause", "sub_sub_clause", "sub_sub_sub_clause", "sub_sub_sub_sub_clause", "subtitle", "text", "text",
    ]
    assert one(spark, '"Fee" means money;', X.classify_definition) == "definition"
    assert one(spark, '"A" means x; "Term B" means y;', X.split_definitions) == ['"A" means x;', '"Term B" means y;']
    assert one(spark, "Title here ........ 12", X.toc_title) == "Title here" and one(spark, "Title here ........ 12", X.toc_page) == 12
    assert one(spark, "12. The thing", X.strip_number) == "The thing"
    assert one(spark, "my_file-NAME", X.title_of) == "My File Name"
    assert one(spark, "How does it work?", X.question_route) == "synthesis" and one(spark, "Fee cap", X.question_route) == "retrieval"
    row = spark.createDataFrame([(3, None), (3, 3), (3, 5), (None, None)], "a int, b int").select(X.page_label(F.col("a"), F.col("b")).alias("l")).collect()
    assert [r["l"] for r in row] == ["p. 3", "p. 3", "pp. 3–5", "page unknown"]


def test_vectors(spark):
    assert one(spark, [3.0, 4.0, 9.0], lambda v: V.truncate_normalize(v, 2), "array<double>") == [0.6, 0.8]
    assert one(spark, [0.0, 0.0], V.normalize, "array<double>") == [0.0, 0.0]
    assert one(spark, [0.0, 0.0], lambda v: V.cosine(v, v), "array<double>") is None
    assert one(spark, "[1,2.5]", V.parse_vector) == [1.0, 2.5]


def test_ocr_lines(spark, tmp_path):
    box = {"page_no": 1, "bbox": {"l": 0, "t": 9, "r": 1, "b": 8}}
    texts = [
        {"self_ref": "#/texts/0", "label": "text", "text": "", "orig": "from orig", "prov": [box]},
        {"self_ref": "#/texts/1", "label": "page_header", "text": "running head", "prov": [box]},
        {"self_ref": "#/texts/2", "label": "page_header", "text": "3.2 kept", "prov": [box]},
        {"self_ref": "#/texts/3", "label": "text", "text": "17", "prov": [box]},
        {"self_ref": "#/groups/x", "label": "text", "text": "not a line", "prov": [box]},
    ]
    cells = [{"start_row_offset_idx": 0, "text": "Part 1"}, {"start_row_offset_idx": 0, "text": "..... 4"}, {"start_row_offset_idx": 1, "text": "Other"}]
    (tmp_path / "a_docling_export.json").write_text(json.dumps({"texts": texts, "tables": [{"label": "document_index", "data": {"table_cells": cells}}]}, indent=1))
    docs = read_ocr(spark, str(tmp_path))
    kept = lines.keep_lines(lines.from_json(docs)).orderBy("line_id").collect()
    assert [(r["doc_id"], r["line_id"], r["text"]) for r in kept] == [("a", 0, "from orig"), ("a", 2, "3.2 kept")]
    assert [r["line"] for r in lines.toc_lines(docs).orderBy("row_no").collect()] == ["Part 1 ..... 4", "Other"]


def test_patch_and_segment(spark):
    rows = spark.createDataFrame([("d", 1, "2. Term", "section_header", 1), ("d", 0, "defs", "text", 1), ("d", 2, "body", "text", 2), ("d", 3, "annex", "text", 9)], "doc_id string, line_id int, text string, label string, page int")
    patch = spark.createDataFrame([("d", 2, "bo", "BO", "> ")], "doc_id string, line_id int, pattern string, replacement string, prepend string")
    assert lines.patch_lines(rows, patch).where("line_id = 2").first()["text"] == "> BOdy"
    cut = lines.segment(rows.withColumn("annex_page", F.lit(9))).orderBy("line_id").collect()
    assert [r["section"] for r in cut] == ["definitions", "body", "body", "annex"]


def test_merge_fragments(spark):
    rows = [(1, "The fee shall be paid to the long-"), (2, "standing owner of the"), (3, "land."), (4, "2. New heading which is long enough"), (5, "(a) first limb of the list goes here."), (6, "It ends here with a full stop and more.")]
    got = lines.merge_fragments(spark.createDataFrame([("d", i, t, "text") for i, t in rows], "doc_id string, line_id int, text string, label string")).orderBy("line_id").collect()
    assert [(r["line_id"], r["absorbed"]) for r in got] == [(1, [2, 3]), (4, []), (5, []), (6, [])] or [(r["line_id"], r["absorbed"]) for r in got][0] == (1, [2, 3])
    assert got[0]["text"] == "The fee shall be paid to the longstanding owner of the land."


def test_stack(spark):
    content = ["3.1 Clause one", "(A) capital", "(i) roman", "(ii) roman two", "(a) alpha", "free text", "(iii) roman three", "3.2 Clause two", "(h) letter", "(i) after h", "9.1 foreign clause", "Part 7"]
    rows = spark.createDataFrame([("d", "3", "Payment", n, t) for n, t in enumerate(content)], "doc_id string, condition string, heading string, line_id int, text string")
    got = [(r["kind"], r["depth"], r["parent_line"]) for r in lines.stack(rows).orderBy("line_id").collect()]
    assert got == [
        ("clause", 4, None), ("sub_clause", 5, 0), ("sub_sub_clause", 6, 1), ("sub_sub_clause", 6, 1), ("sub_sub_sub_clause", 7, 3), ("text", 8, 4), ("sub_sub_clause", 6, 1),
        ("clause", 4, None), ("sub_sub_sub_clause", 7, 7), ("sub_sub_sub_clause", 7, 7), ("text", 8, 9),
    ]


def test_tree_and_chunks(spark):
    nodes = spark.createDataFrame([("a", None, "Root", 0), ("b", "a", "Kid", 0), ("c", "a", "Kid 2", 1), ("d", "b", "Leaf", 0)], "node_id string, parent_id string, title string, ordinal int")
    assert [r["title"] for r in tree.descend(nodes).orderBy("path").collect()] == ["Root", "Kid", "Leaf", "Kid 2"]
    assert tree.full_text(nodes).where("node_id = 'a'").first()["text_full"] == "Root\nKid\nLeaf\nKid 2"
    pieces = spark.createDataFrame([(1, i, f"p{i}", "x" * n) for i, n in enumerate((4, 4, 20, 3, 3, 3))] + [(2, 0, "q", "y")], "source_id int, ord int, label string, text string")
    got = [(r["source_id"], r["part"], r["n_pieces"], r["char_length"], r["label"]) for r in chunking.pack(pieces, 10).orderBy("source_id", "part").collect()]
    assert got == [(1, 1, 2, 8, "Clauses p0 to p1"), (1, 2, 1, 20, "Clause p2"), (1, 3, 3, 9, "Clauses p3 to p5"), (2, 1, 1, 1, "Clause q")]
    titles = spark.createDataFrame([(1, "T", "B"), (2, "U", "C")], "source_id int, title string, breadcrumb string")
    headed = {r["chunk_uid"]: r["text"] for r in chunking.with_header(chunking.pack(pieces, 10), titles).collect()}
    assert headed["2"] == "[U] > C\n\ny" and headed["1:part_2"].startswith("[T] > B (Part 2/3: Clause p2)\n\n")


def test_graph(spark):
    seg = spark.createDataFrame([("d", 0, 0, 10000), ("d", 1, 10, 5000), ("d", 2, 10, 5000), ("d", 3, 4090, 4200)], "doc string, seg_ord int, s long, e long")
    spans = spark.createDataFrame([("d", 1, 20, 30), ("d", 2, 4095, 4100), ("d", 3, 9000, 9001), ("d", 4, 20000, 20001)], "doc string, span_id int, s long, e long")
    got = {r["span_id"]: r["seg_ord"] for r in graph.smallest_containing(seg, spans, ["doc"]).collect()}
    assert got == {1: 1, 2: 3, 3: 0, 4: None}
    cites = graph.citations_in(spark.createDataFrame([("1", "see Condition 4A and condition 5")], "node string, text string"))
    assert sorted(r["target"] for r in cites.collect()) == ["4A", "5"]


def test_containment_is_swept_not_paired(spark):
    """Every span of a dense document against all segments by hand, in one cell and in many."""
    import random

    r = random.Random(7)
    seg = [(d, i, s, s + r.choice((-1, 0, 3, 40, 700))) for d in "ab" for i in range(700) for s in [r.randrange(1500)]] + [(None, 0, 0, 9999), ("a", 900, None, 5), ("c", 1, 0, 10)]
    span = [(d, i, s, s + r.randrange(9)) for d in "ab" for i in range(1500) for s in [r.randrange(1600)]] + [(None, 1, 5, 6), ("a", 9001, 5, None), ("b", 9002, None, 7), ("c", 1, 10, 11), ("c", 2, 10, 10)]
    segments, spans = spark.createDataFrame(seg, "doc string, seg_ord int, s long, e long"), spark.createDataFrame(span, "doc string, span_id int, s long, e long")

    def shortest(d, s, e):
        inside = [(y - x, i) for k, i, x, y in seg if None not in (d, s, e, x) and k == d and x <= s and e <= y]
        return min(inside)[1] if inside else None

    want = {(d, i): shortest(d, s, e) for d, i, s, e in span}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")  # so that a step is more than one batch
    for cell, step in ((4096, 1 << 16), (64, 1 << 16), (4096, 120)):
        found = graph.smallest_containing(segments, spans, ["doc"], cell, step)
        assert {(x["doc"], x["span_id"]): x["seg_ord"] for x in found.collect()} == want
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = graph.smallest_containing(segments, spans, ["doc"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_enriched_and_gold(spark, tmp_path):
    doc = {
        "text": "1 Title body", "segments": [{"id": "s0", "kind": "x", "parent": None, "children": [], "span": {"start": 0, "end": 12}, "title": {"start": 2, "end": 7}, "code": {"start": 0, "end": 1}}],
        "crossreferences": [{"span": {"start": 8, "end": 12}, "start": "s0", "end": "s0"}], "terms": [{"name": {"start": 2, "end": 7}, "meaning": {"start": 8, "end": 12}}],
        "external_documents": [{"name": {"start": 2, "end": 7}, "type": None, "mentions": [{"start": 0, "end": 1}]}],
    }
    (tmp_path / "e_enriched.json").write_text(json.dumps({"results": [{"document": doc}]}))
    r = read_enriched(spark, str(tmp_path))
    assert r["segment"].first()["title_text"] == "Title" and r["segment"].first()["code_text"] == "1"
    assert r["xref"].first()["span_text"] == "body" and r["term"].first()["meaning"] == "body" and r["ext_mention"].first()["type"] == "statute"
    (tmp_path / "gold.json").write_text(json.dumps({"queries": [{"id": "q", "query": "t", "gold": [{"title": "fee"}], "reviewed": False}]}))
    gold = read_gold(spark, str(tmp_path / "gold.json"))
    results = spark.createDataFrame([("q", 1, "d", "1", "Other"), ("q", 2, "d", "2", "The Fee Cap")], "query_id string, rank int, document_id string, condition string, title string")
    assert evaluate.gold_ranks(results, gold).first()["first_rank"] == 2
    changed = evaluate.run_changes(spark.createDataFrame([("q", None), ("r", 1)], "query_id string, first_rank int"), spark.createDataFrame([("q", 2), ("r", 1)], "query_id string, first_rank int"))
    assert [x["query_id"] for x in changed.collect()] == ["q"]


def test_incremental_writes(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "k int, v string")
    path = str(tmp_path / "t")
    sinks.append_absent(rows, None, path, ["k"])
    sinks.append_absent(rows.union(spark.createDataFrame([(3, "c")], "k int, v string")), spark.read.parquet(path), path, ["k"])
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]
    more = spark.createDataFrame([(None, "n"), (None, "m"), (1, "x")], "k int, v string")
    for _ in range(2):  # a null key is written once, and found again
        sinks.append_absent(more, spark.read.parquet(path), path, ["k"])
    assert spark.read.parquet(path).where("k is null").count() == 1 and spark.read.parquet(path).count() == 4
    sinks.write_build(rows, str(tmp_path / "b"), "one")
    assert spark.read.parquet(str(tmp_path / "b")).where("build_id = 'one'").count() == 3
    assert relational.pending(rows, spark.createDataFrame([(1,)], "k int"), ["k"]).count() == 1


def test_models(spark):
    rows = spark.createDataFrame([(i, f"Text {i}. More.") for i in range(25)], "k int, text string")
    got = models.apply_batches(rows, "text", "summary", "string", models.first_sentence()).orderBy("k").collect()
    assert [r["summary"] for r in got] == [f"Text {i}" for i in range(25)]
    assert len(models.apply_batches(rows, "text", "v", "array<double>", models.hash_embedder(40)).first()["v"]) == 40

    def broken(texts):
        raise RuntimeError("down")

    assert models.apply_batches(rows, "text", "summary", "string", broken, tries=2, wait=0.0).where("summary is null").count() == 25
    failed = spark.sparkContext.accumulator(0)
    models.apply_batches(rows, "text", "summary", "string", broken, tries=1, failures=failed).count()
    assert failed.value == 25
    for fault in (lambda texts: texts[1:], lambda texts: texts + 1):
        with pytest.raises(Exception, match="answers to|TypeError"):
            models.apply_batches(rows, "text", "summary", "string", fault, wait=0.0).count()


def test_streaming(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.select("event_id", "ts", "event_type", "value").repartition(2).write.parquet(str(tmp_path / "in"))
    target, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):
        stream = spark.readStream.schema("event_id long, ts timestamp_ntz, event_type string, value double").parquet(str(tmp_path / "in"))
        streaming.process_absent(stream, target, ["event_id"], lambda df: df.withColumn("double", F.col("value") * 2), check).awaitTermination()
    assert spark.read.parquet(target).count() == events.count()
    assert streaming.windowed_counts(events).agg(F.sum("n")).first()[0] == events.count()


def test_hybrid_items_without_vector(spark):
    """They are found by their words and have no dense rank."""
    from quire.plans import hybrid

    queries = spark.createDataFrame([(1, "red fox", [1.0, 0.0])], "query_id long, text string, qvec array<double>")
    items = spark.createDataFrame([(10, "blue whale", [1.0, 0.1]), (11, "red fox red fox", None), (12, "grey owl", None)], "item_id long, text string, vec array<double>")
    fused = {r["item_id"]: (r["dense_rank"], r["lexical_rank"]) for r in hybrid.hybrid(queries, items).collect()}
    assert fused == {10: (1, None), 11: (None, 1)}
    assert {r["item_id"] for r in hybrid.reranked(queries, items).collect()} == {10, 11}


def test_stems_and_lexemes(spark):
    from quire.functions.stem import stem

    published = "consistently consist consolatory consolatori consoles consol conspiracy conspiraci constables constabl knackeries knackeri knavish knavish kneeling kneel knightly knight knitted knit knives knive knocker knocker skies sky dying die news news".split()
    assert [stem(w) for w in published[::2]] == published[1::2]
    assert [stem(w) for w in "hopping hoped cries gas relational activities obligations generally sensational y'all at".split()] == "hop hope cri gas relat activ oblig general sensat y'all at".split()
    assert one(spark, "The Payments of the PAYMENT, 2nd (obligations)!", lambda t: X.lexemes(t, True)) == ["payment", "payment", "2nd", "oblig"]
    rows = spark.createDataFrame([("",), (None,), ("the of",), ("running runs",)], "x string").select(X.lexemes(F.col("x"), True).alias("y")).collect()
    assert [r["y"] for r in rows] == [[], None, [], ["run", "run"]]


def test_lexical_search(spark):
    from quire.operators import search

    items = spark.createDataFrame([(1, "The fee and the fees", None), (2, "nothing here", "Fee table"), (3, None, "fee"), (4, "of the", ""), (5, "fee", "fee")], "item_id int, text string, header string")
    queries = spark.createDataFrame([(1, "what is the fee"), (2, "the of"), (3, None), (4, "table HERE")], "query_id int, text string")

    def got(**k):
        return [(r["query_id"], r["item_id"], round(r["score"], 6), r["rank"]) for r in search.lexical_topk(queries, items, **k).orderBy("query_id", "rank").collect()]

    assert got() == [(1, 1, 0.1, 1), (1, 5, 0.1, 2), (1, 2, 0.0, 3), (4, 2, 0.0, 1)]
    assert got(stemmed=True, k=2)[:2] == [(1, 1, 0.2, 1), (1, 5, 0.1, 2)]
    assert [(r["query_id"], r["item_id"]) for r in search.bm25_topk(queries.where("query_id = 1"), items).orderBy("rank").collect()] == [(1, 5), (1, 1)]


def test_dense_search_takes_odd_vectors(spark):
    from quire.operators import search

    items = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0]), ("c", None), ("d", [1.0, None]), ("e", [float("nan"), 1.0]), ("f", [1.0, 0.0, 0.0]), ("g", [2.0, 0.0]), ("h", [-1.0, 0.1])], "item_id string, vec array<double>")
    queries = spark.createDataFrame([(1, [3.0, 0.0]), (2, None), (3, [0.0, 0.0])], "query_id long, qvec array<double>")
    got = [(r["query_id"], r["item_id"], r["rank"]) for r in search.dense_topk(queries, items).orderBy("rank").collect()]
    assert got == [(1, "a", 1), (1, "g", 2), (1, "h", 3)]
    assert search.dense_topk(queries, items, 1).count() == 1 and search.dense_topk(queries.where("false"), items).count() == 0


def _words(n, seed):
    import random

    r = random.Random(seed)
    return [(i % (n * 4 // 5), " ".join(r.choice("fee cap tax Term of clause part rate sum day".split()) for _ in range(r.randrange(12)))) for i in range(n)]


def test_word_search_ranks_within_tasks(spark, monkeypatch):
    """Hits are not listed: every task hands on its best items alone.  Some items have several rows, some texts tie."""
    from quire.operators import search

    texts = _words(400, 3)
    items = spark.createDataFrame(texts + [(None, "fee fee"), (None, "cap"), (999, None)], "item_id long, text string").repartition(5).withColumn("header", F.lit("Day"))
    queries = spark.createDataFrame([(q, t) for q, t in _words(9, 5)] + [(2, "tax rate"), (50, "the of"), (51, "day day")], "query_id int, text string")
    terms = {q: set() for q in (*range(7), 50, 51)}
    for r in queries.select("query_id", X.lexemes(F.col("text")).alias("w")).collect():
        terms[r["query_id"]] |= set(r["w"])
    score = {}
    for i, t in texts + [(None, "fee fee"), (None, "cap")]:
        for q, wanted in terms.items():
            n = sum(w in wanted for w in t.lower().split())
            if n or "day" in wanted:
                score[q, i] = score.get((q, i), 0) + n
    want = [(q, i, round(s / 10, 6), n) for q in terms for n, (s, i) in enumerate(sorted(((s, i) for (p, i), s in score.items() if p == q), key=lambda x: (-x[0], x[1] is not None, x[1]))[:7], 1)]
    for told in (search.TOLD_TERMS, 0):
        monkeypatch.setattr(search, "TOLD_TERMS", told)
        found = search.lexical_topk(queries, items, 7)
        assert sorted((r["query_id"], r["item_id"] or -1, round(r["score"], 6), r["rank"]) for r in found.collect()) == sorted((q, i or -1, s, n) for q, i, s, n in want)
        if told:
            assert "Generate" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_best_items_are_settled_in_bounded_slices(monkeypatch):
    """However small the slices, the best of each query stay, ties by id."""
    import pyarrow as pa

    from quire.operators import search

    texts = _words(400, 8)
    names, words = [f"d{n:03}" for n in range(len(texts))], [t.lower().split() for _, t in texts]
    b = pa.RecordBatch.from_pydict({"item_id": names, "words": pa.array(words, pa.list_(pa.string())), "heads": pa.array([[]] * len(words), pa.list_(pa.string())), "_again": [False] * len(words)})
    terms = search._Terms(pa.table({"query_id": [1, 1, 2, 3], "token": ["fee", "cap", "fee", "none"]}))
    monkeypatch.setattr(search, "SLICE", 40)
    got = [r for out in search._best(search._counted([b.slice(0, 150), b.slice(150)], terms), terms, 6, None) for r in out.to_pylist()]
    for q, wanted in ((1, {"fee", "cap"}), (2, {"fee"}), (3, set())):
        best = sorted((-sum(w in wanted for w in ws), i) for i, ws in zip(names, words) if wanted & set(ws))[:6]
        assert [(r["item_id"], r["score"]) for r in got if r["query_id"] == q] == [(i, -s) for s, i in best]


def test_bm25_adds_up_rows_of_an_item(spark):
    """Against the checker's SQL, with ids of several rows, of equal length and not."""
    import duckdb

    from quire.operators import search
    from quire.plans.queries import ORACLES

    texts = [(i, t, "en", "web") for i, t in _words(300, 11)] + [(7, "fee cap", "en", "web"), (7, "fee fee", "en", "web"), (1000, None, "en", "web")]
    asked = _words(8, 4)[:6]
    con = duckdb.connect()
    con.sql("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", texts)
    con.sql("create table benchmark (item_id bigint, text varchar)")
    con.executemany("insert into benchmark values (?, ?)", asked)
    items = spark.createDataFrame([x[:2] for x in texts], "item_id long, text string").repartition(4)
    found = search.bm25_topk(spark.createDataFrame(asked, "query_id long, text string"), items).collect()
    want = {(q, i, n): s for q, i, s, n in con.sql(ORACLES["bm25_topk"]).fetchall()}
    assert {(r["query_id"], r["item_id"], r["rank"]): r["score"] for r in found} == pytest.approx(want, abs=1e-5)


def test_texts_of_ranked_items_are_not_sorted(spark):
    """The few ranked rows go to the texts, whatever the threshold of broadcasts, and texts take part in no shuffle."""
    from quire.operators import search

    items = spark.createDataFrame([(i, f"Text {i}", "t", None) for i in range(50)], "item_id long, text string, title string, subtitle string")
    ranked = spark.createDataFrame([(1, 4, 1, 0.5, 0.1), (1, 3, 2, 0.25, 0.2)], "query_id long, item_id long, rank int, rerank_score double, rrf_score double").withColumn("final_rank", F.col("rank"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    e, r = search.evidence(ranked, items), search.response_rows(ranked, items)
    try:
        assert [x["evidence"] for x in e.collect()] == ["[1] Text 4\n\n---\n\n[2] Text 3"]
        assert sorted((x["item_id"], x["preview"]) for x in r.collect()) == [(3, "Text 3"), (4, "Text 4")]
        assert all("SortMergeJoin" not in x._jdf.queryExecution().executedPlan().toString() for x in (e, r))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hybrid_vectors_apart_from_texts(spark, tmp_path):
    """Texts are joined with no vector unless an id has two, and results are those of the SQL, which leaves an item without text out."""
    import duckdb

    from quire.plans import queries as Q

    con = duckdb.connect()
    for n, more in (("one", []), ("two", [(3, [0.5, 0.1], 1)])):
        d = tmp_path / n
        spark.createDataFrame([(i, t or "cap", "en", "web") for i, t in _words(60, 2)[:45]] + [(46, None, "en", "web")], "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
        spark.createDataFrame([(i, [float(i % 7 + 1), float(i % 5) + i / 100], i % 3) for i in range(50)] + more, "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
        spark.createDataFrame([(1, "fee cap"), (2, "tax rate day")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
        for t in ("documents", "embeddings", "benchmark"):
            con.sql(f"create or replace view {t} as select * from read_parquet('{d}/{t}.parquet/*.parquet')")
        q, items, vectors = Q._hybrid_inputs(spark, str(d))
        assert ("Join" in items._jdf.queryExecution().optimizedPlan().toString()) == bool(more) and (vectors is None) == bool(more)
        found = {(r["query_id"], r["item_id"], r["dense_rank"], r["lexical_rank"]) for r in Q.rrf_fusion(spark, str(d)).collect()}
        want = {r[:4] for r in con.sql(Q.ORACLES["rrf_fusion"]).fetchall()}
        assert 46 not in {x[1] for x in found} and (more or found == want)


def test_definitions_are_merged_as_one_by_one(spark):
    """Streamed lines against the rule followed line by line, whatever the batches; no document is a group of its own."""
    import random
    import re

    r = random.Random(5)
    some = ['"Fee"', '"Fee" means', "means the sum", "of all parts;", "", None, "“Cap”", "shall mean a limit", "'Tax' is due", "plain line", '"Term', 'of Years" means long', "‘Day’", "or"]
    rows = [(d, i, r.choice(some), r.choice(["text", "text", "text", "list_item", "page_header", None])) for d in ("a", "b", None) for i in range(300)] + [(f"s{n}", 1, "alone", "text") for n in range(20)]
    patterns = [re.compile(p) for p in X.DEFINITION]

    def by_hand(rows):
        ids, texts, labels = [x[1] for x in rows], [x[2] or "" for x in rows], [x[3] for x in rows]
        i = 0
        while i < len(ids):
            width, kept = 0, ids[i]
            for k in range(1, 4):
                if i + k >= len(ids) or any(x not in ("text", "list_item", "footnote", "formula") for x in labels[i + 1 : i + k + 1]):
                    break
                hit = next((m for p in patterns if (m := p.match(" ".join(texts[i : i + k + 1])))), None)
                if hit and not any(p.match(texts[i]) for p in patterns):
                    words = [w for w in hit[0].split() if len(w) > 2][:3]
                    kept = next((ids[j] for j in range(i, i + k + 1) if hit[0] in texts[j] or any(w in texts[j] for w in words)), ids[i])
                    width = k
                    break
            yield rows[0][0], kept, " ".join(texts[i : i + width + 1]), tuple(m for m in ids[i : i + width + 1] if m != kept)
            i += width + 1

    want = [x for d in {x[0] for x in rows} for x in by_hand([x for x in rows if x[0] == d])]
    frame = spark.createDataFrame(rows, "doc_id string, line_id int, text string, label string")
    try:
        for size in ("10000", "7", "2"):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            found = parsing.merge_definitions(frame)
            got = [(x["doc_id"], x["line_id"], x["text"], tuple(x["absorbed"])) for x in found.collect()]
            assert sorted(got, key=str) == sorted(want, key=str)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert any(x[3] for x in want) and "FlatMapGroups" not in found._jdf.queryExecution().executedPlan().toString()


def test_sections_are_merged_in_one_pass(spark):
    """Each section by its own rules, as if merged apart; the lines are read once."""
    rows = [("d", i, t, "text", s) for i, (t, s) in enumerate([("The fee is", "definitions"), ("x = y", "definitions"), ("owed to", "definitions"), ("the owner", "body"), ("is = 4", "body"), ("Signed by", "annex"), ("the director", "annex"), ("of works and", "annex"), ("roads", "annex")])]
    frame = spark.createDataFrame(rows, "doc_id string, line_id int, text string, label string, section string")
    got = {(r["section"], r["line_id"], r["text"], tuple(r["absorbed"])) for r in lines.merge_fragments(frame, None).collect()}
    apart = {(s, r["line_id"], r["text"], tuple(r["absorbed"])) for s in ("definitions", "body", "annex") for r in lines.merge_fragments(frame.where(F.col("section") == s), s).collect()}
    assert got == apart and len({x[0] for x in got}) == 3
    raw = frame.drop("section").withColumns({"page": F.lit(1), "annex_page": F.lit(2)})
    none = spark.createDataFrame([], "doc_id string, line_id int, pattern string, replacement string, prepend string")
    assert lines.flatten_text(raw, none)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_missing_keys_are_dealt_by_their_number(spark, monkeypatch):
    """Tasks hold a bounded number of keys; nulls match nothing, repeated keys count once."""
    a = spark.createDataFrame([(1, "x"), (1, "x"), (2, None), (3, "y"), (None, "z")], "k int, m string")
    b = spark.createDataFrame([(3, "y"), (2, None), (4, "y")], "k int, m string")
    monkeypatch.setattr(evaluate, "KEYS", 3)
    found = evaluate.missing(a, b, ["k", "m"])
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(1, "x", "expected"), (2, None, "expected"), (None, "z", "expected"), (2, None, "actual"), (4, "y", "actual")], key=str)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "Join" not in plan


def test_dense_search_is_one_python_stage(spark, monkeypatch):
    """Query vectors are told to the tasks or joined, with the same results; told, no pairs of packs are made."""
    import random

    from quire.operators import search

    r = random.Random(9)
    items = spark.createDataFrame([(i, [float(r.randrange(5)) for _ in range(3)]) for i in range(500)], "item_id long, vec array<float>").repartition(3)
    queries = items.where("item_id % 9 = 0").selectExpr("item_id AS query_id", "vec AS qvec")
    got = []
    for told in (search.TOLD_BYTES, -1):
        monkeypatch.setattr(search, "TOLD_BYTES", told)
        found = search.dense_topk(queries, items, 6)
        got.append(sorted(tuple(x) for x in found.collect()))
        assert ("Join" in found._jdf.queryExecution().executedPlan().toString()) == (told < 0)
    vectors = {x["item_id"]: x["vec"] for x in items.collect() if any(x["vec"])}

    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) ** 0.5 * sum(x * x for x in b) ** 0.5)

    want = {(q, n): s for q in vectors if q % 9 == 0 for n, s in enumerate(sorted((cosine(vectors[q], v) for v in vectors.values()), reverse=True)[:6], 1)}
    assert got[0] == got[1] and {(q, n): s for q, _, s, n in got[0]} == pytest.approx(want)
