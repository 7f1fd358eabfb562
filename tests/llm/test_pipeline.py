"""The pipeline and the registry."""

import re

import corpus_pipeline
import odd
from quire.llm import decontam, linededup, queries, sentencepiece, toxicity


def groups_by_hand(docs):
    """{doc_id: least doc_id of its group}: five-word shingles of similarity 0.8 or more, every pair compared."""
    sets = {}
    for doc_id, text in docs:
        words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        words = [w for w in re.split("[\\x20\\x09-\\x0d]+", words) if w]
        sets[doc_id] = {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    of = {d: d for d in sets}

    def top(d):
        while of[d] != d:
            d = of[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or len(x & y) >= 0.8 * len(x | y) - 1e-9:
                u, v = sorted((top(a), top(b)))
                of[v] = u
    return {d: top(d) for d in ids}


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("labels", "benchmark"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash_near_dedup", "substring_dedup", "benchmark_decontamination", "sentencepiece"]
    at, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        at = spark.createDataFrame(stage(spark, at, sf_dir).collect(), None if k == len(corpus_pipeline.STAGES) - 1 else docs.schema)
        seen.append({(r["doc_id"], r["text"]) for r in at.collect()})
        if k < len(corpus_pipeline.STAGES) - 1:
            assert at.columns == docs.columns
    rejected = {r["doc_id"] for r in toxicity.score(docs, labels).where("predicted = 1").collect()}
    assert {d for d, _ in seen[0]} == {r["doc_id"] for r in docs.collect()} - rejected
    assert {d for d, _ in seen[1]} == set(groups_by_hand(sorted(seen[0])).values())
    second = spark.createDataFrame(sorted(seen[1]), "doc_id long, text string")
    assert seen[2] == {(r["doc_id"], r["text"]) for r in linededup.dedup_lines(second).collect()}
    third = spark.createDataFrame(sorted(seen[2]), "doc_id long, text string")
    leaks = {r["doc_id"] for r in decontam.contaminated(third, items).collect()}
    assert {d for d, _ in seen[3]} == {d for d, _ in seen[2]} - leaks
    assert at.columns == [*docs.columns, "tokens", "decoded"]
    whole = sorted(corpus_pipeline.run(spark, sf_dir).select("doc_id", "tokens", "decoded").collect())
    assert whole == sorted(at.select("doc_id", "tokens", "decoded").collect())
    codec = sentencepiece.load(spark)
    assert all(r["decoded"] == codec.decode(r["tokens"]) for r in whole)


def test_stages_take_odd_rows(spark, sf_dir):
    for docs in (odd.frame(spark), odd.clashing(spark), odd.empty(spark)):
        columns = docs.columns
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert docs.columns == columns
            docs.count()


def test_registry():
    import __spark_entry__

    names = list(__spark_entry__.queries())
    assert set(queries.queries()) | {"pipeline"} <= set(names)
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10
