"""Jaccard groups of the pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
import odd
from quire.llm import jaccard, simhash


def plain_kept(docs, shingle=5, similarity=0.8):
    """Ids that stay: the least of each component over all pairs."""
    sets = []
    for _, text in docs:
        words = (text or "").lower().split()
        sets.append({" ".join(words[i : i + shingle]) for i in range(len(words) - shingle + 1)} or ({" ".join(words)} if words else set()))
    label = list(range(len(docs)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a == b or len(a & b) >= similarity * len(a | b):
                label[max(root(i), root(j))] = min(root(i), root(j))
    return {docs[i][0] for i in range(len(docs)) if root(i) == i}


def copies(seed, groups, members):
    """Texts of which many lie close to the bound, all with one passage in common."""
    rng = random.Random(seed)
    passage = [f"shared{i}" for i in range(30)]
    docs = []
    for g in range(groups):
        base = [f"w{rng.randrange(4000)}" for _ in range(rng.randint(8, 150))] + passage
        for _ in range(members):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(words)))
    return docs


def test_stage_keeps_one_of_each_group(spark, sf_dir, monkeypatch):
    for docs, block in ((copies(1, 25, 6), 1 << 20), (copies(2, 2, 60), 500)):
        monkeypatch.setattr(jaccard, "BLOCK", block)
        frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
        kept = {r["doc_id"] for r in corpus_pipeline._near_duplicates(spark, frame, sf_dir).collect()}
        assert kept == plain_kept(docs)
        assert len(kept) < simhash.keep_representatives(frame).count()  # two bits leave near copies


def test_given_documents(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = sorted((r["doc_id"], r["text"]) for r in frame.collect() if r["text"] is not None)
    kept = {r["doc_id"] for r in corpus_pipeline._near_duplicates(spark, frame.where("text is not null"), sf_dir).collect()}
    assert kept == plain_kept(docs)


def test_odd_rows(spark, sf_dir):
    for docs in (odd.frame(spark), odd.clashing(spark)):
        kept = corpus_pipeline._near_duplicates(spark, docs, sf_dir)
        assert kept.columns == docs.columns
        # the fox text with its copies; null and empty texts; five others
        assert kept.count() == 7
    assert corpus_pipeline._near_duplicates(spark, odd.empty(spark), sf_dir).count() == 0


def test_sketches_never_rule_out_a_similar_pair():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = []
    for n in (1, 2, 10, 300, 90_000):
        for share in (1.0, 0.9, 0.8, 0.5, 0.0):
            a = rng.choice(1 << 40, n, replace=False).astype(np.uint64)
            b = np.concatenate((a[: int(n * share)], rng.integers(1 << 41, 1 << 42, n - int(n * share)).astype(np.uint64)))
            both, j = len(np.intersect1d(a, b)), None
            j = both / (len(a) + len(b) - both)
            rows.append((len(rows), 0, len(a), len(b), jaccard.sketch(a), jaccard.sketch(b), j))
    cols = [pa.array(c, t) for c, t in zip(list(zip(*rows))[:6], (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))]
    kept = {u for b in jaccard._possible(0.8)([pa.RecordBatch.from_arrays(cols, names=["u", "v", "an", "bn", "a", "b"])]) for u in b.column("u").to_pylist()}
    assert {r[0] for r in rows if r[6] >= 0.8} <= kept and not {r[0] for r in rows if r[6] == 0 and r[2] == 300} & kept


def test_listed_pairs_are_few_and_hold_every_similar_one(spark):
    """Sets that share common shingles at the end of their order, and hardly any is similar to another."""
    import numpy as np

    rng = np.random.default_rng(5)
    common = np.sort(rng.integers(1 << 40, 1 << 41, 60)).astype(np.uint64)
    own = [rng.integers(0, 1 << 40, int(k)).astype(np.uint64) for k in rng.integers(9, 16, 120)]
    own[1] = own[0][: len(own[0]) - 1]  # 0 and 1 are similar
    sets = [np.concatenate((x, common)) for x in own]  # in their order: the rare ones first
    rows = []
    for i, s in enumerate(sets):
        for place, key in enumerate(s[: int(jaccard.prefix_length(np.array([len(s)]), 0.8)[0])]):
            rows.append((int(key), i, len(s), i, len(s) - place, *map(int, jaccard.parities(s))))
    left = spark.createDataFrame(rows, "key long, fp long, size int, label long, rest int, p0 long, p1 long, p2 long, p3 long")
    got = {(r["u"], r["v"]) for r in jaccard.listed(left, 0.8).collect()}
    pairs = [(i, j) for j in range(len(sets)) for i in range(j)]
    both = {(i, j): len(np.intersect1d(sets[i], sets[j])) for i, j in pairs}
    similar = {p for p in pairs if both[p] >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - both[p])}
    by_size = {p for p in pairs if min(len(sets[p[0]]), len(sets[p[1]])) >= 0.8 * max(len(sets[p[0]]), len(sets[p[1]]))}
    assert (0, 1) in similar <= got
    assert len(by_size) > 5000 and len(got) < 100


def test_parities_never_exceed_the_difference():
    import numpy as np

    rng = np.random.default_rng(6)
    for n in (1, 20, 400, 5000):
        a = rng.choice(1 << 20, n, replace=False).astype(np.uint64)
        b = rng.choice(a, max(1, n * 9 // 10), replace=False)
        x = jaccard.parities(a) ^ jaccard.parities(b)
        assert sum(int(v & 0xFFFFFFFFFFFFFFFF).bit_count() for v in x.tolist()) <= len(np.setxor1d(a, b))
