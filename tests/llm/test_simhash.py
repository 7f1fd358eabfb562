"""Fingerprints and links against brute force; Golay codes; odd rows."""

import random
import re

import numpy as np
import xxhash

import odd
from quire.llm import common, queries, simhash


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """{place in rows: least doc_id reachable} over all pairs."""
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j in range(i):
            if bin(a ^ rows[j][1]).count("1") <= 2:
                label[root(i)] = root(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[root(i)] = min(best.get(root(i), d), d)
    return [best.get(root(i)) for i in range(len(rows))]


def test_fingerprints():
    rng = random.Random(1)
    texts = [None, "", " \n", "one", "one two", "One  TWO three", "É a b c", "a b c a b c a b c", odd.LONG[:5000]]
    texts += [" ".join(rng.choice("ab cd ef gh".split()) + str(rng.randint(0, 9)) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert simhash.fingerprint(None) == 0


def test_golay_codes():
    tables = simhash.golay_tables()
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000).astype(np.int32)
    near = simhash.golay_index(words[:, None] ^ simhash._FLIPS, tables)
    assert {len(set(r)) for r in near.tolist()} <= {1, 6}
    other = words ^ (1 << rng.integers(0, 23, 3000)).astype(np.int32)
    beside = simhash.golay_index(other[:, None] ^ simhash._FLIPS, tables)
    assert all(set(a) & set(b) for a, b in zip(near.tolist(), beside.tolist()))


def test_no_link_is_missed():
    """Any two fingerprints at distance two or less have a key in common."""
    rng = random.Random(2)
    tables = simhash.golay_tables()
    for _ in range(400):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 2)):
            b ^= 1 << bit
        rows, keys = simhash.bucket_keys(np.array([a, b], np.uint64), tables)
        assert set(keys[rows == 0]) & set(keys[rows == 1])


def test_components(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(40)]
    for _ in range(260):  # chains and stars of near fingerprints
        f = rng.choice(fps)
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            f ^= 1 << bit
        fps.append(f)
    rows = [(i * 7 % 1000, f) for i, f in enumerate(fps)]
    want = {d: c for (d, _), c in zip(rows, plain_components(rows))}
    signed = [(d, f - (1 << 64) if f >> 63 else f) for d, f in rows]
    for bucket in (1, 3, 1000):
        classes = spark.createDataFrame(signed, "rep long, fp long").groupBy("fp").agg({"rep": "min"}).toDF("fp", "rep")
        by_fp = {r["fp"]: r["component_id"] for r in simhash._components(classes, bucket).collect()}
        assert {d: by_fp[f] for d, f in signed} == want


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], plain_fingerprint(r["text"])) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op5_simhash(spark, sf_dir).collect()}
    assert got == {d: (f"{f:016x}", c) for (d, f), c in zip(docs, plain_components(docs))}


def test_odd_rows(spark):
    rows = [(d, plain_fingerprint(t)) for d, t, *_ in odd.rows()]
    want = sorted(((d, f"{f:016x}", c) for (d, f), c in zip(rows, plain_components(rows))), key=str)
    for docs in (odd.frame(spark), odd.clashing(spark)):
        got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect()), key=str)
        assert got == want
        kept = simhash.keep_representatives(docs)
        assert kept.columns == docs.columns
        groups = {f for _, f in rows}
        assert kept.count() == len(groups) == len({simhash.fingerprint(r["text"]) for r in kept.collect()})
    assert simhash.near_duplicates(odd.empty(spark)).count() == 0
    assert simhash.keep_representatives(odd.empty(spark)).count() == 0


def test_no_side_is_gathered_on_the_driver(spark):
    """Whatever the threshold, neither the links nor the rounds of components broadcast a table."""
    rng = random.Random(9)
    fps = [rng.getrandbits(63) for _ in range(30)]
    fps += [f ^ 1 << rng.randrange(63) for f in fps]
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp long, rep long")
    docs = spark.createDataFrame([(i, f"some words {i % 5} and more") for i in range(40)], "doc_id long, text string")
    met = []
    seen = simhash.cut

    def plan(df):
        df.collect()  # adaptive execution settles the plan
        met.append(df._jdf.queryExecution().executedPlan().toString())
        return seen(df)

    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100m")
    try:
        with_plans = {m: m.cut for m in (simhash, common)}
        for m in with_plans:
            m.cut = plan
        simhash._components(classes, 3).collect()
        plan(simhash.near_duplicates(docs))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        for m, f in with_plans.items():
            m.cut = f
    assert any("SortMergeJoin" in x for x in met) and not any("Broadcast" in x for x in met)
