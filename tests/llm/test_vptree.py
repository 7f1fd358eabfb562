"""Nearest neighbours against brute force; recall of relaxed search."""

import numpy as np

from compare import connect, same
from quire.llm import queries, vptree

KIND = "vec_id long, embedding array<float>, label int"


def rows(n=700, width=12, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    x[100:160] = x[7]  # many equal vectors
    x[200:220] = 2 * x[3]
    return [(i, [float(v) for v in x[i]], 0) for i in range(n)]


def plain(table, k, modulus):
    ids = np.array([r[0] for r in table])
    v = np.array([r[1] for r in table], np.float64)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % modulus == 0}):
        a = v[ids == q][0]
        s = vptree.cosine(np.broadcast_to(a, v.shape), v)
        out[q] = sorted((-x, i) for x, i in zip(s.tolist(), ids.tolist()) if i != q)[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    return out


def test_exact(spark):
    table = rows()
    for shard_rows in (100_000, 90):
        assert result(vptree.nearest(spark.createDataFrame(table, KIND).repartition(5), 5, 50, 1.0, shard_rows)) == plain(table, 5, 50)


def test_relaxed_recall(spark):
    want = plain(rows(3000, 16, 4), 5, 50)
    got = result(vptree.nearest(spark.createDataFrame(rows(3000, 16, 4), KIND), 5, 50, 1.3, 100_000))
    assert np.mean([len(set(got[q]) & set(want[q])) / 5 for q in want]) >= 0.9


def test_tree_prunes():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 8)) * 6
    x = centres[rng.integers(0, 40, 20_000)] + rng.normal(size=(20_000, 8)) * 0.05
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    tree = vptree.Tree(unit)
    seen = []
    visit = tree._visit
    tree._visit = lambda node, q, active, k, relax: (seen.append(len(node) * len(active)) if isinstance(node, np.ndarray) else None, visit(node, q, active, k, relax))[1]
    found = tree.search(unit[:20], 5)
    assert sum(seen) < 0.3 * 20 * len(unit)
    for i in range(20):
        assert set(np.argsort(-(unit @ unit[i]), kind="stable")[:3]) <= set(np.asarray(found[i]).tolist())


def test_odd_rows(spark):
    table = [(0, [1.0, 0.0], 0), (50, [0.0, 2.0], 0), (1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [3.0, 0.0], 0), (None, [1.0, 1.0], 0), (3, None, 0), (4, [], 0), (5, [0.0, 0.0], 0), (100, [0.0, 0.0], 0)]
    table += [(6, [float("nan"), 1.0], 0), (7, [None, 1.0], 0), (8, [float("inf"), 1.0], 0), (9, [1.0, 2.0, 3.0], 0), (150, [1.0, 1.0, 1.0], 0)]
    df = spark.createDataFrame(table, KIND)
    assert result(vptree.nearest(df)) == {0: [(-1.0, 1), (-1.0, 2), (0.0, 50)], 50: [(0.0, 0), (0.0, 1), (0.0, 2)], 150: [(-6 / (np.sqrt(3.0) * np.sqrt(14.0)), 9)]}
    assert vptree.nearest(df.where("false")).count() == 0
    from pyspark.sql import functions as F

    more = df.withColumns({n: F.lit(1) for n in ("v", "shard", "block", "score", "rank")})
    assert result(vptree.nearest(more)) == result(vptree.nearest(df))


def test_sql(spark, sf_dir):
    got, want = queries.op6_vantage_point(spark, sf_dir).toPandas(), connect(sf_dir).sql(queries.oracle_sql()["op6_vantage_point"]).df()
    same(got, want)


def test_cells_are_pruned(spark, monkeypatch):
    """Clustered vectors: the second round reaches few of the other cells, and misses nothing."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(30, 8)) * 6
    x = centres[rng.integers(0, 30, 6000)] + rng.normal(size=(6000, 8)) * 0.05
    table = [(i, [float(np.float32(v)) for v in x[i]], 0) for i in range(6000)]
    asked, search = [], vptree._search
    monkeypatch.setattr(vptree, "_search", lambda points, a, k, relax: (asked.append((a.count(), points.select("shard").distinct().count())), search(points, a, k, relax))[1])
    got = result(vptree.nearest(spark.createDataFrame(table, KIND), 5, 50, 1.0, 100))
    assert got == plain(table, 5, 50)
    shards = asked[0][1]
    assert shards > 60 and sum(n for n, _ in asked) < 0.35 * 120 * shards
