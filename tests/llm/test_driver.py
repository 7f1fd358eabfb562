"""What the near-duplicate and the toxicity stage of the pipeline ask of the driver."""

import random

import numpy as np
import pyarrow as pa

from quire.llm import common, toxicity

TRAINED = "/root/testdata/sf0.01"


def plain_labels(edges):
    least = {x: x for e in edges if e[0] != e[1] for x in e}
    while any(least[u] != least[v] for u, v in edges if u != v):
        for u, v in edges:
            if u != v:
                least[u] = least[v] = min(least[u], least[v])
    return least


def graphs():
    rng = random.Random(5)
    path = list(range(120))
    rng.shuffle(path)
    yield list(zip(path, path[1:]))
    yield [(10**18, -i) for i in range(1, 60)] + [(3, 3)]
    yield [(rng.randrange(-400, 400), rng.randrange(-400, 400)) for _ in range(300)]
    yield [(7, 7)]


def test_components_take_few_jobs(spark):
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    for edges in graphs():
        frame = spark.createDataFrame(edges, "u long, v long").repartition(3)
        before = scheduler.numTotalJobs()
        got = {r["node"]: r["label"] for r in common.connected_components(frame).collect()}
        assert scheduler.numTotalJobs() - before <= 8
        assert got == plain_labels(edges)


def test_components_beyond_what_a_task_gathers(spark):
    for edges in graphs():
        frame = spark.createDataFrame(edges, "u long, v long").repartition(3)
        for gathered in (0, 100):
            got = [tuple(r) for r in common.connected_components(frame, gathered=gathered).collect()]
            assert sorted(got) == sorted(plain_labels(edges).items())


def test_blocks_of_edges_keep_what_is_connected(monkeypatch):
    monkeypatch.setattr(common, "FOREST_EDGES", 16)
    for edges in graphs():
        edges = [e for e in edges if e[0] != e[1]]
        batches = [pa.RecordBatch.from_arrays([pa.array([u for u, _ in part], pa.int64()), pa.array([v for _, v in part], pa.int64())], names=["u", "v"]) for part in (edges[i : i + 5] for i in range(0, len(edges), 5))]
        stars = [(u, v) for b in common._forest(batches) for u, v in zip(*(c.to_pylist() for c in b.columns))]
        assert len(stars) <= len(edges)
        assert plain_labels(stars) == plain_labels(edges)


def test_training_state_stays_on_the_executor(spark, monkeypatch):
    docs, labels = (spark.read.parquet(f"{TRAINED}/{t}.parquet") for t in ("documents", "labels"))
    came, kept = [], []
    kind = type(docs)
    seen, cut = kind.toArrow, toxicity.cut
    monkeypatch.setattr(kind, "toArrow", lambda self: came.append(seen(self)) or came[-1])
    monkeypatch.setattr(toxicity, "cut", lambda df: kept.append(cut(df)) or kept[-1])
    index, weight, intercept = toxicity.train(docs, labels)
    rows = kept[-1].collect()
    want = toxicity.fit_ftrl([np.array(r["x"], np.int32) for r in rows], [r["label"] for r in rows])
    assert len(rows) > 100 and len(index)
    assert (index == want[0]).all() and (weight == want[1]).all() and intercept == want[2]
    assert sum(t.nbytes for t in came) <= 16 * (len(index) + 1)
