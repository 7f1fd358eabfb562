"""Language and toxicity: held-out accuracy, odd rows, what is never learned from."""

import zlib

import numpy as np
from pyspark.sql import functions as F

import odd
from quire.llm import langid, toxicity
from quire.llm.training import least_by_hash

TRAINED = "/root/testdata/sf0.01"


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{TRAINED}/documents.parquet")
    rows = langid.identify(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) for r in rows)
    held = [r for r in rows if r["held_out"] and r["lang"] and r["text"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) >= 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_ignores_the_held_out_fold(spark):
    docs = spark.read.parquet(f"{TRAINED}/documents.parquet")
    spoilt = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, "xx").otherwise(F.col("lang")))
    a = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs).collect()}
    assert a == {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(spoilt).collect()}


def test_language_odd_rows(spark):
    got = langid.identify(odd.frame(spark)).collect()
    assert len(got) == len(odd.rows())
    by = {r["doc_id"]: r for r in got}
    assert all(by[i]["lang_pred"] == "und" and by[i]["score"] == 0 for i in (4, 5, 6, 7))
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 1}) == 1
    assert all(not r["held_out"] for r in got if r["doc_id"] is None)
    assert langid.identify(odd.empty(spark)).count() == 0
    assert langid.identify(odd.clashing(spark)).count() == len(odd.rows())
    unknown = langid.identify(odd.frame(spark).withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}
    strict = langid.identify(odd.frame(spark), min_cosine=1.1).collect()
    assert {r["lang_pred"] for r in strict} == {"und"}


def test_sample_is_bounded_and_repeatable(spark):
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("label"))
    got = least_by_hash(rows, 10).collect()
    assert len(got) == 20 and sorted(r["label"] for r in got) == [0] * 10 + [1] * 10
    uneven = rows.where("label = 0 or doc_id < 8")
    assert sorted(r["label"] for r in least_by_hash(uneven, {0: 25, 1: 10}).collect()) == [0] * 25 + [1] * 4
    assert least_by_hash(rows, 10_000).count() == 3000 and least_by_hash(rows.where("false"), 5).count() == 0
    assert {r["label"] for r in least_by_hash(uneven, 5, labels=1).collect()} == {0}
    # What is taken are the rows of least hash.
    order = [r["doc_id"] for r in rows.where("label = 1").orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 40)).collect()]
    assert {r["doc_id"] for r in got if r["label"] == 1} == set(order[:10])
    assert {r["doc_id"] for r in got} == {r["doc_id"] for r in least_by_hash(rows.repartition(7), 10).collect()}


def auc(y, x):
    order = np.argsort(np.argsort(x, kind="stable"), kind="stable") + 1
    return (order[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (len(y) - y.sum()))


def test_toxicity_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels)
    rows = got.join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").toPandas()
    held = rows[rows.held_out]
    y = held.toxic.to_numpy()
    assert auc(y, held.score.to_numpy()) >= 0.95
    assert ((held.predicted == 1) & (y == 0)).sum() <= 0.01 * (y == 0).sum()
    assert ((held.predicted == 1) & (y == 1)).sum() >= 0.6 * y.sum()
    assert (rows.predicted == (rows.score >= toxicity.THRESHOLD)).all()
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == got.where("predicted = 0").count()


def test_toxicity_learns_and_stays_sparse():
    rng = np.random.default_rng(1)
    rows, y = [], []
    for i in range(600):
        x = rng.choice(5000, 60, replace=False) + 10
        y.append(int(rng.random() < 0.3))
        rows.append(np.append(x, 3) if y[-1] else x)
    index, weight, _ = toxicity.fit_ftrl(rows, y)
    assert 3 in index and weight[list(index).index(3)] == weight.max() > 1
    assert len(index) < 500


def test_toxicity_against_a_scalar_version():
    """The published update, one coordinate at a time."""
    import math

    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 40, 12)) for _ in range(80)]
    y = [int(3 in x) for x in rows]
    z, n, size = {}, {}, 1 << 6

    def weight(i):
        if abs(z.get(i, 0.0)) <= toxicity.L1:
            return 0.0
        return -(z[i] - math.copysign(toxicity.L1, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(3):
        for x, label in zip(rows, y):
            on = [*x.tolist(), size]
            w = {i: weight(i) for i in on}
            g = 1 / (1 + math.exp(-sum(w.values()))) - label
            for i in on:
                sigma = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - sigma * w[i]
                n[i] = n.get(i, 0.0) + g * g
    index, found, intercept = toxicity.fit_ftrl(rows, y, 6, 3)
    assert set(index.tolist()) == {i for i in range(size) if weight(i)} and len(index)
    assert np.allclose(found, [weight(i) for i in index.tolist()])
    assert abs(intercept - weight(size)) < 1e-9


def test_language_against_a_plain_nearest_centroid(spark):
    """Every prediction against cosines worked out one by one, from counted n-grams."""
    docs = spark.read.parquet(f"{TRAINED}/documents.parquet").limit(120)
    idf, centres, names = langid.train(docs)
    letters = langid.letter_table()
    got = {r["doc_id"]: r for r in langid.predict(docs, (idf, centres, names)).collect()}
    for r in docs.collect():
        counts = langid.ngram_counts(r["text"], letters)
        if counts is None:
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        v = [float(np.log1p(c) * i) for c, i in zip(counts, idf)]
        norm = sum(x * x for x in v) ** 0.5
        cosines = [sum(a * b for a, b in zip(v, c.tolist()) if a) / norm for c in centres]
        best = max(cosines)
        assert abs(got[r["doc_id"]]["score"] - min(1, max(0, best))) < 1e-9
        assert got[r["doc_id"]]["lang_pred"] in {n for n, c in zip(names, cosines) if c > best - 1e-12}


def test_language_rejects_the_distant(spark):
    """A script never learned is farther from all centroids than any held-out text."""
    docs = spark.read.parquet(f"{TRAINED}/documents.parquet")
    model = langid.train(docs)
    far = spark.createDataFrame([(i, t) for i, t in enumerate(("Съешь же ещё этих мягких французских булок", "いろはにほへとちりぬるを", "zzqx qxzz xqzq zqqx"))], "doc_id long, text string")
    near = [r["score"] for r in langid.predict(docs.where("length(text) > 200"), model).collect()]
    distant = [r["score"] for r in langid.predict(far, model).collect()]
    cut = (max(distant) + np.quantile(near, 0.02)) / 2
    assert max(distant) < cut
    assert {r["lang_pred"] for r in langid.predict(far, model, cut).collect()} == {"und"}
    assert np.mean([r["lang_pred"] != "und" for r in langid.predict(docs.where("length(text) > 200"), model, cut).collect()]) > 0.97


def test_toxicity_features():
    f = toxicity.features
    assert len(f(None)) == len(f("")) == len(f("12 ..")) == 0
    assert len(f("a b c")) == 3 + 2 + 1
    assert set(f("Ab, CD")) == set(f("ab cd"))
    assert set(f("a b")) & set(f("a x b")) == set(f("a")) | set(f("b"))


def test_toxicity_odd_rows(spark):
    for docs in (odd.frame(spark), odd.clashing(spark)):
        got = toxicity.score(docs, odd.labels(spark)).collect()
        assert len(got) == len(odd.rows()) and all(0 <= r["score"] <= 1 for r in got)
    none = odd.labels(spark).where("false")
    assert {r["score"] for r in toxicity.score(odd.frame(spark), none).collect()} == {0.5}
    assert toxicity.score(odd.empty(spark), odd.labels(spark)).count() == 0
    docs = odd.clashing(spark)
    assert toxicity.drop_toxic(docs, odd.labels(spark)).columns == docs.columns
