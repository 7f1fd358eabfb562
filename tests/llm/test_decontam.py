"""Decontamination against exact alignment of every item with every text."""

import random

import numpy as np

import odd
from quire.llm import decontam, queries


def plain_edits(item, text):
    """Least word edits of ``item`` against any part of ``text``, by the textbook recursion."""
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, v in enumerate(text, 1):
            new.append(min(row[j - 1] + (v != w), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def plain(docs, items):
    out = {}
    for d, t in docs:
        w = decontam.words(t)
        for i, x in items:
            v = decontam.words(x)
            if v and w and (e := plain_edits(v, w)) <= decontam.edits(len(v)):
                out[d, i] = e
    return out


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        at = rng.randrange(len(words))
        kind = rng.randrange(3)
        if kind == 0:
            words[at] = f"new{rng.randint(0, 99)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"more{rng.randint(0, 99)}")
    return words


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 50)))) for i in range(25)] + [(30, "a b"), (31, None), (None, "x y"), (32, "")]
    docs = []
    for d in range(150):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(0, 120))]
        if rng.random() < 0.7:
            x = items[rng.randrange(25)][1].split()
            at = rng.randint(0, len(w))
            w[at:at] = edited(rng, x, rng.randint(0, int(0.25 * len(x))))
        docs.append((d, " ".join(w).replace("w1 ", "W1, ")))
    want = plain(docs, [x for x in items if x[0] is not None])
    got = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]): r["edits"] for r in got}
    assert set(found) <= set(want) and len(want) > 60
    assert len(found) >= 0.99 * len(want)
    assert np.mean([found[k] == want[k] for k in found]) >= 0.99
    kept = decontam.drop_contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"] for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in found}


def test_alignment():
    rng = random.Random(5)
    for _ in range(200):
        a, b = ([rng.randint(1, 4) for _ in range(rng.randint(1, 9))] for _ in range(2))
        d, start, end = decontam.align(np.array(a), np.array(b))
        assert d == plain_edits(a, b)
        part, row = b[start:end], None
        row = list(range(len(part) + 1))
        for i, w in enumerate(a, 1):
            new = [i]
            for j, v in enumerate(part, 1):
                new.append(min(row[j - 1] + (v != w), row[j] + 1, new[j - 1] + 1))
            row = new
        assert row[-1] == d


def test_embedding_keeps_near_windows_near():
    rng = np.random.default_rng(6)
    a = rng.integers(1, 490, (60, 40)).astype(np.uint64)
    b = a.copy()
    b[:, 20] = 495  # one edit
    far = rng.integers(1, 490, (60, 40)).astype(np.uint64)
    x, y, z = map(decontam.cgk, (a, b, far))
    assert (x != y).mean() < 0.3 < 0.8 < (x != z).mean()


def test_recall_of_the_hashing_alone():
    """Windows at the full distance, edits of any kind: some key meets the item's."""
    rng, met, total = random.Random(9), 0, 0
    for n in (10, 15, 25, 40, 60):
        for _ in range(60):
            item = [f"w{rng.randint(0, 3000)}" for _ in range(n)]
            near = (edited(rng, item, decontam.edits(n)) + [f"z{rng.randint(0, 3000)}" for _ in range(n)])[:n]
            k = decontam.keys(np.stack([decontam.symbols([w.encode() for w in x]) for x in (item, near)]))
            met += bool((k[0] == k[1]).any())
            total += 1
    assert met >= 0.97 * total


def test_window_test_loses_nothing(monkeypatch):
    """Every stretch within the edits of an item begins a window that is looked at."""
    rng = random.Random(10)
    items = [[f"w{rng.randint(0, 40)}" for _ in range(n)] for n in (1, 2, 5, 9, 9, 30)]
    texts = [[f"w{rng.randint(0, 80)}" for _ in range(n)] for n in (1, 4, 7, 60)] + [edited(rng, x, decontam.edits(len(x))) for x in items for _ in range(4)]
    texts += [texts[3][:20] + edited(rng, x, decontam.edits(len(x))) + texts[3][20:] for x in items for _ in range(4)]
    lengths = sorted({len(x) for x in items})
    texts = [[w.encode() for w in t] for t in texts if t]
    monkeypatch.setattr(decontam, "keys", lambda windows: np.zeros((len(windows), 1), np.int64))
    for similarity in (0.8, 0.6, 0.3):
        table = np.zeros(1 << decontam.SLOT_BITS, np.uint64)
        for x in items:
            table[decontam.slots(decontam.symbols([w.encode() for w in x]), len(x))] |= np.uint64(1 << lengths.index(len(x)))
        seen, leaks = set(), 0
        for k, n, first, stretch, _ in decontam.Windows(lengths, table, similarity).regions(texts):
            assert texts[k][first : first + len(stretch.split())] == stretch.split()
            seen |= {(k, n, *texts[k][at : at + n]) for at in range(first, first + len(stretch.split()))}
        for k, t in enumerate(texts):
            for x in items:
                n, e = len(x), decontam.edits(len(x), similarity)
                item = [w.encode() for w in x]
                for at in range(len(t)):
                    # Least edits of the item against stretches that begin here.
                    row = list(range(len(t[at : at + n + e]) + 1))
                    for i, w in enumerate(item, 1):
                        new = [i]
                        for j, v in enumerate(t[at : at + n + e], 1):
                            new.append(min(row[j - 1] + (v != w), row[j] + 1, new[j - 1] + 1))
                        row = new
                    if min(row) <= e:
                        leaks += 1
                        assert (k, n, *t[at : at + n]) in seen  # equal windows of a text stand for each other
        assert leaks > 30


def test_beyond_the_broadcast_bounds(spark, sf_dir, monkeypatch):
    want = sorted(map(tuple, queries.op4_decontamination(spark, sf_dir).collect()))
    for name in ("KEY_ROWS", "WORD_BYTES", "DOCUMENT_ROWS"):
        monkeypatch.setattr(decontam, name, -1)
    assert sorted(map(tuple, queries.op4_decontamination(spark, sf_dir).collect())) == want and want


def test_query(spark, sf_dir):
    docs, items = ([(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").select(i, "text").collect()] for t, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    # Exact alignment only where four words in a row agree: fewer leave no room for a leak of these items.
    runs = {}
    for i, x in items:
        w = decontam.words(x)
        for j in range(max(1, len(w) - 3)):
            runs.setdefault(tuple(w[j : j + 4]), set()).add(i)
    by, want = dict(items), {}
    for d, t in docs:
        w = decontam.words(t)
        for i in {i for j in range(len(w)) for i in runs.get(tuple(w[j : j + 4]), ())}:
            v = decontam.words(by[i])
            if (e := plain_edits(v, w)) <= decontam.edits(len(v)):
                want[d, i] = e
    assert {(r["doc_id"], r["item_id"]): r["edits"] for r in queries.op4_decontamination(spark, sf_dir).collect()} == want


def test_odd_rows(spark):
    items = spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog and runs far away")], "item_id long, text string")
    for docs in (odd.frame(spark), odd.clashing(spark)):
        got = decontam.contaminated(docs, items).collect()
        assert sorted(str(r["doc_id"]) for r in got) == ["1", "10", "2", "2", "3", "None"]
        kept = decontam.drop_contaminated(docs, items)
        assert kept.columns == docs.columns and kept.count() == len(odd.rows()) - 6
    assert decontam.contaminated(odd.empty(spark), items).count() == 0
    assert decontam.contaminated(odd.frame(spark), items.where("false")).count() == 0
    assert decontam.drop_contaminated(odd.frame(spark), items.where("false")).count() == len(odd.rows())
