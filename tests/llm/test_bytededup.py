"""Byte dedup against brute force; suffix arrays against sorting."""

import hashlib
import random

import numpy as np

import odd
from quire.llm import bytededup, queries
from quire.llm.suffixarray import common_prefixes, suffix_array


def plain(docs, length):
    """{doc_id: (bytes, removed, spans, digest of the rest)} window by window."""
    seen, out = set(), {}
    for doc_id, data in sorted(docs):
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[i : i + length] = b"\x01" * length
            seen.add(w)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out[doc_id] = (len(data), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(data, gone) if not g)).hexdigest())
    return out


def result(rows):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows}


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(300):
        n, size = rng.randint(0, 120), rng.choice((1, 2, 3, 26))
        s = np.array([rng.randint(1, size) for _ in range(n)] + [0])
        for walked in (1024, 6, 2):  # names in one digit, and in two at every level
            assert suffix_array(s, size + 1, walked).tolist() == sorted(range(n + 1), key=lambda i: s[i:].tolist())


def test_suffix_array_of_a_long_text():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(9000)]
    text = " ".join(rng.choice(words) for _ in range(20_000)).encode()
    text = text + text[5000:30_000] + b"ab" * 3000 + text[:9000]
    sa = suffix_array(np.concatenate((np.frombuffer(text, np.uint8).astype(np.int64) + 1, [0])), 257)
    assert sorted(sa.tolist()) == list(range(len(text) + 1))
    order = sa[1:].tolist()
    assert all(text[i : i + 40_000] < text[j : j + 40_000] for i, j in zip(order, order[1:]))
    data = np.frombuffer(text, np.uint8)
    starts = np.array(sorted(rng.sample(range(len(text)), 3000)))
    got = common_prefixes(data, sa[1:], starts, 100)
    before = dict(zip(order[1:], order))
    for i, n in zip(starts.tolist(), got.tolist()):
        j = before.get(i)
        want = 0 if j is None else next((k for k in range(100) if text[i + k : i + k + 1] != text[j + k : j + k + 1] or i + k >= len(text)), 100)
        assert n == want


def test_against_brute_force(spark):
    rng = random.Random(2)
    common = [bytes(rng.choice(b"abcdef \n") for _ in range(rng.randint(15, 80))).decode() for _ in range(12)]
    docs = []
    for i in range(80):
        parts = [rng.choice(common)[rng.randint(0, 6) :] if rng.random() < 0.6 else "".join(rng.choice("xyzé🙂 ") for _ in range(rng.randint(1, 30))) for _ in range(rng.randint(0, 8))]
        docs.append((i, "".join(parts)))
    docs += [(80, "ab" * 200), (81, "a" * 300), (82, common[0] * 5)]
    want = plain([(i, t.encode()) for i, t in docs], 20)
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    for hot in (16_384, 1):  # all anchors by suffix arrays; then anchors with two segments spread by windows
        assert result(bytededup.dedup_bytes(frame, 20, 8, hot).collect()) == want


def test_one_passage_with_many_continuations(spark):
    """A passage in 20,000 documents that all go on differently: no task gets over its share."""
    n, passage = 20_000, "A passage that a great many documents share word for word, and after which each of them goes on in its own way: "
    docs = spark.range(0, n, 1, 40).selectExpr("id as doc_id", f"concat('{passage}', sha2(cast(id as string), 256), ' and ', sha2(cast(-id - 1 as string), 256)) as text")
    want = plain([(r["doc_id"], r["text"].encode()) for r in docs.collect()], 100)
    assert result(bytededup.dedup_bytes(docs, hot=1000).collect()) == want and want[n - 1][1] >= len(passage)
    # Windows that every document has leave a task once.
    need = [(d, 0, passage + "x" * 40, [{"start": 0, "n": 20, "anchor": 1, "kind": bytededup.SPREAD}]) for d in range(500)]
    import pyarrow as pa

    kind = pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64()), ("anchor", pa.int64()), ("kind", pa.int32())]))
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in need]), pa.array([r[1] for r in need]), pa.array([r[2] for r in need]), pa.array([r[3] for r in need], kind)], names=["_d", "_t", "text", "need"])
    sent = [r for b in bytededup._fetch(100)([batch]) for r in b.to_pylist()]
    assert sum(r["bytes"] is not None for r in sent) == 20 and sum(r["n"] for r in sent if r["bytes"] is None) == 20 * 499


def test_only_what_may_repeat_is_sorted(monkeypatch):
    """Pieces with a gram but no window in common stay out of the suffix array; no repeat does."""
    rng = random.Random(5)
    some = lambda n: bytes(rng.choice(b"abcdefgh") for _ in range(n))
    gram, passage = some(32), some(150)
    pieces = [some(60) + gram + some(60) for _ in range(2000)] + [some(30) + passage + some(40), some(10) + passage, b"a" * 130]
    sorted_sizes = []
    monkeypatch.setattr(bytededup, "suffix_array", lambda s, size: sorted_sizes.append(len(s)) or suffix_array(s, size))
    where = np.arange(len(pieces))
    got = bytededup.repeated_windows(pieces, where, where * 0, where * 0, 100)
    assert list(zip(*(c.tolist() for c in got))) == [(2001, 0, 10, 51), (2002, 0, 1, 30)]
    assert sum(sorted_sizes) < 500 and len(bytededup.repeated_windows(pieces[:2000], where[:2000], where[:2000] * 0, where[:2000] * 0, 100)[0]) == 0


def test_query_against_brute_force(spark, sf_dir):
    docs = [(r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert result(queries.op7_suffix_array(spark, sf_dir).collect()) == plain(docs, 100)


def test_odd_rows(spark):
    for docs in (odd.frame(spark), odd.clashing(spark)):
        got = bytededup.dedup_bytes(docs).collect()
        assert len(got) == len(odd.rows())
        by = {}
        for r in got:
            by.setdefault(r["doc_id"], set()).add((r["n_bytes"], r["n_removed"]))
        n = len(odd.rows()[0][1])
        assert by[1] == {(n, 0)} and by[2] == {(n, n), (21, 0)} and by[4] == by[5] == {(0, 0)}
        assert (n, n) in by[None]
    assert bytededup.dedup_bytes(odd.empty(spark)).count() == 0
