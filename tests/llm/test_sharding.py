"""Shards against a plain running sum."""

import zlib

import odd
from quire.llm import queries, sharding


def plain(docs, shards):
    rows = sorted(((d is None, d or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in docs))
    total, at, slots, out = sum(r[2] for r in rows), 0, {}, []
    for null, d, size, crc in rows:
        k = min(shards - 1, (2 * at + size) * shards // (2 * total))
        at += size
        out.append((None if null else d, size, crc, k, slots.setdefault(k, 0)))
        slots[k] += 1
    return out


def result(df):
    rows = df.collect()
    assert {r["law"] for r in rows} <= {"bytes"} and all(r["grown_shard"] is None for r in rows)
    return [(r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]


def test_query_against_plain_version(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = result(queries.op8_sharding(spark, sf_dir))
    assert got == plain(docs, 8)
    sizes = [sum(r[1] for r in got if r[3] == k) for k in range(8)]
    assert max(sizes) - min(sizes) <= 2 * max(r[1] for r in got)


def test_odd_rows(spark):
    want = plain([(r[0], r[1]) for r in odd.rows()], 8)
    assert result(sharding.shard_by_bytes(odd.frame(spark))) == want == result(sharding.shard_by_bytes(odd.clashing(spark)))
    assert sharding.shard_by_bytes(odd.empty(spark)).count() == 0
    assert result(sharding.shard_by_bytes(odd.frame(spark), 1)) == plain([(r[0], r[1]) for r in odd.rows()], 1)
