"""SimHash fingerprints and exact Hamming-2 linking through Golay fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each padded
to a 23-bit word of the perfect binary Golay code.  Decoding a word and its 23
one-bit neighbours gives one or six codeword indices; words at distance one
have an index in common, since the plain decoding of either is among the
neighbour decodings of the other.  Two fingerprints at distance two or less
differ over the three segments as (0,0,<=2), which two equal segments catch,
or as (0,1,1), which an equal segment and the Golay indices of the other two
catch.  These compound keys have 42 bits or more, so buckets stay small as
the corpus grows, and no link can be missed.

Buckets of up to ``bucket`` fingerprints are joined and every pair verified.
In larger ones (groups of near copies) pairs are never listed: two
fingerprints link exactly if some word lies within one bit of both, so each
member is sent to its 65 nearest words and tied to the least member that meets
it there.  That is exact, and linear in the members.

Null and empty texts have no shingle: fingerprint zero, linked like any other.
Rows with a null doc_id take part; a component's id is its least non-null
doc_id, or null if it has none.  Repeated rows share a component.  An empty
table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, document_key, packed, shuffled, small

SHINGLE, SEED, DISTANCE, BUCKET = 3, 42, 2, 32
WIDTHS = (22, 21, 21)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_GENERATOR = 0xC75  # x^11+x^10+x^6+x^5+x^4+x^2+1


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> list[int]:
    """Hashes of a text's runs of ``shingle`` words, of the whole text if it has fewer."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().split()  # both act on ASCII only
    n = len(data)
    if not n:
        return []
    joined = b" ".join(data)
    digest = xxhash.xxh64_intdigest
    if n <= shingle:
        return [digest(joined, SEED)]
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, n) + 1) - 1
    starts = np.concatenate(([0], ends[: n - shingle] + 1)).tolist()
    return [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist())]


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of one text as an unsigned integer."""
    hashes = shingle_hashes(text, shingle)
    m = len(hashes)
    if not m:
        return 0
    raw = np.array(hashes, dtype="<u8")
    counts = np.zeros(64, np.int64)
    for i in range(0, m, 1 << 16):
        block = raw[i : i + (1 << 16)]
        counts += np.unpackbits(block.view(np.uint8).reshape(len(block), 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > m, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for b in small(batches):
        values = np.fromiter((fingerprint(t) for t in b.column("text").to_pylist()), np.uint64, b.num_rows)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])


def _keyed(identify):
    def rows(batches):
        for b in small(batches):
            values = pa.array([identify(t) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("_d"), b.column("_t"), values], names=["_d", "_t", "fp"])

    return rows


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the fingerprint's bits as a signed long) of every row."""
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints, "doc_id long, fp long")


def _remainders() -> np.ndarray:
    """Remainder of every 23-bit word modulo the generator, over two half tables."""
    unit = []
    for i in range(23):
        r = 1 << i
        for j in range(22, 10, -1):
            if r >> j & 1:
                r ^= _GENERATOR << (j - 11)
        unit.append(r)
    low, high = np.zeros(1 << 12, np.int32), np.zeros(1 << 11, np.int32)
    for i, r in enumerate(unit):
        table, at = (low, i) if i < 12 else (high, i - 12)
        table[(np.arange(len(table)) >> at & 1) == 1] ^= r
    return low, high


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(remainders of low 12 bits, of high 11 bits, error pattern by remainder)."""
    low, high = _remainders()
    errors = np.zeros(1 << 11, np.int32)
    bits = [1 << i for i in range(23)]
    patterns = bits + [bits[i] | bits[j] for i in range(23) for j in range(i)]
    patterns += [bits[i] | bits[j] | bits[k] for i in range(23) for j in range(i) for k in range(j)]
    p = np.array(patterns, np.int32)
    errors[low[p & 0xFFF] ^ high[p >> 12]] = p
    return low, high, errors


def golay_index(words: np.ndarray, tables) -> np.ndarray:
    """12-bit index of the codeword nearest to each 23-bit word."""
    low, high, errors = tables
    return (words ^ errors[low[words & 0xFFF] ^ high[words >> 12]]) >> 11


_FLIPS = np.array([0] + [1 << i for i in range(23)], np.int32)


def bucket_keys(fps: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, keys): all compound keys of unsigned fingerprints."""
    n = len(fps)
    segments, at = [], 0
    for w in WIDTHS:
        segments.append((fps >> np.uint64(at) & np.uint64((1 << w) - 1)).astype(np.int64))
        at += w
    rows, keys = [], []
    for odd in range(3):  # two equal segments
        i, j = (k for k in range(3) if k != odd)
        rows.append(np.arange(n))
        keys.append(np.int64(odd) << 58 | segments[i] << 22 | segments[j])
    near = [golay_index(s.astype(np.int32)[:, None] ^ _FLIPS, tables).astype(np.int64) for s in segments]
    for same in range(3):  # one equal segment, one bit in each of the others
        j, k = (x for x in range(3) if x != same)
        both = np.concatenate([near[j][:, :1] << 12 | near[k], near[j] << 12 | near[k][:, :1]], axis=1)
        both.sort(axis=1)
        fresh = np.ones(both.shape, bool)
        fresh[:, 1:] = both[:, 1:] != both[:, :-1]
        r, c = np.nonzero(fresh)
        rows.append(r)
        keys.append(np.int64(3 + same) << 58 | segments[same][r] << 24 | both[r, c])
    return np.concatenate(rows), np.concatenate(keys)


def _keys(batches):
    tables = golay_tables()
    for b in batches:
        fps = b.column("fp").to_numpy()
        for i in range(0, len(fps), 20_000):
            part = fps[i : i + 20_000]
            rows, keys = bucket_keys(part.view(np.uint64), tables)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(part[rows])], names=["key", "fp"])


def _nearest_words(fp):
    """The fingerprint and its 64 one-bit neighbours."""
    masks = [0] + [1 << i for i in range(63)] + [-(1 << 63)]
    return F.array(*[fp.bitwiseXOR(F.lit(m).cast("long")) for m in masks])


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Edges ``u, v`` that connect distinct fingerprints ``fp`` exactly as all
    pairs at distance two or less would."""
    keyed = fps.select("fp").distinct().mapInArrow(_keys, "key long, fp long")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(keyed.join(shuffled(shared), "key"))
    few = met.where(F.col("n") <= bucket).select("key", "fp")
    pairs = (
        few.select("key", F.col("fp").alias("u"))
        .join(shuffled(few.select("key", F.col("fp").alias("v"))), "key")
        .where("u < v and bit_count(u ^ v) <= 2")
        .select("u", "v")
    )
    around = met.where(F.col("n") > bucket).select("fp").distinct().select("fp", F.explode(_nearest_words(F.col("fp"))).alias("word"))
    hub = around.groupBy("word").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("word", "hub")
    stars = around.join(shuffled(hub), "word").where("fp <> hub").select(F.col("hub").alias("u"), F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def _components(classes: DataFrame, bucket: int) -> DataFrame:
    """``fp, component_id`` of ``classes`` (fp, rep)."""
    labels = connected_components(links(classes.select("fp"), bucket))
    return _least(classes, labels.withColumnRenamed("node", "fp"))


def _least(classes: DataFrame, labels: DataFrame) -> DataFrame:
    """``fp, component_id`` of ``classes`` (fp, rep) by ``labels`` (fp, label)."""
    labelled = classes.join(shuffled(labels), "fp", "left").select(
        "fp", "rep", F.coalesce("label", "fp").alias("label")
    )
    least = labelled.groupBy("label").agg(F.min("rep").alias("component_id"))
    return labelled.join(shuffled(least), "label").select("fp", "component_id")


def near_duplicates(docs: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row of ``docs``."""
    rows = cut(fingerprints(docs))
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    return rows.join(shuffled(_components(classes, bucket)), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def keep_representatives(docs: DataFrame, bucket: int = BUCKET, shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """One row of ``docs`` for each group of near duplicates, columns unchanged:
    the row of least (doc_id, text hash), a null doc_id last.  Documents link
    at ``DISTANCE`` bits of their fingerprints or, with ``similarity``, exactly
    where their sets of shingles have that Jaccard similarity or more."""
    from . import jaccard

    def identify(text):
        if similarity is None:
            return int(np.uint64(fingerprint(text, shingle)).view(np.int64))
        return jaccard.set_id(jaccard.shingle_set(text, shingle))

    rows = cut(docs.select(*document_key(), F.col("text")).mapInArrow(_keyed(identify), "_d long, _t long, fp long"))
    # The least row of each fingerprint, and whether it is there more than once.
    classes = cut(
        rows.groupBy("fp", "_d", "_t").agg(F.count("*").alias("n")).groupBy("fp").agg(F.min(F.struct("_d", "_t", "n")).alias("least"))
    )
    named = classes.select("fp", F.col("least._d").alias("rep"))
    of = _components(named, bucket) if similarity is None else _least(named, jaccard.components(docs, shingle, similarity))
    kept = (
        classes.join(of, "fp")
        .groupBy("component_id")
        .agg(F.min("least").alias("least"))
        .select("least.*")
    )
    stay = packed(docs, *document_key()).join(kept, ["_d", "_t"])
    once = stay.where("n = 1").select("_row.*")
    repeated = stay.where("n > 1").groupBy("_d", "_t").agg(F.first("_row").alias("_row")).select("_row.*")
    return once.unionByName(repeated)
