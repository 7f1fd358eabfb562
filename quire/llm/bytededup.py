"""Exact substring dedup over bytes, by suffix arrays of content-routed shards.

Every byte that a ``length``-byte string covers which also starts earlier (in
a document of smaller rank, or earlier in the same one) is removed; strings
are judged on the input and do not cross documents.

Routing.  In every window of ``length`` bytes the ``GRAM``-byte gram of least
hash (the leftmost, if several) is its anchor.  It depends on the window's
content alone, so equal windows have equal anchors at equal places, and a
document falls into segments: runs of windows with one anchor.  Segments go to
shards by anchor hash, in packed arrays.  A task sends each distinct segment
of a batch once, its earliest occurrence; the others are repeats already, so a
passage in a third of all documents costs one entry per batch.

Resolution.  In a shard, occurrences of one segment (equal anchor and content
hashes, 128 bits together) after the first are repeats as a whole.  Only
anchors with several distinct segments need their bytes: these are fetched and
what of each such shard's text may repeat (runs of windows whose hash occurs
twice) gets a suffix array by induced sorting and its permuted common prefixes.  Neighbours that share ``length`` bytes form classes of equal
windows, of which all but the earliest are repeats.  Should an anchor have over
``HOT`` distinct segments (a passage after which every document goes on
differently), its segments are dealt out again as single windows by a hash of
the whole window, of which every task sends the earliest it has met alone, so
that no shard grows with the corpus; the same suffix arrays resolve those.
Both ways give every repeat; ``HOT`` bounds a shard's memory.

Null text is empty.  Documents rank by (doc_id, hash of the text), null doc_id
last; rows repeated with id and text are one document and get the same result
each.  Texts shorter than ``length`` keep everything.  An empty table gives an
empty result.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, document_key, shuffle_partitions, small
from .suffixarray import common_prefixes, suffix_array

LENGTH, GRAM, HOT = 100, 32, 16_384
#: Window starts handled at once, bytes under one suffix array, packs a partition gets.
PIECE, ARRAY_BYTES, PACKS = 8 << 20, 2 << 20, 8
_SEGMENT = np.dtype([("anchor", "<u8"), ("seg", "<u8"), ("d", "<i8"), ("t", "<i8"), ("start", "<i8"), ("n", "<i4")])
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        v = np.minimum(v[:-span], v[span:])
        span *= 2
    return np.minimum(v[: len(v) - (width - span)], v[width - span :]) if span < width else v


def _gram_hashes(data: bytes, gram: int) -> np.ndarray:
    n = len(data) - gram + 1
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    h = np.zeros(n, np.uint64)
    for at, odd in zip([*range(0, gram - 7, 8), *([gram - 8] if gram % 8 else [])], (_A, _B, _C, _D) * gram):
        h ^= words[at : at + n]
        h *= odd
        h ^= h >> np.uint64(29)
    return h


def segments(data: bytes, length: int = LENGTH, gram: int = GRAM):
    """(anchor hash, first window, windows) arrays of a document's segments."""
    if len(data) < length:
        return None
    out = []
    for lo in range(0, len(data) - length + 1, PIECE):
        piece = data[lo : lo + PIECE + length - 1]
        h = _gram_hashes(piece, gram)
        # Hash and place in one number: of equal hashes the leftmost is least.
        least = _sliding_min((h >> np.uint64(24)) << np.uint64(24) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        at = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        first = np.concatenate(([0], np.nonzero(at[1:] != at[:-1])[0] + 1))
        out.append((h[at[first]], first + lo, np.diff(np.append(first, len(at)))))
    return tuple(np.concatenate(c) for c in zip(*out))


def _occurrences(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows in order of segment and rank, first of its segment?, another document or place than the row before?)."""
    found = found[np.lexsort((found["start"], found["t"], found["d"], found["seg"], found["anchor"]))]
    first = np.ones(len(found), bool)
    fresh = np.ones(len(found), bool)
    if len(found):
        same = (found["anchor"][1:] == found["anchor"][:-1]) & (found["seg"][1:] == found["seg"][:-1])
        first[1:] = ~same
        fresh[1:] = ~same | (found["d"][1:] != found["d"][:-1]) | (found["t"][1:] != found["t"][:-1]) | (found["start"][1:] != found["start"][:-1])
    return found, first, fresh


def _joined(d, t, start, n):
    """Runs of windows (start, n), joined where they touch in a document."""
    if not len(d):
        return d, t, start, n
    order = np.lexsort((start, t, d))
    d, t, start, n = d[order], t[order], start[order], n[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (start[1:] > start[:-1] + n[:-1])
    at = np.nonzero(new)[0]
    end = np.maximum.reduceat(start + n, at)
    return d[at], t[at], start[at], end - start[at]


def _packs(length: int, gram: int, shards: int):
    """Documents to rows (shard, packed segments) and (shard, repeats found here)."""

    def packed(rows: np.ndarray):
        found, first, fresh = _occurrences(rows)
        again = found[~first & fresh]
        sent = found[first]
        shard = (sent["anchor"] >> np.uint64(33)).astype(np.int64) % shards
        order = np.argsort(shard, kind="stable")
        sent, shard = sent[order], shard[order]
        cuts = np.concatenate(([0], np.nonzero(np.diff(shard))[0] + 1, [len(shard)])).tolist() if len(shard) else [0]
        names, segs = shard[cuts[:-1]].tolist(), [b"".join(np.ascontiguousarray(sent[a:b][f]).tobytes() for f in _SEGMENT.names) for a, b in zip(cuts, cuts[1:])]
        d, t, start, n = _joined(again["d"], again["t"], again["start"], again["n"].astype(np.int64))
        per = 50_000
        for i in range(0, len(d), per):
            names.append(int(start[i] + i) % shards)
            segs.append(None)
        repeats = [None] * (len(names) - len(range(0, len(d), per))) + [
            b"".join(np.ascontiguousarray(c[i : i + per]).tobytes() for c in (d, t, start, n)) for i in range(0, len(d), per)
        ]
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(segs, pa.binary()), pa.array(repeats, pa.binary())], names=["shard", "segs", "repeats"])

    def rows(batches):
        held, count = [], 0
        for b in small(batches):
            seen = set()
            for d, t, text in zip(b.column("_d").to_pylist(), b.column("_t").to_pylist(), b.column("text")):
                if (d, t) in seen:
                    continue
                seen.add((d, t))
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                found = segments(data, length, gram)
                if found is None:
                    continue
                anchor, start, n = found
                digest = xxhash.xxh3_64_intdigest
                part = np.empty(len(anchor), _SEGMENT)
                part["anchor"], part["start"], part["n"], part["d"], part["t"] = anchor, start, n, d, t
                part["seg"] = np.array([digest(data[x:y]) for x, y in zip(start.tolist(), (start + n + length - 1).tolist())], np.uint64)
                held.append(part)
                count += len(part)
                if count >= 1_500_000:
                    yield packed(np.concatenate(held))
                    held, count = [], 0
        if held:
            yield packed(np.concatenate(held))

    return rows


def _unpack(data: bytes, dtype: np.dtype) -> np.ndarray:
    out = np.empty(len(data) // dtype.itemsize, dtype)
    at = 0
    for f in dtype.names:
        size = dtype[f].itemsize * len(out)
        out[f] = np.frombuffer(data, dtype[f], len(out), at)
        at += size
    return out


_RESOLVED = "_d long, _t long, start long, n long, anchor long, kind int"
REPEAT, NEEDED, SPREAD = 0, 1, 2


def _resolved(d, t, start, n, anchor, kind):
    return pa.RecordBatch.from_arrays(
        [pa.array(d), pa.array(t), pa.array(start), pa.array(n), pa.array(anchor), pa.array(kind)], names=["_d", "_t", "start", "n", "anchor", "kind"]
    )


def _resolve(hot: int):
    """Packs of a partition to repeats and to segments whose bytes are needed."""

    def rows(batches):
        held = []
        for b in batches:
            for segs, repeats in zip(b.column("segs").to_pylist(), b.column("repeats").to_pylist()):
                if repeats is not None:
                    d, t, start, n = np.frombuffer(repeats, np.int64).reshape(4, -1)
                    yield _resolved(d, t, start, n, np.zeros(len(d), np.int64), np.full(len(d), REPEAT, np.int32))
                if segs is not None:
                    held.append(_unpack(segs, _SEGMENT))
        if not held:
            return
        found, first, fresh = _occurrences(np.concatenate(held))
        again = found[~first & fresh]
        d, t, start, n = _joined(again["d"], again["t"], again["start"], again["n"].astype(np.int64))
        yield _resolved(d, t, start, n, np.zeros(len(d), np.int64), np.full(len(d), REPEAT, np.int32))
        distinct = found[first]
        if len(distinct):
            new = np.concatenate(([True], distinct["anchor"][1:] != distinct["anchor"][:-1]))
            group = np.cumsum(new) - 1
            kinds = np.bincount(group)[group]
            some = distinct[kinds > 1]
            yield _resolved(
                some["d"], some["t"], some["start"], some["n"].astype(np.int64), some["anchor"].view(np.int64), np.where(kinds[kinds > 1] > hot, SPREAD, NEEDED).astype(np.int32)
            )

    return rows


_FETCHED = "anchor long, bytes binary, _d long, _t long, start long, n long"


def _fetch(length: int, known: int = 200_000):
    """Documents with lists of needed segments to the segments' bytes.  Of equal
    single windows a task sends the earliest it has met; the others are repeats
    (rows without bytes).  Up to ``known`` windows are held to tell them."""

    def rows(batches):
        first: dict[bytes, tuple] = {}
        repeats = []

        def send():
            out = [(xxhash.xxh3_64_intdigest(w, 1) - (1 << 63), w, *place, 1) for w, place in first.items()]
            again = [np.array(c, np.int64) for c in zip(*repeats)] if repeats else [np.empty(0, np.int64)] * 3
            joined = zip(*_joined(*again, np.ones(len(again[0]), np.int64)))
            out += [(int(start), None, int(d), int(t), int(start), int(n)) for d, t, start, n in joined]
            first.clear()
            repeats.clear()
            return _fetched(out)

        for b in batches:
            out, size = [], 0
            for d, t, text, need in zip(b.column("_d").to_pylist(), b.column("_t").to_pylist(), b.column("text"), b.column("need").to_pylist()):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                for s in need:
                    start, n = s["start"], s["n"]
                    if s["kind"] == NEEDED:
                        out.append((s["anchor"], data[start : start + n + length - 1], d, t, start, n))
                        size += n + length
                        continue
                    for at in range(start, start + n):
                        w, place = data[at : at + length], (d, t, at)
                        held = first.setdefault(w, place)
                        if held != place:  # the same place twice is one row repeated
                            repeats.append(max(held, place))
                            first[w] = min(held, place)
                if size > 8 << 20:
                    yield _fetched(out)
                    out, size = [], 0
                if len(first) >= known or len(repeats) >= 4 * known:
                    yield send()
            yield _fetched(out)
        yield send()

    return rows


def _fetched(rows):
    columns = zip(*rows) if rows else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if i == 1 else pa.int64()) for i, c in enumerate(columns)], names=["anchor", "bytes", "_d", "_t", "start", "n"])


def _perhaps_repeated(pieces: list[bytes], d: np.ndarray, t: np.ndarray, start: np.ndarray, length: int):
    """``pieces`` cut down to their runs of windows whose hash another window has.
    Equal windows have equal hashes, so no repeat is lost."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    windows = sizes - length + 1
    before = np.cumsum(windows) - windows
    piece = np.repeat(np.arange(len(pieces)), windows)
    offset = np.arange(len(piece)) - before[piece]
    h = _gram_hashes(b"".join(pieces), length)[(np.cumsum(sizes) - sizes)[piece] + offset]
    ordered = np.sort(h)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return [], d[:0], t[:0], start[:0]
    may = twice[np.minimum(np.searchsorted(twice, h), len(twice) - 1)] == h
    opens, ends = may.copy(), may.copy()
    opens[1:] &= ~may[:-1] | (offset[1:] == 0)
    ends[:-1] &= ~may[1:] | (offset[1:] == 0)
    first, last = np.nonzero(opens)[0], np.nonzero(ends)[0]
    of, lo, hi = piece[first], offset[first], offset[last] + length
    return [pieces[i][x:y] for i, x, y in zip(of.tolist(), lo.tolist(), hi.tolist())], d[of], t[of], start[of] + lo


def repeated_windows(pieces: list[bytes], d: np.ndarray, t: np.ndarray, start: np.ndarray, length: int = LENGTH):
    """(d, t, start, n): runs of windows in ``pieces`` equal to an earlier one."""
    pieces, d, t, start = _perhaps_repeated(pieces, d, t, start, length)
    if not pieces:
        return d, t, start, start
    # Rank pieces, so that a window's (piece rank, offset) is its place in the corpus.
    order = np.lexsort((start, t, d))
    pieces = [pieces[i] for i in order]
    d, t, start = d[order], t[order], start[order]
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    text = np.zeros(int(sizes.sum()) + len(pieces) + 1, np.int16)
    begin = np.concatenate(([0], np.cumsum(sizes[:-1] + 1)))
    raw = b"\x00".join(pieces)
    data = np.frombuffer(raw, np.uint8)
    text[: len(data)] = data.astype(np.int16) + 2
    text[begin + sizes] = 1
    text[-1] = 0
    windows = sizes - length + 1
    place = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
    piece = np.repeat(np.arange(len(pieces)), windows)
    sa = suffix_array(text.astype(np.int64), 258)
    number = np.full(len(text), -1, np.int64)
    number[place] = np.arange(len(place))
    # A window ends within its piece, so what it shares to the full holds no separator.
    shared = common_prefixes(data, sa, place, length) >= length
    ordered = number[sa]
    ordered = ordered[ordered >= 0]
    opens = ~shared[ordered]
    at = np.nonzero(opens)[0]
    # Two rows of one document and place are one window, not a repeat.
    key_d, key_t, absolute = d[piece], t[piece], start[piece] + place - begin[piece]
    least = np.repeat(np.minimum.reduceat(ordered, at), np.diff(np.append(at, len(ordered))))
    again = (ordered != least) & ((key_d[ordered] != key_d[least]) | (key_t[ordered] != key_t[least]) | (absolute[ordered] != absolute[least]))
    w = ordered[again]
    return _joined(key_d[w], key_t[w], absolute[w], np.ones(len(w), np.int64))


def _sorted_shards(length: int):
    """Pieces ordered by anchor to repeats; whole anchors share a suffix array."""

    def solve(held):
        pieces, d, t, start = zip(*held)
        d, t, start, n = repeated_windows(list(pieces), np.array(d, np.int64), np.array(t, np.int64), np.array(start, np.int64), length)
        return _resolved(d, t, start, n, np.zeros(len(d), np.int64), np.full(len(d), REPEAT, np.int32))

    def rows(batches):
        held, size, last = [], 0, None
        for b in batches:
            settled = b.filter(b.column("bytes").is_null())
            if settled.num_rows:
                yield _resolved(*(settled.column(c).to_numpy() for c in ("_d", "_t", "start", "n", "anchor")), np.full(settled.num_rows, REPEAT, np.int32))
            b = b.filter(b.column("bytes").is_valid())
            for anchor, piece, d, t, start in zip(*(b.column(c).to_pylist() for c in ("anchor", "bytes", "_d", "_t", "start"))):
                if anchor != last and size >= ARRAY_BYTES:
                    yield solve(held)
                    held, size = [], 0
                last = anchor
                held.append((piece, d, t, start))
                size += len(piece)
        if held:
            yield solve(held)

    return rows


def _cut_texts(length: int):
    """Documents with their repeats to sizes, spans and the kept bytes' digest."""

    def rows(batches):
        for b in small(batches):
            sizes, removed, spans, digests, offsets = [], [], [], [], []
            for text, runs in zip(b.column("text"), b.column("runs").to_pylist()):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                cuts, end = [], -1
                for start, stop in sorted((r["start"], r["start"] + r["n"] + length - 1) for r in runs or ()):
                    if start <= end:
                        if stop > end:
                            cuts[-1][1] = end = stop
                    else:
                        cuts.append([start, stop])
                        end = stop
                digest, at = sha256(), 0
                view = memoryview(data)
                for start, stop in cuts:
                    digest.update(view[at:start])
                    at = stop
                digest.update(view[at:])
                sizes.append(len(data))
                removed.append(sum(y - x for x, y in cuts))
                spans.append(len(cuts))
                digests.append(digest.hexdigest())
                offsets.append(",".join(f"{x}-{y}" for x, y in cuts))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string()), pa.array(offsets, pa.string())],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "removed_spans"],
            )

    return rows


def dedup_bytes(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, removed_spans`` of every row."""
    if not 8 <= gram <= length:
        raise ValueError("gram must lie between 8 and length")
    n = shuffle_partitions(docs.sparkSession)
    keyed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").select("doc_id", *document_key(), "text")
    packs = keyed.select("_d", "_t", "text").mapInArrow(_packs(length, gram, n * PACKS), "shard int, segs binary, repeats binary")
    resolved = cut(packs.repartition(n, "shard").mapInArrow(_resolve(hot), _RESOLVED))
    need = resolved.where(F.col("kind") != REPEAT).groupBy("_d", "_t").agg(F.collect_set(F.struct("start", "n", "anchor", "kind")).alias("need"))
    # All columns go along, so that both joins with the documents share one exchange.
    pieces = keyed.join(need, ["_d", "_t"]).select("doc_id", "_d", "_t", "text", "need").mapInArrow(_fetch(length), _FETCHED)
    found = pieces.repartition(n, "anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_shards(length), _RESOLVED)
    repeats = resolved.where(F.col("kind") == REPEAT).union(found).groupBy("_d", "_t").agg(F.collect_set(F.struct("start", "n")).alias("runs"))
    return (
        keyed.join(repeats, ["_d", "_t"], "left")
        .select("doc_id", "text", "runs")
        .mapInArrow(_cut_texts(length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed_spans string")
    )
