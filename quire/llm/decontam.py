"""Benchmark decontamination: CGK embedding, bit-sampling LSH, edit verification.

Texts are compared as sequences of normalised words (A-Z lower-cased, ASCII
punctuation and white space as gaps).  A document leaks an item if some
stretch of it is within ``floor((1 - similarity) * item words)`` word edits of
the item.

Windows.  For every item length ``n`` each stretch of ``n`` words of a document
is a window (shorter at the document's end).  An edit breaks two pairs of
adjacent words at most, so a window within ``e`` edits of an item holds
``n - 1 - 2e`` pairs that items of this length have; windows with fewer are
passed over, which loses nothing.  The test reads one table of fixed size
(``2**SLOT_BITS`` hashes of pairs by 64 length classes), whatever the benchmark.

Candidates.  The CGK random walk embeds a window into three times its length:
every step copies the current word, and a random bit of (step, word) says
whether to move on.  Small edit distance becomes small Hamming distance.  A key
is ``SAMPLED`` sampled positions of the embedding; windows and items whose keys
meet in one of the tables are candidates.  There are as many tables as a window
at the full distance needs to be missed with a chance under ``1 - RECALL``,
taking its Hamming share at ``SHARE`` (measured: at most 0.46 on average for 15
to 59 words and edits of any kind).  Keys of windows are joined with keys of
items; nothing but this join pairs a document with an item.

Verification.  Windows travel by regions of ``n`` starts; a candidate region is
aligned with the item exactly (free start and end) and reported with its least
distance and word offsets.

Null and empty texts leak nothing, nor do items without a word.  Items with a
null id or text are ignored; items of equal words are compared once and
reported each.  A document that leaks several items has a row for each;
repeated rows are reported each.  Empty tables give empty results.  Sides are
broadcast only under a checked size (``KEY_ROWS``, ``WORD_BYTES``); beyond it
the same joins shuffle.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, document_key, packed, shuffle_partitions, small

SIMILARITY, RECALL, SHARE, SAMPLED, WALKS = 0.8, 0.998, 0.6, 3, 8
#: Hashes told apart by the window test, words handled at once.
SLOT_BITS, BLOCK_WORDS = 20, 1 << 18
#: Largest broadcast sides: item keys by rows, item words by bytes, leaking documents by rows.
KEY_ROWS, WORD_BYTES, DOCUMENT_ROWS = 4_000_000, 64 << 20, 2_000_000
_GAPS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_FIRST, _SECOND = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
END = np.uint64(7)  # what follows a text's last word


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_GAPS).split() if text else []


def symbols(found: list[bytes]) -> np.ndarray:
    """Word hashes; equal words only matter to candidates, so clashes cost time alone."""
    return np.fromiter(map(zlib.crc32, found), np.uint64, len(found)) + np.uint64(1 << 32)


def edits(n: int, similarity: float = SIMILARITY) -> int:
    """Word edits allowed to an item of ``n`` words."""
    return int(math.floor((1 - similarity) * n + 1e-9))


def least_pairs(n: int, e: int) -> int:
    """Word pairs (for ``n`` = 1: words) of an item that ``e`` edits leave in a window of ``n`` words."""
    return n - 1 - 2 * e if n > 1 else 1 - e


def slots(text: np.ndarray, n: int) -> np.ndarray:
    """Slots of the word pairs (for ``n`` = 1: words) of a text."""
    mixed = text * _SECOND if n == 1 else text[:-1] * _FIRST + text[1:] * _SECOND
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def cgk(windows: np.ndarray, walks: int = WALKS) -> np.ndarray:
    """CGK embeddings of rows of word hashes under each of ``walks`` random
    walks: an array (walk, window, step)."""
    rows, n = windows.shape
    padded = np.tile(np.concatenate((windows, np.full((rows, 1), END)), axis=1), (walks, 1))
    salt = np.repeat(np.arange(walks, dtype=np.uint64) * np.uint64(40503) + np.uint64(1), rows)
    every = np.arange(rows * walks) * (n + 1)
    flat, at, out = padded.ravel(), np.zeros(rows * walks, np.int64), np.empty((3 * n, rows * walks), np.uint64)
    for step in range(3 * n):
        w = flat[every + at]
        out[step] = w
        toss = (w + salt + np.uint64(step * 2654435761)) * _FIRST
        at = np.minimum(at + (toss >> np.uint64(40) & np.uint64(1)).astype(np.int64), n)
    return out.T.reshape(walks, rows, 3 * n)


def keys(windows: np.ndarray) -> np.ndarray:
    """The keys of windows of equal length: an array (window, table)."""
    rows, n = windows.shape
    per_walk = -(-math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - SHARE) ** SAMPLED)) // WALKS)
    pick = np.random.default_rng(n).integers(0, 3 * n, (WALKS, per_walk, SAMPLED))
    table = np.arange(WALKS * per_walk, dtype=np.uint64).reshape(WALKS, 1, per_walk) + np.uint64(n << 20)
    out = np.empty((rows, WALKS * per_walk), np.int64)
    step = max(1, (1 << 18) // n)
    for i in range(0, rows, step):
        embedded = cgk(windows[i : i + step])
        h = np.broadcast_to(table * _SECOND, (WALKS, embedded.shape[1], per_walk)).copy()
        for k in range(SAMPLED):
            h = (h ^ np.take_along_axis(embedded, pick[:, None, :, k], axis=2)) * _SECOND
            h ^= h >> np.uint64(31)
        out[i : i + step] = h.view(np.int64).transpose(1, 0, 2).reshape(embedded.shape[1], -1)
    return out


def align(item: np.ndarray, stretch: np.ndarray) -> tuple[int, int, int]:
    """(least edits, start, end) of ``item`` against any part of ``stretch``."""
    m = len(stretch)
    row = np.zeros(m + 1, np.int64)
    start = np.arange(m + 1)
    for i, w in enumerate(item, 1):
        differ = (stretch != w).astype(np.int64)
        new, origin = np.empty(m + 1, np.int64), np.empty(m + 1, np.int64)
        new[0], origin[0] = i, 0
        across, down = row[:-1] + differ, row[1:] + 1
        new[1:] = np.minimum(across, down)
        origin[1:] = np.where(across <= down, start[:-1], start[1:])
        lift = new - np.arange(m + 1)  # insertions: a running minimum along the row
        low = np.minimum.accumulate(lift)
        came = np.maximum.accumulate(np.where(lift == low, np.arange(m + 1), 0))
        row, start = low + np.arange(m + 1), origin[came]
    end = int(np.argmin(row))
    return int(row[end]), int(start[end]), end


def _items(batches):
    for b in batches:
        out = [[], [], [], [], []]
        for item_id, text in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist()):
            if found := words(text):
                raw = b" ".join(found)
                for column, value in zip(out, (item_id, xxhash.xxh64_intdigest(raw) - (1 << 63), len(found), raw, keys(symbols(found)[None, :])[0])):
                    column.append(value)
        kinds = pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["item_id", "item", "n", "words", "keys"])


def _slots(lengths: list[int]):
    """Items to (slot, length class) of the window test."""
    place = {n: i % 64 for i, n in enumerate(lengths)}

    def rows(batches):
        for b in batches:
            for n, raw in zip(b.column("n").to_pylist(), b.column("words").to_pylist()):
                found = np.unique(slots(symbols(raw.split()), n)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), np.uint64(1) << np.uint64(place[n])).view(np.int64))], names=["slot", "bits"])

    return rows


class Windows:
    """Windows of texts that may be near an item, by region, with their keys."""

    def __init__(self, lengths: list[int], table: np.ndarray, similarity: float):
        self.lengths = [(n, edits(n, similarity), i % 64) for i, n in enumerate(lengths)]
        self.table, self.hits = table, None

    def regions(self, texts: list[list[bytes]]):
        """(text number, item length, region's first word, its words, keys) of each region with a window."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        text = np.concatenate([*map(symbols, texts), np.empty(0, np.uint64)])
        ends = np.cumsum(sizes)
        begin, end = np.repeat(ends - sizes, sizes), np.repeat(ends, sizes)
        for n, e, bit in self.lengths:
            at = self._places(text, ends, begin, n, least_pairs(n, e), np.uint64(bit))
            for i in range(0, len(at), BLOCK_WORDS // n + 1):
                yield from self._keyed(text, texts, ends, at[i : i + BLOCK_WORDS // n + 1], begin, end, n, e)
        self.hits = None

    def _places(self, text, ends, begin, n, least, bit):
        """Where windows of ``n`` words begin that hold ``least`` known pairs."""
        if least <= 0:
            return np.arange(len(text))
        if n == 1:
            return np.nonzero(self.table[slots(text, 1)] >> bit & np.uint64(1))[0]
        if self.hits is None:
            mask = self.table[slots(text, 2)]
            mask[ends[:-1] - 1] = 0  # no pair reaches across the end of a text
            at = np.nonzero(mask)[0]
            self.hits = at, mask[at]
        at, mask = self.hits
        at = at[(mask >> bit & np.uint64(1)).astype(bool)]
        if len(at) < least:
            return at[:0]
        first, last = at[: len(at) - least + 1], at[least - 1 :]
        low = np.maximum(last - (n - 2), begin[first])
        fits = (low <= first) & (begin[first] == begin[last])
        low, count = low[fits], (first - low + 1)[fits]
        return np.unique(np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum())))

    @staticmethod
    def _keyed(text, texts, ends, at, begin, end, n, e):
        grid = at[:, None] + np.arange(n)
        windows = np.where(grid < end[at, None], text[np.minimum(grid, len(text) - 1)], END)
        # Equal windows of one text have the same distance: the first stands for all.
        odd = np.random.default_rng(n).integers(1, 2**63, n).astype(np.uint64) | np.uint64(1)
        same = ((windows ^ windows >> np.uint64(15)) * odd).sum(axis=1) + begin[at].astype(np.uint64) * _FIRST
        first = np.sort(np.unique(same, return_index=True)[1])
        at, made = at[first], keys(windows[first])
        region = (at - begin[at]) // n
        opens = np.nonzero(np.concatenate(([True], (begin[at[1:]] != begin[at[:-1]]) | (region[1:] != region[:-1]))))[0].tolist()
        of = np.searchsorted(ends, at[opens], "right").tolist()
        for k, (i, j) in enumerate(zip(opens, [*opens[1:], len(at)])):
            r = int(region[i]) * n
            whole = texts[of[k]]
            x, y = max(0, r - 2 * e), min(len(whole), r + 2 * n + 2 * e)
            yield of[k], n, x, b" ".join(whole[x:y]), np.unique(made[i:j])


_REGION = "uid long, row long, _d long, _t long, doc_id long, first int, stretch binary, keys array<long>"


def _scan(lengths, table, similarity):
    def rows(batches):
        finder = Windows(lengths, table.value, similarity)
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40
        row = uid = task
        held, size = [], 0

        def flush():
            nonlocal uid, held, size
            out, got = [[] for _ in range(8)], 0
            for k, _, x, stretch, made in finder.regions([h[-1] for h in held]):
                for column, value in zip(out, (uid, *held[k][:-1], x, stretch, made)):
                    column.append(value)
                uid += 1
                got += len(made)
                if got > 1 << 20:
                    yield batch(out)
                    out, got = [[] for _ in range(8)], 0
            yield batch(out)
            held, size = [], 0

        def batch(out):
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["uid", "row", "_d", "_t", "doc_id", "first", "stretch", "keys"])

        for b in small(batches):
            for d, t, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("_d", "_t", "doc_id", "text"))):
                row += 1
                if found := words(text):
                    held.append((row, d, t, doc_id, found))
                    size += len(found)
                    if size >= BLOCK_WORDS:
                        yield from flush()
        if held:
            yield from flush()

    return rows


def _verify(similarity: float):
    """Candidate regions to leaks, by exact alignment."""

    def rows(batches):
        known: dict = {}

        def near(raw, stretch):
            item, found = raw.split(), stretch.split()
            n = len(item)
            there = set(found)
            if sum(w in there for w in item) < n - edits(n, similarity):
                return n + 1, 0, 0, n  # more words than edits are not there at all
            number: dict[bytes, int] = {}
            return *align(np.array([number.setdefault(w, len(number)) for w in item]), np.array([number.get(w, -1) for w in found])), n

        for b in batches:
            out = []
            for i, (first, stretch, raw) in enumerate(zip(b.column("first").to_pylist(), b.column("stretch").to_pylist(), b.column("words").to_pylist())):
                if (found := known.get((stretch, raw))) is None:
                    if len(known) > 20_000:
                        known.clear()
                    found = known[stretch, raw] = near(raw, stretch)
                d, x, y, n = found
                if d <= edits(n, similarity):
                    out.append((i, d, first + x, first + y, n))
            at, d, x, y, n = (np.array(c, np.int64) for c in zip(*out)) if out else [np.empty(0, np.int64)] * 5
            some = b.select(["row", "_d", "_t", "doc_id", "item"]).take(pa.array(at))
            yield pa.RecordBatch.from_arrays([*some.columns, *(pa.array(c.astype(np.int32)) for c in (d, x, y, n))], names=[*some.schema.names, "edits", "first_word", "end_word", "n"])

    return rows


def _bounded(df: DataFrame, size: int, limit: int) -> DataFrame:
    return F.broadcast(df) if size <= limit else df


def leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``row, _d, _t, doc_id, item_id, edits, first_word, end_word, n`` of every
    row (numbered) of ``docs`` and item that it leaks."""
    spark = docs.sparkSession
    given = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null")
    items = cut(given.mapInArrow(_items, "item_id long, item long, n int, words binary, keys array<long>"))
    distinct = items.drop("item_id").dropDuplicates(["item"])
    lengths = sorted(r[0] for r in items.select("n").distinct().collect())  # at most the longest item's words
    slots = items.mapInArrow(_slots(lengths), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros(1 << SLOT_BITS, np.uint64)
    table[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    n_keys, n_bytes = items.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0)), F.coalesce(F.sum(F.length("words")), F.lit(0))).first()

    rows = docs.select(*document_key(), docs["doc_id"].cast("long").alias("doc_id"), "text")
    regions = cut(rows.mapInArrow(_scan(lengths, spark.sparkContext.broadcast(table), similarity), _REGION))
    met = regions.select("uid", F.explode("keys").alias("key")).join(_bounded(distinct.select("item", F.explode("keys").alias("key")), n_keys, KEY_ROWS), "key")
    pairs = met.select("uid", "item").distinct()
    near = pairs.join(regions.drop("keys"), "uid").join(_bounded(distinct.select("item", "words"), n_bytes, WORD_BYTES), "item")
    found = near.repartition(shuffle_partitions(spark), "row").mapInArrow(
        _verify(similarity), "row long, _d long, _t long, doc_id long, item long, edits int, first_word int, end_word int, n int"
    )
    best = found.groupBy("row", "_d", "_t", "doc_id", "item", "n").agg(F.min(F.struct("edits", "first_word", "end_word")).alias("b"))
    return best.join(_bounded(items.select("item", "item_id"), n_bytes, WORD_BYTES), "item").select("row", "_d", "_t", "doc_id", "item_id", "b.*", "n")


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, item_id, edits, first_word, end_word, similarity``: a row for
    every document and item that it leaks."""
    return leaks(docs, benchmark, similarity).select("doc_id", "item_id", "edits", "first_word", "end_word", (1 - F.col("edits") / F.col("n")).alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that leak no item, columns unchanged."""
    gone = cut(leaks(docs, benchmark, similarity).select("_d", "_t").distinct())
    return packed(docs, *document_key()).join(_bounded(gone, gone.count(), DOCUMENT_ROWS), ["_d", "_t"], "left_anti").select("_row.*")
