"""Line dedup: of equal normalised lines the earliest stays; sentences as finer units.

Units are the lines of a text.  A unit is normalised by lower-casing A-Z,
turning runs of ASCII white space into one space and trimming; units without a
word are passed over.  128-bit digests of units are grouped over the whole
corpus; occurrences rank by (doc_id, hash of the text, place in the text), and
all but the first are removed, whatever their length.

Passages are often copied into the middle of a line, where hashing whole lines
cannot see them, so the sentences of lines are units as well: a line is cut
after every run of ``.``, ``!`` or ``?`` (and closing quotes or brackets) that
white space follows.  Repeated sentences that follow one another in a document
form a run, across lines too; a run of ``sentence_words`` words or more is
removed, and shorter ones (common phrases amid other text) stay.  With
``sentence_words=None`` only lines count.

A unit goes with the white space after it, and a line all of whose words went
goes as a whole.  Offsets in the original text are retained.

Null text has no unit and stays null.  A text whose units all go becomes the
empty string.  Null doc_id ranks last.  Rows repeated with id and text are one
document and get the same result each.  An empty table gives an empty result.
Texts of any length are read in one pass.  Only digests (no text) are grouped,
pre-aggregated before the shuffle, so a sentence in a third of all documents
costs one row per task there; the join back with the first occurrences is
split by adaptive skew handling.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut as materialise
from .common import document_key, packed, small

SENTENCE_WORDS = 10
LINE_SEED = 1
# Possessive throughout: no character is looked at more than twice.
_UNIT = re.compile(rb"(?=[^\n])(?:[^\n.!?]++|[.!?]++[\"')\]]*+(?![ \t\r\x0b\x0c\n]|\Z))*+(?:[.!?]++[\"')\]]*+[ \t\r\x0b\x0c]*+)?")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def _text_bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def _unit_rows(sentences: bool):
    """Rows of all worded units.  A line is marked as whole; with ``sentences``
    one of several sentences has a row of its own (under another seed)."""
    digest = xxhash.xxh3_128_digest

    def rows(batches):
        for b in small(batches):
            ids, hashes, counts, numbers, whole, digests = b.column("_d").to_numpy(), b.column("_t").to_numpy(), [], [], [], []
            for text in b.column("text").to_pylist():
                before, i = len(numbers), 0
                for line in _text_bytes(text).lower().split(b"\n"):  # acts on ASCII only
                    units = _UNIT.findall(line)
                    alone = len(units) == 1
                    if units and (words := line.split()):
                        numbers.append(i)
                        whole.append(True)
                        digests.append(digest(b" ".join(words), 0 if alone else LINE_SEED))
                    if sentences and not alone:
                        for k, unit in enumerate(units):
                            if words := unit.split():
                                numbers.append(i + k)
                                whole.append(False)
                                digests.append(digest(b" ".join(words)))
                    i += len(units)
                counts.append(len(numbers) - before)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids, counts)), pa.array(np.repeat(hashes, counts)), pa.array(numbers, pa.int32()), pa.array(whole, pa.bool_()), pa.array(digests, pa.binary())],
                names=["_d", "_t", "_unit", "_whole", "digest"],
            )

    return rows


def repeats(docs: DataFrame, sentences: bool = True) -> DataFrame:
    """``_d, _t, units, lines``: numbers of each document's units that have come
    before, and of a unit of each line that has been a line before."""
    found = docs.select(*document_key(), "text").mapInArrow(_unit_rows(sentences), "_d long, _t long, _unit int, _whole boolean, digest binary")
    place = F.struct("_d", "_t", "_unit")
    # Written out, so that both sides of the join are plain exchanges, which adaptive execution can split.
    firsts = F.min(place).alias("first"), F.min(F.when(F.col("_whole"), place)).alias("first_line"), F.count("*").alias("n")
    first = materialise(found.groupBy("digest").agg(*firsts).where("n > 1").select("digest", "first", "first_line"))
    line = F.col("_whole") & (place != F.col("first_line"))
    again = found.join(first, "digest").where((place != F.col("first")) | line)
    # A line's own row marks its first unit, which has come before like all of the line.
    return again.groupBy("_d", "_t").agg(F.collect_set("_unit").alias("units"), F.collect_set(F.when(line, F.col("_unit"))).alias("lines"))


def cut(text: str, repeated: set[int], min_words: int = SENTENCE_WORDS, whole: set[int] = frozenset()) -> tuple[str, list[tuple[int, int]]]:
    """(what stays of a text, code point spans of the units removed)."""
    data = _text_bytes(text)
    units = [(m.start(), m.end(), len(m[0].split())) for m in _UNIT.finditer(data)]
    gone, run, size = set(), [], 0
    for i, (_, _, words) in enumerate(units):
        if i in repeated:
            run.append(i)
            size += words
        elif words:
            if size >= min_words:
                gone.update(run)
            run, size = [], 0
    if size >= min_words:
        gone.update(run)
    if whole:
        line = np.cumsum([0] + [data.count(b"\n", a, b) for (a, _, _), (b, _, _) in zip(units, units[1:])]).tolist()
        lines_gone = {line[i] for i in whole}
        gone.update(i for i in range(len(units)) if line[i] in lines_gone)
    if not gone:
        return text, []
    lines, spans, held, words_left, cut_here = [], [], [], 0, False
    at = chars = i = 0
    for line in data.split(b"\n"):
        end = at + len(line)
        held, words_left, cut_here = [], 0, False
        while i < len(units) and units[i][0] < end:
            a, b, words = units[i]
            n = len(data[a:b].decode("utf-8", "surrogatepass"))
            if i in gone:
                spans.append((chars, chars + n))
                cut_here = True
            else:
                held.append(data[a:b])
                words_left += words
            chars += n
            i += 1
        if words_left or not cut_here:
            lines.append(b"".join(held))
        at, chars = end + 1, chars + 1
    return b"\n".join(lines).decode("utf-8", "surrogatepass"), spans


def _cut_rows(sentence_words: int | None):
    def rows(batches):
        for b in small(batches):
            texts, spans = [], []
            for text, units, lines in zip(b.column("_row").field("text").to_pylist(), b.column("units").to_pylist(), b.column("lines").to_pylist()):
                kept, gone = cut(text, set(units) if sentence_words is not None else set(), sentence_words or 0, set(lines)) if units else (text, [])
                texts.append(kept)
                spans.append([{"start": x, "end": y} for x, y in gone] or None)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string()), pa.array(spans, kind)], names=["_row", "_text", "_spans"])

    return rows


def dedup_lines(docs: DataFrame, sentence_words: int | None = SENTENCE_WORDS) -> DataFrame:
    """All columns of ``docs`` with ``text`` cut, plus ``removed_spans`` (null
    where nothing went): array of (start, end) in code points of the original."""
    rows = packed(docs, *document_key()).join(repeats(docs, sentence_words is not None), ["_d", "_t"], "left").select("_row", "units", "lines")
    kind = T.StructType([T.StructField("_row", docs.schema), T.StructField("_text", T.StringType()), T.StructField("_spans", _SPANS)])
    done = rows.mapInArrow(_cut_rows(sentence_words), kind)
    columns = [c for c in docs.columns if c != "removed_spans"]
    return done.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns], F.col("_spans").alias("removed_spans"))
