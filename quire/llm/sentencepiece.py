"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie.

The pieces come from a model file.  A Unigram model brings its own log
probabilities.  The file of a merge model (BPE) holds ranks instead, minus the
number of the merge, whose sums mean nothing; its pieces get the log
probabilities of the Zipf-Mandelbrot law over those ranks,
``p(r) = c / (r + ZIPF_SHIFT)`` with ``c`` such that they sum to one.  Nothing
is trained.

Texts are normalised as the file says: by its character map (longest match in
its trie), and by dropping extra spaces.  Normal pieces sit in a double-array
trie over UTF-8 bytes.  White space is escaped to U+2581 and a leading marker
added (where the model asks for it); a character that no piece covers costs ten
less than the least score and is written as byte pieces.

No piece of the vocabularies handled here has the marker after another
character, so the best path of a text is the best paths of its words (a run of
markers and what follows up to the next marker) side by side.  The words of an
Arrow batch are collected once, and the Viterbi recursion runs over all of
them together, one byte position at a time.

Null and empty texts encode to no token (and decode to the empty string).
Decoding turns markers to spaces, byte pieces to bytes (bytes that are not
UTF-8 become U+FFFD) and drops the leading space that encoding added.  Under a
model without a character map it restores every text exactly, but for markers
in the text itself, which come back as spaces; with one, the normalised text.  Repeated rows are
encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import packed, small

MODEL = os.environ.get("QUIRE_PIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")
MARK = "▁"
_MARK = MARK.encode()
CACHED_WORDS = 200_000  # encodings kept by a task; beyond it starts afresh
WORD_BYTES = 1 << 17  # of new words whose paths are sought at once (one word at least)
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, ZIPF_SHIFT = 1, 2.7


def _varint(data: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[i]
        i += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, i
        shift += 7


def _fields(data: bytes):
    """(number, value) of every field of a protocol buffer message."""
    i = 0
    while i < len(data):
        tag, i = _varint(data, i)
        kind = tag & 7
        if kind == 0:
            value, i = _varint(data, i)
        elif kind == 2:
            n, i = _varint(data, i)
            value, i = data[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = data[i : i + n], i + n
        yield tag >> 3, value


def read_model(data: bytes) -> dict:
    """Pieces, log scores, kinds, normaliser and flags from a model file's bytes."""
    pieces, scores, kinds, trained = [], [], [], UNIGRAM
    flags = {"byte_fallback": False, "add_dummy_prefix": True, "remove_extra_whitespaces": True, "charsmap": b""}
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in _fields(value):
                if n == 1:
                    piece = v.decode("utf-8")
                elif n == 2:
                    score = float(np.frombuffer(v, "<f4")[0])
                elif n == 3:
                    kind = v
            pieces.append(piece)
            scores.append(score)
            kinds.append(kind)
        elif number == 2:
            for n, v in _fields(value):
                if n == 3:
                    trained = v
                elif n == 35:
                    flags["byte_fallback"] = bool(v)
        elif number == 3:
            for n, v in _fields(value):
                if n == 2:
                    flags["charsmap"] = bytes(v)
                elif n == 3:
                    flags["add_dummy_prefix"] = bool(v)
                elif n == 4:
                    flags["remove_extra_whitespaces"] = bool(v)
    scores = np.array(scores, np.float32)
    return {"pieces": pieces, "scores": scores if trained == UNIGRAM else zipf_scores(scores, kinds), "kinds": kinds, **flags}


def zipf_scores(ranks: np.ndarray, kinds: list[int]) -> np.ndarray:
    """Log probabilities of the normal pieces by their place in descending order of ``ranks``."""
    normal = np.nonzero(np.array(kinds) == NORMAL)[0]
    place = np.empty(len(normal))
    place[np.argsort(-ranks[normal], kind="stable")] = np.arange(len(normal))
    p = 1 / (place + ZIPF_SHIFT)
    out = np.zeros(len(ranks), np.float32)
    out[normal] = np.log(p / p.sum())
    return out


class CharacterMap:
    """Normaliser of a model file: a size, a double array of prefixes, and the
    zero-terminated replacements that its values point to."""

    def __init__(self, data: bytes):
        size = int.from_bytes(data[:4], "little")
        self.units = np.frombuffer(data[4 : 4 + size], "<u4").tolist()
        self.texts = data[4 + size :]
        # ASCII without a rule of its own stands for itself, if no combining character follows.
        plain = b"".join(re.escape(bytes([c])) for c in range(32, 127) if not self._longest(bytes([c]), 0)[0])
        self.plain = re.compile(b"[" + plain + rb"]+(?![\x80-\xff])") if plain else re.compile(rb"(?!)")

    def __call__(self, text: bytes) -> bytes:
        out, at = [], 0
        while at < len(text):
            if m := self.plain.match(text, at):
                out.append(m[0])
                at = m.end()
                continue
            length, value = self._longest(text, at)
            if length:
                out.append(self.texts[value : self.texts.index(0, value)])
            else:
                lead = text[at]
                length = 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                out.append(text[at : at + length])
            at += length
        return b"".join(out)

    def _longest(self, text: bytes, at: int) -> tuple[int, int]:
        """(bytes, value) of the longest prefix in the double array, zero if none.  A
        unit holds a label in its low byte, a leaf flag in bit 8 and an offset above."""
        units = self.units
        node, found = self._offset(units[0]), (0, 0)
        for i in range(at, len(text)):
            node ^= text[i]
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 512) >> 6)


class DoubleArray:
    """Trie in two integer arrays: child of ``s`` by byte ``c`` is
    ``t = base[s] + c + 1`` if ``check[t] == s``; ``value[s]`` is a key's id."""

    def __init__(self, keys: list[bytes]):
        root: dict = {}
        for i, key in enumerate(keys):
            node = root
            for c in key:
                node = node.setdefault(c, {})
            node[-1] = i
        size = 1 << 20
        while size < 4 * sum(map(len, keys)) + 2048:
            size <<= 1
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        check[0], low, top, queue = 0, 258, 258, [(0, root)]
        while queue:
            state, node = queue.pop()
            value[state] = node.pop(-1, -1)
            if not node:
                continue
            codes = np.array(sorted(node), np.int64) + 1
            while not (spare := check[low : low + 4096] == -1).any():
                low += 4096
            low += int(np.argmax(spare))
            at, span = (low, 64) if len(codes) == 1 else (max(low, top - (512 if len(codes) > 4 else 4096)), 256)
            while True:  # the next free slots where all children fit
                free = np.nonzero(check[at : at + span] == -1)[0] + at - codes[0]
                fits = (free >= 0) & (check[free[:, None] + codes] == -1).all(axis=1) if len(codes) > 1 else free >= 0
                if fits.any():
                    b = int(free[np.argmax(fits)])
                    break
                at, span = at + span, min(2 * span, 2048)
            base[state] = b
            check[b + codes] = state
            top = max(top, b + int(codes[-1]))
            queue += [(b + c + 1, child) for c, child in node.items()]
        self.base, self.check, self.value = base[: top + 512].copy(), check[: top + 512].copy(), value[: top + 512].copy()
        self.longest = max(map(len, keys), default=0)


class Codec:
    """Encoder and decoder of one model."""

    def __init__(self, model: dict):
        self.model = model
        pieces, kinds, scores = model["pieces"], model["kinds"], model["scores"]
        ids = [i for i, k in enumerate(kinds) if k in (NORMAL, USER)]
        self.map = CharacterMap(model["charsmap"]) if model["charsmap"] else None
        if any(re.search(f"[^{MARK}]{MARK}", pieces[i]) for i in ids):
            raise ValueError("pieces with the marker after another character are not supported")
        self.trie = DoubleArray([pieces[i].encode() for i in ids])
        self.ids = np.array(ids, np.int32)
        self.scores = scores[self.ids].astype(np.float64)
        self.unknown_score = float(scores[[i for i, k in enumerate(kinds) if k == NORMAL]].min()) - 10.0
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.bytes = np.full(256, self.unknown, np.int32)
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.bytes[int(pieces[i][3:5], 16)] = i
        out = []
        for piece, k in zip(pieces, kinds):
            out.append(bytes([int(piece[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else b" \xe2\x81\x87 " if k == UNKNOWN else piece.replace(MARK, " ").encode())
        self.out_ends = np.cumsum([0] + [len(x) for x in out])
        self.out_bytes = np.frombuffer(b"".join(out), np.uint8)
        self.forget()

    def words(self, text: str) -> list[bytes]:
        """A text as words: each a run of markers and what follows it."""
        if not text:
            return []
        data = text.encode("utf-8", "surrogatepass")
        if self.map:
            data = self.map(data)
        data = data.replace(_MARK, b" ")  # a marker in the text is the marker, as a space is
        if self.model["remove_extra_whitespaces"]:
            data = re.sub(rb" +", b" ", data).strip(b" ")
        if data and self.model["add_dummy_prefix"]:
            data = b" " + data
        return _WORD.findall(data)

    def viterbi(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(all token ids, ends of each word's tokens) of distinct words."""
        trie, words = self.trie, [w.replace(b" ", _MARK) for w in words]
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        n, total = len(words), int(lengths.sum())
        text = np.concatenate((np.frombuffer(b"".join(words), np.uint8).astype(np.int32) + 1, np.zeros(1, np.int32)))
        starts = np.cumsum(lengths) - lengths
        left = np.repeat(starts + lengths, lengths) - np.arange(total)  # bytes to the word's end
        lead = text[:total] - 1
        width = np.where(lead < 0x80, 1, np.where(lead < 0xC0, 0, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4))))
        width = np.minimum(width, left)
        # Every piece at every position: (start, length, piece), walked together.
        at = np.nonzero(width > 0)[0]
        state = np.zeros(len(at), np.int32)
        single = np.zeros(total, bool)
        found_at, found_len, found_id = [], [], []
        for length in range(1, trie.longest + 1):
            alive = left[at] >= length
            at, state = at[alive], state[alive]
            nxt = trie.base[state] + text[at + length - 1]
            alive = trie.check[nxt] == state
            at, state = at[alive], nxt[alive]
            if not len(at):
                break
            v = trie.value[state]
            hit = v >= 0
            found_at.append(at[hit])
            found_len.append(np.full(int(hit.sum()), length, np.int64))
            found_id.append(v[hit])
            single[at[hit][width[at[hit]] == length]] = True
        lone = np.nonzero((width > 0) & ~single)[0]
        start = np.concatenate([*found_at, lone]).astype(np.int64)
        length = np.concatenate([*found_len, width[lone]]).astype(np.int64)
        piece = np.concatenate([*found_id, np.full(len(lone), -1)]).astype(np.int64)
        score = np.where(piece >= 0, self.scores[np.maximum(piece, 0)], self.unknown_score)
        # Recursion over end offsets, all words at once; equal scores keep the longer piece.
        offset = start - np.repeat(starts, lengths)[start] if total else start
        end = offset + length
        order = np.lexsort((offset, end))
        start, length, piece, score, end = start[order], length[order], piece[order], score[order], end[order]
        best = np.full(total + n + 1, -np.inf)  # slot of a word's boundary: byte position + word number
        word = np.repeat(np.arange(n), lengths)[start] if total else start
        source, target = start + word, start + length + word
        best[np.arange(n) + starts] = 0.0
        came = np.full(total + n + 1, -1, np.int64)
        cuts = np.searchsorted(end, np.arange(1, (int(lengths.max()) if n else 0) + 2))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if a == b:
                continue
            t, s = target[a:b], best[source[a:b]] + score[a:b]
            np.maximum.at(best, t, s)
            first = np.nonzero(s == best[t])[0][::-1]  # reversed: the earliest start is written last
            came[t[first]] = a + first
        # Back along the best paths, all words at once.
        slot = starts + lengths + np.arange(n)
        who = np.arange(n)
        back_word, back_edge = [], []
        begin = starts + np.arange(n)
        while len(who := who[slot[who] != begin[who]]):
            e = came[slot[who]]
            back_word.append(who)
            back_edge.append(e)
            slot[who] = source[e]
        if not back_word:
            return np.empty(0, np.int32), np.zeros(n, np.int64)
        edge, owner = np.concatenate(back_edge), np.concatenate(back_word)
        order = np.lexsort((start[edge], owner))
        edge, owner = edge[order], owner[order]
        known = piece[edge] >= 0
        spread = np.where(known | (not self.model["byte_fallback"]), 1, length[edge])
        owner = np.repeat(owner, spread)
        inside = np.arange(len(owner)) - np.repeat(np.cumsum(spread) - spread, spread)
        edge = np.repeat(edge, spread)
        ids = np.where(piece[edge] >= 0, self.ids[np.maximum(piece[edge], 0)], self.bytes[text[start[edge] + inside] - 1] if self.model["byte_fallback"] else self.unknown)
        return ids.astype(np.int32), np.cumsum(np.bincount(owner, minlength=n))

    def encode_batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all token ids, start offsets with the end appended) of texts."""
        if len(self.known) > CACHED_WORDS:
            self.forget()
        known, new = self.known, []
        per_text = []
        for text in texts:
            words = self.words(text)
            numbers = list(map(known.get, words))
            if None in numbers:
                for i, number in enumerate(numbers):
                    if number is None:
                        w = words[i]
                        if (number := known.get(w)) is None:
                            number = known[w] = len(known)
                            new.append(w)
                        numbers[i] = number
            per_text.append(np.array(numbers, np.int64))
        for a, b in _blocks(new, WORD_BYTES):
            ids, ends = self.viterbi(new[a:b])
            self.ends = np.concatenate((self.ends, ends + len(self.flat)))
            self.flat = np.concatenate((self.flat, ids))
        use = np.concatenate(per_text) if per_text else np.empty(0, np.int64)
        a = self.ends[use]
        n = self.ends[use + 1] - a
        flat = self.flat[gather(a, n)]
        token_ends = np.concatenate(([0], np.cumsum(n)))
        return flat, token_ends[np.concatenate(([0], np.cumsum([len(x) for x in per_text], dtype=np.int64)))].astype(np.int64)

    def forget(self) -> None:
        """Empty the table of words encoded so far."""
        self.known: dict[bytes, int] = {}
        self.flat, self.ends = np.empty(0, np.int32), np.zeros(1, np.int64)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_batch([text])[0].tolist()

    def decode_batch(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of token sequences laid end to end."""
        a = self.out_ends[ids]
        n = self.out_ends[ids + 1] - a
        data = self.out_bytes[gather(a, n)].tobytes()
        at = np.concatenate(([0], np.cumsum(n)))[offsets]
        texts = []
        for x, y in zip(at[:-1].tolist(), at[1:].tolist()):
            if self.model["add_dummy_prefix"] and data[x : x + 1] == b" " and y > x:
                x += 1
            texts.append(data[x:y].decode("utf-8", "replace"))
        return texts

    def decode(self, ids) -> str:
        ids = np.asarray(ids, np.int64)
        return self.decode_batch(ids, np.array([0, len(ids)]))[0]


# Escaped spaces lead a word: "  ab c" is "  ab" and " c".
_WORD = re.compile(rb" *[^ ]+| +")


def gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices of ranges laid end to end."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(total)


def load(spark, path: str = MODEL) -> Codec:
    """The model, read where the driver or Spark's readers find it; at most a
    few megabytes (checked), so that it may travel with the tasks."""
    if os.path.exists(path):
        with open(path, "rb") as f:
            data = f.read()
    else:
        data = bytes(spark.read.format("binaryFile").load(path).first()["content"])
    if len(data) > 64 << 20:
        raise ValueError("model file over 64 MB")
    return Codec(read_model(data))


def _blocks(texts: list[str | bytes | None], size: int = 1 << 20):
    """Ranges of texts of about ``size`` characters (of words: bytes)."""
    a, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= size:
            yield a, i + 1
            a, held = i + 1, 0
    if a < len(texts):
        yield a, len(texts)


def _encoded(codec: Codec, decode: bool):
    """Arrow batches of rows to batches with their tokens and, if asked for, decoded texts."""

    def rows(batches):
        for b in small(batches):
            texts = b.column("_row").field("text").to_pylist()
            for x, y in _blocks(texts):
                ids, offsets = codec.encode_batch(texts[x:y])
                tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                back = [pa.array(codec.decode_batch(ids, offsets), pa.string())] if decode else []
                yield pa.RecordBatch.from_arrays([b.column("_row").slice(x, y - x), tokens, *back], names=["_row", "tokens", *["decoded"][: len(back)]])

    return rows


def _added(docs: DataFrame, rows, **kinds: T.DataType) -> DataFrame:
    """``docs`` with the columns that ``rows`` makes."""
    whole = packed(docs)
    done = whole.mapInArrow(rows, T.StructType([*whole.schema.fields, *(T.StructField(n, k) for n, k in kinds.items())]))
    return done.select("_row.*", *kinds)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns of ``docs`` and ``tokens`` (array of int, empty for null text)."""
    return _added(docs.drop("tokens"), _encoded(load(docs.sparkSession, path), False), tokens=T.ArrayType(T.IntegerType()))


def encode_and_decode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``encode`` and ``decode`` in one pass over the rows."""
    kinds = {"tokens": T.ArrayType(T.IntegerType()), "decoded": T.StringType()}
    return _added(docs.drop(*kinds), _encoded(load(docs.sparkSession, path), True), **kinds)


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """All columns of ``encoded`` and ``decoded``, the text of its ``tokens``
    (a null list: the empty text; a null token: the unknown one)."""
    codec = load(encoded.sparkSession, path)

    def rows(batches):
        for b in batches:
            tokens = b.column("_row").field("tokens")
            lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy()
            ids = pc.fill_null(tokens.flatten(), codec.unknown).to_numpy()
            texts = codec.decode_batch(ids, np.concatenate(([0], np.cumsum(lengths, dtype=np.int64))))
            yield pa.RecordBatch.from_arrays([b.column("_row"), pa.array(texts, pa.string())], names=["_row", "decoded"])

    return _added(encoded.drop("decoded"), rows, decoded=T.StringType())


def digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """``doc_id, n_tokens, n_byte_tokens, tokens_sha256, round_trip`` of every row:
    ``tokens_sha256`` is over the ids as little-endian 32-bit integers and
    ``round_trip`` says that decoding them gives the text (null: the empty text)."""
    codec = load(docs.sparkSession, path)

    def rows(batches):
        is_byte = np.zeros(len(codec.model["pieces"]), bool)
        is_byte[[i for i, k in enumerate(codec.model["kinds"]) if k == BYTE]] = True
        for b in small(batches):
            texts = b.column("text").to_pylist()
            for x, y in _blocks(texts):
                ids, offsets = codec.encode_batch(texts[x:y])
                back = codec.decode_batch(ids, offsets)
                fell = np.concatenate(([0], np.cumsum(is_byte[ids])))[offsets]
                raw = ids.astype("<i4").tobytes()
                cuts = (offsets * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(x, y - x),
                        pa.array(np.diff(offsets)),
                        pa.array(np.diff(fell)),
                        pa.array([hashlib.sha256(raw[p:q]).hexdigest() for p, q in zip(cuts, cuts[1:])], pa.string()),
                        pa.array([(t or "") == d for t, d in zip(texts[x:y], back)], pa.bool_()),
                    ],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "tokens_sha256", "round_trip"],
                )

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text").mapInArrow(
        rows, "doc_id long, n_tokens long, n_byte_tokens long, tokens_sha256 string, round_trip boolean"
    )
