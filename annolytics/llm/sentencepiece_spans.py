"""SentencePiece encoding with the byte span of every piece in the original text.

The model file is read as a protocol buffer: pieces, their types, and the
normaliser's compiled character map (a double-array trie of source strings and
a block of replacements). A text is normalised by replacing the longest prefix
the map knows at every place; the place each normalised byte came from is kept.
White space is then treated as the model says (mark at the front, runs made
one, spaces as marks). The library segments the text; piece lengths, summed up,
give places in the normalised text, and the alignment turns them into spans of
original bytes that follow each other without overlap.

Null texts are empty: begin and end only, decoded to the empty text. Texts of
any length are encoded whole.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import small_batches

# Fixed values of the file format: field numbers and piece types.
PIECES, NORMALIZER = 1, 3
PIECE, PIECE_TYPE = 1, 3
CHARS_MAP, DUMMY_PREFIX, ONE_SPACE, ESCAPE = 2, 3, 4, 5
UNKNOWN, CONTROL, BYTE = 2, 3, 6
MARK = "▁".encode()


def _fields(data: bytes):
    """(number, value) of each field of a message; values are ints or bytes."""
    at = 0

    def number() -> int:
        nonlocal at
        value, shift = 0, 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        tag = number()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(kind) or number()
            yield tag >> 3, data[at:at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement by a compiled map: 4 bytes size of the trie,
    the trie (32-bit units), then replacements that end in a zero byte."""

    def __init__(self, compiled: bytes):
        size = int.from_bytes(compiled[:4], "little") if compiled else 0
        self.units = np.frombuffer(compiled, np.uint32, size // 4, 4).tolist() if size else []
        self.replacements = compiled[4 + size:]
        self.starters = bytes(b for b in range(256) if self._child(self._root(), b) is not None) if size else b""

    def _root(self) -> int:
        return self._offset(self.units[0])

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def _child(self, at: int, byte: int) -> tuple[int, int] | None:
        """(place of the child's children, its unit) along ``byte``."""
        place = at ^ byte
        if place >= len(self.units):
            return None
        unit = self.units[place]
        return (place ^ self._offset(unit), unit) if unit & 0x800000FF == byte else None

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest known prefix."""
        at, best = self._root(), None
        for here in range(start, len(text)):
            step = self._child(at, text[here])
            if step is None:
                break
            at, unit = step
            if unit >> 8 & 1:
                value = self.units[at] & 0x7FFFFFFF
                best = here + 1 - start, self.replacements[value:self.replacements.index(0, value)]
        return best


@lru_cache(maxsize=2)
def model(path: str) -> SpanEncoder:
    return SpanEncoder(path)


class SpanEncoder:
    def __init__(self, path: str):
        with open(path, "rb") as file:
            content = file.read()
        self.library = sentencepiece.SentencePieceProcessor(model_proto=content)
        sizes, kinds, compiled = [], [], b""
        self.prefix = self.one_space = self.escape = True
        for number, value in _fields(content):
            if number == PIECES:
                piece = dict(_fields(value))
                kind = piece.get(PIECE_TYPE, 1)
                kinds.append(kind)
                sizes.append(0 if kind == CONTROL else 1 if kind == BYTE else len(piece[PIECE]))
            elif number == NORMALIZER:
                spec = dict(_fields(value))
                compiled = spec.get(CHARS_MAP, b"")
                self.prefix = bool(spec.get(DUMMY_PREFIX, 1))
                self.one_space = bool(spec.get(ONE_SPACE, 1))
                self.escape = bool(spec.get(ESCAPE, 1))
        self.sizes, self.kinds = np.array(sizes, np.int64), np.array(kinds)
        self.characters = CharacterMap(compiled)

    def normalise(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, original place of each of them, then the end)."""
        data, origin = text, np.arange(len(text) + 1)
        if self.characters.units:
            data, origin = self._mapped(text)
        content = np.frombuffer(data, np.uint8)
        space = content == 0x20
        if self.one_space:
            keep = ~space
            if len(keep):
                keep[1:] |= ~space[:-1]
            filled = np.flatnonzero(~space)
            keep[filled[-1] + 1 if len(filled) else 0:] = False
            if len(keep):
                keep[0] = not space[0]
            end = origin[filled[-1] + 1] if len(filled) else origin[-1]
            content, space, origin = content[keep], space[keep], np.append(origin[:-1][keep], end)
        if self.escape:
            width = np.where(space, len(MARK), 1)
            origin = np.append(np.repeat(origin[:-1], width), origin[-1])
            data = content.tobytes().replace(b" ", MARK)
        else:
            data = content.tobytes()
        if self.prefix and data:
            front = MARK if self.escape else b" "
            data, origin = front + data, np.concatenate([np.repeat(origin[:1], len(front)), origin])
        return data, origin

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, origin, at = bytearray(), [], 0
        while at < len(text):
            found = self.characters.longest(text, at) if text[at] in self.characters.starters else None
            if found is None:
                width = 1
                while at + width < len(text) and text[at + width] & 0xC0 == 0x80:
                    width += 1
                out += text[at:at + width]
                origin += range(at, at + width)
                at += width
            else:
                out += found[1]
                origin += [at] * len(found[1])
                at += found[0]
        return bytes(out), np.array([*origin, len(text)])

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(begin, end) of every id in the UTF-8 bytes of ``text``. Ids that
        stand for nothing in the text have empty spans."""
        raw = text.encode()
        data, origin = self.normalise(raw)
        sizes = self.sizes[ids]
        unknown = np.flatnonzero(self.kinds[ids] == UNKNOWN)
        if len(unknown):
            sizes[unknown] = self._unknown_sizes(data, ids, sizes, unknown)
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(data):
            raise ValueError("pieces do not cover the normalised text")
        return origin[ends - sizes], origin[ends]

    def _unknown_sizes(self, data: bytes, ids, sizes, unknown) -> np.ndarray:
        """Bytes that each unknown piece covers: up to where the next known piece stands."""
        at, found, last = 0, [], 0
        for place in unknown:
            at += int(sizes[last:place].sum())
            width = 1
            while at + width < len(data) and (data[at + width] & 0xC0 == 0x80):
                width += 1
            following = self.library.id_to_piece(int(ids[place + 1])).encode() if place + 1 < len(ids) else b""
            if self.kinds[ids[place + 1]] not in (UNKNOWN, CONTROL) if place + 1 < len(ids) else False:
                there = data.find(following, at + width)
                width = there - at if there >= 0 else width
            elif place + 1 >= len(ids) or self.kinds[ids[place + 1]] == CONTROL:
                width = len(data) - at
            found.append(width)
            at, last = at + width, place + 1
        return np.array(found)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids = self.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
        return [np.array(x, np.uint32) for x in ids]


def encode_documents(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", spans: bool = True) -> DataFrame:
    """(doc_id, ids, starts, ends, decoded) for every row: token ids with begin
    and end, their byte spans, and the text decoded from them."""
    small_batches(docs.sparkSession)

    def encode(batches):
        encoder = model(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = encoder.encode(texts)
            places = [encoder.spans(t, i) for t, i in zip(texts, ids, strict=True)]
            ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)

            def lists(parts, ends=ends):
                return pa.ListArray.from_arrays(ends, np.concatenate(parts).astype(np.int32))

            yield pa.record_batch(
                [batch.column(0), lists(ids), lists([p[0] for p in places]), lists([p[1] for p in places]),
                 pa.array(encoder.library.decode([i.tolist() for i in ids], num_threads=1), pa.string())],
                ["doc_id", "ids", "starts", "ends", "decoded"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(encode, "doc_id long, ids array<int>, starts array<int>, ends array<int>, decoded string")


def encoded_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered_bytes) per row, digested where they are made.

    ``covered_bytes`` is the number of original bytes that the spans hold.
    """
    small_batches(docs.sparkSession)

    def digest(batches):
        encoder = model(path)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            ids = encoder.encode(texts)
            decoded = encoder.library.decode([i.tolist() for i in ids], num_threads=1)
            covered = []
            for t, i in zip(texts, ids, strict=True):
                first, last = encoder.spans(t, i)
                covered.append(int((last - first).sum()))
            yield pa.record_batch([
                batch.column(0), pa.array([len(i) for i in ids], pa.int64()),
                pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], pa.string()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in decoded], pa.string()),
                pa.array(covered, pa.int64()),
            ], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered_bytes"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered_bytes long")
