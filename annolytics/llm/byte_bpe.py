"""Byte-level BPE over padded matrices of words.

A text is cut into words by the vocabulary's pattern. The words that a worker
has not met are laid out by length, one padded matrix a length class: a row is a
word, a cell the token id of a byte. In every round each row merges its leftmost
pair of minimum rank, all rows at once: pairs are looked up in a hash table of
the vocabulary, only the two pairs beside a merge anew, and the matrix is
compacted: rows lose the merged column, finished rows leave. A row is finished
when no neighbouring pair has a rank. Words above ``WIDE`` bytes are rows of
their own; there a round takes every occurrence of the least pair, or only the
leftmost one when a new neighbour would rank below it, which gives the same ids.

A rank file holds ``base64(bytes) rank`` a line and every single byte. It is
read on the driver and sent to the workers (its size is the vocabulary's, not
the data's). Any two neighbours whose joined bytes are a token can merge, as in
rank-file tokenizers; a word that is a token as a whole is that token.

Null texts are empty and give no ids. Texts of any length are encoded whole:
what a worker holds is an Arrow batch and ``CACHE`` known words. Repeated rows
are encoded each on their own; rows without a key keep a null key. Columns other
than the key and the text are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

import base64
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.llm.shared import small_batches

# Longest row of a padded matrix, in bytes.
WIDE = 256
# Known words and their bytes that a worker remembers before it starts anew.
CACHE = 400_000
CACHE_BYTES = 32 << 20
# Rank of a pair that no token joins.
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing hash table from pairs of token ids to the id that joins them."""

    def __init__(self, left: np.ndarray, right: np.ndarray, joined: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(left)) * 4))))
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.values = np.full(1 << self.bits, NONE, np.int32)
        keys = left.astype(np.int64) << 32 | right
        waiting, place, self.probes = np.arange(len(keys)), self._slot(keys), 0
        while len(waiting):
            self.probes += 1
            free = self.keys[place] == -1
            first = np.unique(place[free], return_index=True)[1]
            taken = np.flatnonzero(free)[first]
            self.keys[place[taken]] = keys[waiting[taken]]
            self.values[place[taken]] = joined[waiting[taken]]
            left_over = np.ones(len(waiting), bool)
            left_over[taken] = False
            waiting, place = waiting[left_over], (place[left_over] + 1) & (len(self.keys) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, ``NONE`` where no token joins it; a negative id joins nothing."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        keys[(left < 0) | (right < 0)] = -2
        place = self._slot(keys)
        found = np.where(self.keys[place] == keys, self.values[place], NONE)
        # Only pairs whose slot holds another pair go on to the next slot.
        open_ = np.flatnonzero((self.keys[place] != keys) & (self.keys[place] != -1))
        place = place[open_]
        while len(open_):
            place = (place + 1) & (len(self.keys) - 1)
            here = self.keys[place]
            hit = here == keys[open_]
            found[open_[hit]] = self.values[place[hit]]
            more = ~hit & (here != -1)
            open_, place = open_[more], place[more]
        return found


class Growing:
    """An array that doubles its room as parts are added."""

    def __init__(self, kind):
        self.array, self.size = np.zeros(1024, kind), 0

    def add(self, part: np.ndarray) -> None:
        if self.size + len(part) > len(self.array):
            room = np.zeros(max(2 * len(self.array), self.size + len(part)), self.array.dtype)
            room[:self.size] = self.array[:self.size]
            self.array = room
        self.array[self.size:self.size + len(part)] = part
        self.size += len(part)


class Vocabulary:
    """Token ids and bytes of one rank file, and the encoder over them."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line.strip())
        self.ids = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.pattern = regex.compile(pattern)
        size = max(self.ids.values()) + 1
        token = [b""] * size
        for bytes_, rank in self.ids.items():
            token[rank] = bytes_
        self.length = np.fromiter(map(len, token), np.int64, size)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.bytes = np.frombuffer(b"".join(token), np.uint8)
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int32)
        left, right, joined = [], [], []
        for bytes_, rank in self.ids.items():
            for cut in range(1, len(bytes_)):
                a, b = self.ids.get(bytes_[:cut]), self.ids.get(bytes_[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), joined.append(rank)
        self.table = PairTable(*(np.array(x, np.int64) for x in (left, right)), np.array(joined, np.int32))
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.lengths, self.flat = (Growing(t) for t in (np.int64, np.int64, np.int32))
        self.held = 0

    # -- words -------------------------------------------------------------

    def merge_words(self, words: list[bytes]) -> list[np.ndarray]:
        """Token ids of each word."""
        out: list[np.ndarray | None] = [None] * len(words)
        classes: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            whole = self.ids.get(word)
            if whole is not None:
                out[i] = np.array([whole], np.int32)
            elif len(word) > WIDE:
                out[i] = self._merge_wide(self.single[np.frombuffer(word, np.uint8)])
            else:
                classes.setdefault(max(4, 1 << (len(word) - 1).bit_length()), []).append(i)
        for width, rows in classes.items():
            cells = np.full((len(rows), width), -1, np.int32)
            lengths = np.array([len(words[i]) for i in rows])
            flat = np.frombuffer(b"".join(words[i] for i in rows), np.uint8)
            cells[np.arange(width) < lengths[:, None]] = self.single[flat]
            for row, ids in zip(rows, self._merge_matrix(cells), strict=True):
                out[row] = ids
        return out

    def _merge_matrix(self, cells: np.ndarray) -> list[np.ndarray]:
        """All rows of one padded matrix; padding is -1 and stands at the end."""
        done: list[np.ndarray] = [None] * len(cells)
        rows = np.arange(len(cells))
        ranks = self.table.ranks(cells[:, :-1].ravel(), cells[:, 1:].ravel()).reshape(len(cells), -1)
        while len(rows):
            at = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(rows), np.int64)
            least = ranks[np.arange(len(rows)), at] if ranks.shape[1] else np.full(len(rows), NONE)
            live = least != NONE
            for row, line in zip(rows[~live], cells[~live], strict=True):
                done[row] = line[line >= 0]
            rows, cells, ranks, at, least = rows[live], cells[live], ranks[live], at[live], least[live]
            if not len(rows):
                break
            every, width = np.arange(len(rows)), cells.shape[1]
            cells[every, at] = least
            kept = np.arange(width - 1)
            cells = np.take_along_axis(cells, kept + (kept > at[:, None]), 1)
            kept = np.arange(width - 2)
            ranks = np.take_along_axis(ranks, kept + (kept >= at[:, None]), 1)
            for place, inside in ((at, at < width - 2), (at - 1, at > 0)):
                row, column = every[inside], place[inside]
                ranks[row, column] = self.table.ranks(cells[row, column], cells[row, column + 1])
        return done

    def _merge_wide(self, line: np.ndarray) -> np.ndarray:
        """One long row; a round merges every occurrence of its least pair."""
        ranks = self.table.ranks(line[:-1], line[1:])
        while len(ranks) and (least := ranks.min()) != NONE:
            places = np.flatnonzero(ranks == least)
            # Of overlapping occurrences every other one, from the left of each run.
            run = np.cumsum(np.concatenate([[True], np.diff(places) > 1])) - 1
            first = np.concatenate([[0], np.flatnonzero(np.diff(places) > 1) + 1])
            places = places[(np.arange(len(places)) - first[run]) % 2 == 0]
            merged, changed = self._joined(line, ranks, places, least)
            if len(places) > 1 and changed[1].min(initial=NONE) < least:
                merged, changed = self._joined(line, ranks, places[:1], least)
            line, ranks = merged, changed[0]
        return line

    def _joined(self, line, ranks, places, joined):
        """(row after the merges, (its pair ranks, the ranks that are new))"""
        keep = np.ones(len(line), bool)
        keep[places + 1] = False
        after = line.copy()
        after[places] = joined
        after = after[keep]
        # A pair keeps its rank by its left cell; the last cell of the row has no pair.
        pairs = np.append(ranks, NONE)[keep][:-1]
        at = places - np.arange(len(places))
        touched = np.unique(np.concatenate([at, at - 1]))
        touched = touched[(touched >= 0) & (touched < len(pairs))]
        new = self.table.ranks(after[touched], after[touched + 1])
        pairs[touched] = new
        return after, (pairs, new)

    # -- texts -------------------------------------------------------------

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)"""
        if len(self.known) > CACHE or self.held > CACHE_BYTES:
            self._forget()
        words = [self.pattern.findall(text) for text in texts]
        flat = list(chain.from_iterable(words))
        codes = list(map(self.known.get, flat))
        if None in codes:
            new = list(dict.fromkeys(word for word, code in zip(flat, codes, strict=True) if code is None))
            ids = self.merge_words([word.encode() for word in new])
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.known.update(zip(new, range(self.lengths.size, self.lengths.size + len(new)), strict=True))
            self.starts.add(self.flat.size + np.cumsum(lengths) - lengths)
            self.lengths.add(lengths)
            self.flat.add(np.concatenate(ids))
            self.held += sum(map(len, new))
            codes = list(map(self.known.__getitem__, flat))
        codes = np.array(codes, np.int64)
        lengths = self.lengths.array[codes]
        last = np.cumsum([0, *map(len, words)])
        ends = np.concatenate([[0], np.cumsum(lengths)])[last]
        return self.flat.array[ragged(self.starts.array[codes], lengths)], np.diff(ends)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids, one after the other."""
        return self.bytes[ragged(self.start[ids], self.length[ids])]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of every piece, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


@lru_cache(maxsize=2)
def vocabulary(ranks: bytes, pattern: str) -> Vocabulary:
    """One per worker process."""
    return Vocabulary(ranks, pattern)


def _sent(spark: SparkSession, path: str):
    """The rank file as a broadcast value, read once on the driver."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def _offsets(counts: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32())


def encode(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids) of every row, by the ranks of the file at ``path``."""
    small_batches(docs.sparkSession)
    ranks = _sent(docs.sparkSession, path)

    def run(batches):
        words = vocabulary(ranks.value, pattern)
        for batch in batches:
            ids, counts = words.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.record_batch(
                [batch.column(0), pa.ListArray.from_arrays(_offsets(counts), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    rows = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded) with the bytes that the ids stand for; null ids decode to nothing."""
    ranks = _sent(encoded.sparkSession, path)

    def run(batches):
        words = vocabulary(ranks.value, pattern)
        for batch in batches:
            lists = batch.column(1)
            counts = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            data = words.decode(ids)
            ends = np.concatenate([[0], np.cumsum(words.length[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            decoded = pa.Array.from_buffers(
                pa.binary(), len(lists), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
            yield pa.record_batch([batch.column(0), lists, decoded], ["doc_id", "ids", "decoded"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
