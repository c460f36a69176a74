"""Repeated word sequences, found with compressed FM-indexes over shards.

A window is a fixed number of consecutive words of one document. Windows that
start twice or more anywhere are found like this:

1. Every window has an anchor: among the short word runs inside it the first one
   with the least hash. Equal windows have equal anchors, so a window can only
   repeat where its anchor does. Windows in a row that share the place of their
   anchor form a stretch; its words are a segment of bounded length that holds
   exactly the windows of the stretch.
2. Stretches with an anchor that occurs once are done. For the others a second
   pass over the texts cuts out the segments; equal segments are one with a
   count, so thousands of copies of a document are one.
3. Segments are dealt into shards by anchor, so all places where a window
   could repeat are in one shard. A shard is indexed: suffix array, its
   Burrows-Wheeler transform as a wavelet tree of bit planes, and sums of the
   segment counts in suffix order. Every segment is then streamed through
   backward search, longest match to the left from every end that matters
   (matching statistics), which reports the intervals with matches of a window
   or more that occur at least twice. All segments of a shard step together.
4. The intervals of a document are put together and its words taken out.

An anchor with very many different contexts (a passage that a third of all
documents hold: its inner windows are one segment, but those that reach over
its edges differ everywhere) would make one shard too large. Its windows are
dealt singly instead, by their own content. The table of such anchors is
bounded by the number of stretches over ``CONTEXTS``.

Null, empty and short texts have no windows and lose nothing. Rows that repeat
are documents of their own and repeat each other. Rows are told apart by
``doc_id`` and text; rows without ``doc_id`` take part.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import Bitmap, keep, small_batches
from annolytics.llm.words import mix, sequence_hashes, slices, split_words

WINDOW = 35
# Words of the runs among which anchors are chosen.
RUN = 8
# Different segments of one anchor from which its windows are dealt singly.
CONTEXTS = 256
# Places of segments that a shard stands for on average.
SHARD_PLACES = 20_000
# Bytes of a word's hash in a segment.
WORD_BYTES = 5


class WaveletTree:
    """Ranks of symbols in a sequence, one bit plane per bit of a symbol; each
    plane is packed into bytes with sums every 64 bits."""

    def __init__(self, sequence: np.ndarray, symbols: int):
        self.depth = max(1, int(symbols - 1).bit_length())
        self.planes, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bits = (sequence >> level & 1).astype(np.uint8)
            blocks = -(-len(bits) // 64) + 1
            padded = np.zeros(blocks * 64, np.uint8)
            padded[:len(bits)] = bits
            packed = np.packbits(padded, bitorder="little").view("<u8")
            sums = np.zeros(blocks + 1, np.int32)
            np.cumsum(np.bitwise_count(packed), out=sums[1:])
            self.planes.append((packed, sums))
            self.zeros.append(len(bits) - int(bits.sum()))
            sequence = np.concatenate([sequence[bits == 0], sequence[bits == 1]])

        self.starts = np.zeros(symbols, np.int64)
        self.starts = self._down(np.arange(symbols), self.starts)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a place in the sequence comes to on the way of ``symbol`` through the planes."""
        for level, ((packed, sums), zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            block = at >> 6
            below = packed[block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            ones = sums[block] + np.bitwise_count(below)
            one = symbol >> (self.depth - 1 - level) & 1
            at = np.where(one == 1, zeros + ones, at - ones)
        return at

    def ranks(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How often ``symbol`` stands before low and before high."""
        both = self._down(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return both[:len(low)] - self.starts[symbol], both[len(low):] - self.starts[symbol]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Order of the suffixes, by doubling. Ranks settle once all differ."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    width = 1
    while True:
        second = np.zeros(n, np.int64)
        second[:-width or None] = rank[width:] + 1 if width < n else 0
        key = rank.astype(np.int64) * (n + 1) + second
        order = np.argsort(key)
        changed = np.concatenate([[0], np.diff(key[order]) != 0])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(changed)
        if rank[order[-1]] == n - 1 or width >= n:
            return order
        width *= 2


class Index:
    """FM-index of segments (arrays of word ids from 1), each with a weight.

    Segment ends are distinct symbols in the order of the segments, so no match
    runs over an end.
    """

    def __init__(self, words: np.ndarray, bounds: np.ndarray, weights: np.ndarray):
        segments = len(bounds) - 1
        lengths = np.diff(bounds)
        symbols = int(words.max(initial=0)) + 1
        # Ends: symbol 0 in the index; told apart while sorting by negative values.
        text = np.zeros(len(words) + segments, np.int64)
        ends = bounds[1:] + np.arange(segments)
        inside = np.ones(len(text), bool)
        inside[ends] = False
        text[inside] = words
        told = text + segments
        told[ends] = np.arange(segments)
        order = suffix_array(told)
        before = text[order - 1]
        self.tree = WaveletTree(before, symbols)
        counts = np.bincount(text, minlength=symbols)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(segments), lengths + 1)
        self.sums = np.concatenate([[0], np.cumsum(weights[owner[order]])])
        self.size = len(text)

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        below, upto = self.tree.ranks(symbol, low, high)
        return self.first[symbol] + below, self.first[symbol] + upto

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.sums[high] - self.sums[low]


def _common(words: np.ndarray, bounds: np.ndarray, weights: np.ndarray, window: int, times: int, run: int = 4):
    """(segment, start, end) of the longest parts, of a window or more, in which
    every run of ``run`` words occurs ``times`` times in all segments."""
    places = len(words) - run + 1
    if places <= 0:
        return (np.zeros(0, np.int64),) * 3
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    _, kind = np.unique(sequence_hashes(mix(words), run), return_inverse=True)
    whole = owner[:places] == owner[run - 1:]
    counts = np.bincount(kind[whole], weights[owner[:places][whole]], kind.max() + 1)
    good = np.concatenate([[False], whole & (counts[kind] >= times), [False]])
    edge = np.flatnonzero(np.diff(good.astype(np.int8)))
    start, end = edge[::2], edge[1::2] + run - 1
    long = end - start >= window
    return owner[start[long]], start[long], end[long]


def repeated_words(words: np.ndarray, bounds: np.ndarray, weights: np.ndarray, window: int = WINDOW, times: int = 2) -> list[list[tuple[int, int]]]:
    """Intervals (start, end) of each segment whose matches of ``window`` words
    or more occur at least ``times`` times, by weight."""
    index = Index(words, bounds, weights)
    found: list[list[tuple[int, int]]] = [[] for _ in range(len(bounds) - 1)]
    # Only stretches without a short run of words that is alone can hold a match.
    owner, start, last = _common(words, bounds, weights, window, times)
    n = len(start)
    stop = last - start  # end of the match being sought, in words of the stretch
    offset = start - bounds[owner]
    active = np.arange(n)
    at = stop.copy()
    low = np.zeros(n, np.int64)
    high = np.full(n, index.size, np.int64)
    while len(active):
        going = at[active] > 0
        symbol = words[start[active] + np.maximum(at[active] - 1, 0)]
        new_low, new_high = index.step(symbol, low[active], high[active])
        going &= (new_high > new_low) & (index.weight(new_low, new_high) >= times)
        on = active[going]
        low[on], high[on] = new_low[going], new_high[going]
        at[on] -= 1
        # Others end their match: report it, go to the next end that can hold a new window.
        off = active[~going]
        full = stop[off] - at[off] >= window
        done = off[full]
        for s, first, end in zip(owner[done].tolist(), (at + offset)[done].tolist(), (stop + offset)[done].tolist(), strict=True):
            found[s].append((first, end))
        stop[off] = np.where(full, at[off] + window - 1, stop[off] - 1)
        at[off] = stop[off]
        low[off], high[off] = 0, index.size
        active = np.concatenate([on, off[stop[off] >= window]])
    return found


def _anchors(hashes: np.ndarray, bounds: np.ndarray, window: int, run: int):
    """(text, start, end, anchor) of the stretches: windows ``start:end`` in a row
    that share the place of their anchor; starts count from the text's first word."""
    runs = mix(sequence_hashes(hashes, run), 17)
    inside = window - run + 1
    out = []
    for text, (first, last) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if last - first < window:
            continue
        mine = runs[first:last - run + 1]
        # Sliding minimum by doubling; ties go to one value, so content alone decides.
        least, width = mine, 1
        while width * 2 <= inside:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < inside:
            least = np.minimum(least[:len(mine) - inside + 1], least[inside - width:])
        cut = np.flatnonzero(np.diff(least)) + 1
        values = least[np.concatenate([[0], cut])]
        if np.isin(mine, values).sum() > len(values):  # an anchor stands in several places
            cut = np.flatnonzero(np.diff(_places(mine, least))) + 1
        starts = np.concatenate([[0], cut])
        out.append((np.full(len(starts), text), starts, np.concatenate([cut, [len(least)]]), least[starts]))
    if not out:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _places(runs: np.ndarray, least: np.ndarray) -> np.ndarray:
    """First place of each window's anchor, at or after the window's start."""
    order = np.lexsort((np.arange(len(runs)), runs))
    value = runs[order]
    # Among equal runs, in the order of their places, the first that is not before the window.
    begin, end = np.searchsorted(value, least, "left"), np.searchsorted(value, least, "right")
    low, high = begin.copy(), end - 1
    start = np.arange(len(least))
    while np.any(low < high):
        middle = (low + high) // 2
        after = order[middle] >= start
        high = np.where(after, middle, high)
        low = np.where(after, low, np.minimum(middle + 1, high))
    return order[low]


def _sums(hashes: np.ndarray) -> np.ndarray:
    """Running sums that give the fingerprint of any run of words."""
    multiplier = np.full(len(hashes) + 1, 0x9FB21C651E98DF25, np.uint64)
    multiplier[0] = 1
    powers = np.cumprod(multiplier, dtype=np.uint64)
    return np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[:-1], dtype=np.uint64)]), powers


_INVERSE = pow(0x9FB21C651E98DF25, -1, 1 << 64)


def _fingerprints(hashes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprint of words start:end, the same for equal sequences."""
    sums, _ = _sums(hashes)
    inverse = np.full(len(hashes) + 1, _INVERSE, np.uint64)
    inverse[0] = 1
    inverse = np.cumprod(inverse, dtype=np.uint64)
    return mix((sums[end] - sums[start]) * inverse[start], 3) ^ mix(end - start, 4)


def repeated_intervals(docs: DataFrame, window: int = WINDOW, run: int = RUN) -> DataFrame:
    """(row, intervals) of the rows of ``docs`` (row, text) that have repeated
    windows: arrays of word places, starts and ends in turn."""
    spark = docs.sparkSession
    small_batches(spark)

    def stretches(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                words = split_words(texts, lower=False)
                hashes = words.hashes()
                text, start, end, anchor = _anchors(hashes, words.bounds, window, run)
                base = words.bounds[text]
                digest = _fingerprints(hashes, base + start, base + end - 1 + window)
                yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(digest.view(np.int64))], ["anchor", "digest"])

    # Anchors that occur more than once, and how many different segments each has.
    seen = docs.select("row", "text").mapInArrow(stretches, "anchor long, digest long")
    counted = seen.groupBy("anchor", "digest").agg(F.count(F.lit(1)).alias("copies"))
    anchors = keep(
        counted.groupBy("anchor").agg(F.sum("copies").alias("places"), F.count(F.lit(1)).alias("segments")).where("places > 1"), "anchors")
    wide = np.sort(anchors.where(F.col("segments") > CONTEXTS).select("anchor").toArrow()["anchor"].to_numpy())
    held = spark.sparkContext.broadcast((Bitmap.of(anchors, "anchor", hashed=True), wide))

    def segments(batches):
        """Each stretch whose anchor may repeat: (row, start, key, digest, words)."""
        filter_, wide = held.value
        for batch in batches:
            for first, texts in slices(batch.column(1)):
                words = split_words(texts, lower=False)
                hashes = words.hashes()
                text, start, end, anchor = _anchors(hashes, words.bounds, window, run)
                some = filter_.has_hashes(anchor)
                text, start, end, anchor = text[some], start[some], end[some], anchor[some]
                single = np.isin(anchor.view(np.int64), wide)
                # Windows of wide anchors go singly, under their own fingerprint.
                times = np.where(single, end - start, 1)
                at = np.repeat(np.arange(len(text)), times)
                offset = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                begin = start[at] + np.where(single[at], offset, 0)
                finish = np.where(single[at], begin + 1, end[at])
                base = words.bounds[text[at]]
                digest = _fingerprints(hashes, base + begin, base + finish - 1 + window)
                key = np.where(single[at], mix(digest, 8), anchor[at])
                short = np.ascontiguousarray(hashes.view(np.uint8).reshape(-1, 8)[:, :WORD_BYTES])
                cells = [short[b + s:b + e - 1 + window].tobytes() for b, s, e in zip(base.tolist(), begin.tolist(), finish.tolist(), strict=True)]
                yield pa.record_batch([
                    batch.column(0).slice(first, len(texts)).take(pa.array(text[at])), pa.array(begin.astype(np.int32)),
                    pa.array(key.view(np.int64)), pa.array(digest.view(np.int64)), pa.array(cells, pa.binary())],
                    ["row", "start", "key", "digest", "words"])

    cut = docs.select("row", "text").mapInArrow(segments, "row long, start int, key long, digest long, words binary")
    cut = keep(cut, "segments")
    # Equal segments are one.
    distinct = cut.groupBy("key", "digest").agg(F.first("words").alias("words"), F.count(F.lit(1)).alias("copies"))
    total = cut.agg(F.count(F.lit(1))).first()[0]
    shards = max(1, total // SHARD_PLACES + 1)

    def search(part: pd.DataFrame) -> pd.DataFrame:
        bounds = np.concatenate([[0], np.cumsum([len(w) // WORD_BYTES for w in part["words"]])])
        hashes = np.zeros((bounds[-1], 8), np.uint8)
        hashes[:, :WORD_BYTES] = np.frombuffer(b"".join(part["words"]), np.uint8).reshape(-1, WORD_BYTES)
        _, ids = np.unique(hashes.view(np.uint64).ravel(), return_inverse=True)
        found = repeated_words(ids.astype(np.int64) + 1, bounds, part["copies"].to_numpy(), window)
        some = [i for i, x in enumerate(found) if x]
        return pd.DataFrame({
            "key": part["key"].to_numpy()[some], "digest": part["digest"].to_numpy()[some],
            "intervals": [[v for pair in found[i] for v in pair] for i in some]})

    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    matches = distinct.select(shard, "key", "digest", "words", "copies").groupBy("shard").applyInPandas(
        search, "key long, digest long, intervals array<int>")
    places = cut.select("row", "start", "key", "digest").join(matches, ["key", "digest"])
    moved = F.transform("intervals", lambda x: x + F.col("start"))
    return places.select("row", moved.alias("part")).groupBy("row").agg(F.flatten(F.collect_list("part")).alias("intervals"))


def without_repeats(docs: DataFrame, window: int = WINDOW, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, intervals) per row of ``docs``;
    the digest is of the kept words joined by spaces."""
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    rows = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("row"), "text")
    found = repeated_intervals(rows, window).withColumnRenamed("row", "_row")

    def cut(batches):
        for batch in batches:
            intervals = batch.column(2).to_pylist()
            counts, removed, digests = [], [], []
            for first, texts in slices(batch.column(1)):
                words = split_words(texts, lower=False, hashed=False)
                data = words.data.tobytes()
                for row in range(len(texts)):
                    begin, end = words.bounds[row], words.bounds[row + 1]
                    stay = np.ones(end - begin, bool)
                    for s, e in zip(*[iter(intervals[first + row] or [])] * 2, strict=True):
                        stay[s:e] = False
                    kept = np.flatnonzero(stay) + begin
                    joined = b" ".join([data[s:e] for s, e in zip(words.start[kept].tolist(), words.end[kept].tolist(), strict=True)])
                    counts.append(len(stay))
                    removed.append(len(stay) - len(kept))
                    digests.append(hashlib.sha256(joined).hexdigest())
            yield pa.record_batch(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), batch.column(2)],
                ["doc_id", "n_words", "n_removed", "kept_sha256", "intervals"])

    # Texts without intervals stay where they are; a filter of fixed size tells most of them.
    found = keep(found, "intervals")
    held = docs.sparkSession.sparkContext.broadcast(Bitmap.of(found, "_row"))

    def part(wanted: bool):
        def choose(batches):
            for batch in batches:
                yield batch.filter(pa.array(held.value.has(batch.column(3).to_numpy()) == wanted)).select([0, 1, 2])

        return rows.select("doc_id", "row", "text", Bitmap.place("row").alias("place")).mapInArrow(choose, "doc_id long, row long, text string")

    moved = part(True).join(found, F.col("row") == F.col("_row"), "left").select("doc_id", "text", "intervals")
    still = part(False).select("doc_id", "text", F.lit(None).cast("array<int>").alias("intervals"))
    return moved.unionByName(still).mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, intervals array<int>")


ORACLE = """
with d as (
    select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i, len(words) as n
    from (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents)
), g as (
    select doc_id, i, n, word, md5(string_agg(word, ' ') over (partition by doc_id order by i rows between current row and 34 following)) as h from d
), x as (
    select doc_id, i, word, i <= n - 34 and count(*) over (partition by h, i <= n - 34) > 1 as again from g
), m as (
    select doc_id, i, word, coalesce(bool_or(again) over (partition by doc_id order by i rows between 34 preceding and current row), false) as gone from x
), o as (
    select doc_id, count(*) as n_words, count(*) filter (where gone) as n_removed, string_agg(word, ' ' order by i) filter (where not gone) as kept
    from m group by doc_id
)
select documents.doc_id, coalesce(n_words, 0) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from documents left join o using (doc_id)
"""
