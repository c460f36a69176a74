"""Words of whole Arrow text columns, found and hashed as flat arrays.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]``. UTF-8 never
uses those bytes inside a character, so bytes and characters agree. A word's
hash is a polynomial over its bytes, taken as a difference of running sums, so
a batch of texts costs a few array passes and no loop over words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Bytes of text that are hashed at a time; a longer single text is taken whole.
SLICE_BYTES = 1_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _BASE_INVERSE: np.ones(1, np.uint64)}


def _power(base: int, upto: int) -> np.ndarray:
    """base ** 0 .. base ** (upto - 1), modulo 2 ** 64."""
    if len(_powers[base]) < upto:
        steps = np.full(upto, base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps, dtype=np.uint64)
    return _powers[base]


def mix(values: np.ndarray, seed: int = 0) -> np.ndarray:
    """A seeded bijection of 64-bit values whose bits all depend on each other."""
    x = values.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all texts, offsets of each text); null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    content = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return content[ends[0]:ends[-1]], ends - ends[0]


def slices(texts: pa.Array, upto: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in runs of about ``upto`` bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    first, total = 0, 0
    for row, size in enumerate(sizes):
        if row > first and total + size > upto:
            yield first, texts.slice(first, row - first)
            first, total = row, 0
        total += int(size)
    if first < len(texts):
        yield first, texts.slice(first)


@dataclass(frozen=True)
class Words:
    """Words of some texts. Word ``i`` holds bytes ``start[i]:end[i]`` of
    ``data``; text ``t`` holds words ``bounds[t]:bounds[t + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    bounds: np.ndarray
    sums: np.ndarray | None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def hashes(self, start: np.ndarray | None = None, end: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of the given byte ranges."""
        start, end = (self.start, self.end) if start is None else (start, end)
        inverse = _power(_BASE_INVERSE, len(self.data) + 1)
        raw = (self.sums[end] - self.sums[start]) * inverse[start]
        return mix(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def split_words(texts: pa.Array, lower: bool, hashed: bool = True) -> Words:
    data, offsets = flat(texts)
    if lower:
        data = _LOWER[data]
    inside = ~_SPACE[data]
    before = np.empty_like(inside)
    after = np.empty_like(inside)
    if len(data):
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        edges = offsets[1:-1]
        edges = edges[(edges > 0) & (edges < len(data))]
        before[edges] = False
        after[edges - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    sums = None
    if hashed:
        sums = np.zeros(len(data) + 1, np.uint64)
        terms = (data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data) + 1)[:len(data)]
        np.cumsum(terms, out=sums[1:])
    return Words(data, offsets, start, end, np.searchsorted(start, offsets, "left"), sums)


def split_lines(texts: pa.Array) -> Words:
    """The lines of each text (at least one) as spans without white space at
    their ends, in bytes with A-Z in lower case."""
    data, offsets = flat(texts)
    data = _LOWER[data]
    breaks = np.flatnonzero(data == 0x0A)
    first = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
    last = np.sort(np.concatenate([offsets[1:], breaks]))
    # The nearest byte inside at or after each place, and the nearest before it.
    inside = np.flatnonzero(~_SPACE[data])
    after = np.searchsorted(inside, first, "left")
    before = np.searchsorted(inside, last, "left") - 1
    full = before >= after
    start, end = first.copy(), first.copy()
    start[full], end[full] = inside[after[full]], inside[before[full]] + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, len(data) + 1)[:len(data)], out=sums[1:])
    counts = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) + 1
    return Words(data, offsets, start, end, np.concatenate([[0], np.cumsum(counts)]), sums)


_STEPS = [pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64) for k in range(64)]


def sequence_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` words that start at each word; the last
    ``width - 1`` places have none. Ranges over two texts are the caller's to drop."""
    places = len(hashes) - width + 1
    if places <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(places, np.uint64)
    for k in range(width):
        total += hashes[k:k + places] * np.uint64(_STEPS[k % 64])
    return mix(total, width)


def shingle_sets(words: Words, width: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; a text with fewer words than
    ``width`` has its whole sequence as one shingle, a text without words none."""
    hashes = words.hashes()
    whole = sequence_hashes(hashes, width)
    for first, last in zip(words.bounds[:-1], words.bounds[1:], strict=True):
        n = last - first
        if n >= width:
            yield np.unique(whole[first:last - width + 1])
        elif n:
            yield sequence_hashes(hashes[first:last], int(n))
        else:
            yield np.zeros(0, np.uint64)
