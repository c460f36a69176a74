"""Counts over whole texts, a batch at a time: one pass of arrays over code points in place of a dozen regular expressions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex

from annolytics.functions import text as tx

# Code points measured at once, unless one text is longer.
POINTS = 1 << 21

_WORD, _KANA, _SCRIPT, _DIGIT, _LATIN, _BLANK, _HIDDEN, _PLAIN, _BAD, _END = (np.uint16(1 << i) for i in range(10))
_RUN = regex.compile(tx.TOKEN.replace("\\s", "\\t-\\r "))

COUNTS = "chars int, script_chars int, bad_chars int, odd_chars int, shown_chars int, tokens int, scored int, native int, known int, latin int"
MEASURES = f"digest string, marked boolean, run boolean, {COUNTS}"
_NAMES = [part.split()[0] for part in COUNTS.split(", ")]


@lru_cache(4)
def _flags(script: str) -> np.ndarray:
    """What each code point is, one bit each."""
    classes = {
        _WORD: r"[\p{L}\p{N}]", _KANA: tx.SCRIPT, _SCRIPT: script, _DIGIT: tx.DIGIT, _LATIN: tx.LATIN, _BLANK: "[\\t-\\r ]",
        _HIDDEN: r"[\t-\r \p{Z}]", _PLAIN: f"[{script[1:-1]}{tx.ORDINARY_MARKS}" + r"\p{L}\p{N}_]", _BAD: "[�?]",
        _END: "[\\n\\r\\u0085\\u2028\\u2029]",
    }
    every = "".join(map(chr, range(0x110000)))
    flags = np.zeros(0x110000, np.uint16)
    for bit, members in classes.items():
        for run in regex.finditer(members + "+", every):
            flags[run.start():run.end()] |= bit
    return flags


def _counts(texts: Sequence[str], script: str, hints: Sequence[str]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The counts of each text, and whether it holds six equal characters in a row."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    points = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    flag = _flags(script)[points]
    flag[begin + size] = _BLANK | _HIDDEN | _PLAIN | _END  # the line break after each text counts as nothing

    def has(bits: np.uint16) -> np.ndarray:
        return (flag & bits) != 0

    def each(mask: np.ndarray) -> np.ndarray:
        return np.add.reduceat(mask, begin, dtype=np.int64)

    word = has(_WORD)
    starts = ~has(_BLANK)
    starts[1:] &= ~(word[1:] & word[:-1])
    for at in np.flatnonzero(each(has(_KANA))).tolist():  # where scripts change inside a run of letters
        place = slice(int(begin[at]), int(begin[at] + size[at]))
        starts[place] = False
        starts[begin[at] + np.fromiter((m.start() for m in _RUN.finditer(texts[at])), np.int64)] = True
    first = np.flatnonzero(starts)
    owner = np.searchsorted(begin, first, "right") - 1

    def tokens(mask: np.ndarray) -> np.ndarray:
        """Tokens with a character of the mask, which holds no white space."""
        return np.logical_or.reduceat(mask, first) if len(first) else np.zeros(0, bool)

    def tallied(mask: np.ndarray) -> np.ndarray:
        return np.bincount(owner[mask], minlength=len(texts))

    inside = has(_SCRIPT) & ~has(_BLANK)
    native = tokens(inside)
    other = tokens(has(_DIGIT)) | native
    known = np.zeros(len(first), bool)
    # Behind a token stands white space or the next one.
    for hint in filter(None, set(hints)):
        letters = np.frombuffer(hint.encode("utf-32-le"), np.uint32)
        here = first[first + len(letters) < len(points)]
        for i, letter in enumerate(letters):
            here = here[(points[here + i] == letter) & ((i == 0) | ~starts[here + i])]
        after = here + len(letters)
        here = here[starts[after] | ((flag[after] & _BLANK) != 0)]
        known[np.searchsorted(first, here)] = True
    total = np.bincount(owner, minlength=len(texts))
    broken = np.fromiter((t.count("ï¿½") for t in texts), np.int64, len(texts))
    same = np.zeros(len(points), bool)
    same[1:] = (points[1:] == points[:-1]) & ((flag[1:] & _END) == 0)
    five = same[4:] & same[3:-1] & same[2:-2] & same[1:-3] & same[:-4] if len(same) > 4 else np.zeros(0, bool)
    run = np.zeros(len(texts), bool)
    run[np.searchsorted(begin, np.flatnonzero(five) + 4, "right") - 1] = True
    return {
        "chars": size, "script_chars": each(has(_SCRIPT)), "bad_chars": each(has(_BAD)) + broken,
        "odd_chars": each(~has(_PLAIN)), "shown_chars": size + 1 - each(has(_HIDDEN)), "tokens": total,
        "scored": total - each(~has(_WORD | _KANA | _SCRIPT | _BLANK)), "native": tallied(native), "known": tallied(known),
        "latin": tallied(tokens(has(_LATIN)) & ~other),
    }, run


def _slices(texts: Sequence[str]) -> Iterator[Sequence[str]]:
    first = total = 0
    for at, text in enumerate(texts):
        if total and total + len(text) > POINTS:
            yield texts[first:at]
            first, total = at, 0
        total += len(text) + 1
    if first < len(texts):
        yield texts[first:]


def measured(column: pa.Array, script: str, hints: Sequence[str]) -> list[pa.Array]:
    """The columns of ``MEASURES`` for a column of texts without nulls; copies in the batch are measured once."""
    packed = column.dictionary_encode()
    texts = packed.dictionary.to_pylist()
    parts = [_counts(part, script, hints) for part in _slices(texts)]
    digest = [hashlib.md5(t.encode()).hexdigest() for t in texts]
    marked = ["?" in t or "ï¿½" in t for t in texts]
    run = np.concatenate([r for _, r in parts]) if parts else np.zeros(0, bool)
    found = [pa.array(digest, pa.string()), pa.array(marked, pa.bool_()), pa.array(run)]
    for name in _NAMES:
        whole = np.concatenate([c[name] for c, _ in parts]) if parts else np.zeros(0, np.int64)
        found.append(pa.array(whole.astype(np.int32)))
    return [values.take(packed.indices) for values in found]
