"""Tokens of texts in a script without spaces, by a caller's dictionary.

Every text is a lattice: each dictionary word that occurs at a place is an edge
from its first to behind its last code point; so that every text has a way
through, a code point alone and the rest of its run of one script are edges as
unknown words. The way of least total cost, then of fewest tokens, then with
the longest last token at each place, gives the tokens. A text in which no
dictionary word occurs is one token as a whole, and so is every text without a
dictionary.

A dictionary within bounds is compiled to a trie of sorted arrays, sent to the
workers, and followed from all places of an Arrow batch of texts at once, one
code point a step; lemma, reading and pos are fetched for the chosen words. A larger one stays a table: the substrings of the distinct
texts are joined to it, the edges of a text gathered, and the same path search
runs on them. Tests hold both equal.

Dictionary rows are surface, lemma, reading, pos and cost; of rows with one
surface the cheapest counts. Empty or null surfaces and null costs are left
out. Texts are trimmed first; empty and null ones have no tokens.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions import text as tx

# Costs of an unknown token, and of each of its code points.
UNKNOWN, UNKNOWN_CHAR = 3_000, 500
# Words longer than this are no dictionary words.
LONGEST = 40

# Words and bytes (12 a letter, and what else a word has) of a dictionary that goes to the workers as a whole.
DICTIONARY_WORDS, DICTIONARY_BYTES = 4_000_000, 256 << 20
# Texts of at most so many code points find their ways together; a key has room for their places.
SHORT = 500
# Bits of a letter's code in a key of the trie.
_LETTER = np.uint64(21)

_WORD = "struct<surface:string,lemma:string,reading:string,pos:array<string>,cost:int>"
_TOKEN = "array<struct<surface:string,lemma:string,reading:string,pos:array<string>,start:int,end:int,known:boolean>>"
_TOKEN_TYPE = pa.list_(pa.struct([
    ("surface", pa.string()), ("lemma", pa.string()), ("reading", pa.string()), ("pos", pa.list_(pa.string())),
    ("start", pa.int32()), ("end", pa.int32()), ("known", pa.bool_())]))


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Trie:
    """Words as a trie of sorted levels: the state of a prefix is its place among the keys of its
    length, a key holds the state of the prefix before and the next letter's code."""

    def __init__(self, words: Iterable[str]):
        self.words = sorted(set(words))
        points = _points("".join(self.words))
        self.letters = np.unique(points)
        codes = np.searchsorted(self.letters, points).astype(np.uint64)
        length = np.fromiter(map(len, self.words), np.int64, len(self.words))
        begin = np.cumsum(length) - length
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        state, alive = np.zeros(len(self.words), np.uint64), np.flatnonzero(length)
        while len(alive):
            depth = len(self.levels)
            keys, place = np.unique(state[alive] << _LETTER | codes[begin[alive] + depth], return_inverse=True)
            state[alive] = place
            word, ends = np.full(len(keys), -1, np.int32), alive[length[alive] == depth + 1]
            word[state[ends].astype(np.int64)] = ends
            self.levels.append((keys, word))
            alive = alive[length[alive] > depth + 1]

    def __getstate__(self) -> dict:
        """Without the words: workers only need their numbers."""
        return {**self.__dict__, "words": None}

    def matches(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in the joined texts, length, word) of every occurrence; a separator stands after each text."""
        points = _points("\0".join([*texts, ""]))
        if not self.levels:
            return (np.zeros(0, np.int64),) * 3
        codes = np.searchsorted(self.letters, points)
        known = self.letters[np.minimum(codes, len(self.letters) - 1)] == points
        known[np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1] = False
        codes = codes.astype(np.uint64)
        start, state = np.arange(len(codes)), np.zeros(len(codes), np.uint64)
        found: list[tuple[np.ndarray, ...]] = []
        for step, (keys, word) in enumerate(self.levels):
            inside = start + step < len(codes)
            inside[inside] = known[start[inside] + step]
            start, state = start[inside], state[inside]
            key = state << _LETTER | codes[start + step]
            place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            good = keys[place] == key
            start, state = start[good], place[good].astype(np.uint64)
            hit = word[place[good]]
            found.append((start[hit >= 0], np.full(int((hit >= 0).sum()), step + 1), hit[hit >= 0]))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))


def _best_path(text: str, edges: dict[int, list[tuple[int, int, object]]], runs, unknown: int, each: int) -> list[tuple]:
    """(start, end, word) of the least way; ``edges`` are (end, cost, word) by start."""
    size = len(text)
    run_end = [0] * size
    for run in runs.finditer(text):
        for place in range(*run.span()):
            run_end[place] = run.end()
    never = (1 << 60, 0, 0)
    best, by = [never] * (size + 1), [None] * (size + 1)
    best[0] = (0, 0, 0)
    for place in range(size):
        cost, tokens, _ = best[place]
        if cost >= never[0]:
            continue

        def reach(end, more, word, cost=cost, tokens=tokens, place=place):
            there = (cost + more, tokens + 1, place)
            if there < best[end]:
                best[end], by[end] = there, word

        if not run_end[place]:  # white space is passed without a token
            there = (cost, tokens, best[place][2])
            if there < best[place + 1]:
                best[place + 1], by[place + 1] = (cost, tokens, place), ()
            continue
        for end, more, word in edges.get(place, ()):
            reach(end, more, word)
        reach(place + 1, unknown + each, None)
        if run_end[place] > place + 1:
            reach(run_end[place], unknown + each * (run_end[place] - place), None)
    path, end = [], size
    while end:
        start = best[end][2]
        if by[end] != ():
            path.append((start, end, by[end]))
        end = start
    return path[::-1]


def _best_paths(texts: Sequence[str], edges: tuple[np.ndarray, ...], runs, unknown: int, each: int) -> tuple[np.ndarray, ...]:
    """The ways of :func:`_best_path` for many texts of at most ``SHORT`` code points at once, place by place:
    (text, start, end, word) of all tokens in order; ``edges`` are (text, start, length, cost, word)."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(size + 1) - size - 1
    spans = [(i, *run.span()) for i, text in enumerate(texts) for run in runs.finditer(text)]
    owner, low, high = np.array(spans, np.int64).reshape(-1, 3).T
    width = high - low
    text = np.repeat(owner, width)
    place = np.arange(len(text)) - np.repeat(np.cumsum(width) - width, width) + np.repeat(low, width)
    run_end = np.repeat(high, width)
    long = run_end > place + 1
    blank = np.ones(int(size.sum() + len(size)), bool)
    blank[begin[text] + place] = blank[begin + size] = False
    white = np.flatnonzero(blank)
    white_text = np.searchsorted(begin, white, "right") - 1
    # Words, single code points, rests of runs, and white space, which is passed without a token.
    edges = tuple(part[~blank[begin[edges[0]] + edges[1]]] for part in edges)
    ways = [
        (edges[0], edges[1], edges[1] + edges[2], edges[3].astype(np.int64), edges[4].astype(np.int64)),
        (text, place, place + 1, np.full(len(text), unknown + each), np.full(len(text), -1)),
        (text[long], place[long], run_end[long], unknown + each * (run_end - place)[long], np.full(int(long.sum()), -1)),
        (white_text, white - begin[white_text], white - begin[white_text] + 1, np.zeros(len(white), np.int64), np.full(len(white), -2)),
    ]
    of, start, end, cost, word = (np.concatenate(part) for part in zip(*ways, strict=True))
    order = np.lexsort((of, end))
    of, start, end, cost, word = (part[order] for part in (of, start, end, cost, word))
    source, target = begin[of] + start, begin[of] + end
    paid, tokens, last, by = (np.zeros(len(blank), np.int64) for _ in range(4))
    limits = np.searchsorted(end, np.arange(1, int(size.max(initial=0)) + 2))
    for low, high in zip(limits[:-1], limits[1:], strict=True):
        at = source[low:high]
        passed = word[low:high] == -2
        key = (paid[at] + cost[low:high] << 10 | tokens[at] + ~passed) << 10 | np.where(passed, last[at], start[low:high]) << 1 | (word[low:high] < 0)
        first = np.flatnonzero(np.diff(target[low:high], prepend=-1))
        least = np.minimum.reduceat(key, first)
        won = np.flatnonzero(key == np.repeat(least, np.diff(first, append=high - low)))
        there = target[low:high][won]
        paid[there], tokens[there] = least >> 20, least >> 10 & 1023
        last[there], by[there] = start[low:high][won], word[low:high][won]
    row, now = np.arange(len(texts)), size.copy()
    found = []
    while len(row := row[now[row] > 0]):
        node = begin[row] + now[row]
        found.append((row, last[node], now[row], by[node]))
        now[row] = last[node]
    if not found:
        return (np.zeros(0, np.int64),) * 4
    row, start, end, word = (np.concatenate(part) for part in zip(*found, strict=True))
    keep = word != -2
    order = np.lexsort((start[keep], row[keep]))
    return tuple(part[keep][order] for part in (row, start, end, word))


def _token_column(texts: Sequence[str], paths: Sequence[Sequence[tuple]], described: Callable[[object], tuple]) -> pa.Array:
    """An array of tokens per text from its (start, end, word), word None if unknown."""
    surface, lemma, reading, pos, starts, ends, known = ([] for _ in range(7))
    for text, path in zip(texts, paths, strict=True):
        for start, end, word in path:
            form = text[start:end]
            base, sound, tags = (form, "", []) if word is None else described(word)
            surface.append(form)
            lemma.append(base or form)
            reading.append(sound or "")
            pos.append(tags or [])
            starts.append(start)
            ends.append(end)
            known.append(word is not None)
    kind = _TOKEN_TYPE.value_type
    columns = (pa.array(c, kind.field(i).type) for i, c in enumerate((surface, lemma, reading, pos, starts, ends, known)))
    offsets = np.cumsum([0, *map(len, paths)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(list(columns), fields=list(kind)))


def _usable(dictionary: DataFrame) -> DataFrame:
    """One row per surface: the cheapest, then the least by its other columns."""
    rows = dictionary.select(
        F.col("surface").cast("string").alias("surface"), F.struct(
            F.col("cost").cast("int").alias("cost"), F.col("lemma").cast("string").alias("lemma"),
            F.col("reading").cast("string").alias("reading"), F.col("pos").cast("array<string>").alias("pos")).alias("w"))
    good = F.length("surface").between(1, LONGEST) & F.col("w.cost").isNotNull()
    return rows.where(good).groupBy("surface").agg(F.min("w").alias("w")).select("surface", "w.*")


def _fits(words: DataFrame, rows: int, size: int) -> bool:
    more = F.octet_length(F.to_json(F.struct(F.nullif("lemma", "surface").alias("lemma"), "reading", "pos")))
    width = F.length("surface") * 12 + F.octet_length("surface") + more
    counted, total = words.agg(F.count(F.lit(1)), F.coalesce(F.sum(width), F.lit(0))).first()
    return counted <= rows and total <= size


def _edges_by_join(texts: DataFrame, words: DataFrame) -> DataFrame:
    """(text, edges) of the distinct texts, by joining their substrings to the dictionary."""
    places = texts.select("text").distinct().select("text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("p"))
    pieces = places.select("text", "p", F.explode(F.sequence(
        F.lit(1), F.least(F.lit(LONGEST), F.length("text") - F.col("p") + 1))).alias("n"))
    pieces = pieces.select(F.md5("text").alias("digest"), "p", "n", F.expr("substring(text, p, n)").alias("surface"))
    edge = F.struct((F.col("p") - 1).alias("start"), "n", "cost", "lemma", "reading", "pos")
    return pieces.join(words, "surface").groupBy("digest").agg(F.collect_list(edge).alias("edges"))


def tokenize(
    df: DataFrame, dictionary: DataFrame | None = None, text: str = "text", out: str = "tokens", runs: str = tx.TOKEN,
    unknown: int = UNKNOWN, unknown_char: int = UNKNOWN_CHAR, most_rows: int = DICTIONARY_WORDS,
    most_bytes: int = DICTIONARY_BYTES,
) -> DataFrame:
    """``df`` with an array ``out`` of the tokens of each text: surface, lemma, reading, pos, start, end, known.

    Starts and ends count code points of the trimmed text. ``runs`` is the
    pattern of a run of one script; code points outside all runs are white space.
    """
    names = df.columns
    rows = df.withColumn("_trimmed", F.regexp_replace(F.coalesce(F.col(f"`{text}`"), F.lit("")), r"^\s+|\s+$", ""))
    shape = T.StructType([*df.schema.fields, T.StructField(out, T._parse_datatype_string(_TOKEN))])
    packed, words = None, None
    if dictionary is not None:
        words = _usable(dictionary)
        if _fits(words, most_rows, most_bytes):
            table = words.withColumn("lemma", F.nullif("lemma", "surface")).toArrow().sort_by("surface").combine_chunks()
            trie = Trie(table["surface"].to_pylist())
            packed = df.sparkSession.sparkContext.broadcast((trie, table["cost"].to_numpy(), table.select(["lemma", "reading", "pos"])))
        else:
            found = _edges_by_join(rows.where("_trimmed <> ''").select(F.col("_trimmed").alias("text")), words)
            rows = rows.withColumn("_digest", F.md5("_trimmed")).join(
                found.select(F.col("digest").alias("_digest"), F.col("edges").alias("_edges")), "_digest", "left")
            rows = rows.select(*[f"`{n}`" for n in names], "_trimmed", "_edges")

    def run(batches):
        pattern = regex.compile(runs)
        trie, costs, entries = packed.value if packed else (None, None, None)

        @lru_cache(1 << 16)
        def entry(word):
            return tuple(column[word].as_py() for column in entries.columns)

        described = tuple if entries is None else entry

        for batch in batches:
            texts = batch.column(len(names)).to_pylist()
            paths: list = [[(0, len(t), None)] if t else [] for t in texts]
            edges: dict[int, dict] = {}
            if trie is not None:
                size = np.array([len(t) for t in texts], np.int64)
                begins = np.cumsum([0, *(size + 1)])
                place, length, word = trie.matches(texts)
                owner = np.searchsorted(begins, place, "right") - 1
                place = place - begins[owner]
                hit = np.unique(owner)
                short = hit[size[hit] <= SHORT]
                in_short = size[owner] <= SHORT
                found = _best_paths([texts[i] for i in short], (
                    np.searchsorted(short, owner[in_short]), place[in_short], length[in_short],
                    costs[word[in_short]], word[in_short]), pattern, unknown, unknown_char)
                for i in short.tolist():
                    paths[i] = []
                for row, start, end, w in zip(short[found[0]].tolist(), *(part.tolist() for part in found[1:]), strict=True):
                    paths[row].append((start, end, w if w >= 0 else None))
                rest = ~in_short
                for row, start, n, cost, w in zip(
                        owner[rest].tolist(), place[rest].tolist(), length[rest].tolist(), costs[word[rest]].tolist(),
                        word[rest].tolist(), strict=True):
                    edges.setdefault(row, {}).setdefault(start, []).append((start + n, cost, w))
            elif batch.num_columns > len(names) + 1:
                for row, listed in enumerate(batch.column(len(names) + 1).to_pylist()):
                    for e in listed or ():
                        edges.setdefault(row, {}).setdefault(e["start"], []).append(
                            (e["start"] + e["n"], e["cost"], (e["lemma"], e["reading"], e["pos"])))
            for row, held in edges.items():
                paths[row] = _best_path(texts[row], held, pattern, unknown, unknown_char)
            yield pa.record_batch(
                [*batch.columns[:len(names)], _token_column(texts, paths, described)], schema=pa.schema(
                    [*[batch.schema.field(i) for i in range(len(names))], pa.field(out, _TOKEN_TYPE)]))

    return rows.mapInArrow(run, shape)


def with_readings(df: DataFrame, tokens: str = "tokens") -> DataFrame:
    """Tokens with reading in hiragana and Latin letters and their ideographs; signs and tokens
    without a reading have an empty one. The text's own reading is that of its tokens in order."""
    def one(t):
        sign = tx.is_symbol(t["surface"], t["pos"]) | (t["reading"] == "*")
        kana = F.when(sign, F.lit("")).otherwise(tx.katakana_to_hiragana(t["reading"]))
        return F.struct(
            t["surface"].alias("surface"), t["lemma"].alias("lemma"), t["pos"].alias("pos"), t["start"].alias("start"),
            t["end"].alias("end"), t["known"].alias("known"), kana.alias("reading_hiragana"),
            F.regexp_extract_all(t["surface"], F.lit("[㐀-鿿]"), F.lit(0)).alias("ideographs"))

    read = df.withColumn(tokens, F.transform(tokens, one))
    return read.withColumn("reading_hiragana", F.array_join(F.transform(tokens, lambda t: t["reading_hiragana"]), ""))


def token_rows(df: DataFrame, keys: Sequence[str], tokens: str = "tokens") -> DataFrame:
    """One row per token: keys, place, and the token's fields."""
    return df.select(*keys, F.posexplode(tokens).alias("pos_", "t")).select(*keys, F.col("pos_").alias("place"), "t.*")


def _located(batches):
    """Offsets of a stream of rows by text: the text first, then its tokens in order."""
    group, text, at, missing = None, "", 0, set()
    for batch in batches:
        starts, ends, hits = [], [], []
        columns = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_group", "_kind", "_text", "_surface"))
        for owner, kind, whole, surface in zip(*columns, strict=True):
            if owner != group:
                group, text, at, missing = owner, whole or "", 0, set()
            if not kind:
                continue
            place = -1 if surface in missing else text.find(surface, at)
            if place < 0:
                missing.add(surface)  # not behind here, so not behind any later end either
            starts.append(max(place, at))
            hits.append(place >= 0)
            at = starts[-1] + len(surface)
            ends.append(at)
        tokens = batch.filter(pc.equal(batch.column(batch.schema.get_field_index("_kind")), 1))
        kept = [n for n in tokens.schema.names if n not in ("_group", "_kind", "_text", "_surface")]
        yield pa.RecordBatch.from_arrays(
            [*(tokens.column(tokens.schema.get_field_index(n)) for n in kept), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()),
             pa.array(hits, pa.bool_())], [*kept, "start", "end", "found"])


def locate(
    tokens: DataFrame, texts: DataFrame, keys: Sequence[str], position: str = "pos", surface: str = "surface", text: str = "text",
) -> DataFrame:
    """``tokens`` with ``start``, ``end`` and ``found``: each is searched in its text from the end of the token before.

    A token that does not occur there stands at that end (``found`` false), and
    the search goes on behind it. Offsets count code points of the trimmed text.

    Texts and tokens meet in one shuffle by ``keys`` and pass as a sorted stream,
    so a task holds one text and one batch of tokens, however many tokens a text
    has. Null keys are a key; of several texts of a key the least counts; tokens
    of one position go by surface; without a text, or with a null one, nothing
    is found; a null or empty surface stands at the end before, found if that is
    inside the text. Columns start, end and found of the input are replaced.
    """
    tokens = tokens.drop("start", "end", "found")
    group = F.to_json(F.struct(*[F.col(f"`{k}`") for k in keys]), {"ignoreNullFields": "false"})
    trimmed = F.regexp_replace(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), r"^\s+|\s+$", "")
    rows = tokens.withColumns({
        "_group": group, "_kind": F.lit(1), "_text": F.lit(None).cast("string"),
        "_surface": F.coalesce(F.col(f"`{surface}`").cast("string"), F.lit(""))})
    wholes = texts.select(
        group.alias("_group"), F.lit(0).alias("_kind"), trimmed.alias("_text"), F.lit("").alias("_surface"))
    stream = rows.unionByName(wholes, allowMissingColumns=True).repartition("_group").sortWithinPartitions(
        "_group", "_kind", "_text", F.col(f"`{position}`"), "_surface")
    fields = [T.StructField(f.name, f.dataType) for f in tokens.schema]
    shape = T.StructType([*fields, T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("found", T.BooleanType())])
    return stream.mapInArrow(_located, shape)
