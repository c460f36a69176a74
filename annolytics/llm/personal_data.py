"""Personal data by patterns, and by contexts learned from what the patterns find.

The base patterns give entities that are certain by their form: mail addresses,
IP addresses, card numbers that pass their check digit, phone numbers. They are
the seeds of a bootstrap. A pattern is what stands next to an entity: its two
words before, or the word before and the word after; where a text begins, its
beginning stands for the missing word. An instance is an entity
or any other token that could identify somebody (one with digits or an at sign)
in such a place. Patterns and instances form a graph that Spark scores in turns:

* a pattern is as sure as the share of its different instances that are
  trusted, and counts only with enough different seeds of one kind;
* an instance is as sure as its patterns together, one being enough.

Instances of sure patterns become trusted and support further patterns, until a
turn finds no more. Then every token with a trusted value that is no base
entity is a span of its own, of the kind its patterns have, whatever stands
around it. Base spans always stay.

Everything is built-in functions: places of matches come from the lengths of
the pieces between them, so no Python runs on the rows. Every pass is over
whole texts. Words and matches are cut out of texts first, so what is grouped
and joined are slim rows; a pattern that occurs everywhere is counted by
partial sums.

Null and empty texts have no spans. Rows that repeat get a row each, and count
as one instance. Extra columns are ignored. Rows without ``doc_id`` are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import keep

KINDS = ("email", "ip", "card", "phone")

# The patterns of the four kinds. Possessive forms and the guards
# before them find the same matches without going back over long runs.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){12,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# What a text must hold for a pattern to be tried at all.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}

# A bootstrap pattern needs so many different seeds of its kind, and this share of trusted instances.
SEEDS = 5
SURE = 0.8
# Turns after which the bootstrap must have settled; it fails if it has not.
TURNS = 200
# Code points around a match in which its neighbours are looked for.
REACH = 80

# Matches of one text that are placed together.
BLOCK = 128

_DIGITS = r"[^0-9]"


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed a single time, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, value) of the matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.arrays_zip(
        F.transform(F.slice(gaps, 1, F.size(found)), lambda g: F.length(g)).alias("gap"), found.alias("value"))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def placed(block: Column, at: Column) -> Column:
        return F.aggregate(
            block, F.struct(at.alias("at"), empty.alias("spans")),
            lambda state, x: F.struct(
                (state["at"] + x["gap"] + F.length(x["value"])).alias("at"),
                F.concat(state["spans"], F.array(F.struct(
                    (state["at"] + x["gap"]).alias("start"),
                    (state["at"] + x["gap"] + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("spans")),
            lambda state: state["spans"])

    # Appending copies what is there, so matches go in blocks: widths of whole blocks are summed
    # first, and each block is placed from its own beginning.
    def blocks(matches: Column) -> Column:
        count = F.floor((F.size(matches) - 1) / BLOCK).cast("int")
        return F.transform(F.sequence(F.lit(0), count), lambda b: F.slice(matches, b * BLOCK + 1, F.lit(BLOCK)))

    def joined(parts: Column) -> Column:
        widths = F.transform(parts, lambda block: F.aggregate(block, F.lit(0), lambda a, x: a + x["gap"] + F.length(x["value"])))
        begins = F.aggregate(
            widths, F.array(F.lit(0)), lambda sums, w: F.concat(sums, F.array(F.element_at(sums, F.lit(-1)) + w)))
        return F.flatten(F.zip_with(parts, F.slice(begins, F.lit(1), F.size(parts)), placed))

    return _once(pairs, lambda p: F.when(F.size(p) > 0, _once(blocks(p), joined)).otherwise(empty))


def _ip_is_valid(value: Column) -> Column:
    def small(part: Column) -> Column:
        digits = F.ltrim(part, F.lit("0"))
        return (F.length(digits) < 3) | ((F.length(digits) == 3) & (digits <= "255"))

    return F.forall(F.split(value, r"\."), small)


def _luhn(value: Column) -> Column:
    digits = F.reverse(F.regexp_replace(value, _DIGITS, ""))
    numbers = F.transform(F.filter(F.split(digits, ""), lambda d: d != ""), lambda d: d.cast("int"))
    doubled = F.transform(numbers, lambda d, i: F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return _ip_is_valid(value)
    if kind == "card":
        return _luhn(value)
    if kind == "phone":
        return F.length(F.regexp_replace(value, _DIGITS, "")).between(9, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value), by kind as listed, then by start."""
    def of(kind: str) -> Column:
        spans = F.filter(_spans(text, PATTERNS[kind]), lambda s: _valid(kind, s["value"]))
        named = F.transform(spans, lambda s: F.struct(
            F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
        if NEEDS[kind] is None:
            return named
        none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
        return F.when(F.contains(text, F.lit(NEEDS[kind])), named).otherwise(none)

    return F.concat(*map(of, KINDS))


def _pieces(text: Column) -> Column:
    """The text in pieces of ``REACH`` code points: cutting at a place of a text counts from its beginning each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{REACH}}}"), F.lit(0))


def _cut(pieces: Column, first: Column, length: Column) -> Column:
    """``length`` code points, ``REACH`` at most, from place ``first``."""
    at = F.floor(first / REACH).cast("int")
    two = F.concat(*(F.coalesce(F.get(pieces, at + k), F.lit("")) for k in range(2)))
    return F.substr(two, first - at * REACH + 1, length)


def _neighbours(pieces: Column, start: Column, end: Column) -> tuple[Column, Column, Column]:
    """(second word before, word before, word after) within reach, lower case, "" where there is none; "^" is the text's beginning."""
    first = F.greatest(start - REACH, F.lit(0))
    before = F.filter(F.split(F.lower(_cut(pieces, first, start - first)), r"\s+"), lambda w: w != "")
    after = F.filter(F.split(F.lower(_cut(pieces, end, F.lit(REACH))), r"\s+"), lambda w: w != "")
    n = F.size(before)

    def word(words: Column, at: Column) -> Column:
        return F.when((at >= 1) & (at <= F.size(words)), F.get(words, at - 1)).otherwise(F.lit(""))

    def begins(there: Column, missing: Column) -> Column:
        return F.when((first == 0) & missing, F.lit("^")).otherwise(there)

    return begins(word(before, n - 1), n == 1), begins(word(before, n), n == 0), word(after, F.lit(1))


# Tokens that could identify somebody: at least four digits or an at sign, between white space.
_CANDIDATE = r"(?<!\S)(?=\S*(?:@|[0-9]\S*[0-9]\S*[0-9]\S*[0-9]))\S+"


def _candidates(text: Column) -> Column:
    """Such tokens as (start, end, value), without punctuation at their ends."""
    spans = _spans(text, _CANDIDATE)

    def trimmed(s: Column) -> Column:
        left = F.regexp_replace(s["value"], r"^[\p{Punct}&&[^+]]+", "")
        core = F.regexp_replace(left, r"[\p{Punct}]+$", "")
        start = s["start"] + F.length(s["value"]) - F.length(left)
        return F.struct(start.alias("start"), (start + F.length(core)).alias("end"), core.alias("value"))

    return F.filter(F.transform(spans, trimmed), lambda s: F.length(s["value"]) > 0)


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", seeds: int = SEEDS, sure: float = SURE, turns: int = TURNS) -> DataFrame:
    """(doc_id, base, added): spans (kind, start, end, value) of each row of
    ``docs``; ``added`` is null where the contexts found nothing."""
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    # One pass over the texts: base entities, other candidates, and their neighbours.
    marked = rows.select(
        "doc_id", F.xxhash64("text").alias("tie"), _pieces(F.col("text")).alias("pieces"), base_spans(F.col("text")).alias("base"),
        F.when(F.rlike("text", F.lit("[0-9@]")), _candidates(F.col("text"))).alias("tokens"))

    def clear(token: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < token["end"]) & (token["start"] < b["end"]))

    def placed(kind: Column, s: Column) -> Column:
        two, one, after = _neighbours(F.col("pieces"), s["start"], s["end"])
        return F.struct(
            kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"),
            F.filter(F.array(
                F.when((two != "") & (one != ""), F.concat_ws(" ", F.lit("<"), two, one)),
                F.when((one != "") & (after != ""), F.concat_ws(" ", F.lit("|"), one, after)),
            ), lambda p: p.isNotNull()).alias("patterns"))

    none = F.lit(None).cast("string")
    marked = keep(marked.select(
        "doc_id", "tie",
        F.concat(
            F.transform("base", lambda b: placed(b["kind"], b)),
            F.transform(F.coalesce(F.filter("tokens", clear), F.array()), lambda t: placed(none, t)),
        ).alias("spans")), "spans")

    entities = marked.select("doc_id", "tie", F.explode("spans").alias("s")).select("doc_id", "tie", "s.*")
    # Edges of the graph: which value stands in which pattern, once each.
    edges = keep(
        entities.select("kind", "value", F.explode("patterns").alias("pattern"))
        .groupBy("pattern", "value").agg(F.max("kind").alias("kind")), "edges")
    trusted = keep(entities.where("kind is not null").select("value", "kind").distinct(), "trusted")
    for _ in range(turns):
        known = edges.drop("kind").join(trusted.withColumnRenamed("kind", "of"), "value", "left")
        votes = known.groupBy("pattern").agg(
            F.countDistinct("value").alias("n"),
            *[F.count_if(F.col("of") == kind).alias(kind) for kind in KINDS])
        most = F.greatest(*KINDS)
        kind = reduce(lambda other, k: F.when(F.col(k) == most, F.lit(k)).otherwise(other), reversed(KINDS), F.lit(KINDS[0]))
        patterns = votes.where((most >= seeds) & (most >= F.lit(sure) * F.col("n"))).select(
            "pattern", kind.alias("of"), (most / F.col("n")).alias("score"))
        scored = edges.where("kind is null").join(patterns, "pattern").groupBy("value", "of").agg(
            (1 - F.product(1 - F.col("score"))).alias("score"))
        found = scored.groupBy("value").agg(F.max(F.struct("score", "of")).alias("x")).where(F.col("x.score") >= sure)
        found = found.select("value", F.col("x.of").alias("kind")).join(trusted, "value", "left_anti")
        found = keep(found, "found")
        if found.isEmpty():
            break
        trusted = trusted.unionByName(found)
    else:
        raise RuntimeError(f"contexts still give new values after {turns} turns")
    # A trusted value counts where a sure pattern surrounds it, or anywhere it stands as a token.
    extra = entities.where("kind is null").drop("kind", "patterns").distinct().join(trusted, "value")
    extra = extra.groupBy("doc_id", "tie").agg(F.array_sort(F.collect_set(F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).alias("order"), "start", "end", "kind", "value"))).alias("more"))
    extra = extra.select(
        F.col("doc_id").alias("_doc"), F.col("tie").alias("_tie"),
        F.transform("more", lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"])).alias("added"))
    base = F.transform(F.filter("spans", lambda s: s["kind"].isNotNull()), lambda s: F.struct(s["kind"], s["start"], s["end"], s["value"]))
    return marked.join(extra, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("tie") == F.col("_tie")), "left").select(
        "doc_id", base.alias("base"), "added")


def spelled(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of the spans of :func:`find`."""
    order = F.array(*map(F.lit, KINDS))
    both = F.array_sort(F.transform(
        F.concat("base", F.coalesce("added", F.array())),
        lambda s: F.struct(F.array_position(order, s["kind"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def count(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(
        "doc_id", *map(count, KINDS),
        F.sha2(spelled(F.col("base")), 256).alias("base_sha256"), spelled(both).alias("spans"))
