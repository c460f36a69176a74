"""Similarity join of documents on word shingles, filtered under several token orders.

Two documents link when the Jaccard similarity of their shingle sets reaches
the threshold. Sorted by any order all documents share, two linked sets have a
token in common among the first ``n - ceil(threshold * n) + 1`` of each. One
order alone lets many pairs through; here a pair must pass under every one of
several orders before its sets are compared.

* All orders put frequent shingles last, so passages that many documents share
  hardly ever make candidates. Frequencies are lower bounds counted over all
  documents (shingles that recur within a window of some million), summed in
  one small shuffle; the table used is bounded and any table gives whole results.
* The first order makes candidates with one shuffle of (token, set) rows. Equal
  sets are one node, so exact copies cost nothing. Its prefixes are longer by
  one token in 16, and a pair must share that many and one more, so pairs that
  meet in a stray passage end there.
* Candidates are verified in two steps. The sets of a token first meet a few hubs
  of its own, from the middle of the group where there is one: that is linear at any
  size and joins most of a large group of near copies into one component. Then
  pairs of *different* components that share enough tokens are taken, all of
  them, so no link between components is lost.
* The other orders are tested on the sets of a candidate pair, then the sets
  are intersected.

Null or empty texts, and texts of white space, have no shingles and link with
nothing. Rows that repeat, or share a ``doc_id``, are rows like any other: one
result row each. The result is classes: links inside a component are not all
established, so there is no number of links per document. A null ``doc_id`` keeps its row; its component is the least
doc_id it reaches, or null. Other columns of the input are ignored, whatever
they are called.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.llm.shared import Bitmap, components, keep, small_batches, spare_names
from annolytics.llm.words import mix, shingle_sets, slices, split_words

WIDTH = 5
SIMILARITY = Fraction(4, 5)
ORDERS = 3
# Shingles counted together before those that recur are passed on, and how often they must recur.
WINDOW = 4_000_000
RECURS = 4
# Largest table of frequent shingles that orders the rest (12 bytes each).
FREQUENT = 1 << 17
# One token in this many is added to the first order's prefixes; so many more must be shared.
LONGER = 16
# Hubs that the nodes of a token meet in a round, and rounds before the rest is taken pair by pair.
HUBS = 3
ROUNDS = 1


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batch's rows and their sets, in slices of bounded size."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index("text"))
        for first, texts in slices(column):
            yield batch.slice(first, len(texts)), list(shingle_sets(split_words(texts, lower=True), width))


def _recurring(held: list[np.ndarray]) -> pa.RecordBatch:
    token, count = np.unique(np.concatenate(held), return_counts=True)
    often = count >= RECURS
    return pa.record_batch([pa.array(token[often].view(np.int64)), pa.array(count[often].astype(np.int64))], ["token", "n"])


def frequent_shingles(docs: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted shingles, level of each): the most frequent ones, at most ``FREQUENT``.

    The level is four times the binary logarithm of the count, at most 255.
    """
    def count(batches):
        held, total = [], 0
        for _, sets in _sets(batches, width):
            held += sets
            total += sum(map(len, sets))
            if total >= WINDOW:
                yield _recurring(held)
                held, total = [], 0
        if held:
            yield _recurring(held)

    level = F.least(F.floor(4 * F.log2("n")), F.lit(255)).cast("int")
    counted = keep(
        docs.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
        .select("token", level.alias("level")), "frequent")
    sizes = sorted(((r["level"], r["count"]) for r in counted.groupBy("level").count().collect()), reverse=True)
    lowest, total = 256, 0
    for value, size in sizes:
        if total + size > FREQUENT:
            break
        lowest, total = value, total + size
    table = counted.where(F.col("level") >= lowest).toArrow()
    token = table["token"].to_numpy().view(np.uint64)
    place = np.argsort(token)
    return token[place], table["level"].to_numpy()[place].astype(np.uint64)


def _ranks(tokens: np.ndarray, order: int, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sort key of each token under one order: frequent ones last, the rest by a hash of their own."""
    keys, levels = frequent
    rank = mix(tokens, order + 1) >> np.uint64(8)
    if len(keys):
        at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
        rank |= np.where(keys[at] == tokens, levels[at], np.uint64(0)) << np.uint64(56)
    return rank


def _prefix(tokens: np.ndarray, order: int, frequent, similarity: Fraction, more: int = 0) -> np.ndarray:
    n = len(tokens)
    size = n + (-n * similarity.numerator // similarity.denominator) + 1 + more
    ranks = _ranks(tokens, order, frequent)
    if size < n:
        some = np.argpartition(ranks, size - 1)[:size]
        tokens, ranks = tokens[some], ranks[some]
    return tokens[np.argsort(ranks)]


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def _node(tokens: np.ndarray) -> int:
    """Fingerprint of a whole set, the same for equal sets."""
    total = np.sum(mix(tokens, 99), dtype=np.uint64) ^ mix(np.array([len(tokens)]), 98)[0]
    return int(total.view(np.int64))


def _linked(x: np.ndarray, y: np.ndarray, frequent, similarity: Fraction, orders: int) -> bool:
    top, bottom = similarity.numerator, similarity.denominator
    if bottom * min(len(x), len(y)) < top * max(len(x), len(y)):
        return False
    for order in range(1, orders):
        if not _shared(_prefix(x, order, frequent, similarity), _prefix(y, order, frequent, similarity)):
            return False
    both = _shared(x, y)
    return bottom * both >= top * (len(x) + len(y) - both)


def _distinct_sets(keys: pa.Array, texts: pa.Array, width: int) -> dict[int, np.ndarray]:
    """Set of each distinct fingerprint in ``keys`` whose text really has it."""
    rows: dict[int, list[int]] = {}
    for row, key in enumerate(keys.to_pylist()):
        rows.setdefault(key, []).append(row)
    found, turn = {}, 0
    while rows:  # once, unless a text stands for a set that is not its own
        taken = texts.take(pa.array([of[turn] for of in rows.values()], pa.int64()))
        sets = {}
        for start, part in slices(taken):
            for at, tokens in enumerate(shingle_sets(split_words(part, lower=True), width), start):
                sets[at] = tokens
        found |= {key: sets[at] for at, key in enumerate(rows) if _node(sets[at]) == key}
        turn += 1
        rows = {key: of for key, of in rows.items() if key not in found and turn < len(of)}
    return found


def _verified(pairs: DataFrame, texts: DataFrame, shared, width: int, similarity: Fraction, orders: int) -> DataFrame:
    """The (a, b) of ``pairs`` (a, b, a_text, b_text) that are similar enough.

    Only texts that some pair names are moved; a filter of fixed size drops the
    others before the shuffle.
    """
    spark = texts.sparkSession
    named = pairs.select(F.col("a_text").alias("row")).unionByName(pairs.select(F.col("b_text").alias("row")))
    held = spark.sparkContext.broadcast(Bitmap.of(named, "row"))

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.has(batch.column(2).to_numpy()))).select([0, 1])

    def compare(batches):
        for batch in batches:
            a, b = batch.column(0), batch.column(1)
            left = _distinct_sets(a, batch.column(2), width)
            right = _distinct_sets(b, batch.column(3), width)
            good = [
                x in left and y in right and _linked(left[x], right[y], shared.value, similarity, orders)
                for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)
            ]
            yield pa.record_batch([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    moved = texts.select("row", "text", Bitmap.place("row").alias("place")).mapInArrow(pick, "row long, text string")
    found = (
        pairs.join(moved.select(F.col("row").alias("b_text"), F.col("text").alias("right")), "b_text")
        .join(moved.select(F.col("row").alias("a_text"), F.col("text").alias("left")), "a_text")
        .select("a", "b", "left", "right")
    )
    return found.mapInArrow(compare, "a long, b long").distinct()


def _row(key: str, text: str) -> Column:
    """Name of a row, the same for rows of equal key and text only."""
    return F.xxhash64(F.col(f"`{key}`").cast("long"), F.col(f"`{text}`").cast("string"))


def similarity_classes(
    docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = WIDTH,
    similarity: Fraction = SIMILARITY, orders: int = ORDERS,
) -> DataFrame:
    """One row per row of ``docs``: (doc_id, n_shingles, component_id).

    ``component_id`` is the smallest key that chains of links reach.
    """
    return _classes(docs, text, key, width, similarity, orders).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` without copies: of each class the row with the least key
    (of rows that share it, one), and every row without shingles."""
    doc, name, least = spare_names(docs, "_doc", "_row", "_first")
    classes = _classes(docs, text, key, WIDTH, SIMILARITY, ORDERS).where("n_shingles > 0").select("doc_id", "row", "head")
    classes = keep(
        classes.groupBy("doc_id", "row").agg(F.max(F.col("row") != F.col("head.row")).alias("gone"), F.count(F.lit(1)).alias("copies"))
        .where("gone or copies > 1").select(F.col("doc_id").alias(doc), F.col("row").alias(name), "gone"), "copies")
    same = F.col(f"`{key}`").cast("long").eqNullSafe(F.col(doc)) & (_row(key, text) == F.col(name))
    single = docs.join(classes.select(doc, name), same, "left_anti")
    repeated = classes.where("not gone").select(doc, name)
    if repeated.isEmpty():
        return single
    first = docs.join(repeated, same).groupBy(doc, name).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias(least))
    return single.unionByName(first.select(f"{least}.*"))


def _meetings(crossing: DataFrame, similarity: Fraction, needed: str) -> DataFrame:
    """Rows (token, a, a_n, b, b_n) that hold every pair of different components that may link.

    Two bounds hold at the first token that a pair shares, so only there and shortly after it
    do the two meet. The smaller of two linked sets has one in a shorter prefix: what they
    share is at least 2 s / (1 + s) of it. And all the tokens they need in common come
    from this one on, in both prefixes: a passage that is too short for that joins nothing.
    """
    top, bottom = similarity.numerator, similarity.denominator
    left, right = (
        crossing.select("token", F.col("node").alias(side), F.col("n").alias(f"{side}_n"), F.col("pos").alias(f"{side}_pos"),
            F.col("rest").alias(f"{side}_rest"), F.col("component").alias(f"{side}_c"))
        for side in ("a", "b"))
    left = left.where(f"a_pos < a_n - ceil({2 * top} * a_n / {top + bottom}) + 1")
    met = left.join(right, "token").where("a_c <> b_c and (a_n < b_n or (a_n = b_n and a < b))")
    return met.where(f"least(a_rest, b_rest) >= {needed}")


def _classes(docs: DataFrame, text: str, key: str, width: int, similarity: Fraction, orders: int) -> DataFrame:
    """The rows of :func:`similarity_classes` with ``row``, the row's name, and ``head``,
    the (none, doc_id, row) that stands for its class."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), _row(key, text).alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    shared = spark.sparkContext.broadcast(frequent_shingles(texts.select("text"), width))

    def describe(batches):
        for rows, sets in _sets(batches, width):
            first = [_prefix(s, 0, shared.value, similarity, len(s) // LONGER).view(np.int64) for s in sets]
            ends = np.cumsum([0, *map(len, first)]).astype(np.int32)
            yield pa.record_batch(
                [rows.column(0), rows.column(1), pa.array([_node(s) for s in sets], pa.int64()),
                 pa.array([len(s) for s in sets], pa.int64()),
                 pa.ListArray.from_arrays(ends, np.concatenate(first))],
                ["doc_id", "row", "node", "n", "tokens"])

    described = keep(texts.mapInArrow(describe, "doc_id long, row long, node long, n long, tokens array<long>"), "sets")
    documents = described.select("doc_id", "row", "node", "n")

    # Candidates of the first order: tokens that two different sets have in their prefix.
    rows = described.select("node", "n", F.posexplode("tokens").alias("pos", "token")).repartition("token")
    # Both sides read one exchange: the bounds on n and pos hold always, and keep its columns alike.
    tokens = rows.groupBy("token").agg(
        F.min("node").alias("least"), F.max("node").alias("most"), F.min("n").alias("n"), F.min("pos").alias("pos"))
    tokens = tokens.where("least < most and n > 0 and pos >= 0").select("token")
    rows = keep(rows.join(tokens, "token").distinct(), "candidates")
    # Of each set its prefix tokens that others share, and a row whose text stands for it.
    found = rows.groupBy("node").agg(F.max("n").alias("n"), F.collect_list("token").alias("tokens"))
    chosen = keep(found.join(described.groupBy("node").agg(F.min("row").alias("row")), "node"), "chosen")
    top, bottom = similarity.numerator, similarity.denominator

    def beyond(n: str) -> str:
        """Tokens of a set after its prefix."""
        return f"greatest(0, ceil({top} * {n} / {bottom}) - 1 - {n} div {LONGER})"

    # What two linked sets share in their prefixes: of the tokens they have in common at most
    # the smaller prefix's rest lies beyond both.
    needed = f"ceil({top} * (a_n + b_n) / {top + bottom}) - greatest({beyond('a_n')}, {beyond('b_n')})"

    def named(pairs: DataFrame) -> DataFrame:
        """Pairs that share enough of their prefixes, with the rows whose texts stand for their sets."""
        for side in ("a", "b"):
            pairs = pairs.join(chosen.select(
                F.col("node").alias(side), F.col("row").alias(f"{side}_text"), F.col("n").alias(f"{side}_n"),
                F.col("tokens").alias(f"{side}_tokens")), side)
        pairs = pairs.where(F.size(F.array_intersect("a_tokens", "b_tokens")) >= F.expr(needed))
        return keep(pairs.select("a", "b", "a_text", "b_text"), "pairs")

    def near(pairs: DataFrame, more: int) -> DataFrame:
        """Distinct (a, b) of one row per shared token (a, a_n, b, b_n) that fit in size; with
        ``more`` they share one token and one in ``more`` of the smaller set."""
        return (
            pairs.where(f"{bottom} * least(a_n, b_n) >= {top} * greatest(a_n, b_n)")
            .groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min(F.least("a_n", "b_n")).alias("n"))
            .where("true" if not more else f"shared > n div {more}").select("a", "b")
        )

    def split(label: DataFrame | None) -> DataFrame:
        """(token, node, n, pos, component, rest, cross, nodes) of tokens that join different
        components; ``cross`` counts the pairs of nodes such a token would make,
        ``rest`` the prefix tokens from this one on that a node shares with any other."""
        found = rows.withColumn("component", F.col("node"))
        if label is not None:
            found = rows.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        onwards = Window.partitionBy("node").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
        found = found.select("token", "node", "n", "pos", "component", F.count(F.lit(1)).over(onwards).alias("rest"))
        each = found.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("token").agg(
            F.sum("k").alias("nodes"), F.sum(F.col("k") * F.col("k")).alias("own"))
        each = each.select("token", "nodes", ((F.col("nodes") * F.col("nodes") - F.col("own")) / 2).alias("cross")).where("cross > 0")
        return keep(found.join(each, "token"), "split")

    # The nodes of a token meet a few hubs of it first. Sets made of shared tokens alone stand in the middle of their group; most hubs are such.
    links, label = None, None
    crossing = split(None)
    for turn in range(ROUNDS):
        if crossing.isEmpty():
            break
        crowded = crossing.join(chosen.select("node", (F.size("tokens") / F.col("n")).alias("middle")), "node")
        chance = [F.pmod(F.xxhash64("node", F.lit(turn * HUBS + k)), F.lit(1000)) / 1000 for k in range(HUBS)]
        draw = [
            F.max(F.struct((F.col("middle") * (1 - 0.05 * k * u) if 2 * k < HUBS else u).alias("by"), "node", "n", "component"))
            for k, u in enumerate(chance)]
        hubs = crowded.groupBy("token").agg(F.array(*draw).alias("hubs"))
        met = crowded.join(hubs, "token").select("node", "n", "component", F.explode(F.array_distinct("hubs")).alias("hub"))
        star = near(met.where("component <> hub.component").select(
            F.col("hub.node").alias("a"), F.col("hub.n").alias("a_n"), F.col("node").alias("b"), F.col("n").alias("b_n")), LONGER)
        star = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        more = keep(_verified(named(star), texts, shared, width, similarity, orders), "links")
        if more.isEmpty():
            break
        links = more if links is None else links.unionByName(more)
        label = components(links)
        crossing = split(label)

    # All pairs of different components that share enough tokens.
    rest = near(_meetings(crossing, similarity, needed), 0)
    more = keep(_verified(named(rest), texts, shared, width, similarity, orders), "links")
    links = more if links is None else links.unionByName(more)
    label = components(links)

    placed = (
        documents.join(label, "node", "left")
        .withColumn("component", F.when(F.col("n") > 0, F.coalesce("component", "node")))
    )
    least = placed.where("n > 0").groupBy("component").agg(
        F.min("doc_id").alias("component_id"),
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("head"))
    return placed.join(least, "component", "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        "row", "head",
    )


ORACLE = """
with recursive d as (
    select doc_id, unnest(words) as word, generate_subscripts(words, 1) as i, len(words) as n
    from (select doc_id, list_filter(regexp_split_to_array(
              translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as words from documents)
), g as (
    select doc_id, i, n, concat_ws(' ', word, lead(word, 1) over w, lead(word, 2) over w, lead(word, 3) over w, lead(word, 4) over w) as shingle
    from d window w as (partition by doc_id order by i)
), s as (
    select distinct doc_id, shingle from g where i <= n - 4 or (n < 5 and i = 1)
), t as (
    select doc_id, shingle, count(*) over (partition by doc_id) as n from s
), p as (
    select a.doc_id as a, b.doc_id as b from t a join t b on a.shingle = b.shingle and a.doc_id <> b.doc_id
    group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), r as (
    select doc_id, doc_id as other from documents
    union
    select r.doc_id, p.b from r join p on p.a = r.other
)
select c.doc_id, coalesce(z.n, 0) as n_shingles, c.component_id
from (select doc_id, min(other) as component_id from r group by doc_id) c
left join (select doc_id, count(*) as n from s group by doc_id) z using (doc_id)
"""
