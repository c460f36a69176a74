"""Repair of conversations: cheapest edits that give ``(system? (user assistant)+)?``.

Faults are found row by row; then each conversation is reduced to two letters a
row (role initial and fault), and a shortest path over these letters decides
its edits. A path's weight is one integer: its high digits are the cost, its low
digits, one position an edit in base 8, the letters of the audit, the end padded
with zeros. So the plain minimum of integers finds the cheapest edits and, among
equal costs, the audit that sorts first; nothing else is compared. Edits are
Delete, Insert, Keep and Rerole, whose initials sort as their digits do.

From a state of the pattern a letter leads to one state only. Rows go in blocks
of ``BLOCK``: a pass of plain costs from the end gives the cost at each block's
border, and the integers of a block then need only that block's digits. Two
paths of one block cover the same rows, so neither audit begins the other and
the block that they differ in decides. Integers stay short for any length.

Rows are numbered by the range-split index of ``plans.skew``; copies are found
by their first row (combined before the shuffle); letters are joined in chunks
first; kept texts are joined to their edits by row, and digests are streams. What
meets for one conversation is two letters a row, which is less than its audit
and cost may take; no task holds the texts of a conversation.

Order is by turn (null first), then role, then text. Null roles and texts are
one space. Rows without conv_id are one conversation. Turn gaps ignore null
turns. Roles count by their first letter, s, u or a; others can only be reroled
or deleted. A conversation of which no row is left has no report; an empty
table has none at all. Repeated rows are copies of each other, all but the first
duplicates. Other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import keep, own_rows
from annolytics.plans.skew import ordered_index

SPACE = " \t\n\x0b\x0c\r"
# Fixed values of the repair: costs of the edits, the extra cost of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
# Digits of the audit letters; 0 is the end.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
LETTERS = " DIKR"
# States of the pattern: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
GIVEN = (USER, USER, ASSISTANT, USER)  # the only role that may be written next
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLES = {USER: "user", ASSISTANT: "assistant"}
NEVER = 1 << 40
# Rows of one block of integers, rows of one chunk of letters.
BLOCK = 128
CHUNK = 1024


class Plan(NamedTuple):
    """The cheapest edits of one conversation."""

    cost: int
    audit: str
    lines: list[tuple[int | None, str | None]]  # (row kept or None, role written or None) in order


def _edges(state: int, initial: str, fault: str) -> Iterator[tuple[str, int, int]]:
    """(letter, cost, next state) of the edits of one row."""
    yield "D", DELETE, state
    if fault in "kt":
        late = TRUNCATED if fault == "t" else 0
        if initial in KEPT[state]:
            yield "K", late, KEPT[state][initial]
        yield "R", REROLE + late, GIVEN[state]


def _with_inserts(values: list[int], insert) -> list[int]:
    """Up to two inserts before what ``values`` stand for; a third would only come back to a state."""
    best = values
    for _ in range(2):
        best = [min(value, insert(best[GIVEN[state]])) for state, value in enumerate(values)]
    return best


def _borders(codes: str, block: int) -> list[list[int]]:
    """Least cost to the end from each state, before each block and at the end."""
    rows = len(codes) // 2
    end = [0 if state in (START, ASSISTANT) else NEVER for state in range(4)]
    cost = _with_inserts(end, lambda value: value + INSERT)
    found = [cost]
    for row in range(rows - 1, -1, -1):
        initial, fault = codes[2 * row], codes[2 * row + 1]
        kept = [min(c + cost[to] for _, c, to in _edges(state, initial, fault)) for state in range(4)]
        cost = _with_inserts(kept, lambda value: value + INSERT)
        if row % block == 0:
            found.append(cost)
    return found[::-1]


def _block_weights(codes: str, after: list[int] | None, width: int) -> list[int]:
    """Least weight from each state over one block; ``after`` is None for the end of the conversation."""
    low, top = 3 * width, 3 * (width - 1)
    mask = (1 << low) - 1

    def step(letter: str, cost: int, value: int) -> int:
        return (cost << low) + (DIGITS[letter] << top) + (value >> low << low) + ((value & mask) >> 3)

    def insert(value: int) -> int:
        return step("I", INSERT, value)

    if after is None:
        value = _with_inserts([0 if state in (START, ASSISTANT) else NEVER << low for state in range(4)], insert)
    else:
        value = [cost << low for cost in after]
    for row in range(len(codes) // 2 - 1, -1, -1):
        initial, fault = codes[2 * row], codes[2 * row + 1]
        kept = [min(step(letter, c, value[to]) for letter, c, to in _edges(state, initial, fault)) for state in range(4)]
        value = _with_inserts(kept, insert)
    return value


def plan(codes: str, block: int = BLOCK) -> Plan:
    """The cheapest edits for a conversation of two letters a row: s, u, a or x, and the
    fault: k none, t truncated, b blank, d duplicate."""
    rows = len(codes) // 2
    borders = _borders(codes, block)
    state, row, audit, lines = START, 0, [], []
    last = max(0, rows - 1) // block
    for number in range(last + 1):
        part = codes[2 * block * number:2 * block * (number + 1)]
        width = 3 * (len(part) // 2) + 3
        weight = _block_weights(part, None if number == last else borders[number + 1], width)[state]
        for place in range(width - 1, -1, -1):
            digit = weight >> 3 * place & 7
            if not digit:
                break
            letter = LETTERS[digit]
            audit.append(letter)
            if letter == "K":
                lines.append((row, None))
                state = KEPT[state][codes[2 * row]]
            elif letter != "D":
                state = GIVEN[state]
                lines.append((None if letter == "I" else row, ROLES[state]))
            row += letter != "I"
    return Plan(borders[0][START], "".join(audit), lines)


def illegal_pairs(codes: str) -> int:
    """Neighbouring rows whose role initials do not follow each other."""
    initials = codes[::2]
    return sum(initials[i:i + 2] not in ("su", "ua", "au") for i in range(len(initials) - 1))


# -- tables --------------------------------------------------------------------


def _key(conv_id: Column) -> Column:
    """One text per conversation; rows without an id share one."""
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def turns(conversations: DataFrame) -> DataFrame:
    """(key, conv_id, turn, role, text) with null roles and texts as one space."""
    rows = own_rows(conversations, "conv_id", "turn", "role", "text")
    return rows.select(
        _key(F.col("conv_id")).alias("key"), "conv_id", F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows of :func:`turns` with faults put in, by a checksum of conversation and turn."""
    named = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.col("kind")
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.withColumn("kind", F.crc32(named) % 20).where("kind <> 0").select(
        "key", "conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")


def with_faults(rows: DataFrame) -> DataFrame:
    """Rows of :func:`turns` with ``place`` (from 1) and ``code``: role initial and first fault."""
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    placed = keep(ordered_index(rows, ["key"], order, "place"), "placed")
    shown = F.rtrim("text", F.lit(SPACE))
    slim = placed.select(
        "key", "place", "role", F.md5("text").alias("digest"),
        F.when(F.length(shown) == 0, "b").when(F.right(shown, F.lit(1)).isin(".", "!", "?"), "k").otherwise("t").alias("fault"))
    first = slim.groupBy("key", "role", "digest").agg(F.min("place").alias("place")).select("key", "place", F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when((F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(F.col("fault"))
    codes = slim.join(first, ["key", "place"], "left").select("key", "place", F.concat(
        F.when(initial.isin("s", "u", "a"), initial).otherwise("x"), fault).alias("code"))
    return placed.join(codes, ["key", "place"])


class Repair(NamedTuple):
    report: DataFrame  # key, conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit
    lines: DataFrame  # key, conv_id, position, place, role, text


def _joined(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.array_join(F.transform(parts, lambda p: p["t"]), "").alias(text))


def repair(rows: DataFrame) -> Repair:
    """Report and repaired lines of every conversation in ``rows`` (as of :func:`turns`)."""
    placed = keep(with_faults(rows), "faults")
    chunks = placed.select("key", F.floor((F.col("place") - 1) / CHUNK).alias("chunk"), "place", "code")
    codes = _joined(_joined(chunks, ["key", "chunk"], "place", "code"), ["key"], "chunk", "code")

    def edits(batches):
        names = ["key", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "position", "place", "role"]
        kinds = [pa.string(), *[pa.int64()] * 5, pa.string(), pa.int64(), pa.int64(), pa.string()]
        out = []

        def flush():
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
            out.clear()
            return batch

        for batch in batches:
            for key, code in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                best, faults = plan(code), code[1::2]
                out.append((key, *map(faults.count, "bdt"), illegal_pairs(code), best.cost, best.audit, None, None, None))
                for position, (place, role) in enumerate(best.lines):
                    out.append((key, *[None] * 6, position, None if place is None else place + 1, role))
                    if len(out) >= 10_000:
                        yield flush()
        if out:
            yield flush()

    made = keep(codes.select("key", "code").mapInArrow(
        edits, "key string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
               "position long, place long, role string"), "edits")
    spans = placed.groupBy("key").agg(
        F.first("conv_id").alias("conv_id"),
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"))
    report = made.where("position is null").drop("position", "place", "role").join(spans, "key").select(
        "key", "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    written = made.where("position is not null").select("key", "position", "place", F.col("role").alias("new_role"))
    lines = written.join(placed.select("key", "place", "role", "text"), ["key", "place"], "left").select(
        "key", "position", "place", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return Repair(report, lines)
