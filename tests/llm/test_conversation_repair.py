"""Conversation repair against enumerated edits and a plain Python reading of the contract."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest

from annolytics.llm import conversation_repair, oracles, queries

SCHEMA = "conv_id long, turn long, role string, text string, key string, place int, code string, kind int"
COST = {"D": 4, "I": 3, "K": 0, "R": 3}


def enumerated(codes: str) -> tuple[int, str]:
    """(cost, audit) by trying every choice per row and every number of inserts per gap."""
    rows = [codes[i:i + 2] for i in range(0, len(codes), 2)]
    found = []
    for inserts in itertools.product(range(3), repeat=len(rows) + 1):
        slots = [[["I"]] * inserts[0]]
        for row, more in zip(rows, inserts[1:], strict=True):
            options = ["D"] + (["K", "R"] if row[1] in "kt" else [])
            slots.append([options])
            slots.append([["I"]] * more)
        choices = [o for slot in slots for o in slot]
        for audit in itertools.product(*choices):
            # Written roles are free, so only kept initials bind: fill the others by the pattern.
            places, row = [], 0
            for letter in audit:
                if letter in "KR":
                    places.append(rows[row][0] if letter == "K" else "?")
                elif letter == "I":
                    places.append("?")
                row += letter != "I"
            want = ["ua" * len(places), "s" + "ua" * len(places)]
            legal = not places or any(
                (len(places) - o) % 2 == 0 and len(places) > o and all(p == w or (p == "?" and w != "s") for p, w in zip(places, pattern, strict=False))
                for o, pattern in enumerate(want))
            if legal:
                late = sum(3 for letter, r in zip([x for x in audit if x != "I"], rows, strict=True) if letter != "D" and r[1] == "t")
                found.append((sum(COST[x] for x in audit) + late, "".join(audit)))
    return min(found)


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_every_short_conversation(n):
    letters = [a + b for a in "suax" for b in "ktb"]
    for rows in itertools.product(letters, repeat=n):
        if n == 3 and random.Random("".join(rows)).random() > 0.08:
            continue
        plan = conversation_repair.plan("".join(rows))
        assert (plan.cost, plan.audit) == enumerated("".join(rows)), rows


def test_blocks_change_nothing():
    rng = random.Random(2)
    for n in (1, 5, 64, 129, 400):
        for _ in range(10):
            codes = "".join(rng.choice("suuuaaax") + rng.choice("kkkktbd") for _ in range(n))
            whole = conversation_repair.plan(codes, 10_000)
            assert whole == conversation_repair.plan(codes, 1) == conversation_repair.plan(codes, 7) == conversation_repair.plan(codes)


def test_a_very_long_conversation_takes_time_by_its_length():
    plan = conversation_repair.plan("uksk" * 20_000 + "ub" * 20_000)
    assert plan.audit.count("D") + plan.audit.count("K") + plan.audit.count("R") == 60_000


def written(role, audit, rows):
    """Repaired lines of an audit."""
    out, state, at = [], "", 0
    for letter in audit:
        now = "assistant" if state == "u" else "user"
        if letter == "I":
            out.append((now, ""))
        elif letter == "K":
            out.append(rows[at])
        elif letter == "R":
            out.append((now, rows[at][1]))
        if letter != "D":
            state = out[-1][0][:1]
        at += letter != "I"
    return out


def contract(table):
    """{conv_id: row of op13} read off the contract."""
    found, turns = {}, defaultdict(list)
    for conv, turn, role, text in table:
        turns[conv]
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        turns[conv] += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    for conv, rows in turns.items():
        rows = sorted(rows)
        codes, seen = "", set()
        for _, _, role, text in rows:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = "b" if not shown else "d" if (role, text) in seen else "k" if shown[-1] in ".!?" else "t"
            seen.add((role, text))
            codes += (role[:1] if role[:1] in ("s", "u", "a") else "x") + fault
        numbers = [t for known, t, _, _ in rows if known]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        initials = [r[2][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        plan = conversation_repair.plan(codes)
        lines = written(None, plan.audit, [(r[2], r[3]) for r in rows])
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in lines).encode()).hexdigest()
        found[conv] = (gaps, *map(codes[1::2].count, "bdt"), illegal, plan.cost, plan.audit, digest)
    return found


COLUMNS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def invented():
    rng = random.Random(13)
    rows = []
    for conv in range(60):
        for turn in range(rng.choice([1, 2, 5, 9])):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "system", "tool", None, ""]),
                         rng.choice(["Yes.", "no", "é!", None, "", " \t", "Why? \n", "a.b", "\x1c", "Yes."])))
    return [*rows, (None, 1, "user", "x."), (None, None, "assistant", "y"), (90, 4, "user", "long. " * 50_000), (90, 4, "user", "long. " * 50_000)]


def folder_of(spark, rows, path):
    spark.createDataFrame([(*r, "k", 1, "c", 2) for r in rows], SCHEMA).write.parquet(f"{path}/conversations.parquet")
    return str(path)


def test_query_on_awkward_rows(spark, tmp_path):
    rows = invented()
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversation_repair(spark, folder_of(spark, rows, tmp_path)).collect()}
    assert got == contract(rows)


def test_empty_table(spark, tmp_path):
    assert queries.op13_conversation_repair(spark, folder_of(spark, [], tmp_path)).collect() == []


def test_query_and_lines_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in queries.op13_conversation_repair(spark, folder).collect()}
    assert got == contract(rows)
    lines = defaultdict(list)
    for r in conversation_repair.repair(conversation_repair.damaged(conversation_repair.turns(table))).lines.orderBy("position").collect():
        lines[r.key].append(r.role)
    for roles in lines.values():
        assert re.fullmatch("s?(ua)+", "".join(r[0] for r in roles))


def test_sql_text_agrees_with_the_contract():
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = invented()
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    names = [d[0] for d in con.execute(oracles.CONVERSATION_REPAIR).description]
    got = {r[0]: r[1:] for r in con.execute(oracles.CONVERSATION_REPAIR).fetchall()}
    assert names[1:] == COLUMNS and got == contract(rows)
