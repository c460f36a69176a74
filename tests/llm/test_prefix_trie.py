"""The prefix trie against a trie of Python dictionaries."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from annolytics.llm import oracles, prefix_trie, queries

SCHEMA = "conv_id long, turn long, role string, text string, path string, head int, n long, least long"


def plain(sequences):
    """Rows of the contract for {conv_id: [(role, text), ...]}."""
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for conv, turns in sequences.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
            if d:
                kids[tuple(turns[:d - 1])].add(tuple(turns[:d]))
        ends[tuple(turns)].append(conv)
    done = {}
    for node in sorted(members, key=len, reverse=True):
        below = [done[k] for k in kids[node]]
        n = len(members[node])
        own = (n - 1) * len(node[-1][1].encode()) if node else 0
        done[node] = (sum(b[0] for b in below) or 1, own + sum(b[1] for b in below))
    return sorted(
        (min(members[k]), len(k), min(members[k[:-1]]) if k else None, len(members[k]), len(kids[k]), *done[k],
         hashlib.sha256(",".join(map(str, sorted(ends[k]))).encode()).hexdigest()) for k in members)


def collected(frame):
    return sorted(map(tuple, frame.collect()))


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)


def by_turn(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            found[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return found


def invented(seed: int, many: int):
    """Shared beginnings, copies and a long common head."""
    rng = random.Random(seed)
    rows = []
    for conv in range(many):
        head = [("system", "same é beginning")] * rng.choice([0, 0, 5]) if conv % 3 else [("user", "hello")] * 7
        tail = [(rng.choice(["user", "assistant"]), rng.choice("abc")) for _ in range(rng.choice([0, 1, 2, 3, 6]))]
        rows += [(conv * 5 - 40, i, r, t) for i, (r, t) in enumerate(head + tail)] or [(conv * 5 - 40, None, None, None)]
    return rows


@pytest.mark.parametrize("limit", [1, 4, 10_000])
def test_bursting_changes_nothing(spark, limit):
    rows = invented(limit, 90)
    want = plain({c: [x[2:] for x in sorted(v)] for c, v in by_turn(rows).items()})
    got = collected(prefix_trie.build(prefix_trie.paths(table(spark, rows)), limit))
    assert got == want


def test_a_long_shared_beginning_is_one_round(spark):
    rows = [(c, i, "user", f"t{i}") for c in range(8) for i in range(200)] + [(c, 200, "assistant", str(c)) for c in range(8)]
    rows += [(20, i, "user", f"t{i}") for i in range(200)]
    want = plain({c: [x[2:] for x in sorted(v)] for c, v in by_turn(rows).items()})
    assert collected(prefix_trie.build(prefix_trie.paths(table(spark, rows)), 3)) == want


def test_awkward_rows(spark):
    rows = [(1, None, None, None), (1, 2, "user", ""), (1, 2, "user", ""), (2, None, "", ""), (2, 2, "user", None),
            (None, 1, "user", "x"), (3, 1, "us", "erx"), (4, 1, "user", "x"), (-7, 5, "user", "é" * 50_000), (-7, None, "a", "b")]
    want = plain({c: [x[2:] for x in sorted(v)] for c, v in by_turn(rows).items()})
    assert collected(prefix_trie.build(prefix_trie.paths(table(spark, rows)))) == want


def test_empty_table_and_turnless_conversation(spark):
    assert prefix_trie.build(prefix_trie.paths(table(spark, []))).collect() == []
    lone = spark.range(3).select(F.col("id").alias("conv_id"), F.unhex(F.lit("")).alias("path"))
    assert collected(prefix_trie.build(lone)) == plain({0: [], 1: [], 2: []})


def rebuilt(found):
    out = {}
    for conv in found:
        h = zlib.crc32(str(conv).encode()) % 9
        out[conv] = found.get(conv - int(conv - 5 * int(conv / 5)), [])[:h] + found[conv][h:]
    return out


def test_query_on_the_small_tables(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    found = {c: [x[2:] for x in sorted(v)] for c, v in by_turn(rows).items()}
    assert collected(queries.op11_prefix_trie(spark, folder)) == plain(rebuilt(found))


def test_sql_text_agrees_with_plain_python(tmp_path):
    con = duckdb.connect()
    con.execute("create table conversations (conv_id bigint, turn bigint, role varchar, text varchar)")
    rows = invented(3, 60) + [(7, None, None, "x"), (7, 0, "user", None), (None, 1, "a", "b")]
    con.executemany("insert into conversations values (?, ?, ?, ?)", rows)
    found = {c: [x[2:] for x in sorted(v)] for c, v in by_turn(rows).items()}
    assert sorted(con.execute(oracles.PREFIX_TRIE).fetchall()) == plain(rebuilt(found))
