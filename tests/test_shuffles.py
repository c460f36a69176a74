"""Rows that belong to one panel move together once; later steps need no shuffle of their own."""

from __future__ import annotations

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from annolytics.operators import boxes as bx
from annolytics.operators import ordering as od
from annolytics.operators import spatial as sp
from annolytics.plans import skew

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def frame(spark):
    spots = spark.range(60).selectExpr(
        "cast(id % 3 as int) as panel_id", "cast(id div 3 as int) as ord", "cast(id * 7 % 11 * 20 as int) as x",
        "cast(id * 5 % 12 * 20 as int) as y", "cast(20 + id % 4 * 15 as int) as width", "cast(20 + id % 5 * 12 as int) as height")
    return spots.selectExpr("*", "x as x1", "y as y1", "x + width as x2", "y + height as y2", "1 + ord % 2 as line_count").cache()


def moves(df) -> list[str]:
    """Keys of the plan's shuffles."""
    return re.findall(r"Exchange hashpartitioning\((.*?), \d+\)", df._jdf.queryExecution().executedPlan().toString())


@pytest.fixture
def large(spark):
    """No side is small enough for a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_reading_bands_move_once(large, frame):
    assert len(moves(od.reading_bands(frame))) == 1


@pytest.mark.parametrize("size", [2, 3, 8])
def test_median_and_ties_of_gathered_bands(spark, size):
    rows = [(1, i, 5, 10 * (i % 3), 10, h, 0) for i, h in enumerate([60, 20, 90, 20, 40, 70, 30, 100][:size], 1)]
    df = spark.createDataFrame(rows, "panel_id int, ord int, x int, y int, width int, height int, more int")
    columns = ["panel_id", "ord", "more", "band", "reading_order"]
    gathered, crowded = (sorted(map(tuple, od.reading_bands(df, limit).select(columns).collect())) for limit in (2000, 1))
    assert gathered == crowded and len(gathered) == size


def test_suppression_moves_once(large, frame):
    assert len(moves(sp.suppress_overlaps(frame))) == 1


def test_copies_lose_alike_in_both_ways(spark):
    rows = [(p, i, x, 0, x + 10, 10, line) for p in (1, 2) for i, (x, line) in enumerate(
        [(0, 1), (0, 1), (2, 2), (0, 1), (2, 2), (40, 1), (40, 3), (40, 1), (44, 2)], 1)]
    df = spark.createDataFrame(rows, "panel_id int, ord int, x1 int, y1 int, x2 int, y2 int, line_count int")
    columns = ["panel_id", "ord", "suppressed_by"]
    ways = [{tuple(r) for r in sp.suppress_overlaps(df, fold_rows=limit).select(columns).collect()} for limit in (500, 8, 1)]
    assert ways[0] == ways[1] == ways[2] and len(ways[0]) == len(rows)


def test_split_by_gap_moves_once(large, frame):
    lines = frame.withColumns({
        "distance": (F.col("x") + F.col("y")).cast("double"), "first_y": F.col("y"), "font_size": F.lit(9),
        "vertical": F.lit(True), "angle": F.lit(0)})
    assert len(moves(od.split_by_gap(lines, ["panel_id"]))) == 1


@pytest.mark.parametrize("name", ["incremental_targets", "apply_partial_result", "apply_overrides"])
def test_box_state_moves_by_panel_only(spark, large, name):
    keys = moves(entry.queries()[name](spark, FOLDER))
    assert keys and not [k for k in keys if "region_id" in k]


@pytest.mark.parametrize("name", ["apply_partial_result", "apply_partial_boxes"])
def test_partial_result_reads_boxes_once(spark, large, name):
    assert len(moves(entry.queries()[name](spark, FOLDER))) == 1


def test_partial_result_of_odd_rows(spark):
    keys = [(1, "a"), (1, "a"), (1, "b"), (1, "c"), (1, "d"), (1, None), (1, None), (None, "a"), (2, "a")]
    boxes = spark.createDataFrame(
        [(i, p, r, i, 0, 5, 5, True, None, s, True) for i, ((p, r), s) in enumerate(zip(keys, [*["detected"] * 4, "manual", *["detected"] * 4]))],
        "ord int, panel_id int, region_id string, x int, y int, width int, height int, vertical boolean, "
        "forced_orientation string, source string, computed boolean")
    stored = spark.createDataFrame(
        [(1, "a", "old", "s"), (1, "b", "old", "s"), (1, "b", "twin", "s"), (1, None, "old", "s"), (1, None, "old", "s"), (2, "a", None, None), (3, "a", "gone", "s")],
        "panel_id int, region_id string, text string, box_signature string")
    targets = spark.createDataFrame(
        [(1, "a"), (1, "a"), (1, "c"), (1, "d"), (1, None), (None, "a"), (5, "x")], "panel_id int, region_id string")
    returned = spark.createDataFrame(
        [(1, "a", "new", "", 7), (1, "a", "too", "", 7), (1, "b", "unasked", "", 7), (1, None, "keyless", "", 7), (5, "x", "no box", "", 7)],
        "panel_id int, region_id string, text string, box_signature string, more int")
    kept, annotations = bx.apply_partial_result(boxes, stored, targets, returned)
    assert kept.columns == [*bx.KEYS, *(c for c in boxes.columns if c not in bx.KEYS)] and annotations.columns == stored.columns
    assert {(r.ord, r.computed) for r in kept.collect()} == {(0, True), (1, True), (2, True), (4, False), (5, True), (6, True), (7, True), (8, True)}
    signed = {r.ord: r.box_signature for r in bx.with_signature(boxes).collect()}
    assert Counter(map(tuple, annotations.collect())) == Counter([
        *((1, "a", text, signed[i]) for text in ("new", "too") for i in (0, 1)), (1, "b", "old", "s"), (1, "b", "twin", "s"),
        (1, None, "old", "s"), (1, None, "old", "s"), (2, "a", None, None), (3, "a", "gone", "s")])


def test_answers_and_boxes_of_one_row_or_several(spark):
    """An answer counts for every box of its region, wherever they stand."""
    rows = spark.range(4).selectExpr(
        "1 as panel_id", "'a' as region_id", "id = 0 as asked",
        "named_struct('x', int(id), 'y', 0, 'width', 1, 'height', 1, 'vertical', true, 'forced_orientation', string(null)) as box",
        "named_struct('text', 'old', 'box_signature', 's') as stored", "case when id > 1 then named_struct('text', string(id)) end as answer")
    new = bx.partial_annotations(rows)
    assert Counter(r.text for r in new.collect()) == {"2": 4, "3": 4} and new.distinct().count() == 8


def test_overrides_read_boxes_once(spark, large):
    assert len(moves(entry.queries()["apply_overrides"](spark, FOLDER))) == 1


def test_overrides_of_odd_rows(spark):
    shape = "panel_id int, region_id string, ord int, x int, width int"
    base = spark.createDataFrame(
        [(1, "a", 1, 10, 20), (1, "a", 2, 11, 21), (1, "b", 3, 12, 22), (1, "c", 4, 13, 23), (1, None, 5, 14, 24), (1, None, 5, 14, 24), (None, "a", 6, 15, 25), (1, "d", 7, None, 26)], shape)
    removed = spark.createDataFrame([(1, "b"), (1, "b"), (1, "f"), (1, None), (None, "a")], "panel_id int, region_id string")
    patches = spark.createDataFrame(
        [(1, "a", 1, 90, 91), (1, "a", 2, None, 92), (1, "c", 1, 93, 94), (1, None, 1, 95, 96), (1, "d", 3, 97, None), (9, "z", 1, 98, 99)], shape)
    added = spark.createDataFrame(
        [(1, "c", 8, 50, 51), (1, "c", 9, 52, None), (1, "e", 3, 53, 54), (1, "f", 1, 55, 56), (1, "b", 1, 57, 58), (1, None, 1, 59, 60), (1, None, 2, 61, 62)], shape)
    left = bx.apply_overrides(base, removed, patches, added, ["x", "width"])
    assert left.columns == base.columns
    assert Counter(map(tuple, left.collect())) == Counter([
        (1, "a", 1, 10, 92), (1, "a", 2, 11, 92), (1, "c", 9, 52, None), (1, None, 5, 14, 24), (1, None, 5, 14, 24),
        (None, "a", 6, 15, 25), (1, "d", 7, 97, 26), (1, "e", 3, 53, 54), (1, None, 2, 61, 62)])


def test_keys_of_crowded_buckets_are_counted(spark, monkeypatch):
    monkeypatch.setattr(skew, "BUCKET_ROWS", 1)
    monkeypatch.setattr(skew, "BUCKETS", 3)
    rows = [(k,) for k, n in ((None, 9), (1, 3), (2, 12), (3, 1), (4, 5), (5, 5)) for _ in range(n)]
    ordinary, heavy = skew.split_groups(spark.createDataFrame(rows, "k int"), ["k"], 6)
    assert {r.k for r in heavy.collect()} == {None, 2} and heavy.count() == 21 and ordinary.count() == 14
    assert skew.split_groups(spark.createDataFrame(rows, "k int"), ["k"], 12)[1] is None
