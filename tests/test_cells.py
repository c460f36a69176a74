"""The grid join against all pairs, and what one cell holds when a page is crowded."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from annolytics.plans import cells

BOXES = "panel_id string, ord int, x1 int, y1 int, x2 int, y2 int"


@pytest.mark.parametrize("reach", [0, 9])
def test_all_pairs_of_all_sizes(spark, reach):
    rng = random.Random(reach)
    rows = []
    for panel in "pq":
        for i in range(120):
            size, x, y = rng.choice([3, 20, 100, 600, 3_000]), rng.randrange(-200, 2_000), rng.randrange(-200, 2_000)
            rows.append((panel, i, x, y, x + rng.randrange(0, size + 1), y + rng.randrange(1, size + 1)))
    frame = spark.createDataFrame(rows, BOXES)
    got = sorted((r.panel_id, r.a.ord, r.b.ord) for r in cells.cell_pairs(frame, frame, ["panel_id"], F.lit(reach) if reach else None).collect())
    real = [r for r in rows if r[4] > r[2]]
    assert got == sorted(
        (a[0], a[1], b[1]) for a in real for b in real if a[0] == b[0]
        and max(a[2] - reach, b[2]) < min(a[4] + reach, b[4]) and max(a[3] - reach, b[3]) < min(a[5] + reach, b[5]))
    assert cells.cell_pairs(frame.limit(0), frame, ["panel_id"]).collect() == []


def test_a_crowded_spot_and_a_page_wide_rectangle(spark):
    """4,000 small boxes within 192 x 192 and one box over everything: no cell holds more than a few hundred
    of the boxes that meet each other, and the wide box is listed a few times only."""
    small = spark.range(4_000).select(
        F.lit("p").alias("panel_id"), F.col("id").cast("int").alias("ord"), (F.col("id") % 64 * 3).cast("int").alias("x1"),
        (F.floor(F.col("id") / 64) * 3).cast("int").alias("y1")).withColumns({"x2": F.col("x1") + 2, "y2": F.col("y1") + 2})
    wide = spark.createDataFrame([("p", 9_999, -50_000, -50_000, 50_000, 50_000)], BOXES)
    placed = cells._placed(small.unionByName(wide), None, cells.CELL)
    listed = cells._listed(placed, placed, "a", small.columns, ["panel_id"], cells._LEFT_LIVES, cells._RIGHT_LIVES, cells.CELL)
    met = listed.where(F.col("_way") == cells._BOTH).groupBy("_grid", "_cx", "_cy").count().agg(F.max("count")).first()[0]
    assert met <= 320
    assert listed.where("a.ord = 9999").count() <= 8
    assert listed.count() <= 4_000 * 6
    pairs = cells.cell_pairs(small.unionByName(wide), small.unionByName(wide), ["panel_id"], self_order=F.col("a.ord") < F.col("b.ord"))
    assert pairs.count() == 4_000


def test_few_rectangles_of_a_key_move_once(spark, monkeypatch):
    rng = random.Random(8)
    rows = [(k, i, x, y, x + rng.randrange(0, 90), y + rng.randrange(0, 90), 1) for k, n in ((1, 40), (2, 12), (None, 3), (3, 300))
            for i, (x, y) in enumerate((rng.randrange(300), rng.randrange(300)) for _ in range(n))]
    frame = spark.createDataFrame(rows, "panel_id int, ord int, x1 int, y1 int, x2 int, y2 int, copies int")
    order = F.col("a.ord") < F.col("b.ord")
    for reach in (None, F.lit(7)):
        ways = [cells.cell_pairs(f, f, ["panel_id"], reach, self_order=order, sources=s) for f, s in (
            (frame, []), (frame, [frame]), (frame.where("panel_id < 3"), []), (frame.where("panel_id < 3"), [frame.where("panel_id < 3")]))]
        found = [sorted((r.panel_id, r.a.ord, r.b.ord) for r in way.select("panel_id", "a", "b").collect()) for way in ways]
        assert found[0] == found[1] and found[2] == found[3] and 0 < len(found[2]) < len(found[0])
    monkeypatch.delattr(cells, "_listed")
    few = frame.where("panel_id < 3")
    assert cells.cell_pairs(few, few, ["panel_id"], sources=[few]).count() > 52
