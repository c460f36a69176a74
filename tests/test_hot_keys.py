"""The ways around hot keys give the rows the plain ways give, and both agree
with plain Python on random fixtures."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from annolytics.operators import ordering as od
from annolytics.operators import spatial as sp
from annolytics.plans import skew

COLUMNS = ("panel_id int, ord int, x int, y int, width int, height int, x1 int, y1 int, x2 int, y2 int, "
           "line_count int, conf double")


def boxes(seed: int, panels: int = 3, size: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    rows = []
    for panel in range(panels):
        for place in range(size):
            x, y = rng.randrange(12) * 20, rng.randrange(12) * 20
            w, h = rng.choice([20, 40, 70]), rng.choice([20, 40, 70])
            rows.append((panel, place + 1, x, y, w, h, x, y, x + w, y + h, rng.randrange(1, 3), rng.choice([.4, .5, .6])))
    return rows


@pytest.fixture(scope="module")
def rows():
    return boxes(7)


@pytest.fixture(scope="module")
def frame(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).cache()


def area(r):
    return (r[8] - r[6]) * (r[9] - r[7])


def overlap(a, b):
    return max(0, min(a[8], b[8]) - max(a[6], b[6])) * max(0, min(a[9], b[9]) - max(a[7], b[7]))


def collected(df, *columns):
    return sorted(map(str, df.select(*columns).collect()))


@pytest.mark.parametrize("helper", ["index", "total", "previous"])
def test_ordered_helpers(frame, helper):
    order = ["y", F.col("x").desc(), "ord"]
    make = {
        "index": lambda limit: skew.ordered_index(frame, ["panel_id"], order, "v", limit),
        "total": lambda limit: skew.running_total(frame, ["panel_id"], order, F.col("x"), "v", limit),
        "previous": lambda limit: skew.with_previous(frame, ["panel_id"], order, ["x", "ord"], "v", limit),
    }[helper]
    assert collected(make(10**6), "panel_id", "ord", "v") == collected(make(5), "panel_id", "ord", "v")


def test_rows_without_a_key_are_a_hot_key_too(spark):
    nulls = spark.range(50).selectExpr("cast(null as int) as k", "cast(id as int) as ord")
    frame = nulls.unionByName(spark.range(5).selectExpr("1 as k", "cast(id as int) as ord"))
    ordinary, heavy = skew.split_groups(frame, ["k"], 10)
    assert (ordinary.count(), heavy.count()) == (5, 50)
    made = {
        "index": lambda limit: skew.ordered_index(frame, ["k"], ["ord"], "v", limit),
        "total": lambda limit: skew.running_total(frame, ["k"], ["ord"], F.col("ord"), "v", limit),
        "previous": lambda limit: skew.with_previous(frame, ["k"], ["ord"], ["ord"], "v", limit),
    }
    for name, make in made.items():
        hot = collected(make(10), "k", "ord", "v")
        assert len(hot) == 55 and hot == collected(make(10**6), "k", "ord", "v"), name


def test_only_tables_of_few_rows_and_bytes_are_broadcast(spark, monkeypatch):
    table = spark.range(10).selectExpr("id", "repeat('x', 100) as t")

    def hinted():
        return "ResolvedHint" in skew.small_side(table)._jdf.queryExecution().analyzed().toString()

    assert hinted()
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1000)
    assert not hinted()
    monkeypatch.setattr(skew, "BROADCAST_BYTES", 1 << 20)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 9)
    assert not hinted()


@pytest.mark.parametrize("limit", [500, 8])
def test_duels(frame, rows, limit):
    expected = {}
    for panel in {r[0] for r in rows}:
        members, beaten = [r for r in rows if r[0] == panel], {}
        for i, a in enumerate(members):
            if a[1] in beaten:
                continue
            for b in members[i + 1:]:
                shared = overlap(a, b)
                if b[1] in beaten or shared <= 0 or shared / min(area(a), area(b)) < 0.5:
                    continue
                if (area(a), a[10]) >= (area(b), b[10]):
                    beaten.setdefault(b[1], a[1])
                else:
                    beaten.setdefault(a[1], b[1])
        expected.update({(panel, r[1]): beaten.get(r[1]) for r in members})
    got = {(r.panel_id, r.ord): r.suppressed_by for r in sp.suppress_overlaps(frame, fold_rows=limit).collect()}
    assert got == expected


@pytest.mark.parametrize("limit", [500, 8])
def test_best_first_suppression(frame, rows, limit):
    expected = set()
    for panel in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == panel), key=lambda r: (-r[11], r[1])):
            if all(overlap(k, r) / (area(k) + area(r) - overlap(k, r)) <= 0.35 for k in kept):
                kept.append(r)
        expected |= {(panel, k[1]) for k in kept}
    got = {(r.panel_id, r.ord) for r in sp.suppress_by_iou(frame, fold_rows=limit).collect()}
    assert got == expected


@pytest.mark.parametrize("limit", [2000, 7])
def test_bands(frame, rows, limit):
    expected = {}
    for panel in {r[0] for r in rows}:
        members = [r for r in rows if r[0] == panel]
        heights = sorted(r[5] for r in members)
        near, bands = max(24, int(heights[len(heights) // 2] * 0.7)), []
        for r in sorted(members, key=lambda r: (r[3], -r[2])):
            for band in bands:
                if abs(r[3] + r[5] / 2 - sum(b[3] + b[5] / 2 for b in band) / len(band)) <= near:
                    band.append(r)
                    break
            else:
                bands.append([r])
        ordered = []
        for band in bands:
            ordered += sorted(band, key=lambda r: -(r[2] + r[4] / 2))
        expected.update({(panel, r[1]): i for i, r in enumerate(ordered, 1)})
    got = {(r.panel_id, r.ord): r.reading_order for r in od.reading_bands(frame, limit).collect()}
    assert got == expected


def clustered(members, ratio=1.3, cosine=0.866):
    """Seeds absorb later lines in turn."""
    taken, clusters, number = {}, 0, {}
    for i, seed in enumerate(members):
        if i in taken:
            continue
        clusters += 1
        font, vx, vy, n, last = seed["font"], seed["vx"], seed["vy"], 1, seed
        number[seed["ord"]] = clusters
        for j in range(i + 1, len(members)):
            line = members[j]
            if j in taken:
                continue
            mean = (font * n + line["font"]) / (n + 1)
            rel = font / line["font"]
            cos = (vx * line["vx"] + vy * line["vy"]) / (((vx**2 + vy**2) ** .5) * ((line["vx"]**2 + line["vy"]**2) ** .5))
            jump = ((line["x"] - last["x"])**2 + (line["y"] - last["y"])**2) ** .5
            touch = overlap(line["box"], last["box"]) > 0
            if not touch and (rel > ratio or 1 / rel > ratio or abs(cos) < cosine
                              or line["d"] - last["d"] > 2 * mean or jump > mean * 2.5):
                continue
            taken[j] = True
            number[line["ord"]] = clusters
            font, vx, vy, n, last = mean, vx + line["vx"], vy + line["vy"], n + 1, line
    return number


@pytest.mark.parametrize("limit", [2000, 7])
def test_clusters(frame, rows, limit):
    lines = frame.select(
        "panel_id", "ord", "x1", "y1", "x2", "y2", (F.col("line_count") * 10).alias("font_size"),
        (F.col("x") + F.col("y")).cast("double").alias("distance"), F.col("width").alias("vec_x"),
        F.col("height").alias("vec_y"), F.col("x").alias("first_x"), F.col("y").alias("first_y"))
    got = {(r.panel_id, r.ord): r.cluster for r in od.cluster_lines(lines, fold_rows=limit).collect()}
    expected = {}
    for panel in {r[0] for r in rows}:
        members = [{"ord": r[1], "font": r[10] * 10, "vx": r[4], "vy": r[5], "x": r[2], "y": r[3], "d": r[2] + r[3], "box": r}
                   for r in sorted((r for r in rows if r[0] == panel), key=lambda r: (r[2] + r[3], r[1]))]
        expected.update({(panel, o): c for o, c in clustered(members).items()})
    assert got == expected


def test_growth(frame):
    seeds = frame.where("ord = 1")
    small, large = (collected(sp.grow_rects(seeds, frame, 5, limit), "panel_id", "x1", "y1", "x2", "y2") for limit in (500, 5))
    assert small == large and len(small) == 3


def test_split_by_gap(frame):
    lines = frame.withColumns({
        "distance": (F.col("x") + F.col("y")).cast("double"), "first_y": F.col("y"), "font_size": F.lit(9),
        "vertical": F.lit(True), "angle": F.lit(0)})
    plain, chunked = (collected(od.split_by_gap(lines, ["panel_id"], limit), "panel_id", "ord", "sub_block") for limit in (10**6, 6))
    assert plain == chunked


def test_pairs_match_nested_loops(frame, rows):
    got = {(r.panel_id, r.a_ord, r.b_ord): r.box_pairs for r in sp.overlap_pairs(frame, cell=32).collect()}
    rects = {}
    for r in rows:
        rects.setdefault((r[0], *r[6:10]), []).append(r)
    first = {k: (v[0], len(v)) for k, v in rects.items()}
    expected = {}
    for ka, (a, na) in first.items():
        if na > 1:
            expected[(a[0], a[1], a[1])] = na * (na - 1) // 2
        for kb, (b, nb) in first.items():
            if a[0] == b[0] and a[1] < b[1] and overlap(a, b) / min(area(a), area(b)) >= 0.5:
                expected[(a[0], a[1], b[1])] = na * nb
    assert got == expected


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(1, 40), st.integers(1, 40)), min_size=1, max_size=25))
def test_survivors_do_not_overlap(spark, rects):
    data = [(1, i, x, y, x + w, y + h, 1) for i, (x, y, w, h) in enumerate(rects, 1)]
    df = spark.createDataFrame(data, "panel_id int, ord int, x1 int, y1 int, x2 int, y2 int, line_count int")
    kept = [tuple(r) for r in sp.suppress_overlaps(df).where("suppressed_by is null").select("x1", "y1", "x2", "y2").collect()]
    assert kept
    for i, a in enumerate(kept):
        for b in kept[i + 1:]:
            shared = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
            smaller = min((a[2] - a[0]) * (a[3] - a[1]), (b[2] - b[0]) * (b[3] - b[1]))
            assert shared / smaller < 0.5
