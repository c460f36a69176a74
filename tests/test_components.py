"""Components and greedy selection on graphs against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from annolytics.operators import spatial
from annolytics.plans import components as cp
from annolytics.plans import greedy

EDGES = "panel_id string, src long, dst long"


def plain_components(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for p, a, b in edges:
        x, y = find((p, a)), find((p, b))
        root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root}


def test_components_of_random_graphs_and_a_path(spark):
    rng = random.Random(1)
    edges = [(p, rng.randrange(60), rng.randrange(60)) for p in "ab" for _ in range(35)]
    edges += [("path", i, i + 1) for i in range(3_000)] + [("star", 0, i) for i in range(1, 500)]
    rng.shuffle(edges)
    edges = [e for e in edges if e[1] != e[2]]
    got = {(r.panel_id, r.node): (r.panel_id, r.component) for r in cp.components(spark.createDataFrame(edges, EDGES), ["panel_id"]).collect()}
    assert got == plain_components(edges)
    assert cp.components(spark.createDataFrame([], EDGES), ["panel_id"]).collect() == []


def plain_greedy(nodes, edges):
    before = {}
    for p, a, b in edges:
        before.setdefault((p, b), []).append((p, a))
    taken = {}
    for node in sorted(nodes):
        taken[node] = not any(taken[x] for x in before.get(node, ()))
    return taken


@pytest.mark.parametrize("limit", [greedy.COMPONENT_EDGES, 40, 0])
def test_streams_and_rounds_take_the_same_nodes(spark, limit):
    rng = random.Random(7)
    nodes = [(p, i) for p in "ab" for i in range(80)]
    edges = list({(p, a, b) for p in "ab" for a, b in (sorted((rng.randrange(80), rng.randrange(80))) for _ in range(70)) if a < b})
    got = greedy.take_greedily(
        spark.createDataFrame(nodes, "panel_id string, node long"), spark.createDataFrame(edges, EDGES), ["panel_id"], limit)
    assert {(r.panel_id, r.node): r.taken for r in got.collect()} == plain_greedy(nodes, edges)


def chain(spark, n: int):
    """Boxes of one panel, each over the next one only."""
    return spark.range(n).select(
        F.lit("p").alias("panel_id"), F.col("id").alias("ord"), (F.col("id") * 10).cast("int").alias("x1"), F.lit(0).alias("y1"),
        (F.col("id") * 10 + 16).cast("int").alias("x2"), F.lit(10).alias("y2"), F.lit(1).alias("line_count"),
        (1 - F.col("id") / 1_000_000).alias("conf"))


def test_a_chain_of_boxes_is_decided_in_a_pass(spark, monkeypatch):
    monkeypatch.setattr(greedy, "_in_rounds", None)
    n = 20_000
    kept = spatial.suppress_by_iou(chain(spark, n), 0.2).agg(F.count(F.lit(1)), F.max(F.col("ord") % 2)).first()
    assert tuple(kept) == (n // 2, 0)
    fates = spatial.suppress_overlaps(chain(spark, n), 0.3).agg(
        F.count_if(F.col("suppressed_by").isNull() & (F.col("ord") % 2 == 0)), F.count_if(F.col("suppressed_by") == F.col("ord") - 1)).first()
    assert tuple(fates) == (n // 2, n // 2)


def test_a_crowded_panel_of_lines_folds_in_stretches(spark, monkeypatch):
    """100,000 lines of one panel in 20,000 rows: no fold takes the panel's rows one chunk after the other."""
    from annolytics.operators import ordering
    from annolytics.plans import folds

    limits = []
    inner = folds.split_groups
    monkeypatch.setattr(folds, "split_groups", lambda df, keys, limit: limits.append((tuple(keys), found := inner(df, keys, limit))) or found)
    boxes = spark.range(100_000).select(
        F.lit("p").alias("panel_id"), F.col("id").alias("ord"), (F.col("id") % 5 * 100).cast("int").alias("x"),
        (F.floor(F.col("id") / 5) * 200).cast("int").alias("y"), F.lit(80).alias("width"), (F.lit(40) + F.col("id") % 3).cast("int").alias("height"))
    out = ordering.reading_bands(boxes)
    wrong = out.where(
        (F.col("band") != F.floor(F.col("ord") / 5) + 1) | (F.col("reading_order") != F.floor(F.col("ord") / 5) * 5 + 5 - F.col("ord") % 5))
    assert out.count() == 100_000 and wrong.isEmpty()
    stretches = [heavy for keys, (_, heavy) in limits if "_stretch" in keys]
    assert stretches == [None]
