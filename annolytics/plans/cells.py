"""Grid-cell join for rectangles, on grids of several widths.

A rectangle lives on the grid whose cells are just as wide as it is, so it lies
in four cells at most, however large it is, and small rectangles that crowd a
spot are spread over small cells. Every grid is four times as wide as the one
below. Two rectangles of one grid meet in a cell of it; of different grids they
meet on the wider one, where the smaller is listed as a guest. Guests never meet
each other there, so a page-wide rectangle costs a cell's guests one comparison
each and no pairs among them. Guests are listed only on grids that some rectangle
of the other side lives on.

A pair that shares several cells is taken in exactly one of them, the cell of
the top-left corner of its intersection, so no de-duplication shuffle is needed.

Where the caller can tell which keys hold few rectangles, those are paired by key
alone: every rectangle moves once instead of once per cell and way of meeting.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions import geometry as g
from annolytics.plans.skew import heavy_groups, join_groups, small_side

# Width of the smallest cells, and how many grids there are above it.
CELL = 48
GRIDS = 10
# Rows of a key whose rectangles are all compared with each other.
FEW = 128

# How two rectangles of a cell meet: both live there, or one of them is a guest.
_BOTH, _LEFT_LIVES, _RIGHT_LIVES = range(3)


def _cell(value: Column, width: Column) -> Column:
    return F.floor(value / width).cast("int")


def _width(grid: Column, cell: int) -> Column:
    return F.call_function("shiftleft", F.lit(cell).cast("bigint"), (grid * 2).cast("int"))


def _placed(df: DataFrame, reach: Column | None, cell: int) -> DataFrame:
    """Rows with area, with the rectangle they reach and the grid they live on."""
    box = g.rect() if reach is None else g.padded(g.rect(), reach)
    sides = {f"reach_{n}": v for n, v in zip(("x1", "y1", "x2", "y2"), box)}
    size = F.greatest(box.x2 - box.x1, box.y2 - box.y1)
    grid = F.least(F.greatest(F.ceil(F.log2(size / cell) / 2), F.lit(0)), F.lit(GRIDS)).cast("int")
    return df.where((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1"))).withColumns({**sides, "_grid": grid})


def _grids(df: DataFrame) -> Column:
    """The grids that rows live on, one bit each; a subquery of one row."""
    return df.select(F.expr("bit_or(shiftleft(1, _grid))").alias("grids")).scalar()


def _listed(df: DataFrame, others: DataFrame, side: str, columns: Sequence[str], keys: Sequence[str], lives: int, visits: int, cell: int) -> DataFrame:
    """Rows once per cell and way of meeting; their columns packed under the name of their side."""
    packed = F.struct(*columns, *(f"reach_{n}" for n in ("x1", "y1", "x2", "y2")))
    grids = F.filter(
        F.sequence(F.lit(0), F.lit(GRIDS)),
        lambda l: F.expr("_others").bitwiseAND(F.call_function("shiftleft", F.lit(1), l)) != 0)
    # One way per grid at or above the own one, and one for all grids below, where the others are guests.
    ways = F.array_distinct(F.transform(grids, lambda l: F.struct(
        F.greatest(l, F.col("_grid")).alias("grid"),
        F.when(l == F.col("_grid"), _BOTH).when(l < F.col("_grid"), lives).otherwise(visits).alias("way"))))
    rows = df.withColumn("_others", _grids(others)).select(*keys, packed.alias(side), F.explode(ways).alias("_w"))
    width = _width(F.col("_w.grid"), cell)
    at = {n: F.col(f"{side}.reach_{n}") for n in ("x1", "y1", "x2", "y2")}
    return rows.select(*keys, side, F.col("_w.grid").alias("_grid"), F.col("_w.way").alias("_way"),
                       F.explode(F.sequence(_cell(at["x1"], width), _cell(at["x2"] - 1, width))).alias("_cx")).withColumn(
        "_cy", F.explode(F.sequence(_cell(at["y1"], _width(F.col("_grid"), cell)), _cell(at["y2"] - 1, _width(F.col("_grid"), cell)))))


def _overlap() -> tuple[Column, Column, Column]:
    """Left edge and upper edge of what the two rectangles share, and whether they share anything."""
    corner_x = F.greatest(F.col("a.reach_x1"), F.col("b.x1"))
    corner_y = F.greatest(F.col("a.reach_y1"), F.col("b.y1"))
    return corner_x, corner_y, (
        (corner_x < F.least(F.col("a.reach_x2"), F.col("b.x2"))) & (corner_y < F.least(F.col("a.reach_y2"), F.col("b.y2"))))


def _straight(one: DataFrame, two: DataFrame, left: Sequence[str], right: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Pairs of keys that hold few rectangles: all of a key meet, and each is moved once."""
    reach = [f"reach_{n}" for n in ("x1", "y1", "x2", "y2")]
    a = one.select(*keys, F.struct(*left, *reach).alias("a"))
    b = two.select(*keys, F.struct(*right, *reach).alias("b"))
    return a.join(b, list(keys)).where(_overlap()[2])


def _gridded(one: DataFrame, two: DataFrame, left: Sequence[str], right: Sequence[str], keys: Sequence[str], cell: int) -> DataFrame:
    a = _listed(one, two, "a", left, keys, _LEFT_LIVES, _RIGHT_LIVES, cell)
    b = _listed(two, one, "b", right, keys, _RIGHT_LIVES, _LEFT_LIVES, cell)
    corner_x, corner_y, meet = _overlap()
    width = _width(F.col("_grid"), cell)
    here = (_cell(corner_x, width) == F.col("_cx")) & (_cell(corner_y, width) == F.col("_cy"))
    return a.join(b, [*keys, "_grid", "_way", "_cx", "_cy"]).where(meet & here).select(*keys, "a", "b")


def cell_pairs(
    left: DataFrame, right: DataFrame, keys: Sequence[str], reach: Column | None = None,
    cell: int = CELL, self_order: Column | None = None, sources: Sequence[DataFrame] = (),
) -> DataFrame:
    """Pairs (structs ``a`` and ``b``) of the same keys whose rectangles overlap
    after the left one is widened by ``reach``.

    ``self_order`` restricts a self-join, for example to ``a.id < b.id``.
    ``sources`` are tables that together hold at least as many rows of a key as
    either side; keys with at most ``FEW`` rows there are paired without grids.
    """
    one, two = _placed(left, reach, cell), _placed(right, None, cell)
    names = left.columns, right.columns, keys
    if sources:
        rows = reduce(DataFrame.unionByName, (s.select(*keys) for s in sources))
        heavy = heavy_groups(rows, keys, FEW)
        if heavy is None:
            pairs = _straight(one, two, *names)
        else:
            heavy = small_side(heavy)
            few, many = ([join_groups(side, heavy, keys, how) for side in (one, two)] for how in ("left_anti", "left_semi"))
            pairs = _straight(*few, *names).unionByName(_gridded(*many, *names, cell))
    else:
        pairs = _gridded(one, two, *names, cell)
    return pairs if self_order is None else pairs.where(self_order)
