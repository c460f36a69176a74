"""Rectangle arithmetic on columns.

A rectangle is half-open: x1 <= x < x2, y1 <= y < y2. Every function takes and
returns Spark columns, so all of it runs inside whole-stage code generation.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rect(NamedTuple):
    x1: Column
    y1: Column
    x2: Column
    y2: Column


def rect(prefix: str = "", suffix: str = "") -> Rect:
    """Rectangle of columns such as ``a_x1 .. a_y2`` or ``x1_b .. y2_b``."""
    return Rect(*(F.col(f"{prefix}{name}{suffix}") for name in ("x1", "y1", "x2", "y2")))


def rect_in(holder: Column) -> Rect:
    """Rectangle held as fields of a struct column."""
    return Rect(holder["x1"], holder["y1"], holder["x2"], holder["y2"])


def from_size(x: Column, y: Column, width: Column, height: Column) -> Rect:
    return Rect(x, y, x + width, y + height)


def _positive(value: Column) -> Column:
    return F.greatest(F.lit(0), value)


def area(r: Rect) -> Column:
    return _positive(r.x2 - r.x1).cast("bigint") * _positive(r.y2 - r.y1)


def center(r: Rect) -> tuple[Column, Column]:
    return (r.x1 + r.x2) / 2, (r.y1 + r.y2) / 2


def overlap(a: Rect, b: Rect) -> Column:
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    tall = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return _positive(wide).cast("bigint") * _positive(tall)


def touching_overlap(a: Rect, b: Rect) -> Column:
    """Overlap area, 0 for rectangles that touch, -1 for rectangles apart."""
    wide = F.least(a.x2, b.x2) - F.greatest(a.x1, b.x1)
    tall = F.least(a.y2, b.y2) - F.greatest(a.y1, b.y1)
    return F.when((wide < 0) | (tall < 0), F.lit(-1).cast("bigint")).otherwise(wide.cast("bigint") * tall)


def contains(outer: Rect, inner: Rect) -> Column:
    return (
        (outer.x1 <= inner.x1) & (outer.y1 <= inner.y1)
        & (outer.x2 >= inner.x2) & (outer.y2 >= inner.y2)
    )


def hull(a: Rect, b: Rect) -> Rect:
    return Rect(
        F.least(a.x1, b.x1), F.least(a.y1, b.y1),
        F.greatest(a.x2, b.x2), F.greatest(a.y2, b.y2),
    )


def clipped(r: Rect, width: Column, height: Column) -> Rect:
    return Rect(
        F.greatest(F.lit(0), r.x1), F.greatest(F.lit(0), r.y1),
        F.least(width, r.x2), F.least(height, r.y2),
    )


def padded(r: Rect, pad: Column) -> Rect:
    return Rect(r.x1 - pad, r.y1 - pad, r.x2 + pad, r.y2 + pad)


def inset(r: Rect, ratio: float, width: Column, height: Column) -> Rect:
    """Shrunk by a share of each side, kept at least one unit wide and tall."""
    dx = ((r.x2 - r.x1) * F.lit(ratio)).cast("int")
    dy = ((r.y2 - r.y1) * F.lit(ratio)).cast("int")
    return Rect(
        F.greatest(F.lit(0), r.x1 + dx),
        F.greatest(F.lit(0), r.y1 + dy),
        F.greatest(r.x1 + dx + 1, F.least(width, r.x2 - dx)),
        F.greatest(r.y1 + dy + 1, F.least(height, r.y2 - dy)),
    )


def allocation_window(
    r: Rect, vertical: Column, width: Column, height: Column,
    wide_factor: float = 2.8, tall_factor: float = 1.55,
) -> Rect:
    """Search window around a text rectangle, by reading direction.

    Fixed values: vertical text 2.8 x width, 0.82 x height, 96 wide, 1.22 x
    height, 54 tall; horizontal text 1.55 x width, 96 wide, 1.55 x height, 44 tall.
    """
    w = F.greatest(F.lit(1), r.x2 - r.x1)
    h = F.greatest(F.lit(1), r.y2 - r.y1)
    cx, cy = center(r)
    span_x = F.when(vertical, F.greatest(w * wide_factor, h * 0.82, F.lit(96.0))).otherwise(
        F.greatest(w * 1.55, F.lit(96.0)))
    span_y = F.when(vertical, F.greatest(h * 1.22, F.lit(54.0))).otherwise(
        F.greatest(h * tall_factor, F.lit(44.0)))
    left = F.greatest(F.lit(0.0), cx - span_x / 2).cast("int")
    top = F.greatest(F.lit(0.0), cy - span_y / 2).cast("int")
    right = F.least(width.cast("double"), cx + span_x / 2).cast("int")
    bottom = F.least(height.cast("double"), cy + span_y / 2).cast("int")
    return Rect(left, top, F.greatest(left + 1, right), F.greatest(top + 1, bottom))


def text_window(r: Rect, width: Column, height: Column, divisor: int = 8, shrink: bool = False) -> Rect:
    """Padded by a weighted side length, clamped to the last pixel of the page."""
    w, h = r.x2 - r.x1, r.y2 - r.y1
    pad = F.bround((F.greatest(h, w) * 0.25 + F.least(h, w) * 0.75) / divisor, 0).cast("int")
    pad = -pad if shrink else pad
    return Rect(
        F.greatest(F.lit(0), r.x1 - pad), F.greatest(F.lit(0), r.y1 - pad),
        F.least(width - 1, r.x2 + pad), F.least(height - 1, r.y2 + pad),
    )


def gaps(a: Rect, b: Rect) -> tuple[Column, Column]:
    return (
        _positive(F.greatest(a.x1, b.x1) - F.least(a.x2, b.x2)),
        _positive(F.greatest(a.y1, b.y1) - F.least(a.y2, b.y2)),
    )


def min_side(r: Rect) -> Column:
    return F.least(r.x2 - r.x1, r.y2 - r.y1)


def overlap_of_smaller(a: Rect, b: Rect) -> Column:
    """Overlap as a share of the smaller rectangle."""
    return overlap(a, b) / F.greatest(F.lit(1), F.least(area(a), area(b)))


def iou(a: Rect, b: Rect) -> Column:
    shared = overlap(a, b)
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def size(r: Rect) -> tuple[Column, Column, Column, Column]:
    """x, y, width, height; sides are at least one unit."""
    return r.x1, r.y1, F.greatest(F.lit(1), r.x2 - r.x1), F.greatest(F.lit(1), r.y2 - r.y1)


def relative_distance(a: tuple[Column, Column], b: tuple[Column, Column], width: Column, height: Column) -> Column:
    """Distance of two points as a share of the page diagonal."""
    diagonal = F.greatest(F.lit(1.0), F.hypot(width.cast("double"), height.cast("double")))
    return F.hypot(a[0] - b[0], a[1] - b[1]) / diagonal


def corners(r: Rect) -> Column:
    """Clockwise corner list, from the top left."""
    return F.array(
        F.array(r.x1, r.y1), F.array(r.x2, r.y1), F.array(r.x2, r.y2), F.array(r.x1, r.y2),
    )


def midlines(points: Column) -> tuple[Column, Column]:
    """Lengths of a quadrilateral's lines from mid-side to mid-side, downwards and across."""
    def length(i: int, j: int, k: int, m: int) -> Column:
        return F.hypot(*((points[i][n].cast("double") + points[j][n] - points[k][n] - points[m][n]) / 2 for n in (0, 1)))

    return length(2, 3, 1, 0), length(1, 2, 3, 0)


def bounds(points: Column) -> Rect:
    """Bounding rectangle of an array of [x, y] points."""
    xs = F.transform(points, lambda p: p[0])
    ys = F.transform(points, lambda p: p[1])
    return Rect(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys))


def rotated(points: Column, cx: Column, cy: Column, degrees: Column) -> Column:
    """Points turned about a centre, truncated to integers."""
    s, c = F.sin(F.radians(degrees)), F.cos(F.radians(degrees))

    def turn(p: Column) -> Column:
        dx, dy = p[0] - cx, p[1] - cy
        return F.array((dy * s + dx * c + cx).cast("int"), (dy * c - dx * s + cy).cast("int"))

    return F.transform(points, turn)
