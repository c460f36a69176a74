"""Text boxes: shaping, overrides, incremental state.

A box row is panel_id, region_id, ord, x, y, width, height, vertical,
forced_orientation, source, computed and optional layout columns. A stored
annotation row is panel_id, region_id, box_signature, text and payload columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.functions import geometry as g
from annolytics.functions.hashing import box_signature, region_id
from annolytics.plans.skew import by, ordered_index

KEYS = ["panel_id", "region_id"]
# Columns that a box's signature is made of.
SIGNED = ("x", "y", "width", "height", "vertical", "forced_orientation")
# What a row says about a region, in the order in which the rows of a region are read.
REMOVED, PATCH, ADDED, BASE = range(4)


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast(kind)


def _keyed() -> Column:
    return F.col("panel_id").isNotNull() & F.col("region_id").isNotNull()


def normalize_boxes(df: DataFrame, source: str = "manual") -> DataFrame:
    """Clamp geometry, settle the orientation, and fill id, source and flags."""
    x = F.greatest(F.lit(0), F.coalesce(F.col("x").cast("int"), F.lit(0)))
    y = F.greatest(F.lit(0), F.coalesce(F.col("y").cast("int"), F.lit(0)))
    width = F.greatest(F.lit(1), F.coalesce(F.col("width").cast("int"), F.lit(1)))
    height = F.greatest(F.lit(1), F.coalesce(F.col("height").cast("int"), F.lit(1)))
    forced = _column(df, "forced_orientation", "string")
    forced = F.when(forced.isin("vertical", "horizontal"), forced)
    vertical = F.coalesce(forced == "vertical", _column(df, "vertical", "boolean"), height >= width)
    given = _column(df, "region_id", "string")
    shaped = {
        "x": x, "y": y, "width": width, "height": height, "vertical": vertical,
        "forced_orientation": forced,
        "region_id": F.coalesce(F.nullif(given, F.lit("")), region_id(x, y, width, height)),
        "source": F.coalesce(F.nullif(_column(df, "source", "string"), F.lit("")), F.lit(source)),
        "computed": F.coalesce(_column(df, "computed", "boolean"), F.lit(False)),
        "font_size": F.coalesce(_column(df, "font_size", "int").cast("int"), F.lit(0)),
        "angle": F.coalesce(_column(df, "angle", "int").cast("int"), F.lit(0)),
    }
    return df.withColumns(shaped)


def with_signature(df: DataFrame, name: str = "box_signature") -> DataFrame:
    return df.withColumn(name, box_signature(*(F.col(c) for c in SIGNED)))


def with_polygon(df: DataFrame, name: str = "polygon") -> DataFrame:
    """Corner list of each box, clockwise from the top left."""
    box = g.from_size(*(F.col(c) for c in ("x", "y", "width", "height")))
    return df.withColumn(name, g.corners(box))


def crop_windows(
    df: DataFrame, page_width: Column, page_height: Column,
    pad_ratio: float | None = 0.05, pad_min: int | None = 4,
) -> DataFrame:
    """Padded crop rectangle of each box, clamped to the page. A zero or missing
    option means its default."""
    ratio, least = pad_ratio or 0.05, pad_min or 4
    box = g.from_size(*(F.col(c) for c in ("x", "y", "width", "height")))
    pad = F.greatest(F.lit(least), (F.least("width", "height") * F.lit(ratio)).cast("int"))
    crop = g.clipped(g.padded(box, pad), page_width, page_height)
    return df.withColumns(dict(zip(("crop_x1", "crop_y1", "crop_x2", "crop_y2"), crop)))


def compact_bbox(df: DataFrame, points: str = "points") -> DataFrame:
    """Point list to x, y, width, height (rounded half to even); no usable point gives nulls."""
    usable = F.filter(F.col(points), lambda p: F.size(p) >= 2)
    box = g.bounds(usable)
    return df.withColumns({
        "bbox_x": F.bround(box.x1, 0).cast("int"),
        "bbox_y": F.bround(box.y1, 0).cast("int"),
        "bbox_width": F.bround(box.x2 - box.x1, 0).cast("int"),
        "bbox_height": F.bround(box.y2 - box.y1, 0).cast("int"),
    })


def clipped_bbox(df: DataFrame, page_width: Column, page_height: Column, points: str = "points") -> DataFrame:
    """Bounding rectangle of a point list, kept inside the page and non-empty."""
    box = g.bounds(F.col(points))
    x1 = F.greatest(F.lit(0), F.least(box.x1, page_width - 1)).cast("int")
    y1 = F.greatest(F.lit(0), F.least(box.y1, page_height - 1)).cast("int")
    return df.withColumns({
        "clip_x1": x1, "clip_y1": y1,
        "clip_x2": F.least(F.greatest(box.x2, x1 + 1), page_width).cast("int"),
        "clip_y2": F.least(F.greatest(box.y2, y1 + 1), page_height).cast("int"),
    })


def line_candidate_box(df: DataFrame, lines: str = "lines") -> DataFrame:
    """Extent of all line points, padded by the font size (at least 10) and
    clamped to the box; null without points or without area."""
    points = F.filter(F.flatten(F.col(lines)), lambda p: F.size(p) >= 2)
    extent = g.bounds(points)
    pad = F.greatest(F.coalesce(F.col("font_size"), F.lit(0)), F.lit(10))

    def clamp(value: Column, low: Column, high: Column) -> Column:
        return F.greatest(low, F.least(F.bround(value, 0).cast("int"), high))

    right, bottom = F.col("x") + F.col("width"), F.col("y") + F.col("height")
    box = g.Rect(
        clamp(extent.x1 - pad, F.col("x"), right), clamp(extent.y1 - pad, F.col("y"), bottom),
        clamp(extent.x2 + pad, F.col("x"), right), clamp(extent.y2 + pad, F.col("y"), bottom),
    )
    usable = (F.size(points) > 0) & (box.x2 > box.x1) & (box.y2 > box.y1)
    x, y, width, height = g.size(box)
    return df.withColumns({
        "line_x": F.when(usable, x), "line_y": F.when(usable, y),
        "line_width": F.when(usable, width), "line_height": F.when(usable, height),
    })


def filter_detections(df: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Keep detections whose object confidence, and then whose object times best
    class confidence, exceed the threshold; the first best class wins."""
    best = F.array_max("class_scores")
    return (
        df.where(F.col("obj_conf") > threshold)
        .withColumns({
            "conf": F.col("obj_conf") * best,
            "cls": (F.array_position("class_scores", best) - 1).cast("int"),
        })
        .where(F.col("conf") > threshold)
    )


def apply_overrides(
    base: DataFrame, removed: DataFrame, patches: DataFrame, added: DataFrame,
    patch_columns: Sequence[str],
) -> DataFrame:
    """Base rows without the removed, patched by id, plus the added rows.

    Among added rows, and among patches, the last by ``ord`` wins; an added row
    replaces a base row of the same id, and removal beats both. "Last" is a
    partial aggregate, so a region with many patches leaves each task as one row.
    """
    patch_columns = [c for c in patch_columns if c in base.columns]

    def last(df: DataFrame, columns: Sequence[str]) -> DataFrame:
        packed = F.max_by(F.struct(*columns), F.struct("ord"))
        return df.groupBy(*KEYS).agg(packed.alias("_row")).select(*KEYS, "_row.*")

    def said(role: int, rows: DataFrame) -> DataFrame:
        return rows.withColumns({"_role": F.lit(role), "_turn": F.lit(0)})

    rows = said(BASE, base)
    for other in (
        said(REMOVED, removed.select(*KEYS).distinct()),
        said(PATCH, last(patches, patch_columns)),
        said(ADDED, last(added, [c for c in base.columns if c not in KEYS])),
    ):
        rows = rows.unionByName(other, allowMissingColumns=True)
    return overridden(rows, patch_columns)


def overridden(said: DataFrame, patch_columns: Sequence[str]) -> DataFrame:
    """What is left of base rows after removals, patches and added rows, all given as rows of one table.

    ``said`` has the columns of a base row, ``_role`` (REMOVED, PATCH, ADDED or BASE) and ``_turn``, by
    which the last patch and the last added row of a region win. Rows of a region are read once, in
    the order of the roles; base rows without a panel or region have no counterpart and stay as they are.
    """
    columns = [c for c in said.columns if c not in ("_role", "_turn")]
    role = F.col("_role")
    alone = F.when(~_keyed() & (role == BASE), F.xxhash64(F.to_json(F.struct(*columns))))
    region = (
        Window.partitionBy(*KEYS, "_alone").orderBy("_role", F.col("_turn").desc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    fix = F.when((role == PATCH) & _keyed(), F.struct(*patch_columns))
    read = said.withColumn("_alone", alone).withColumns({
        "_gone": F.max((role == REMOVED) & _keyed()).over(region),
        "_fix": F.first(fix, ignorenulls=True).over(region),
        "_added": F.count(F.when(role == ADDED, True)).over(region),
    })
    stays = ((role == BASE) & (F.col("_added") == 0)) | ((role == ADDED) & (F.col("_added") == 1))
    return read.where(stays & ~F.col("_gone")).select(*(
        F.when(role == BASE, F.coalesce(F.col("_fix")[c], F.col(c))).otherwise(F.col(c)).alias(c)
        if c in patch_columns else F.col(c)
        for c in columns
    ))


def active_boxes(boxes: DataFrame) -> DataFrame:
    """The manual boxes of a panel if it has any, else its detected ones."""
    manual = boxes.groupBy("panel_id").agg(F.bool_or(F.col("source") == "manual").alias("_manual"))
    return (
        boxes.join(manual, "panel_id")
        .where(~F.col("_manual") | (F.col("source") == "manual"))
        .drop("_manual")
    )


def without_orphans(annotations: DataFrame, boxes: DataFrame) -> DataFrame:
    """Annotations whose box is still active."""
    return annotations.join(active_boxes(boxes).select(*KEYS), KEYS, "left_semi")


def promote_active(boxes: DataFrame) -> DataFrame:
    """The active boxes, all marked manual."""
    return active_boxes(boxes).withColumn("source", F.lit("manual"))


def incremental_targets(
    boxes: DataFrame, annotations: DataFrame, changed_panels: DataFrame | None = None,
    fresh: bool = False,
) -> DataFrame:
    """Boxes to recompute, each with the first reason that applies: fresh,
    settings, uncomputed, missing or stale."""
    stored = annotations.select(*KEYS, F.col("box_signature").alias("_stored"), F.lit(True).alias("_known"))
    joined = with_signature(boxes).join(stored, KEYS, "left")
    if changed_panels is None:
        joined = joined.withColumn("_changed", F.lit(False))
    else:
        flagged = changed_panels.select("panel_id").distinct().withColumn("_changed", F.lit(True))
        joined = joined.join(flagged, "panel_id", "left")
    reason = (
        F.when(F.lit(fresh), "fresh")
        .when(F.col("_changed"), "settings")
        .when(~F.coalesce(F.col("computed"), F.lit(False)), "uncomputed")
        .when(F.col("_known").isNull(), "missing")
        .when(~F.col("_stored").eqNullSafe(F.col("box_signature")), "stale")
    )
    return joined.withColumn("reason", reason).where(F.col("reason").isNotNull()).drop("_stored", "_known", "_changed")


def result_view(boxes: DataFrame, annotations: DataFrame) -> DataFrame:
    """One row per active box in order: the stored annotation where the box is
    computed and unchanged, else an uncomputed placeholder."""
    stored = annotations.select(
        *KEYS, F.col("box_signature").alias("_stored"), F.col("text").alias("_text"),
        F.col("confidence").alias("_confidence"),
    )
    shown = ordered_index(active_boxes(boxes), ["panel_id"], by(["ord"]), "reading_order")
    joined = with_signature(shown).join(stored, KEYS, "left")
    valid = F.coalesce(F.col("computed") & (F.col("_stored") == F.col("box_signature")), F.lit(False))
    facing = F.coalesce(
        F.col("forced_orientation"), F.when(F.col("vertical"), "vertical").otherwise("horizontal"))
    return joined.select(
        *KEYS, "reading_order", "x", "y", "width", "height", "vertical",
        F.when(valid, F.coalesce(F.col("_text"), F.lit(""))).otherwise("").alias("text"),
        F.when(valid, F.coalesce(F.col("_confidence"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(valid, F.length("_text")).otherwise(0).cast("bigint").alias("char_count"),
        facing.alias("recognized_orientation"),
        F.when(F.col("forced_orientation").isNotNull(), "manual").otherwise("box").alias("orientation_source"),
        valid.alias("computed"),
        F.when(valid, "computed").otherwise("uncomputed").alias("ocr_status"),
        F.col("source").alias("box_source"),
    )


def apply_partial_result(
    boxes: DataFrame, annotations: DataFrame, targets: DataFrame, returned: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """New (boxes, annotations) after a recogniser answered for ``targets``.

    Old annotations of targets go, returned ones come in with the signature of
    their box, and a detected target without an answer is dropped. It is the
    upsert a table MERGE does, written as whole new tables.
    """
    def packed(df: DataFrame, name: str) -> DataFrame:
        return df.select(*KEYS, F.struct(*(c for c in df.columns if c not in KEYS)).alias(name))

    payload = [c for c in annotations.columns if c != "box_signature"]
    rows = packed(boxes, "box")
    for other in (
        packed(annotations, "stored"), packed(returned.select(*payload), "answer"),
        targets.select(*KEYS).distinct().withColumn("asked", F.lit(True)),
    ):
        rows = rows.unionByName(other, allowMissingColumns=True)
    return partial_boxes(rows), partial_annotations(rows)


def partial_annotations(said: DataFrame) -> DataFrame:
    """New annotations, from rows of one table that say something about a region: ``asked`` (it is a
    target), ``box``, ``stored`` (annotation) and ``answer``, structs without the keys.

    A row may say several of these; what it does not say is null. Rows without a panel or region
    have no counterpart.
    """
    held = said.select("stored.*").columns
    rows = said.select(
        *KEYS, "stored", "answer", F.coalesce(F.col("asked") & _keyed(), F.lit(False)).alias("_asked"),
        F.when(F.col("box").isNotNull() & _keyed(), F.struct(*(F.col("box")[c].alias(c) for c in SIGNED))).alias("_box"),
        F.when(~_keyed(), F.xxhash64(F.to_json("stored"))).alias("_alone"),
        F.col("answer").isNotNull().cast("int").alias("_answers"),
    )
    region = Window.partitionBy(*KEYS, "_alone").orderBy("_answers")
    answered = F.when(F.col("_answers") == 1, F.col("_box"))
    met = rows.withColumns({
        "_asked": F.max("_asked").over(region.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)),
        # Only rows with an answer get the boxes, those of rows without one and those of their own kind.
        "_boxes": F.concat(
            F.collect_list("_box").over(region.rangeBetween(-1, -1)),
            F.collect_list(answered).over(region.rangeBetween(Window.currentRow, Window.currentRow))),
    })
    # An answer counts for each box of its region, a stored annotation once.
    counts = (
        F.when(F.col("_asked") & F.col("answer").isNotNull(), F.col("_boxes"))
        .when(~F.col("_asked") & F.col("stored").isNotNull(), F.array("_box"))
    )
    signature = box_signature(*(F.col("_of")[c] for c in SIGNED))
    return met.select(*KEYS, "stored", "answer", "_asked", F.explode(counts).alias("_of")).select(*KEYS, *(
        F.when(F.col("_asked"), signature if c == "box_signature" else F.col("answer")[c])
        .otherwise(F.col("stored")[c]).alias(c)
        for c in held
    ))


def partial_boxes(said: DataFrame) -> DataFrame:
    """New boxes, from the same rows as those of :func:`partial_annotations`."""
    held = said.select("box.*").columns
    rows = said.select(
        *KEYS, F.coalesce(F.col("asked") & _keyed(), F.lit(False)).alias("_asked"),
        (F.col("answer").isNotNull() & _keyed()).alias("_answered"), F.col("box").isNotNull().alias("_is_box"),
        F.when(~_keyed(), F.xxhash64(*(F.col("box")[c] for c in SIGNED))).alias("_alone"), "box.*",
    )
    region = Window.partitionBy(*KEYS, "_alone")
    met = rows.withColumns({name: F.max(name).over(region) for name in ("_asked", "_answered")})
    lost = F.col("_asked") & ~F.col("_answered")
    return (
        met.where(F.col("_is_box") & ~(lost & (F.col("source") == "detected")))
        .withColumn("computed", F.when(F.col("_asked"), F.col("_answered")).otherwise(F.col("computed")))
        .select(*KEYS, *held)
    )


def upper_median_height(boxes: DataFrame) -> DataFrame:
    """Upper median height per panel and the row tolerance made from it.

    The discrete percentile over descending heights keeps one counter per
    distinct height, so no panel's boxes are gathered.
    """
    median = F.expr("percentile_disc(0.5) within group (order by _tall desc)")
    return (
        boxes.withColumn("_tall", tall_enough(F.col("height"))).groupBy("panel_id")
        .agg(median.cast("int").alias("median_height"))
        .withColumn("row_tolerance", row_tolerance(F.col("median_height")))
    )


def tall_enough(height: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(height, F.lit(1)))


def row_tolerance(median_height: Column) -> Column:
    return F.greatest(F.lit(24), (median_height * F.lit(0.7)).cast("int"))


def group_extent(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Smallest rectangle around all members of a group, with their number."""
    return df.groupBy(*keys).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"),
        F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.count(F.lit(1)).alias("members"),
    )


def orientation_stats(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Direction, font size and angle of a block from its line quadrilaterals.

    ``lines`` has one row per line: the block keys, language and points (four
    corners). Everything is a sum, so blocks of any length combine map side.
    """
    def mid(i: int, j: int, axis: int) -> Column:
        return (F.col("points")[i][axis] + F.col("points")[j][axis]) / 2

    sums = lines.groupBy(*keys).agg(
        *(F.sum(mid(2, 3, a) - mid(1, 0, a)).alias(f"v{n}") for a, n in ((0, "x"), (1, "y"))),
        *(F.sum(mid(1, 2, a) - mid(3, 0, a)).alias(f"h{n}") for a, n in ((0, "x"), (1, "y"))),
        F.count(F.lit(1)).alias("line_count"),
        F.max("language").alias("language"),
    )
    norm_v, norm_h = F.hypot("vx", "vy"), F.hypot("hx", "hy")
    vertical = F.when(F.col("language") == "ja", norm_v > norm_h).otherwise(norm_v > norm_h * 2)
    shaped = sums.withColumns({"norm_v": norm_v, "norm_h": norm_h, "vertical": vertical})
    vec_x = F.when(F.col("vertical"), F.col("vx")).otherwise(F.col("hx"))
    vec_y = F.when(F.col("vertical"), F.col("vy")).otherwise(F.col("hy"))
    size = F.when(F.col("vertical"), F.col("norm_h")).otherwise(F.col("norm_v")) / F.col("line_count")
    turned = (F.atan2(vec_y, vec_x) / F.lit(3.141592653589793) * 180).cast("int")
    angle = F.when(F.col("vertical"), turned - 90).otherwise(turned)
    return shaped.select(
        *keys, "language", "line_count", "vertical",
        vec_x.alias("vec_x"), vec_y.alias("vec_y"),
        F.hypot(vec_x, vec_y).alias("norm"),
        F.bround(size, 0).cast("int").alias("font_size"),
        F.when(F.abs(angle) < 3, 0).otherwise(angle).cast("int").alias("angle"),
    )


def line_distances(lines: DataFrame, stats: DataFrame, keys: Sequence[str], page_width: float) -> DataFrame:
    """Distance of each line's centre from its block's reading axis."""
    cx = (F.col("points")[0][0] + F.col("points")[2][0]) / 2
    cy = (F.col("points")[0][1] + F.col("points")[2][1]) / 2
    joined = lines.drop("language").join(stats, list(keys))
    dx = cx - F.when(F.col("vertical"), F.lit(float(page_width))).otherwise(F.lit(0.0))
    reach = F.hypot(dx, cy)
    cosine = (dx * F.col("vec_x") + cy * F.col("vec_y")) / (reach * F.col("norm") + F.lit(1e-10))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    return joined.withColumn("distance", F.abs(F.sin(F.acos(cosine)) * reach))
