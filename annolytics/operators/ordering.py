"""Reading order, line grouping, numbering and naming."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from annolytics.functions import geometry as g
from annolytics.functions.hashing import file_stem
from annolytics.operators.boxes import row_tolerance, tall_enough, upper_median_height
from annolytics.plans.folds import first_fit, fold, once
from annolytics.plans.skew import FOLD_ROWS, WINDOW_ROWS, ordered_index, running_total, split_groups, top_rows, with_previous
from annolytics.plans.storage import settle


# Room for rounding where reaches decide what may be folded apart.
SLACK = 1e-6


def reading_bands(boxes: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Boxes with ``band`` and ``reading_order``: rough rows from top to bottom,
    right to left inside a row.

    Boxes come in order of (y, -x); each joins the first band whose mean centre
    is within the panel's row tolerance. Ordinary panels are gathered once, and
    tolerance, bands and order come from the panel's own array; give only the
    columns that are needed. Crowded panels go by joins.
    """
    ordinary, heavy = split_groups(boxes, ["panel_id"], fold_rows)
    result = _gathered_bands(ordinary)
    return result if heavy is None else result.unionByName(_crowded_bands(settle(heavy), fold_rows))


def _near(band: Column, node: Column) -> Column:
    return F.abs(node["center"] - band["total"] / band["n"]) <= node["row_tolerance"]


def _widened(band: Column, node: Column) -> Column:
    return F.struct((band["total"] + node["center"] * node["n"]).alias("total"), (band["n"] + node["n"]).alias("n"))


def _new_band(node: Column) -> Column:
    return F.struct((node["center"] * node["n"]).alias("total"), node["n"].alias("n"))


_BAND = "struct<total:double,n:bigint>"


def _gathered_bands(boxes: DataFrame) -> DataFrame:
    """Bands of panels that fit into one array each."""
    row = F.struct(*(F.col(c) for c in boxes.columns if c != "panel_id"))
    # y, -x and ord decide the order; the rest of the struct is the row.
    entry = F.struct(
        F.col("y").alias("_y"), (-F.col("x")).alias("_x"), F.col("ord").alias("_o"),
        (F.col("y") + F.col("height") / 2).alias("center"), F.lit(1).cast("bigint").alias("n"), row.alias("row"))
    panels = boxes.where("panel_id is not null").groupBy("panel_id").agg(F.array_sort(F.collect_list(entry)).alias("nodes"))
    heights = F.array_sort(F.transform("nodes", lambda n: tall_enough(n["row"]["height"])))
    middle = F.get(heights, F.floor(F.size("nodes") / 2).cast("int")).cast("int")
    nodes = once(row_tolerance(middle), lambda near: F.transform("nodes", lambda n: F.struct(
        n["center"].alias("center"), n["n"].alias("n"), near.alias("row_tolerance"))))
    none = F.array().cast(f"array<{_BAND}>")
    banded = panels.withColumn("member_of", fold(nodes, none, _near, _widened, _new_band)["member_of"])
    inside = F.array_sort(F.zip_with("nodes", "member_of", lambda n, band: F.struct(
        band.alias("band"), (-(n["row"]["x"] + n["row"]["width"] / 2)).alias("_c"), n["_y"], n["_x"], n["_o"], n["row"].alias("row"))))
    placed = banded.select("panel_id", F.posexplode(inside).alias("_at", "_e"))
    shown = (F.col("panel_id") if c == "panel_id" else F.col(f"_e.row.{c}").alias(c) for c in boxes.columns)
    return placed.select(*shown, F.col("_e.band").alias("band"), (F.col("_at") + 1).cast("bigint").alias("reading_order"))


def _crowded_bands(boxes: DataFrame, fold_rows: int) -> DataFrame:
    """The same by joins.

    Boxes at one place follow each other; if they share a height they land in
    one band (their centre pulls its mean closer), so they enter as one
    weighted node, and copies cost nothing.
    """
    spot = ["panel_id", "y", "x"]
    mixed = boxes.groupBy(*spot).agg((F.min("height") != F.max("height")).alias("_mixed"))
    tied = boxes.join(mixed, spot).withColumn("_tie", F.when(F.col("_mixed"), F.col("ord")).otherwise(0)).drop("_mixed")
    place = ["y", "x", "_tie", "height"]
    nodes = (
        tied.groupBy("panel_id", *place).agg(F.count(F.lit(1)).alias("n"))
        .join(upper_median_height(boxes), "panel_id")
        .withColumn("center", F.col("y") + F.col("height") / 2)
    )
    bands = first_fit(
        nodes, ["panel_id"], [F.col("y"), -F.col("x"), F.col("_tie")],
        [*place, "center", "n", "row_tolerance"], _BAND, matches=_near, absorb=_widened, opened=_new_band,
        limit=fold_rows,
        # A band's mean lies among its centres, so centres further apart than the tolerance never meet.
        interval=(F.col("center"), F.col("center") + F.col("row_tolerance") + SLACK),
    ).select("panel_id", *place, F.col("group").alias("band"))
    placed = tied.join(bands, ["panel_id", *place]).drop("_tie")
    inside = [F.col("band"), -(F.col("x") + F.col("width") / 2), F.col("y"), -F.col("x"), F.col("ord")]
    return ordered_index(placed, ["panel_id"], inside, "reading_order")


def grid_order(
    blocks: DataFrame, page_width: float, page_height: float, flip_language: str = "ja",
) -> DataFrame:
    """Blocks with ``weight`` and ``grid_order`` on a 4 x 3 page grid.

    The page reads right to left when most blocks are in ``flip_language``. A
    wide page counts as two facing pages, the second after the first.
    """
    rows, columns = 4, 3
    spread = page_width > page_height
    width = page_width / 2 if spread else page_width
    area = page_height * width
    majority = blocks.groupBy("panel_id").agg(
        (F.count_if(F.col("language") == flip_language) > F.count(F.lit(1)) / 2).alias("flipped"))
    mid_x, mid_y = g.center(g.rect())
    across = F.when(F.col("flipped"), F.lit(float(page_width)) - mid_x).otherwise(mid_x)
    placed = blocks.join(majority, "panel_id").withColumns({"_ax": across, "_ay": mid_y}).withColumns({
        "_gx": (F.col("_ax") / width * columns).cast("int"),
        "_gy": (F.col("_ay") / page_height * rows).cast("int"),
    })
    weight = (
        (F.col("_gy") * columns + F.col("_gx")) * F.lit(float(area))
        + (F.col("_ax") - F.col("_gx") * width / columns) * 1.2
        + (F.col("_ay") - F.col("_gy") * page_height / rows)
    )
    if spread:
        weight = weight + F.when(F.col("_gx") >= columns, F.lit(float(area * rows * columns))).otherwise(F.lit(0.0))
    weighed = placed.withColumn("weight", weight).drop("_ax", "_ay", "_gx", "_gy", "flipped")
    return ordered_index(weighed, ["panel_id"], ["weight", "ord"], "grid_order")


def split_by_gap(lines: DataFrame, keys: Sequence[str], limit: int = WINDOW_ROWS) -> DataFrame:
    """Lines with ``sub_block``: a block is cut where a line stands apart.

    Lines are taken by distance, then ``ord``. A line that does not overlap the
    one before starts a sub-block if it is further than two font sizes, or, in
    an upright vertical block, if its first point is more than a font size
    lower or higher and either the running sub-block has two lines already or
    the distance is above one font size.

    The "two lines already" part refers to the previous decision. A line
    therefore either decides by itself or negates the previous decision, and a
    run of negations ends at the last line that decided by itself: a running
    count of deciding lines and the parity of the steps since give the answer
    without a fold.
    """
    keys = list(keys)
    order = ["distance", "ord"]
    here = lines.withColumn("_box", F.struct("x1", "y1", "x2", "y2"))
    ordinary, heavy = split_groups(here, keys, limit)
    # Ordinary keys: all steps look back in one order, so one shuffle and one sort serve them.
    back = Window.partitionBy(*keys).orderBy(*order)
    upto = back.rowsBetween(Window.unboundedPreceding, 0)
    marked = _own_decisions(ordinary.withColumn("_prev", F.lag(F.struct("distance", "first_y", "_box")).over(back)))
    placed = marked.withColumn("_at", F.row_number().over(back))
    decider = F.when(F.col("_own").isNotNull(), F.struct("_own", "_at"))
    placed = placed.withColumn("_run", F.last(decider, ignorenulls=True).over(upto))
    starts = _starts(F.col("_run._own"), F.col("_at") - F.col("_run._at") + 1).cast("bigint")
    result = placed.withColumn("sub_block", F.sum(starts).over(upto)).drop("_own", "_at", "_run")
    if heavy is None:
        return result
    here = with_previous(heavy, keys, order, ["distance", "first_y", "_box"], "_prev", limit)
    marked = _own_decisions(here)
    runs = running_total(marked, keys, order, F.col("_own").isNotNull().cast("int"), "_run", limit)
    placed = ordered_index(runs, [*keys, "_run"], order, "_step", limit)
    deciders = runs.where(F.col("_own").isNotNull()).select(*keys, "_run", F.col("_own").alias("_start"))
    joined = placed.join(deciders, [*keys, "_run"])
    starts = _starts(F.col("_start"), F.col("_step"))
    numbered = running_total(joined.withColumn("_starts", starts), keys, order, F.col("_starts").cast("int"),
                             "sub_block", limit)
    return result.unionByName(numbered.drop("_own", "_run", "_step", "_start", "_starts"))


def _own_decisions(lines: DataFrame) -> DataFrame:
    """Lines with ``_own``: whether they start a block, null where they negate the decision before."""
    apart = g.overlap(g.rect(), g.rect_in(F.col("_prev._box"))) <= 0
    step = F.abs(F.col("distance") - F.col("_prev.distance"))
    far = apart & (step > F.col("font_size") * 2)
    shifted = (
        apart & F.col("vertical") & (F.abs("angle") < 15)
        & (F.abs(F.col("first_y") - F.col("_prev.first_y")) > F.col("font_size"))
    )
    first = F.col("_prev").isNull()
    surely = first | far | (shifted & (step > F.col("font_size")))
    return lines.withColumn(
        "_own", F.when(surely, F.lit(True)).when(~shifted, F.lit(False))
    ).drop("_prev", "_box")


def _starts(decided: Column, step: Column) -> Column:
    """The decision ``step`` lines into a run that begins with ``decided``."""
    return F.when(step % 2 == 1, decided).otherwise(~decided)


def cluster_lines(
    lines: DataFrame, font_ratio: float = 1.3, gap_fonts: float = 2.0, min_cosine: float = 0.866,
    fold_rows: int = FOLD_ROWS,
) -> DataFrame:
    """Scattered lines with ``cluster``: each line, in order of distance, joins
    the first cluster that accepts it.

    A cluster accepts a line that overlaps its last line, or one of similar
    font size and direction that follows closely. Font size is averaged and
    direction summed as the cluster grows. Handing lines to the first accepting
    seed gives the same clusters as letting each seed absorb later lines in
    turn, since a seed sees a line only after all earlier lines were decided.
    """
    fields = ["ord", "distance", "font_size", "vec_x", "vec_y", "first_x", "first_y", "x1", "y1", "x2", "y2"]
    shape = ("struct<n:bigint,font:double,vx:double,vy:double,distance:double,fx:double,fy:double,"
             "x1:double,y1:double,x2:double,y2:double>")

    def last_of(n: Column) -> list[Column]:
        return [
            n["distance"].cast("double").alias("distance"), n["first_x"].cast("double").alias("fx"),
            n["first_y"].cast("double").alias("fy"), *(n[c].cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")),
        ]

    def font(c: Column, n: Column) -> Column:
        return (c["font"] * c["n"] + n["font_size"]) / (c["n"] + 1)

    def accepts(c: Column, n: Column) -> Column:
        ratio = c["font"] / (n["font_size"] + F.lit(1e-10))
        norms = F.hypot(c["vx"], c["vy"]) * F.hypot(n["vec_x"].cast("double"), n["vec_y"].cast("double"))
        cosine = (c["vx"] * n["vec_x"] + c["vy"] * n["vec_y"]) / (norms + F.lit(1e-10))
        jump = F.hypot(n["first_x"] - c["fx"], n["first_y"] - c["fy"])
        similar = (
            (ratio <= font_ratio) & (F.lit(1.0) / (ratio + F.lit(1e-300)) <= font_ratio)
            & (F.abs(cosine) >= min_cosine)
            & (n["distance"] - c["distance"] <= font(c, n) * gap_fonts) & (jump <= font(c, n) * 2.5)
        )
        return (g.overlap(g.rect_in(c), g.rect_in(n)) > 0) | similar

    def absorb(c: Column, n: Column) -> Column:
        return F.struct(
            (c["n"] + 1).alias("n"), font(c, n).alias("font"),
            (c["vx"] + n["vec_x"]).alias("vx"), (c["vy"] + n["vec_y"]).alias("vy"), *last_of(n))

    def opened(n: Column) -> Column:
        return F.struct(
            F.lit(1).cast("bigint").alias("n"), n["font_size"].cast("double").alias("font"),
            n["vec_x"].cast("double").alias("vx"), n["vec_y"].cast("double").alias("vy"), *last_of(n))

    # A cluster reaches from its last line as far as that overlaps, or 2.5 mean font sizes from its first point.
    largest = lines.groupBy("panel_id").agg((F.max("font_size") * 2.5 + SLACK).alias("_far"))
    ranged = lines.join(largest, "panel_id")
    grouped = first_fit(
        ranged, ["panel_id"], [F.col("distance"), F.col("ord")], fields, shape, accepts, absorb, opened,
        limit=fold_rows, interval=(
            F.least("y1", "first_y").cast("double"), F.greatest("y2", "first_y").cast("double") + F.col("_far")))
    return lines.join(grouped.select("panel_id", "ord", F.col("group").alias("cluster")), ["panel_id", "ord"])


def limit_per_panel(boxes: DataFrame, n: int, order: Sequence[str] = ("ord",)) -> DataFrame:
    """First ``n`` boxes of each panel in reading order (a report limit)."""
    return top_rows(boxes, ["panel_id"], order, n, "place")


def instance_ids(instances: DataFrame, prefix: str = "bubble") -> DataFrame:
    """Numbered ids per panel by (y, x, -confidence)."""
    order = ["y1", "x1", F.col("confidence").desc(), "ord"]
    numbered = ordered_index(instances, ["panel_id"], order, "_n")
    return numbered.withColumn("instance_id", F.format_string(f"{prefix}_%03d", "_n")).drop("_n")


def shared_once(rows: DataFrame, order: str = "ord") -> DataFrame:
    """``mode``: the first row of a shared container paints it, later rows reuse
    it, rows without a container stand alone."""
    first = (
        rows.where(F.col("bubble_id").isNotNull())
        .groupBy("panel_id", "bubble_id").agg(F.min(order).alias("_first"))
    )
    mode = (
        F.when(F.col("bubble_id").isNull(), "alone")
        .when(F.col(order) == F.col("_first"), "paint").otherwise("reuse")
    )
    return rows.join(first, ["panel_id", "bubble_id"], "left").withColumn("mode", mode).drop("_first")


@F.pandas_udf(StringType())
def _ascii(names: pd.Series) -> pd.Series:
    folded = names.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")
    return folded.where(names.notna(), None)


# Accepted upload suffixes.
UPLOAD_SUFFIXES = (".jpg", ".jpeg", ".png")


def clean_names(df: DataFrame, raw: str = "raw_name", suffixes: Sequence[str] = UPLOAD_SUFFIXES) -> DataFrame:
    """``stem`` and ``suffix`` of an upload: last path component, ASCII letters,
    digits, dash and underscore, at most 100 characters. Other suffixes drop out."""
    last = F.regexp_extract(F.replace(F.col(raw), F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(last, r"^.+(\.[^.]+)$", 1))
    dashed = F.regexp_replace(_ascii(file_stem(last)), "[^A-Za-z0-9_-]+", "-")
    stem = F.coalesce(F.nullif(F.btrim(dashed, F.lit("-._")), F.lit("")), F.lit("panel"))
    short = F.coalesce(F.nullif(F.rtrim(F.substring(stem, 1, 100), F.lit("-._")), F.lit("")), F.lit("panel"))
    return df.withColumns({"suffix": suffix, "stem": short}).where(F.col("suffix").isin(*suffixes))


def unique_names(new: DataFrame, taken: DataFrame, order: Sequence[str]) -> DataFrame:
    """New rows with a ``filename`` no one has: stem, then stem-2, stem-3, ...

    ``order`` must be a total order. Two stems can meet on one name (number 2 of
    ``a`` is number 1 of ``a-2``); the earlier row keeps it and the others draw
    again with all given names taken, until every name is unique.
    """
    columns = new.columns
    new = settle(new)
    named = settle(_numbered_names(new, taken, order))
    place = F.struct(*order)
    while True:
        first = named.groupBy("filename").agg(F.min(place).alias("_first"), F.count(F.lit(1)).alias("_n"))
        clash = first.where(F.col("_n") > 1)
        if clash.isEmpty():
            return named
        lost = settle(
            named.join(clash, "filename").where(place != F.col("_first")).select(*columns))
        kept = named.join(lost.select(*order), list(order), "left_anti")
        known = taken.select("filename").unionByName(kept.select("filename"))
        named = settle(kept.unionByName(_numbered_names(lost, known, order)))


def _numbered_names(new: DataFrame, taken: DataFrame, order: Sequence[str]) -> DataFrame:
    """The r-th new name of a stem gets the r-th number no taken name uses.

    If t(j) is the j-th used number, t(j) - j free numbers lie below it, so the
    r-th free number is r plus the used numbers with t(j) - j < r. Sorted
    together on that scale, a new name's place in the merged order *is* its
    number.
    """
    group = ["stem", "suffix"]
    columns = new.columns
    wanted = ordered_index(new, group, order, "_r").withColumn("_scale", F.col("_r")).withColumn("_old", F.lit(0))
    known = taken.select("filename").distinct()
    whole = known.select(
        F.regexp_extract("filename", r"^(.*)(\.[^.]+)$", 1).alias("stem"),
        F.regexp_extract("filename", r"^(.*)(\.[^.]+)$", 2).alias("suffix"),
        F.lit(1).cast("bigint").alias("_t"),
    )
    tail = r"^(.*)-([2-9]|[1-9][0-9]{1,17})(\.[^.]+)$"
    numbered = known.where(F.col("filename").rlike(tail)).select(
        F.regexp_extract("filename", tail, 1).alias("stem"),
        F.regexp_extract("filename", tail, 3).alias("suffix"),
        F.regexp_extract("filename", tail, 2).cast("bigint").alias("_t"),
    )
    used = settle(whole.unionByName(numbered).distinct().join(new.select(*group).distinct(), group, "left_semi"))
    used = ordered_index(used, group, ["_t"], "_j").select(
        *group, (F.col("_t") - F.col("_j")).alias("_scale"), F.lit(1).alias("_old"))
    merged = wanted.select(*columns, "_scale", "_old").unionByName(used, allowMissingColumns=True)
    # On equal scale the new name comes first, since t(j) - j < r is strict;
    # used numbers of equal scale are interchangeable.
    placed = ordered_index(merged, group, ["_scale", "_old", *order], "_n").where(F.col("_old") == 0)
    name = F.when(F.col("_n") == 1, F.concat("stem", "suffix")).otherwise(
        F.concat(F.col("stem"), F.lit("-"), F.col("_n").cast("string"), F.col("suffix")))
    return placed.withColumn("filename", name).select(*columns, "filename")


def with_offsets(pieces: DataFrame, keys: Sequence[str], position: str = "pos") -> DataFrame:
    """Start and end of each piece of a text: gaps and lengths summed in order."""
    width = F.col("gap") + F.length("surface")
    summed = running_total(pieces, keys, [position], width, "end")
    return summed.withColumn("start", F.col("end") - F.length("surface"))


def state_change_log(versions: DataFrame) -> DataFrame:
    """Versions whose state hash differs from the version before; the first is no edit."""
    seen = with_previous(versions, ["panel_id"], ["ts", "version_id"], ["state_hash"], "_before")
    return (
        seen.where(F.col("_before.state_hash") != F.col("state_hash"))
        .withColumn("previous_hash", F.col("_before.state_hash")).drop("_before")
    )


def latest_artifact(results: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Newest artifact per panel, the lowest cache key on a tie: one partial aggregate."""
    newest = F.struct(F.col("saved_at"), -F.col("cache_key"))
    picked = F.max_by(F.struct(*columns), newest)
    return results.groupBy("panel_id").agg(picked.alias("_a")).select("panel_id", "_a.*")
