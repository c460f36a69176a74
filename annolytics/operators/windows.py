"""Context windows over dialogue lines, model calls per window, and answers.

A line row is panel_id, line_id, ord (1-based, dense in its panel), text,
orientation.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions.responses import aligned_translations, response_parts
from annolytics.operators import annotations as an
from annolytics.plans.skew import ordered_index
from annolytics.plans.storage import bound_batches, settle

# Lines per window, and how many of them are targets.
WINDOW_LINES, TARGET_LINES = 10, 8
# Prompts that one call of a model gets at most.
MODEL_ROWS = 256

# Names of target languages.
LANGUAGES = {"en": "English", "de": "German", "fr": "French", "es": "Spanish"}

STYLES = {
    "literal": "Keep close to the wording of the source.",
    "learner": "Sound natural, and keep the wording useful for a language learner.",
    "natural": "Sound like natural dialogue, with its feeling and tone.",
}


def context_windows(lines: DataFrame, size: int = WINDOW_LINES, targets: int = TARGET_LINES) -> DataFrame:
    """(line columns, window, role) for every line of every window.

    Up to ``size`` lines make one window. Beyond that, targets go in chunks and
    free places take context, alternately before and after, before first. With
    s free places, B lines before and A after, that is
    min(B, max(ceil(s/2), s - A)) before and the rest after. A line finds the
    few windows that may hold it by arithmetic; nothing is joined but the line
    count of its panel.
    """
    totals = lines.groupBy("panel_id").agg(F.count(F.lit(1)).cast("bigint").alias("_n"))
    near = (size - 1 + targets - 1) // targets
    counted = lines.join(totals, "panel_id").withColumns({"_p": F.col("ord").cast("bigint") - 1})
    home = F.floor(F.col("_p") / targets).cast("bigint")
    many = F.col("_n") > size
    last = F.floor((F.col("_n") - 1) / targets).cast("bigint")
    options = F.when(many, F.sequence(
        F.greatest(F.lit(0).cast("bigint"), home - near), F.least(last, home + near))).otherwise(
        F.array(F.lit(0).cast("bigint")))
    spread = counted.withColumns({"_home": F.when(many, home).otherwise(0), "window": F.explode(options)})
    start = F.col("window") * targets
    end = F.least(start + targets, F.col("_n"))
    free = F.lit(size) - (end - start)
    after_all = F.col("_n") - end
    before = F.least(start, F.greatest(F.ceil(free / 2), free - after_all))
    after = F.least(after_all, free - before)
    inside = (F.col("_p") >= start - before) & (F.col("_p") < end + after)
    role = F.when(F.col("window") == F.col("_home"), "target").otherwise("context")
    return (
        spread.withColumn("role", role)
        .where((F.col("role") == "target") | (many & inside))
        .drop("_n", "_p", "_home")
    )


def _window_rows(windows: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row per window with its (at most ten) lines in order."""
    fields = ["ord", "line_id", "role", "orientation", "text", *extra]
    return windows.groupBy("panel_id", "window").agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("lines"))


def _ids(role: str) -> Column:
    held = F.filter("lines", lambda e: e["role"] == role)
    return F.transform(held, lambda e: e["line_id"].cast("string"))


def prompt_rows(windows: DataFrame, language: str = "en", style: str = "natural", box: str | None = None) -> DataFrame:
    """One prompt per window: instruction, target ids in order, and lines as JSON."""
    rows = _window_rows(windows, (box,) if box else ())

    def line(e: Column) -> Column:
        parts = [
            e["line_id"].cast("string").alias("id"), e["role"].alias("role"), e["ord"].alias("order"),
            e["orientation"].alias("orientation"), e["text"].alias("text"),
        ]
        return F.struct(*parts, *([e[box].alias("box")] if box else []))

    head = (
        f"Translate the target lines into {LANGUAGES.get(language, language)}. "
        f"{STYLES.get(style, STYLES['natural'])}\n"
        "Lines with role context only show the surroundings; leave them out of the answer.\n"
        'Answer with JSON only: {"translations":[{"id":"<id>","translation":"<text>"}]}\n'
        "Target ids, in this order: "
    )
    shaped = rows.withColumns({
        "target_ids": _ids("target"), "context_ids": _ids("context"),
        "lines_json": F.to_json(F.transform("lines", line)),
    })
    return shaped.withColumn(
        "prompt", F.concat(F.lit(head), F.to_json("target_ids"), F.lit("\n\nLines:\n"), F.col("lines_json"))
    ).drop("lines")


def window_debug(windows: DataFrame) -> DataFrame:
    """Line count and id lists per window."""
    rows = _window_rows(windows)
    return rows.select(
        "panel_id", "window", F.size("lines").alias("line_count"),
        _ids("target").alias("target_ids"), _ids("context").alias("context_ids"))


def call_model(prompts: DataFrame, model: Callable[[list[str]], list[str]], column: str = "raw") -> DataFrame:
    """Prompts with the model's raw answers. ``model`` maps prompts to answers; it runs on
    the executors, on at most ``MODEL_ROWS`` prompts at a time, so a task never holds more."""
    schema = T.StructType([*prompts.schema.fields, T.StructField(column, T.StringType())])
    at, most = prompts.columns.index("prompt"), MODEL_ROWS
    bound_batches(prompts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, most):
                part = batch.slice(first, most)
                answers = pa.array(model(part.column(at).to_pylist()), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, answers], schema.names)

    return prompts.mapInArrow(run, schema)


def read_answers(answered: DataFrame, raw: str = "raw", ids: str = "target_ids") -> DataFrame:
    """One row per target id with its translation, '' where the answer lacks it."""
    keys = [c for c in answered.columns if c not in (raw, ids)]
    texts = aligned_translations(F.col("_parts"), F.col(ids))
    parsed = answered.withColumn("_parts", response_parts(F.col(raw)))
    return parsed.select(*keys, F.explode(F.arrays_zip(
        F.col(ids).alias("id"), texts.alias("translated"))).alias("_t")).select(
        *keys, F.col("_t.id").alias("id"), F.col("_t.translated").alias("translated"))


def translate(
    lines: DataFrame, model: Callable[[list[str]], list[str]], language: str = "en", style: str = "natural",
) -> DataFrame:
    """(panel_id, line_id, translated) for every line, through context windows."""
    prompts = prompt_rows(context_windows(lines), language, style).select("panel_id", "window", "target_ids", "prompt")
    answers = read_answers(call_model(prompts, model).drop("prompt"))
    return answers.select("panel_id", F.col("id").alias("line_id"), "translated")


def translation_job(
    annotations: DataFrame, model: Callable[[list[str]], list[str]], engine: str, language: str = "en", style: str = "natural",
) -> tuple[DataFrame, DataFrame]:
    """(annotations with translations and their flags, one status row per panel).

    Annotations that are computed and hold text become lines in reading order,
    go through context windows to the model, whose answers are written once, and
    come back by region. Others, and regions the model left out, have an empty
    translation, and the flags say which of them should have had one.

    Status: ``asked`` lines, ``answered`` with a translation that is not blank,
    ``missing`` placed annotations without one, and ``success``: nothing was
    asked or something was answered, so a model that fails on a whole panel
    never reports success.
    """
    region = annotations.schema["region_id"].dataType
    asked = an.computed_text(annotations).where(F.col("panel_id").isNotNull() & F.col("region_id").isNotNull())
    lines = ordered_index(
        asked.select("panel_id", F.col("ord").alias("_ord"), "region_id", "text", "vertical"), ["panel_id"], ["_ord", "region_id"], "ord")
    lines = lines.select(
        "panel_id", F.col("region_id").alias("line_id"), "ord", "text", F.when(F.col("vertical"), "vertical").otherwise("horizontal").alias("orientation"))
    answers = settle(translate(lines, model, language, style))
    by_region = answers.select("panel_id", F.col("line_id").cast(region).alias("region_id"), "translated")
    nothing = by_region.where("false").select("panel_id", F.lit(1).alias("ord"), "translated")
    merged = an.merge_translation(annotations, by_region, nothing)
    if "uncomputed" not in merged.columns:
        merged = merged.withColumn("uncomputed", F.lit(None).cast("boolean"))
    flagged = an.flag_missing(merged)
    spoken = F.length(F.btrim(F.coalesce(F.col("translated"), F.lit("")))) > 0
    counted = answers.groupBy("panel_id").agg(F.count(F.lit(1)).alias("asked"), F.count_if(spoken).alias("answered"))
    status = flagged.groupBy("panel_id").agg(F.count_if("translation_missing").alias("missing")).join(counted, "panel_id", "left")
    status = status.fillna(0, ["asked", "answered"]).withColumns({
        "success": (F.col("asked") == 0) | (F.col("answered") > 0), "engine_requested": F.lit(engine)})
    return flagged, status
