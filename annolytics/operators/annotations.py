"""Annotations: column rules, flags, and id-keyed merges of stage results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.functions.hashing import bag_digest
from annolytics.plans.skew import ordered_text

KEYS = ["panel_id", "region_id"]

# The columns a recognised annotation may carry.
ANNOTATION_COLUMNS = (
    "id text confidence bbox char_count vertical ocr_variant region_id recognized_orientation "
    "orientation_source reading_order font_size angle lines ocr_debug box_signature computed "
    "uncomputed box_source ocr_status"
).split()

# Columns that hold a translation.
TRANSLATION_COLUMNS = (
    "translated translation_engine_requested translation_engine_used translation_model "
    "translation_target_lang translation_style translation_prompt_version "
    "translation_prompt_payload translation_error"
).split()

# Texts that count as no translation, and what is shown instead.
BLANK_TRANSLATIONS = ("", "—", "...")
MISSING_TRANSLATION = "No translation available"


def is_computed(default: bool = True) -> Column:
    return F.coalesce(F.col("computed"), F.lit(default))


def has_text(column: str = "text") -> Column:
    return F.length(F.coalesce(F.col(column), F.lit(""))) > 0


def sanitize_annotations(df: DataFrame, keep: Sequence[str] = ("panel_id",)) -> DataFrame:
    """Only the allowed columns (and table keys), with both flags filled in."""
    chosen = [c for c in df.columns if c in ANNOTATION_COLUMNS or c in keep]
    flags = {
        name: F.coalesce(F.col(name), F.lit(default)) if name in df.columns else F.lit(default)
        for name, default in (("computed", True), ("uncomputed", False))
    }
    return df.select(*chosen).withColumns(flags)


def strip_translation(df: DataFrame) -> DataFrame:
    return df.drop(*TRANSLATION_COLUMNS)


def flag_missing(df: DataFrame, engine_failed: bool = False) -> DataFrame:
    """Mark rows without a place on the page, and rows without a translation.

    Uncomputed rows pass unmarked. A row counts as translated unless its text
    is blank, a dash or an ellipsis; a placeholder shows unless the engine failed.
    """
    skipped = ~is_computed() | F.coalesce(F.col("uncomputed"), F.lit(False))
    unplaced = ~skipped & ~F.coalesce(F.col("has_bbox"), F.lit(False))
    blank = F.btrim(F.coalesce(F.col("translated"), F.lit(""))).isin(*BLANK_TRANSLATIONS)
    untranslated = ~skipped & ~unplaced & blank
    shown = F.lit("" if engine_failed else MISSING_TRANSLATION)
    return df.withColumns({
        "localization_missing": unplaced,
        "translation_missing": untranslated,
        "translated": F.when(untranslated, shown).otherwise(F.col("translated")),
        "computed": ~skipped,
        "uncomputed": skipped,
    })


def computed_text(df: DataFrame, default: bool = True) -> DataFrame:
    return df.where(is_computed(default) & has_text())


def last_per_key(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per key: of several the last one wins, by ``ord`` where there is
    one and by all columns after it, so that reruns agree."""
    packed = F.struct(*(["ord"] if "ord" in df.columns else []), *[c for c in df.columns if c != "ord"])
    kept = df.groupBy(*[F.col(k).alias(f"_k_{k}") for k in keys]).agg(F.max(packed).alias("_last"))
    return kept.select(*[F.col(f"_last.{c}").alias(c) for c in df.columns])


def merge_translation(annotations: DataFrame, by_region: DataFrame, by_position: DataFrame) -> DataFrame:
    """Attach translations by region id, else by position, else ''."""
    named = last_per_key(by_region.select(*KEYS, "translated"), KEYS).select(*KEYS, F.col("translated").alias("_named"), F.lit(True).alias("_hit"))
    placed = last_per_key(by_position.select("panel_id", "ord", "translated"), ["panel_id", "ord"]).select("panel_id", "ord", F.col("translated").alias("_placed"))
    return (
        annotations.drop("translated")
        .join(named, KEYS, "left").join(placed, ["panel_id", "ord"], "left")
        .withColumn("translated", F.when(F.col("_hit"), F.col("_named"))
                    .otherwise(F.coalesce(F.col("_placed"), F.lit(""))))
        .drop("_named", "_placed", "_hit")
    )


def merge_enrichment(annotations: DataFrame, stage: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Stage columns win where the stage has a value for the same region."""
    stage = last_per_key(stage.select(*KEYS, *[c for c in columns if c not in KEYS]), KEYS)
    news = stage.select(*KEYS, *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = annotations.join(news, KEYS, "left")
    merged = {
        c: F.coalesce(F.col(f"_new_{c}"), F.col(c)) if c in annotations.columns else F.col(f"_new_{c}")
        for c in columns
    }
    return joined.withColumns(merged).drop(*(f"_new_{c}" for c in columns))


def stage_status(base: DataFrame, stage: DataFrame, name: str = "enrichment") -> DataFrame:
    """One row per panel of ``base``: how its job ended once a later stage was merged in.

    ``base`` has panel_id, success and error of the reading itself, ``stage``
    panel_id, ord, success, source, lookup_hits, lookup_misses and error of its
    attempts, of which the last by ``ord`` counts. The job's ``success`` is the
    stage's: a failed or missing stage never reports the reading's, which stays
    as ``read_success``. A stage's error, unless empty, replaces the reading's.
    Null successes are failures, missing counts 0. Panels may repeat in ``base``
    (the last row counts); stages of other panels are left out.
    """
    read = last_per_key(base.select("panel_id", "success", "error"), ["panel_id"])
    last = last_per_key(stage.select("panel_id", "ord", "success", "source", "lookup_hits", "lookup_misses", "error"), ["panel_id"])
    own = F.struct("success", "source", "lookup_hits", "lookup_misses", F.nullif("error", F.lit("")).alias("error"))
    joined = read.join(last.select("panel_id", own.alias("_stage")), "panel_id", "left")
    done = F.coalesce(F.col("_stage.success"), F.lit(False))
    return joined.select(
        "panel_id", F.coalesce("success", F.lit(False)).alias("read_success"), done.alias(f"{name}_success"), done.alias("success"),
        F.col("_stage.source").alias(f"{name}_source"),
        F.coalesce(F.col("_stage.lookup_hits"), F.lit(0)).cast("bigint").alias("lookup_hits"),
        F.coalesce(F.col("_stage.lookup_misses"), F.lit(0)).cast("bigint").alias("lookup_misses"),
        F.col("_stage.error").alias(f"{name}_error"), F.coalesce(F.col("_stage.error"), F.col("error")).alias("error"))


def enrichment_job(
    annotations: DataFrame, base: DataFrame, stage: DataFrame, found: DataFrame, columns: Sequence[str],
) -> tuple[DataFrame, DataFrame]:
    """(annotations with the enrichment's ``columns``, status rows of their panels).

    ``found`` holds the enrichment by region. Of panels whose last attempt
    failed nothing is merged, so their annotations are those of the reading.
    """
    status = stage_status(base, stage)
    good = found.join(status.where("success").select("panel_id"), "panel_id", "left_semi")
    return merge_enrichment(annotations, good, columns), status


def preserve_payload(
    previous: DataFrame, current: DataFrame, signature: Sequence[str], payload: Sequence[str],
) -> DataFrame:
    """Current rows, keeping the previous payload where both are computed and
    text, place and orientation (the signature columns) are unchanged."""
    old = previous.select(
        *KEYS, F.struct(*signature).alias("_old_sig"), is_computed().alias("_old_done"),
        *(F.col(c).alias(f"_old_{c}") for c in payload),
    )
    joined = current.join(old, KEYS, "left")
    same = (
        is_computed() & F.coalesce(F.col("_old_done"), F.lit(False))
        & F.struct(*signature).eqNullSafe(F.col("_old_sig"))
    )
    kept = {
        c: (F.when(same, F.coalesce(F.col(c), F.col(f"_old_{c}"))).otherwise(F.col(c))
            if c in current.columns else F.when(same, F.col(f"_old_{c}")))
        for c in payload
    }
    return (
        joined.withColumns({**kept, "payload_kept": same})
        .drop("_old_sig", "_old_done", *(f"_old_{c}" for c in payload))
    )


def vocabulary(annotations: DataFrame, enrichment: DataFrame, translations: DataFrame) -> DataFrame:
    """Study rows: text, reading, tokens and meaning (translation, else gloss)."""
    shown = annotations.where(F.length(F.btrim(F.coalesce(F.col("text"), F.lit("")))) > 0)
    return (
        shown.select(*KEYS, "ord", F.btrim("text").alias("text"))
        .join(enrichment.select(*KEYS, "reading", "token_count", "glossary"), KEYS, "left")
        .join(last_per_key(translations.select(*KEYS, "translated"), KEYS).withColumnRenamed("translated", "_meaning"), KEYS, "left")
        .withColumn("meaning", F.coalesce(
            F.nullif(F.col("_meaning"), F.lit("")), F.col("glossary"), F.lit("")))
        .withColumn("reading", F.coalesce(F.col("reading"), F.lit("")))
        .drop("_meaning", "glossary")
    )


def panel_text(df: DataFrame) -> DataFrame:
    """Computed texts of each panel, one per line, in reading order (``ord``)."""
    return ordered_text(computed_text(df, default=False), ["panel_id"], "ord", F.col("text"), "\n")


def text_fingerprint(df: DataFrame, keys: Sequence[str] = ("panel_id",), with_ids: bool = False) -> DataFrame:
    """Digest of each panel's computed texts in order, optionally with their ids."""
    parts = [F.col("ord").cast("string"), *([F.col("region_id").cast("string")] if with_ids else []), F.col("text")]
    return computed_text(df).groupBy(*keys).agg(
        bag_digest(F.concat_ws("\u001f", *parts)).alias("text_hash"), F.count(F.lit(1)).alias("texts"))


def missing_ids(requested: DataFrame, returned: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Requested keys that did not come back."""
    return requested.select(*keys).distinct().join(returned.select(*keys), list(keys), "left_anti")
