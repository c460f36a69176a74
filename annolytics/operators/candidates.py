"""Choice among the recognition candidates of a region.

A candidate row is region_id, ord, variant, text, error, expected (the
orientation the detector expects: vertical or horizontal).
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from annolytics.functions import measures as ms
from annolytics.functions import text as tx
from annolytics.functions.hashing import md5_text
from annolytics.plans.skew import top_rows
from annolytics.plans.storage import bound_batches, settle

ROTATED = "_rot90_"


def is_rotated(variant: Column) -> Column:
    return F.contains(variant, F.lit(ROTATED))


def variant_orientation(variant: Column) -> Column:
    return F.when(is_rotated(variant), "horizontal").otherwise("vertical")


def _digest() -> Column:
    return md5_text(F.coalesce(F.col("text"), F.lit("")))


def with_consensus(candidates: DataFrame) -> DataFrame:
    """``same_text``: unrotated candidates of the region with the same text, and
    the bonus: 8 each for an unrotated one (three at most), -8 for a rotated
    one that agrees with any.

    Texts are compared through ``digest`` (made here unless present) and left
    behind: only digests are shuffled, and the counts combine before the shuffle.
    """
    keyed = candidates if "digest" in candidates.columns else candidates.withColumn("digest", _digest())
    keyed = keyed.drop("text")
    counts = (
        keyed.where(~is_rotated(F.col("variant")))
        .groupBy("region_id", "digest").agg(F.count(F.lit(1)).alias("same_text"))
    )
    joined = keyed.join(counts, ["region_id", "digest"], "left").withColumn(
        "same_text", F.coalesce(F.col("same_text"), F.lit(0)))
    bonus = (
        F.when(~is_rotated(F.col("variant")), F.least(F.col("same_text"), F.lit(3)) * 8)
        .when(F.col("same_text") > 0, -8).otherwise(0)
    )
    return joined.withColumn("variant_consensus", bonus.cast("int"))


def with_plausibility(df: DataFrame, script: str = tx.SCRIPT, hints: Sequence[str] = ()) -> DataFrame:
    """Adds the plausibility measures of ``text`` (columns p_*), inside the row:
    no shuffle, whole texts. Each stage is a column of its own, so that a count
    is made once however many measures use it."""
    lined = df.withColumn("_lines", tx.run_lines(F.col("text")))
    counts = {**tx.run_counts(F.col("_lines"), script, hints), **tx.char_counts(F.col("text"), script)}
    counted = lined.withColumns({f"_c_{k}": v for k, v in counts.items()})
    measures = tx.plausibility({k: F.col(f"_c_{k}") for k in counts})
    return counted.withColumns({f"p_{k}": v for k, v in measures.items()}).drop(
        "_lines", *(f"_c_{k}" for k in counts))


def analysed_plausibility(
    df: DataFrame, tokens: str = "tokens", script: str = tx.SCRIPT, hints: Sequence[str] = (),
) -> DataFrame:
    """The same measures from an analyser's tokens, an array of (surface, lemma,
    reading, pos) held in the row."""
    classed = df.withColumn("_classes", tx.token_classes(F.col(tokens), script, hints))
    counts = {**tx.class_counts(F.col("_classes")), **tx.char_counts(F.col("text"), script)}
    counted = classed.withColumns({f"_c_{k}": v for k, v in counts.items()})
    measures = tx.plausibility({k: F.col(f"_c_{k}") for k in counts})
    return counted.withColumns({f"p_{k}": v for k, v in measures.items()}).drop(
        "_classes", *(f"_c_{k}" for k in counts))


# Bonus for the expected orientation by preference.
VERTICAL_BONUS = {"off": 0, "normal": 8, "strong": 14}


def measure_candidates(
    candidates: DataFrame, script: str = tx.SCRIPT, hints: Sequence[str] = (), plausibility: bool = True,
) -> DataFrame:
    """Everything the score needs from a candidate's text, without the text: a
    batch-by-batch pass where the data lies, before any shuffle."""
    kept = ["region_id", "ord", "variant", "error", "expected"]
    rows = candidates.select(*kept, F.coalesce(F.col("text"), F.lit("")).alias("_text"))
    usable = tx.usable_hints(hints, script)
    bound_batches(candidates.sparkSession)

    def measure(batches):
        for batch in batches:
            yield pa.record_batch([*batch.columns[:len(kept)], *ms.measured(batch.column(len(kept)), script, usable)], names)

    shape = T.StructType([*rows.schema.fields[:len(kept)], *T._parse_datatype_string(ms.MEASURES).fields])
    names = shape.names
    measured = rows.mapInArrow(measure, shape)
    score = tx.plausibility({k: F.col(k) for k in ("script_chars", "shown_chars", "scored", "native", "known", "latin", "tokens")})["score"]
    return measured.withColumn("plausible", score if plausibility else F.lit(0.0)).select(
        *kept, "digest", "plausible", "chars", "script_chars", "bad_chars", "odd_chars", "marked", "run")


def score_candidates(
    candidates: DataFrame, script: str = tx.SCRIPT, hints: Sequence[str] = (),
    vertical_preference: str = "normal", plausibility: bool = True,
) -> DataFrame:
    """One slim row per candidate (region_id, ord) with ``score``, its parts and
    its text measures; an empty text scores -100.

    Parts: script quality, layout fit, orientation bias, consensus,
    plausibility, and penalties for a low script share, runs and length.
    """
    # Settled, because the choice reads these slim rows several times and the
    # texts behind them should be read once.
    measured = with_consensus(settle(measure_candidates(candidates, script, hints, plausibility)))
    facing = variant_orientation(F.col("variant"))
    bonus = VERTICAL_BONUS.get(vertical_preference, 8)
    parts = {
        "script_quality": F.col("script_chars") * F.lit(2.4) + F.least(F.col("chars"), F.lit(32)) * F.lit(0.8)
        - F.col("bad_chars") * 14 - F.col("odd_chars") * 4,
        "layout_fit": F.when(facing == F.col("expected"), 10).otherwise(-12),
        "orientation_bias": F.when(
            F.col("expected") == "vertical", F.when(facing == "vertical", bonus).otherwise(-bonus)).otherwise(0),
        "penalty_low_script": F.when(
            F.col("script_chars") / F.greatest(F.lit(1), F.col("chars")) < 0.55, -12).otherwise(0),
        "penalty_run": F.when(F.col("run"), -10).otherwise(0),
        "penalty_overlong": F.when(
            F.col("chars") > 48, -F.least(F.lit(16.0), (F.col("chars") - 48) * F.lit(0.5))).otherwise(F.lit(0.0)),
    }
    added = (*parts, "variant_consensus", "plausible")
    total = sum((F.col(name) for name in added), F.lit(0.0))
    empty = F.col("chars") == 0
    zeroed = {name: F.when(empty, F.lit(0)).otherwise(F.col(name)) for name in added if name != "script_quality"}
    return (
        measured.withColumns(parts)
        .withColumn("score", F.when(empty | F.col("error").isNotNull(), -100).otherwise(F.bround(total, 0)).cast("int"))
        .withColumns({**zeroed, "script_quality": F.when(empty, F.lit(-100.0)).otherwise(F.round("script_quality", 2))})
    )


_MEASURES = ("ord", "variant", "score", "chars", "script_chars", "marked", "run")


def choose_candidate(scored: DataFrame, margin: int = 15) -> DataFrame:
    """Best candidate per region, first on ties. A rotated winner gives way to
    the best unrotated one that is at most ``margin`` behind. Two partial
    aggregates over slim rows: no window, no gathered lists, no texts."""
    usable = F.col("error").isNull()
    first = F.struct(F.col("score"), -F.col("ord"))
    value = F.struct(*_MEASURES)
    upright = usable & ~is_rotated(F.col("variant")) & (F.col("chars") > 0)
    picked = scored.groupBy("region_id").agg(
        F.max_by(F.when(usable, value), F.when(usable, first)).alias("_best"),
        F.max_by(F.when(upright, value), F.when(upright, first)).alias("_plain"),
        F.count(F.lit(1)).alias("candidates"),
    )
    guarded = (
        is_rotated(F.col("_best.variant")) & F.col("_plain").isNotNull()
        & (F.col("_plain.score") >= F.col("_best.score") - margin)
    )
    won = F.when(guarded, F.col("_plain")).otherwise(F.col("_best"))
    return picked.select(
        "region_id", "candidates", F.coalesce(guarded, F.lit(False)).alias("rotation_guarded"), won.alias("_w"),
    ).select("region_id", "candidates", "rotation_guarded", "_w.*")


def close_scores(scored: DataFrame, within: int = 3) -> DataFrame:
    """Per region: are the two best scores within ``within`` of each other?"""
    best = top_rows(scored.select("region_id", "score", "ord"), ["region_id"], [F.col("score").desc(), "ord"], 2, "place")
    return best.groupBy("region_id").agg(
        F.coalesce((F.count(F.lit(1)) > 1) & (F.max("score") - F.min("score") <= within), F.lit(False)).alias("close"))


def recognise(
    candidates: DataFrame, script: str = tx.SCRIPT, hints: Sequence[str] = (), margin: int = 15,
    vertical_preference: str = "normal",
) -> DataFrame:
    """The whole choice: score, pick, warn and rate each region, and fetch the
    chosen text. Texts move once, in the last join."""
    scored = score_candidates(candidates, script, hints, vertical_preference)
    chosen = choose_candidate(scored, margin).join(close_scores(scored), "region_id")
    rated = rate_choice(chosen)
    texts = candidates.select("region_id", "ord", "text")
    return rated.join(texts, ["region_id", "ord"])


def rate_choice(chosen: DataFrame) -> DataFrame:
    """Warnings, confidence and quality of chosen candidates from their measures."""
    warned = chosen.withColumn("warnings", tx.warnings_from(
        F.col("script_chars"), F.col("chars"), F.col("marked"), F.col("run"), F.col("score"), F.col("close")))
    rated = warned.withColumn("confidence", tx.confidence(F.col("chars"), F.col("score"), F.col("warnings")))
    return rated.withColumn("quality", F.when(F.col("chars") == 0, "bad").otherwise(
        tx.quality(F.col("confidence"), F.col("warnings"))))


def raw_fallback(chosen: DataFrame, fallback: DataFrame, script: str = tx.SCRIPT) -> DataFrame:
    """Regions left without text take the cleaned text of the plain crop, if any.
    Cleaning and scoring happen before the join, once per fallback row."""
    cleaned = fallback.select("region_id", tx.clean_text(F.col("text")).alias("_plain"))
    plain = cleaned.withColumn("_base", tx.baseline_score(F.col("_plain"), script))
    empty = F.length(F.coalesce(F.col("text"), F.lit(""))) == 0
    used = empty & (F.length(F.coalesce(F.col("_plain"), F.lit(""))) > 0)
    return (
        chosen.join(plain, "region_id", "left")
        .withColumns({
            "score": F.when(used, F.col("_base")).otherwise(F.col("score")),
            "variant": F.when(used, "raw_fallback").otherwise(F.col("variant")),
            "text": F.when(used, F.col("_plain")).otherwise(F.col("text")),
        }).drop("_plain", "_base")
    )
