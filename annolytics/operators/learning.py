"""Learning progress and stage timing. The same functions serve batch and streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.plans.skew import ordered_index


def word_stats(answers: DataFrame, keys: Sequence[str] = ("word",)) -> DataFrame:
    """Answers seen and answered right, per word (and any further keys)."""
    return answers.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("seen"), F.count_if(F.col("knew")).alias("correct"))


def progress_summary(answers: DataFrame, mastery: int = 3) -> DataFrame:
    """Per learner, and over all learners (null): distinct words seen, words
    mastered (right at least ``mastery`` times) and panels completed.

    The global row counts a word once over all learners, so it is summed from
    its own word counts, made from the per-learner ones.
    """
    per = word_stats(answers, ["learner_id", "word"])
    total = per.groupBy("word").agg(F.sum("correct").alias("correct"))
    counted = [F.count(F.lit(1)).alias("words_seen"), F.count_if(F.col("correct") >= mastery).alias("mastered")]
    words = per.groupBy("learner_id").agg(*counted).unionByName(
        total.agg(*counted).withColumn("learner_id", F.lit(None).cast("bigint")))
    done = answers.where("panel_complete").select("learner_id", "panel_id").distinct()
    panels = done.groupBy("learner_id").agg(F.count(F.lit(1)).alias("panels_completed")).unionByName(
        done.select("panel_id").distinct().agg(F.count(F.lit(1)).alias("panels_completed"))
        .withColumn("learner_id", F.lit(None).cast("bigint")))
    joined = words.join(panels.withColumnRenamed("learner_id", "_l"), F.col("learner_id").eqNullSafe(F.col("_l")), "left")
    return joined.withColumn("panels_completed", F.coalesce("panels_completed", F.lit(0))).drop("_l")


def completed_panels(answers: DataFrame) -> DataFrame:
    """Each completed panel once per learner, in order of first completion."""
    first = answers.where("panel_complete").groupBy("learner_id", "panel_id").agg(
        F.min("ts").alias("completed_at"))
    return ordered_index(first, ["learner_id"], ["completed_at", "panel_id"], "place")


def stage_durations(trace: DataFrame, keys: Sequence = ("scan_id", "stage")) -> DataFrame:
    """Start, end, last status, longest elapsed time and error flag per stage."""
    return trace.groupBy(*keys).agg(
        F.min("ts").alias("started_at"), F.max("ts").alias("ended_at"),
        F.max_by("status", F.struct("ts", "event_id")).alias("status"),
        F.max("elapsed_ms").alias("elapsed_ms"), F.count(F.lit(1)).alias("events"),
        F.bool_or(F.col("status") == "error").alias("failed"))


def stage_matrix(trace: DataFrame, stages: Sequence[str]) -> DataFrame:
    """Longest elapsed time per scan, one column per stage (a fixed list, so the
    pivot needs no extra pass)."""
    return trace.groupBy("scan_id").pivot("stage", list(stages)).agg(F.max("elapsed_ms"))


# Methods that change something, and the path prefixes to log.
WRITE_METHODS = ("POST", "PUT", "PATCH", "DELETE")
QUIET_PREFIXES = ("/api/media/", "/api/thumb/", "/css/", "/js/", "/assets/")
LOGGED_PREFIXES = ("/api/scanner/", "/api/runtime/ocr-assets/")


def notable_requests(requests: DataFrame) -> DataFrame:
    """Failures, and successful writes under the logged prefixes."""
    def under(prefixes: Sequence[str]):
        found = F.lit(False)
        for prefix in prefixes:
            found = found | F.col("path").startswith(prefix)
        return found

    important = F.col("method").isin(*WRITE_METHODS) & ~under(QUIET_PREFIXES) & under(LOGGED_PREFIXES)
    return requests.where((F.col("status") >= 400) | important)
