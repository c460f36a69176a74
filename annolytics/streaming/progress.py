"""Learning progress and stage timing on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.operators.learning import stage_durations, word_stats


def running_word_stats(answers: DataFrame) -> DataFrame:
    """Seen and correct per word so far; run in update mode."""
    return word_stats(answers)


def panels_completed_once(answers: DataFrame) -> DataFrame:
    """Each completed panel once, over any span of time. The state is one row per panel."""
    done = answers.where("panel_complete").select("panel_id", F.col("ts").cast("timestamp").alias("ts"))
    return done.dropDuplicates(["panel_id"])


def daily_stage_durations(trace: DataFrame, delay: str | None = "1 hour") -> DataFrame:
    """Stage timing per scan, stage and day; a day is final once the watermark passes it,
    or never without ``delay`` (run in update mode)."""
    timed = trace.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay is not None:
        timed = timed.withWatermark("ts", delay)
    summed = stage_durations(timed, [F.window("ts", "1 day").alias("day"), "scan_id", "stage"])
    return summed.withColumn("day", F.col("day.start"))


def answer_sessions(answers: DataFrame, gap: str = "30 minutes", delay: str | None = None) -> DataFrame:
    """Study sessions per learner: answers no further apart than ``gap``. Batch,
    or streaming when ``delay`` is given."""
    timed = answers.withColumn("ts", F.col("ts").cast("timestamp"))
    if delay is not None:
        timed = timed.withWatermark("ts", delay)
    sessions = timed.groupBy("learner_id", F.session_window("ts", gap).alias("s")).agg(
        F.count(F.lit(1)).alias("answers"), F.count_if(F.col("knew")).alias("known"))
    return sessions.select(
        "learner_id", F.col("s.start").alias("started_at"), F.col("s.end").alias("ended_at"), "answers", "known")
