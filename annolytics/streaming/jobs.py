"""Background jobs: one active job per request, latest status, expiry.

A job event is job_id, request_key, status (queued, running, done, error) and
updated_at, in order of (updated_at, job_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.plans.skew import running_total
from annolytics.plans.storage import fresh_dir
from annolytics.streaming.runs import finish

ACTIVE, FINISHED = ("queued", "running"), ("done", "error")

# Fixed value: seconds a finished job is kept.
JOB_TTL_SECONDS = 900


def _with_owner(events: DataFrame) -> DataFrame:
    """Events with ``cut`` (finished events of the request so far) and the first
    active job of that cut."""
    order = ["updated_at", "job_id"]
    cut = running_total(events, ["request_key"], order, F.col("status").isin(*FINISHED).cast("int"), "cut")
    owner = cut.where(F.col("status").isin(*ACTIVE)).groupBy("request_key", "cut").agg(
        F.min_by("job_id", F.struct(*order)).alias("owner_id"))
    return cut.join(owner, ["request_key", "cut"], "left")


def _served(owned: DataFrame) -> DataFrame:
    return owned.where(F.col("status").isin(*ACTIVE)).select(
        "request_key", "job_id", "owner_id", (F.col("job_id") != F.col("owner_id")).alias("reused"))


def dedupe_jobs(events: DataFrame) -> DataFrame:
    """Active events with the job that serves them: the first active one of
    their request since its last finished event; later ones reuse it.

    A running count of finished events cuts each request's history, and the
    first active event of a cut is a plain minimum.
    """
    return _served(_with_owner(events))


def first_active(events: DataFrame) -> DataFrame:
    """Oldest active job per request, over the whole table."""
    return events.where(F.col("status").isin(*ACTIVE)).groupBy("request_key").agg(
        F.min_by("job_id", F.struct("updated_at", "job_id")).alias("owner_id"),
        F.count(F.lit(1)).alias("requests"))


def dedupe_job_stream(events: DataFrame, timeout: int = 600) -> DataFrame:
    """The streaming form of :func:`dedupe_jobs`, drained into a table.

    Each micro-batch is deduplicated together with the open job of each request
    left by the batch before, which enters as the oldest event. State is a
    table with one row per request with an open job, one version per batch, so
    a repeated batch starts from the same state. Batches must come in time order.
    """
    spark = events.sparkSession
    target = fresh_dir(spark, "jobs")
    columns = ["request_key", "job_id", "status", "updated_at"]

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.select(*columns, F.lit(False).alias("carried"))
        if number > 0:
            opened = spark.read.parquet(f"{target}/open/{number - 1}").select(
                "request_key", F.col("owner_id").alias("job_id"), F.lit("running").alias("status"),
                "updated_at", F.lit(True).alias("carried"))
            rows = rows.unionByName(opened)
        owned = _with_owner(rows)
        owned.write.mode("overwrite").parquet(f"{target}/owned/{number}")
        owned = spark.read.parquet(f"{target}/owned/{number}")
        _served(owned.where(~F.col("carried"))).write.mode("overwrite").parquet(f"{target}/served/batch={number}")
        last = owned.groupBy("request_key").agg(
            F.max_by("owner_id", "cut").alias("owner_id"), F.min("updated_at").alias("updated_at"))
        last.where(F.col("owner_id").isNotNull()).write.mode("overwrite").parquet(f"{target}/open/{number}")

    query = (
        events.writeStream.foreachBatch(store).option("checkpointLocation", f"{target}/state")
        .trigger(availableNow=True).start()
    )
    finish(query, timeout)
    return spark.read.parquet(f"{target}/served").drop("batch")


def latest_status(events: DataFrame, keys: tuple[str, ...] = ("request_key",)) -> DataFrame:
    """Last status per key; batch, or streaming in update mode."""
    return events.groupBy(*keys).agg(
        F.max_by("status", F.struct("updated_at", "job_id")).alias("status"),
        F.max("updated_at").alias("updated_at"), F.count(F.lit(1)).alias("updates"))


def prune_finished(jobs: DataFrame, now: Column, ttl_seconds: int = JOB_TTL_SECONDS) -> DataFrame:
    """Jobs without those finished more than the lifetime ago."""
    age = F.unix_micros(now) - F.unix_micros(F.col("updated_at").cast("timestamp"))
    return jobs.where(~(F.col("status").isin(*FINISHED) & (age > ttl_seconds * 1_000_000)))
