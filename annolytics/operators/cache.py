"""Cache status, freshness and skipping of finished work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_status(entries: DataFrame) -> DataFrame:
    """Entries per panel and bucket, per panel, and over all, in one pass over
    grouping sets. A null panel or bucket stands for all of them."""
    return (
        entries.groupingSets([["panel_id", "bucket"], ["panel_id"], []], "panel_id", "bucket")
        .agg(F.count(F.lit(1)).alias("entries"), F.coalesce(F.bool_or("has_entries"), F.lit(False)).alias("has_cache"))
    )


def box_status(active: DataFrame) -> DataFrame:
    """Boxes, uncomputed boxes and overrides per panel."""
    return active.groupBy("panel_id").agg(
        F.count(F.lit(1)).alias("box_count"),
        F.count_if(~F.coalesce(F.col("computed"), F.lit(False))).alias("uncomputed_box_count"),
        F.bool_or(F.col("source") == "manual").alias("has_overrides"))


def with_freshness(entries: DataFrame, now: Column, ttl_seconds: int, schema_version: int) -> DataFrame:
    """``fresh``: younger than the lifetime; ``valid``: current schema and content.
    ``now`` is given, so a result can be repeated."""
    age = F.unix_micros(now) - F.unix_micros(F.col("retrieved_at").cast("timestamp"))
    return entries.withColumns({
        "fresh": F.coalesce(age < ttl_seconds * 1_000_000, F.lit(False)),
        "valid": (F.col("schema_version") == schema_version) & F.coalesce(F.col("has_entries"), F.lit(False)),
    })


def refreshed(cached: DataFrame, fetched: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Cached entries after a fetch: fresh ones stay, stale ones take the fetched
    payload, and a stale one the fetch missed stays, marked ``stale``."""
    news = fetched.select(*keys, F.lit(True).alias("_got"), *(F.col(c).alias(f"_new_{c}") for c in payload))
    joined = cached.join(news, keys, "left")
    take = ~F.col("fresh") & F.coalesce(F.col("_got"), F.lit(False))
    values = {c: F.when(take, F.col(f"_new_{c}")).otherwise(F.col(c)) for c in payload}
    return joined.withColumns({
        **values, "stale": ~F.col("fresh") & F.col("_got").isNull(),
    }).drop("_got", *(f"_new_{c}" for c in payload))


def unfinished(work: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Work whose fingerprint has no stored result yet."""
    return work.join(done.select(key).distinct(), key, "left_anti")


def cleared(
    requests: DataFrame, entries: DataFrame, annotations: DataFrame, boxes: DataFrame, reading: str = "ocr",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(entries, annotations, boxes) after the buckets that ``requests`` names were cleared.

    A request is a panel_id and a bucket, null for all of the panel. Clearing the
    bucket of the ``reading`` takes the panel's annotations and leaves its boxes
    uncomputed, clearing all takes the boxes too; later stages lose their entries
    only. Rows of other panels, or without one, stay as they are; repeated
    requests count once.
    """
    wanted = requests.groupBy(F.col("panel_id").alias("_panel")).agg(
        F.collect_set("bucket").alias("_buckets"), F.bool_or(F.col("bucket").isNull()).alias("_all"))
    wanted = wanted.withColumn("_reading", F.col("_all") | F.array_contains("_buckets", reading))
    of_panel = F.col("panel_id") == F.col("_panel")
    kept = entries.join(wanted, of_panel & (F.col("_all") | F.array_contains("_buckets", F.col("bucket"))), "left_anti")
    read = annotations.join(wanted.where("_reading"), of_panel, "left_anti")
    placed = boxes.join(wanted, of_panel, "left").where(~F.coalesce(F.col("_all"), F.lit(False)))
    stale = F.coalesce(F.col("_reading"), F.lit(False))
    placed = placed.withColumn("computed", F.when(stale, F.lit(False)).otherwise(F.col("computed")))
    return kept, read, placed.select(*boxes.columns)
