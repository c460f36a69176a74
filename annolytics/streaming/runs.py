"""File streams in, results out, through shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.plans.storage import fresh_dir


def file_stream(spark: SparkSession, folder: str, glob: str, schema) -> DataFrame:
    """Stream over the parquet files of a folder that match ``glob``."""
    return spark.readStream.schema(schema).option("pathGlobFilter", glob).parquet(folder)


def run_appending(stream: DataFrame, timeout: int = 600) -> DataFrame:
    """Drain a stream into parquet files and return them as a table."""
    spark = stream.sparkSession
    target = fresh_dir(spark, "stream")
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", f"{target}/data").option("checkpointLocation", f"{target}/state")
        .trigger(availableNow=True).start()
    )
    finish(query, timeout)
    return spark.read.schema(stream.schema).parquet(f"{target}/data")


def run_updating(stream: DataFrame, keys: list[str], timeout: int = 600) -> DataFrame:
    """Drain an updating aggregate; the last update of each key is its result.

    Each batch overwrites its own folder, so a repeated batch cannot count twice.
    """
    spark = stream.sparkSession
    target = fresh_dir(spark, "stream")

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/data/batch={number}")

    query = (
        stream.writeStream.outputMode("update").foreachBatch(store)
        .option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    )
    finish(query, timeout)
    updates = spark.read.option("basePath", f"{target}/data").parquet(f"{target}/data")
    latest = F.max_by(F.struct(*stream.columns), F.col("batch")).alias("_row")
    return updates.groupBy(*keys).agg(latest).select("_row.*")


def run_complete(stream: DataFrame, timeout: int = 600) -> DataFrame:
    """Drain an aggregate whose every batch gives the whole result; the last one counts.

    For results that are still open when the stream ends, where update mode does
    not serve (session windows). The state keeps every key.
    """
    spark = stream.sparkSession
    target = fresh_dir(spark, "stream")
    last = []

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/data/batch={number}")
        last[:] = [number]

    query = (
        stream.writeStream.outputMode("complete").foreachBatch(store)
        .option("checkpointLocation", f"{target}/state").trigger(availableNow=True).start()
    )
    finish(query, timeout)
    if not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{target}/data/batch={last[0]}")


def finish(query, timeout: int) -> None:
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout} s")
    if query.exception() is not None:
        raise query.exception()
