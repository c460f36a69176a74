"""Where intermediate results live, and how lineage is cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and stream output.

    The cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own; elsewhere an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    fallback = spark.conf.get("annolytics.local.dir", None)
    if fallback:
        return fallback
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    fallback = tempfile.mkdtemp(prefix="annolytics-")
    spark.conf.set("annolytics.local.dir", fallback)
    return fallback


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared one."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint, so a lost executor replays files."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores.

    A small file is one split and would keep a CPU-bound pass on one core. An
    input with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def bound_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound what one Arrow batch of whole texts may hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
