"""Value statistics per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fill_statistics(values: DataFrame, keys: Sequence[str], value: str, dark_below: float = 190.0) -> DataFrame:
    """Median, deviation, dark share and count of byte-valued samples per group.

    Fixed values for a flat group: at least 40 samples, median at least 205,
    deviation at most 18, dark share at most 0.035. The exact median counts
    distinct values, of which a byte has 256.
    """
    stats = values.groupBy(*keys).agg(
        F.median(value).cast("int").alias("median_value"),
        F.round(F.stddev_pop(value), 3).alias("std"),
        F.round(F.avg((F.col(value) < dark_below).cast("int")), 3).alias("dark_ratio"),
        F.count(value).alias("sample_count"),
    )
    flat = (
        (F.col("sample_count") >= 40) & (F.col("median_value") >= 205)
        & (F.col("std") <= 18.0) & (F.col("dark_ratio") <= 0.035)
    )
    return stats.withColumn("flat", flat)


def diverse_top_bins(
    values: DataFrame, keys: Sequence[str], value: str, bins: int = 255, k: int = 3,
    apart: float = 10.0, tolerance: float = 0.001,
) -> DataFrame:
    """Up to ``k`` of the fullest histogram bins whose left edges lie more than
    ``apart`` from each other; the walk ends at ``k`` bins or just after the
    first bin below ``tolerance`` of all values.

    Only the at most ``bins`` counters of a group come together, never its values.
    """
    keys = list(keys)
    extent = values.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    flat = F.col("_lo") == F.col("_hi")
    extent = extent.withColumns({
        "_lo": F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo").cast("double")),
        "_hi": F.when(flat, F.col("_hi") + 0.5).otherwise(F.col("_hi").cast("double")),
    })
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins))
    counts = (
        values.join(extent, keys).withColumn("_bin", place.cast("int"))
        .groupBy(*keys, "_bin", "_lo", "_hi").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_edge", F.col("_lo") + F.col("_bin") * width)
    )
    node = F.struct((-F.col("_n")).alias("rank"), F.col("_edge").alias("edge"))
    walk = counts.groupBy(*keys).agg(
        F.array_sort(F.collect_list(node)).alias("_bins"), F.sum("_n").alias("_all"))

    start = F.struct(F.array().cast("array<double>").alias("picked"), F.lit(False).alias("done"))

    def step(state, b):
        clear = F.forall(state["picked"], lambda e: F.abs(e - b["edge"]) > apart)
        first = F.size(state["picked"]) == 0
        picked = F.when(clear, F.array_append(state["picked"], b["edge"])).otherwise(state["picked"])
        below = ~first & (-b["rank"] < F.col("_all") * tolerance)
        moved = F.struct(picked.alias("picked"), ((F.size(picked) >= k) | below).alias("done"))
        return F.when(state["done"], state).otherwise(moved)

    top = F.aggregate("_bins", start, step, lambda s: s["picked"])
    return walk.select(*keys, F.posexplode(top).alias("place", "edge"))
