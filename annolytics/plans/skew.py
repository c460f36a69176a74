"""Ordered and grouped work that stays distributed when one key is hot.

A plain window or a collected group puts every row of a key into one task.
That is the best plan for ordinary keys, and fatal for a key that holds a third
of all rows. Each helper here therefore counts rows per key first (a partial
aggregate over the key columns only) and treats keys above a limit separately:

* ordinary keys keep the plain window: one shuffle;
* heavy keys are range-partitioned on (key, order), so a key spreads over many
  tasks; each chunk is numbered, summed or looked back in alone, and a small
  table of chunk totals carries the state from chunk to chunk.

Both branches are exact and together hold every row.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.plans.storage import settle

# Rows of one key that a single task may sort in a window.
WINDOW_ROWS = 2_000_000
# Rows of one key that may be gathered into one array for an ordered fold.
FOLD_ROWS = 2_000
# Buckets that keys are counted in first where the limit is at least so many rows each.
BUCKETS, BUCKET_ROWS = 4_096, 100_000
# Rows and bytes (as JSON) of a checked table that may be broadcast.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 << 20

_CHUNK = "_chunk"


def by(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(item) if isinstance(item, str) else item for item in order]


def heavy_groups(df: DataFrame, keys: Sequence[str], limit: int) -> DataFrame | None:
    """Keys with more than ``limit`` rows, or None when there are none.

    A bucket holds all rows of its keys, so where no bucket is above a large limit no key is,
    and no key is moved; otherwise the keys of such buckets are counted.
    """
    if limit >= BUCKET_ROWS:
        bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
        sizes = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows"))
        crowded = [row["_bucket"] for row in sizes.where(F.col("_rows") > limit).collect()]
        if not crowded:
            return None
        df = df.where(bucket.isin(crowded))
    heavy = (
        df.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .where(F.col("_rows") > limit)
        .select(*keys)
    )
    if heavy.isEmpty():
        return None
    return settle(heavy)


def small_side(df: DataFrame) -> DataFrame:
    """Broadcast ``df`` only if its rows and bytes, summed per task, are few.

    Beyond the bounds the join is left to Spark, which shuffles both sides and
    splits skewed partitions at run time.
    """
    row = F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns]))
    rows, size = df.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(row)), F.lit(0))).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else df


def join_groups(df: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, of which null equals null, so that rows without a key are a group too."""
    other = table.select(*[F.col(c).alias(f"_key_{c}") if c in keys else F.col(c) for c in table.columns])
    same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys))
    return df.join(other, same, how).drop(*(f"_key_{k}" for k in keys))


def split_groups(df: DataFrame, keys: Sequence[str], limit: int | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of heavy keys or None).

    ``limit=None`` says that the caller has already split off the heavy keys.
    """
    heavy = None if limit is None else heavy_groups(df, keys, limit)
    if heavy is None:
        return df, None
    heavy = small_side(heavy)
    return join_groups(df, heavy, keys, "left_anti"), join_groups(df, heavy, keys, "left_semi")


def _chunked(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Rows tagged with the range partition they fall in, settled once so that
    every later read sees the same partition bounds."""
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], *order)
    return settle(ranged.withColumn(_CHUNK, F.spark_partition_id()))


def _chunk_window(keys: Sequence[str], order: Sequence[Column]):
    return Window.partitionBy(*keys, _CHUNK).orderBy(*order)


def _carry(totals: DataFrame, keys: Sequence[str], total: str, name: str) -> DataFrame:
    """Sum of the totals of all earlier chunks of the key."""
    before = (
        Window.partitionBy(*keys).orderBy(_CHUNK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return totals.select(*keys, _CHUNK, F.coalesce(F.sum(total).over(before), F.lit(0)).alias(name))


def ordered_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], name: str,
    limit: int | None = WINDOW_ROWS,
) -> DataFrame:
    """1-based position of each row in its key, by a total order."""
    order = by(order)
    ordinary, heavy = split_groups(df, keys, limit)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("bigint")
    result = ordinary.withColumn(name, number)
    if heavy is None:
        return result
    rows = _chunked(heavy, keys, order)
    totals = rows.groupBy(*keys, _CHUNK).agg(F.count(F.lit(1)).alias("_total"))
    carried = small_side(_carry(totals, keys, "_total", "_before"))
    local = F.row_number().over(_chunk_window(keys, order))
    spread = (
        join_groups(rows.withColumn("_local", local), carried, [*keys, _CHUNK])
        .withColumn(name, (F.col("_local") + F.col("_before")).cast("bigint"))
        .drop("_local", "_before", _CHUNK)
    )
    return result.unionByName(spread)


def running_total(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str,
    limit: int | None = WINDOW_ROWS,
) -> DataFrame:
    """Sum of ``value`` over the rows up to and including this one."""
    order = by(order)
    df = df.withColumn("_value", value.cast("bigint"))
    ordinary, heavy = split_groups(df, keys, limit)
    upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    result = ordinary.withColumn(name, F.sum("_value").over(upto)).drop("_value")
    if heavy is None:
        return result
    rows = _chunked(heavy, keys, order)
    totals = rows.groupBy(*keys, _CHUNK).agg(F.sum("_value").alias("_total"))
    carried = small_side(_carry(totals, keys, "_total", "_before"))
    local = F.sum("_value").over(_chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    spread = (
        join_groups(rows.withColumn("_local", local), carried, [*keys, _CHUNK])
        .withColumn(name, F.col("_local") + F.col("_before"))
        .drop("_local", "_before", "_value", _CHUNK)
    )
    return result.unionByName(spread)


def reach_before(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], value: Column, name: str,
    limit: int | None = WINDOW_ROWS,
) -> DataFrame:
    """Largest ``value`` of the rows before this one, null on a key's first row."""
    order = by(order)
    df = df.withColumn("_value", value)
    ordinary, heavy = split_groups(df, keys, limit)
    earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    result = ordinary.withColumn(name, F.max("_value").over(earlier)).drop("_value")
    if heavy is None:
        return result
    rows = _chunked(heavy, keys, order)
    totals = rows.groupBy(*keys, _CHUNK).agg(F.max("_value").alias("_total"))
    chunks = Window.partitionBy(*keys).orderBy(_CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carried = small_side(totals.select(*keys, _CHUNK, F.max("_total").over(chunks).alias("_before")))
    local = F.max("_value").over(_chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, -1))
    spread = (
        join_groups(rows.withColumn("_local", local), carried, [*keys, _CHUNK])
        .withColumn(name, F.greatest("_local", "_before")).drop("_local", "_before", "_value", _CHUNK)
    )
    return result.unionByName(spread)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], columns: Sequence[str],
    name: str, limit: int | None = WINDOW_ROWS,
) -> DataFrame:
    """Struct ``name`` of ``columns`` of the row before, null on a key's first row."""
    order = by(order)
    packed = F.struct(*columns)
    ordinary, heavy = split_groups(df, keys, limit)
    result = ordinary.withColumn(name, F.lag(packed).over(Window.partitionBy(*keys).orderBy(*order)))
    if heavy is None:
        return result
    rows = _chunked(heavy, keys, order)
    window = _chunk_window(keys, order)
    marked = rows.withColumn("_here", F.lag(packed).over(window))
    tails = (
        rows.withColumn("_left", F.lead(F.lit(1)).over(window))
        .where(F.col("_left").isNull())
        .select(*keys, _CHUNK, packed.alias("_tail"))
    )
    lifted = small_side(
        tails.select(
            *keys, _CHUNK,
            F.lag("_tail").over(Window.partitionBy(*keys).orderBy(_CHUNK)).alias("_earlier"),
        )
    )
    spread = (
        join_groups(marked, lifted, [*keys, _CHUNK])
        .withColumn(name, F.coalesce("_here", "_earlier"))
        .drop("_here", "_earlier", _CHUNK)
    )
    return result.unionByName(spread)


def top_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], n: int | None, name: str) -> DataFrame:
    """First ``n`` rows per key (all without ``n``), numbered. Spark limits each key to ``n`` rows
    per task before the shuffle (window group limit), so a hot key stays small."""
    window = Window.partitionBy(*keys).orderBy(*by(order))
    numbered = df.withColumn(name, F.row_number().over(window))
    return numbered if n is None else numbered.where(F.col(name) <= n)


def ordered_text(
    df: DataFrame, keys: Sequence[str], position: str, text: Column, separator: str,
    part_rows: int = 1_000,
) -> DataFrame:
    """Texts joined in order, in parts of at most ``part_rows`` rows.

    ``position`` is the 1-based place of the row in its key, so a key with few
    rows gives exactly one part, and a hot key many parts instead of one huge
    string in one task.
    """
    part = F.floor((F.col(position) - 1) / part_rows).cast("bigint")
    gathered = F.array_sort(F.collect_list(F.struct(F.col(position).alias("p"), text.alias("t"))))
    return df.groupBy(*keys, part.alias("part")).agg(
        F.array_join(F.transform(gathered, lambda e: e["t"]), separator).alias("text"),
        F.count(text).alias("pieces"),
    )
