"""What the operators share: settled tables, bounded membership filters, components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from annolytics.plans.storage import fresh_dir

# White space of the contracts, as a Java character class.
SPACES = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: lineage ends
    there, and a lost executor costs only its running tasks."""
    folder = fresh_dir(df.sparkSession, label)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Bound what one Arrow batch of whole texts may hold in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def own_rows(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns. Other columns of the input, whatever they are
    called, never meet the working columns of an operator."""
    return df.select(*[F.col(f"`{name}`").alias(name) for name in names])


def spare_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, lengthened until ``df`` has no such column."""
    taken, found = {name.lower() for name in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


class Bitmap:
    """Fixed-size membership filter over 64-bit keys. It may say yes wrongly,
    never no; with more keys than bits it lets everything pass. Its size does
    not depend on the data (8 MB), so it may be sent to every worker."""

    BITS = 1 << 26

    def __init__(self, words: np.ndarray):
        self.words = words

    @classmethod
    def of(cls, keys: DataFrame, key: str, hashed: bool = False) -> Bitmap:
        """``hashed`` says that the keys are hashes whose low bits will do."""
        bit = (F.col(key).bitwiseAND(F.lit(cls.BITS - 1)) if hashed else cls.place(key)).alias("bit")
        parts = (
            keys.select(bit)
            .groupBy(F.shiftright("bit", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int))) as bits"))
            .toArrow()
        )
        words = np.zeros(cls.BITS // 64, np.int64)
        if parts.num_rows:
            words[parts["word"].to_numpy()] = parts["bits"].to_numpy()
        return cls(words)

    @staticmethod
    def place(key: str) -> Column:
        """The column to hand to :meth:`has` along with the rows."""
        return F.pmod(F.xxhash64(F.col(key)), F.lit(Bitmap.BITS))

    def has_hashes(self, hashes: np.ndarray) -> np.ndarray:
        return self.has(hashes.view(np.int64) & (self.BITS - 1))

    def has(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63)) & 1 == 1


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """(node, component) of an undirected graph given as (a, b) rows; the
    component is the smallest node that links reach. Nodes without a row in
    ``edges`` are absent.

    Alternates the large-star and small-star steps: each turns every
    neighbourhood to its smallest member, so the depth falls geometrically, and
    a step is one shuffle over at most twice the edges. A node with very many
    neighbours is only ever aggregated by ``min`` (combined before the
    shuffle) and joined, never gathered. The loop ends when a round changes
    nothing and raises if it does not.
    """
    now = keep(
        edges.where("a <> b")
        .select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct(), "edges")
    state = _state(now)
    for _ in range(rounds):
        # Large star: every neighbour above v goes to the least of v's closed neighbourhood.
        both = now.select("v", "u").unionByName(now.select(F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy("v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        large = both.join(least, "v").where("u > v").select(F.col("u").alias("v"), F.col("m").alias("u"))
        # A v that is its own least keeps its neighbours; the others' lower edges become v -> m.
        large = large.where("v <> u").distinct()
        # Small star: every neighbour at or below v, and v itself, go to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        joined = large.join(least, "v")
        small = joined.where("u <> m").select(F.col("u").alias("v"), F.col("m").alias("u"))
        small = small.unionByName(least.select("v", F.col("m").alias("u"))).where("v <> u").distinct()
        now = keep(small, "edges")
        after = _state(now)
        if after == state:
            return (
                now.select(F.col("v").alias("node"), F.col("u").alias("component"))
                .unionByName(now.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
            )
        state = after
    raise RuntimeError("components did not settle")


def _state(edges: DataFrame) -> tuple:
    """Fingerprint of an edge table: equal tables give equal values."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")),
        F.sum(F.xxhash64("u", "v", F.lit(7)).cast("decimal(20,0)")),
    ).first()
    return tuple(row)
