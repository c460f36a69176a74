"""Connected components of a graph given as edge rows, in rounds of joins.

Two steps alternate. In the first every node ties its larger neighbours to the
least node around it; in the second it ties its smaller neighbours, and itself,
to the least of them. Distances shrink geometrically, so a path of n nodes needs
about log n rounds, and edges never grow in number. A node with very many
neighbours is only reduced by ``min`` and joined, never gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.plans.storage import settle

# Rounds after which something is wrong: log2 of any row count is far below.
ROUNDS = 100


def components(edges: DataFrame, keys: Sequence[str], a: str = "src", b: str = "dst") -> DataFrame:
    """(keys, node, component) of every node that has an edge; the component is its least node.

    Edges never join different ``keys``. Nodes without an edge are absent.
    """
    keys = list(keys)
    now = settle(edges.where(F.col(a) != F.col(b)).select(
        *keys, F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).distinct())
    before = None
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(*keys, F.col("u").alias("v"), F.col("v").alias("u")))
        least = both.groupBy(*keys, "v").agg(F.least(F.min("u"), F.col("v")).alias("m"))
        larger = both.where("u > v").join(least, [*keys, "v"]).select(*keys, F.col("u").alias("v"), F.col("m").alias("u")).distinct()
        least = larger.groupBy(*keys, "v").agg(F.min("u").alias("m"))
        smaller = larger.join(least, [*keys, "v"]).where("u <> m").select(*keys, F.col("u").alias("v"), F.col("m").alias("u"))
        now = settle(smaller.unionByName(least.select(*keys, "v", F.col("m").alias("u"))).distinct())
        after = tuple(now.agg(
            F.count(F.lit(1)), F.sum(F.xxhash64(*keys, "v", "u").cast("decimal(20,0)")),
            F.bit_xor(F.xxhash64("u", "v", *keys))).first())
        if after == before:
            roots = now.select(*keys, F.col("u").alias("node"), F.col("u").alias("component")).distinct()
            return now.select(*keys, F.col("v").alias("node"), F.col("u").alias("component")).unionByName(roots)
        before = after
    raise RuntimeError(f"components did not settle in {ROUNDS} rounds")
