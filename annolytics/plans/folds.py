"""First-fit grouping of ordered rows.

Rows are taken in order; each joins the first open group that accepts it, or
opens a new one. Groups change as they grow, so the result depends on the
order and cannot be a window. Ordinary keys run as one array fold inside the
JVM. Keys above the limit are cut into stretches where the caller can say how
far a row reaches: a sweep in order of the intervals cuts wherever nothing that
came before reaches the next row. No group spans a cut, so all stretches fold at
once, and groups are numbered by their first rows afterwards. A stretch that is
still above the limit runs the same fold chunk by chunk: a round folds the next
chunk of every such stretch onto the groups settled by the round before, so no
task ever holds more than one chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.plans.skew import FOLD_ROWS, join_groups, ordered_index, reach_before, running_total, split_groups
from annolytics.plans.storage import settle

Rule = Callable[[Column, Column], Column]
Use = Callable[[Column], Column]


def once(value: Column, use: Use) -> Column:
    """``use(value)`` where value is evaluated once, also if ``use`` needs it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(
    nodes: Column, groups: Column, matches: Rule, absorb: Rule, opened: Callable[[Column], Column],
) -> Column:
    """Struct of the groups after the pass, and each node's 1-based group."""
    start = F.struct(groups.alias("groups"), F.array().cast("array<bigint>").alias("member_of"))

    def step(state: Column, node: Column) -> Column:
        hit = F.array_position(F.transform(state["groups"], lambda g: matches(g, node)), F.lit(True))

        def place(found: Column) -> Column:
            extended = F.when(
                found > 0,
                F.transform(state["groups"], lambda g, i: F.when(i == found - 1, absorb(g, node)).otherwise(g)),
            ).otherwise(F.array_append(state["groups"], opened(node)))
            number = F.when(found > 0, found).otherwise(F.size(state["groups"]) + 1).cast("bigint")
            return F.struct(extended.alias("groups"), F.array_append(state["member_of"], number).alias("member_of"))

        return once(hit, place)

    return F.aggregate(nodes, start, step)


def _stretches(df: DataFrame, keys: Sequence[str], interval: tuple[Column, Column]) -> DataFrame:
    """Rows with ``_stretch``: a number per run of rows whose intervals hang together."""
    low, high = interval
    ranged = df.withColumns({"_low": low, "_high": high})
    reached = reach_before(ranged, keys, ["_low", "_high"], F.col("_high"), "_reach")
    starts = (F.col("_reach").isNull() | (F.col("_low") > F.col("_reach"))).cast("int")
    # Equal rows may be swept in any order: none but the first of them starts a stretch.
    return running_total(reached.withColumn("_start", starts), keys, ["_low", "_high", F.desc("_start")], F.col("_start"), "_stretch").drop(
        "_low", "_high", "_reach", "_start")


def first_fit(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], fields: Sequence[str],
    group_type: str, matches: Rule, absorb: Rule, opened: Callable[[Column], Column],
    limit: int = FOLD_ROWS, interval: tuple[Column, Column] | None = None,
) -> DataFrame:
    """(keys, fields, group) for every row; ``order`` must be a total order of
    ascending columns, given as expressions.

    ``interval`` is a row's (low, high): rows whose intervals are apart, and groups of
    such rows, never accept each other.
    """
    keys, fields = list(keys), list(fields)
    if interval is not None:
        near, far = split_groups(df, keys, limit)
        result = first_fit(near, keys, order, fields, group_type, matches, absorb, opened, limit)
        if far is None:
            return result
        cut = settle(_stretches(far, keys, interval))
        parts = settle(first_fit(
            cut.withColumns({f"_r{i}": column for i, column in enumerate(order)}), [*keys, "_stretch"], order,
            [*fields, *(f"_r{i}" for i in range(len(order)))], group_type, matches, absorb, opened, limit))
        # A group's number is the place of its first row among the first rows of the key's groups.
        ranks = [f"_r{i}" for i in range(len(order))]
        first = parts.groupBy(*keys, "_stretch", "group").agg(F.min(F.struct(*ranks)).alias("_first"))
        numbered = ordered_index(first, keys, ["_first"], "_number").drop("_first")
        whole = join_groups(parts, numbered, [*keys, "_stretch", "group"])
        return result.unionByName(whole.select(*keys, *fields, F.col("_number").alias("group")))
    steps = [column.alias(f"_o{i}") for i, column in enumerate(order)]
    rows = df.select(*keys, *fields, *steps)
    names = [f"_o{i}" for i in range(len(order))]
    node = F.struct(*names, *fields)
    none = F.array().cast(f"array<{group_type}>")

    def assigned(folded: DataFrame) -> DataFrame:
        pairs = F.arrays_zip(F.col("nodes"), F.col("_f.member_of").alias("member_of"))
        return folded.select(*keys, F.explode(pairs).alias("p")).select(
            *keys, *(F.col(f"p.nodes.{f}").alias(f) for f in fields), F.col("p.member_of").alias("group"))

    ordinary, heavy = split_groups(rows, keys, limit)
    gathered = ordinary.groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
    result = assigned(gathered.withColumn("_f", fold(F.col("nodes"), none, matches, absorb, opened)))
    if heavy is None:
        return result
    numbered = ordered_index(heavy, keys, names, "_i").withColumn(
        "_round", F.floor((F.col("_i") - 1) / limit).cast("bigint"))
    numbered = settle(numbered)
    rounds = numbered.agg(F.max("_round")).head()[0]
    groups = numbered.select(*keys).distinct().withColumn("groups", none)
    for number in range(rounds + 1):
        chunk = (
            numbered.where(F.col("_round") == number)
            .groupBy(*keys).agg(F.array_sort(F.collect_list(node)).alias("nodes"))
        )
        folded = settle(
            join_groups(chunk, groups, keys)
            .withColumn("_f", fold(F.col("nodes"), F.col("groups"), matches, absorb, opened))
        )
        result = result.unionByName(assigned(folded))
        groups = folded.select(*keys, F.col("_f.groups").alias("groups"))
    return result
