"""Mixing sources to target weights, by Efraimidis-Spirakis sampling.

Each source gets a target number of words: its weight's share of all words, at
most ``EPOCHS`` times its own size, the excess going to the others by weight.
Of a source with target T and size S every document is taken T div S times;
for the rest every document draws an exponential key with its quality weight as
rate, and documents are taken in the order of their keys until the budget is
met. The last of them gives as many words as are still needed.

A source may hold most of the rows. Its keys are cut into ranges by their known
distribution; range totals are summed up in a small table and documents only
within their range, so no task holds a whole source.

Null texts have size 0 and are taken for 0 words. The null source is a source,
last in order. Keys depend on ``doc_id`` alone, ties go by ``doc_id`` and then
by a hash of the text; rows that agree in all of these are alike, so any order
among them gives the same result rows. Missing or non-positive quality weights
count as 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from annolytics.llm.shared import WORD, keep, spare_names
from annolytics.plans.skew import ordered_index

WEIGHTS = (1, 2, 3)
EPOCHS = 3
# Documents in one range of keys.
RANGE_ROWS = 500
SEED = 20_240
# Sampling weight by quality label; documents without one have 1.
QUALITY = {1: 2.0, 0: 0.5}


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, n, target) from (source, source_size, n).

    The level L with sum(min(epochs * size, weight * L)) = all sizes is found in
    rounds over the sources; each round only returns two sums. A source that is
    full stays full, so the rounds end.
    """
    named = sizes.withColumn("_none", F.lit(0))
    placed = ordered_index(named, ["_none"], [F.col("source").isNull(), F.col("source")], "_place")
    which = F.pmod(F.col("_place") - 1, F.lit(len(weights))).cast("int")
    placed = keep(placed.select(
        "source", "source_size", "n", (F.lit(epochs) * F.col("source_size")).alias("_most"),
        F.element_at(F.array(*[F.lit(w) for w in weights]), which + 1).cast("double").alias("_weight")), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, None
    while True:
        over = F.col("_most") <= F.lit(level) * F.col("_weight")
        row = placed.agg(
            F.coalesce(F.sum(F.when(over, F.col("_most"))), F.lit(0)), F.sum(F.when(~over, F.col("_weight"))),
            F.count_if(over)).first()
        if row[1] is None or row[2] == full:
            break
        full = row[2]
        level = max(level, (total - row[0]) / row[1])
    target = F.least(F.col("_most").cast("double"), F.lit(level) * F.col("_weight"))
    return placed.select("source", "source_size", "n", target.alias("target"))


def sampling_key(identity: Column, quality: Column, seed: int = SEED) -> Column:
    """-ln(u) / weight, with u in (0, 1) fixed by the identity."""
    u = (F.pmod(F.xxhash64(identity, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    rate = F.when(quality > 0, quality).otherwise(F.lit(1.0))
    return -F.log(u) / F.coalesce(rate, F.lit(1.0))


def mix(
    docs: DataFrame, quality: DataFrame | None = None, key: str = "doc_id", text: str = "text", source: str = "source",
    weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, tie) for every row of ``docs``.

    ``quality`` has one row (doc_id, weight) per document; others weigh 1.
    ``tie`` is a hash of the text that tells rows of one ``doc_id`` apart.
    """
    sized = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"),
        word_count(F.col(f"`{text}`").cast("string")).alias("size"), F.xxhash64(F.col(f"`{text}`").cast("string")).alias("tie"))
    sized = keep(sized, "sizes")
    totals = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, epochs)
    if quality is None:
        weighed = sized.withColumn("weight", F.lit(1.0))
    else:
        weight = quality.groupBy("doc_id").agg(F.max("weight").cast("double").alias("weight"))
        weighed = sized.join(weight, "doc_id", "left")
    drawn = weighed.select("*", sampling_key(F.col("doc_id"), F.col("weight"), seed).alias("_key"))
    totals = totals.select(F.col("source").alias("_source"), "source_size", "n", "target")
    drawn = drawn.join(totals, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    ranges = F.ceil(F.col("n") / RANGE_ROWS)
    drawn = keep(drawn.select(
        "doc_id", "source", "size", "source_size", "target", "tie", "_key",
        F.least(F.floor((1 - F.exp(-F.col("_key"))) * ranges), ranges - 1).cast("long").alias("_range")), "drawn")

    sums = drawn.groupBy("source", "_range").agg(F.sum("size").alias("_sum"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(
        F.col("source").alias("_s"), F.col("_range").alias("_r"), F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    within = (
        Window.partitionBy("source", "_range").orderBy("_key", "doc_id", "tie")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    rows = drawn.withColumn("_ahead", F.coalesce(F.sum("size").over(within), F.lit(0))).join(
        sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_range") == F.col("_r")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    budget = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    rest = F.greatest(F.lit(0), F.least(F.col("size"), F.col("budget") - F.col("_before") - F.col("_ahead")))
    return (
        rows.withColumn("whole", whole).withColumn("budget", budget)
        .select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + rest).cast("long").alias("taken"), "tie")
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """(doc_id, weight) from quality labels."""
    weight = F.lit(1.0)
    for label, value in QUALITY.items():
        weight = F.when(F.col("quality") == label, F.lit(value)).otherwise(weight)
    return labels.select("doc_id", weight.alias("weight"))


def mixed_documents(docs: DataFrame, quality: DataFrame | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it. The document
    that meets its source's budget is kept whole; untaken ones go."""
    doc, tie, own, times, nth = spare_names(docs, "_doc", "_tie", "_t", "_times", "_n")
    taken = mix(docs, quality).where("taken > 0").select(
        F.col("doc_id").alias(doc), F.col("tie").alias(tie), F.ceil(F.col("taken") / F.col("size")).cast("int").alias(times)
    ).groupBy(doc, tie).agg(F.max(times).alias(times))
    names = docs.columns
    rows = docs.withColumn(own, F.xxhash64(F.col("text"))).join(
        taken, F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.col(own) == F.col(tie)))
    return rows.withColumn(nth, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[f"`{n}`" for n in names])
