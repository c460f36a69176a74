"""Toxicity by a factorization machine over hashed terms.

A document's features are the hashed terms it holds: its words without
punctuation, in lower case, and the beginnings of longer words. Single weights
add up; factors add what pairs of terms say together beyond that, such as an
insult next to a mention of a group, or two insults where one is harmless.

Spark counts every term over all labelled training rows and keeps those that
the label depends on most (at most ``FEATURES``). A mention that says nothing
alone must still meet the insult it turns into an attack, so a second count
reads the open documents, those with a suspect term but none that decides
alone: terms on which the label depends among these become features too, with
the suspects that they need. The machine is fitted on the driver to a bounded
sample of the training rows, reduced to these features: the ``SAMPLE`` rows with
the least hash of ``doc_id``, in that order, so reruns agree. Scoring reads
every text whole, in Arrow batches, next to a model of fixed size.

Null and empty texts have no features and get the score of the bias. Labels are
matched by ``doc_id``; rows without ``doc_id`` or label train nothing and are
scored; ``doc_id``s that are labelled twice take the greater label. Without any
training rows of both kinds every score is 0.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import Bitmap, keep, small_batches
from annolytics.llm.words import slices, split_words

SAMPLE = 30_000
FEATURES = 4_096
FACTORS = 8
STEPS = 200
FOLDS = 5
# A term is telling if it is this many standard deviations off in this many documents,
TELLING = 5.0
SEEN = 4
# and change the odds of the label at least so many times.
LIFT = 3.0
# A term is a suspect if it changes the odds so many times,
SUSPECT = 1.5
# and decides alone if this share of its documents is labelled.
DECIDES = 0.8
# Terms that count only beside a suspect, at most.
PARTNERS = 1_024
# Terms that are counted together before their counts are passed on.
COUNTED = 2_000_000
# Bytes of the word beginnings that are terms of their own.
BEGINNINGS = (4, 5, 6)

_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[list(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = True


def term_sets(texts: pa.Array):
    """Sorted distinct hashed terms of each text (int64), in slices of bounded size."""
    for _, part in slices(texts):
        words = split_words(part, lower=True)
        start, end = words.start.copy(), words.end.copy()
        for _ in range(4):  # punctuation at the ends, at most four marks on a side
            start += (start < end) & _PUNCTUATION[words.data[np.minimum(start, len(words.data) - 1)]] if len(start) else 0
            end -= (start < end) & _PUNCTUATION[words.data[np.maximum(end - 1, 0)]] if len(end) else 0
        text = np.repeat(np.arange(len(part)), words.counts)
        full = start < end
        owners, terms = [text[full]], [words.hashes(start[full], end[full])]
        for n in BEGINNINGS:
            long = end - start > n
            owners.append(text[long])
            terms.append(words.hashes(start[long], start[long] + n) ^ np.uint64(0x5555555555555555 + n))
        owner, term = np.concatenate(owners), np.concatenate(terms)
        order = np.argsort(owner, kind="stable")
        term = term[order]
        bounds = np.searchsorted(owner[order], np.arange(len(part) + 1))
        for first, last in zip(bounds[:-1], bounds[1:], strict=True):
            yield np.unique(term[first:last]).view(np.int64)


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    """Rows that no training step sees."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(folds)) == 0, F.lit(False))


@dataclass(frozen=True)
class Machine:
    """score = sigmoid(bias + w.x + sum over pairs <v_i, v_j> x_i x_j), x in {0, 1}."""

    terms: np.ndarray
    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def places(self, terms: np.ndarray) -> np.ndarray:
        """Which features a document's sorted terms hold."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        return at[self.terms[at] == terms]

    def score(self, places: np.ndarray) -> float:
        factors = self.factors[places]
        pairs = 0.5 * (np.sum(factors.sum(0) ** 2) - np.sum(factors ** 2))
        total = self.bias + self.weights[places].sum() + pairs
        return float(1.0 / (1.0 + np.exp(-np.clip(total, -40, 40))))


def fit(terms: np.ndarray, rows: list[np.ndarray], labels: np.ndarray, factors: int = FACTORS, steps: int = STEPS) -> Machine:
    """Full-batch Adam on the logistic loss, with ridge penalties. Deterministic."""
    n, k = len(terms), factors
    if not len(labels) or labels.min() == labels.max():
        return Machine(terms[:0], -40.0, np.zeros(0), np.zeros((0, k)))
    lengths = np.array([len(r) for r in rows])
    place = np.concatenate(rows)
    full = np.flatnonzero(lengths)
    row_starts = np.cumsum(lengths[full]) - lengths[full]
    owner = np.repeat(full, lengths[full])
    order = np.argsort(place, kind="stable")
    used, column_starts = np.unique(place[order], return_index=True)

    def by_row(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(rows), *values.shape[1:]))
        if len(full):
            out[full] = np.add.reduceat(values, row_starts)
        return out

    def by_term(values: np.ndarray) -> np.ndarray:
        out = np.zeros((n, *values.shape[1:]))
        if len(used):
            out[used] = np.add.reduceat(values[order], column_starts)
        return out

    rng = np.random.default_rng(5)
    rate = float(np.clip(labels.mean(), 1e-6, 1 - 1e-6))
    state = {"b": np.array([np.log(rate / (1 - rate))]), "w": np.zeros(n), "v": rng.normal(0, 0.05, (n, k))}
    moments = {name: (np.zeros_like(x), np.zeros_like(x)) for name, x in state.items()}
    ridge = {"b": 0.0, "w": 2e-5, "v": 1e-4}
    for step in range(1, steps + 1):
        v = state["v"][place]
        sums = by_row(v)
        total = state["b"][0] + by_row(state["w"][place]) + 0.5 * ((sums ** 2).sum(1) - by_row((v ** 2).sum(1)))
        error = (1 / (1 + np.exp(-np.clip(total, -40, 40))) - labels) / len(rows)
        each = error[owner]
        slope = {"b": np.array([error.sum()]), "w": by_term(each), "v": by_term(each[:, None] * (sums[owner] - v))}
        for name, x in state.items():
            g = slope[name] + ridge[name] * x
            m, s = moments[name]
            m *= 0.9
            m += 0.1 * g
            s *= 0.999
            s += 0.001 * g * g
            x -= 0.05 * (m / (1 - 0.9 ** step)) / (np.sqrt(s / (1 - 0.999 ** step)) + 1e-8)
    return Machine(terms, float(state["b"][0]), state["w"], state["v"])


def _features(terms: np.ndarray) -> Machine:
    """A machine that knows its terms only."""
    return Machine(np.sort(terms), 0.0, np.zeros(len(terms)), np.zeros((len(terms), 1)))


def _dependent(known: DataFrame, share: float, lift: float, most: int) -> pa.Table:
    """(term, odds, rate) of the terms on which the label depends most in ``known``
    (toxic, text), of whose rows ``share`` are labelled; every row is counted."""
    def total(terms: list[np.ndarray], toxic: list[np.ndarray]) -> pa.RecordBatch:
        term, kind = np.unique(np.concatenate(terms), return_inverse=True)
        marks = np.concatenate(toxic)
        return pa.record_batch(
            [pa.array(term), pa.array(np.bincount(kind, minlength=len(term)).astype(np.int64)),
             pa.array(np.bincount(kind, marks, len(term)).astype(np.int64))], ["term", "n", "p"])

    def count(batches):
        terms, toxic, size = [], [], 0
        for batch in batches:
            for mark, each in zip(batch.column(0).to_pylist(), term_sets(batch.column(1)), strict=True):
                terms.append(each)
                toxic.append(np.full(len(each), mark))
                size += len(each)
                if size > COUNTED:
                    yield total(terms, toxic)
                    terms, toxic, size = [], [], 0
        if terms:
            yield total(terms, toxic)

    counted = known.select("toxic", "text").mapInArrow(count, "term long, n long, p long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("p").alias("p"))
    spread = F.sqrt(F.col("n") * share * (1 - share) + 1)
    odds = F.abs(F.log((F.col("p") + 0.5) / (F.col("n") - F.col("p") + 0.5)) - float(np.log(share / (1 - share))))
    return (
        counted.withColumn("odds", odds).where((F.col("n") >= SEEN) & (F.col("odds") >= float(np.log(lift))))
        .select("term", "odds", (F.col("p") / F.col("n")).alias("rate"), F.abs((F.col("p") - F.col("n") * share) / spread).alias("z"))
        .where(F.col("z") >= TELLING).orderBy(F.desc("z"), "term").limit(most).toArrow()
    )


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, features: int = FEATURES) -> Machine:
    """A machine from the labelled rows of ``docs`` that are not held out."""
    spark = docs.sparkSession
    small_batches(spark)
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Texts without a label go before the join, by a filter of fixed size.
    held = spark.sparkContext.broadcast(Bitmap.of(marks, "doc_id"))

    def pick(batches):
        for batch in batches:
            yield batch.filter(pa.array(held.value.has(batch.column(2).to_numpy()))).select([0, 1])

    picked = texts.withColumn("place", Bitmap.place("doc_id")).mapInArrow(pick, "doc_id long, text string")
    # A merge at every size: the labels grow with the documents, so they are never broadcast whole.
    known = keep(picked.join(marks.hint("merge"), "doc_id").select("doc_id", "toxic", "text"), "known")
    row = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rows, toxic = row[0], row[1]
    if toxic in (0, rows):
        return fit(np.zeros(0, np.int64), [], np.zeros(0))

    found = _dependent(known, toxic / rows, SUSPECT, features)
    told = found["odds"].to_numpy() >= np.log(LIFT)
    suspects = _features(found["term"].to_numpy())
    decisive = _features(found["term"].to_numpy()[found["rate"].to_numpy() >= DECIDES])

    def opened(batches):
        for batch in batches:
            yield batch.filter(pa.array([
                len(suspects.places(each)) > 0 and not len(decisive.places(each)) for each in term_sets(batch.column(2))], pa.bool_()))

    open_rows = known.mapInArrow(opened, known.schema)
    row = open_rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    chosen = found["term"].to_numpy()[told]
    if 0 < row[1] < row[0]:
        partners = _dependent(open_rows, row[1] / row[0], SUSPECT, PARTNERS)["term"].to_numpy()
        if not np.isin(partners, chosen).all():  # the telling ones first, then what the pairs need
            chosen = np.array(list(dict.fromkeys([*chosen, *partners, *found["term"].to_numpy()]))[:features], np.int64)
    machine = _features(chosen)

    def reduce(batches):
        for batch in batches:
            places = [machine.places(each) for each in term_sets(batch.column(1))]
            ends = np.cumsum([0, *map(len, places)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(ends, np.concatenate(places).astype(np.int32))
            yield pa.record_batch([batch.column(0), lists, batch.column(2), batch.column(3)], ["toxic", "places", "place", "doc_id"])

    # Somewhat more rows by hash, then the least of them.
    part = int(min(1.0, 1.05 * sample / rows) * 1_000_000)
    drawn = known.withColumn("place", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1_000_000_000))).where(F.col("place") < 1000 * part)
    drawn = drawn.select("toxic", "text", "place", "doc_id").mapInArrow(reduce, "toxic int, places array<int>, place long, doc_id long")
    drawn = drawn.orderBy("place", "doc_id", "places").limit(sample).select("toxic", "places").toArrow()
    places = [np.array(x, np.int64) for x in drawn["places"].to_pylist()]
    return fit(machine.terms, places, drawn["toxic"].to_numpy().astype(float))


def score(docs: DataFrame, machine: Machine, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text, held_out, score, predicted), one row per row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)

    def judge(batches):
        for batch in batches:
            model = shared.value
            scores = [model.score(model.places(terms)) for terms in term_sets(batch.column(2))]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["doc_id", "held_out", "score"])

    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"), held_out(F.col(f"`{key}`").cast("long")).alias("held_out"),
        F.col(f"`{text}`").cast("string").alias("text"))
    return rows.mapInArrow(judge, "doc_id long, held_out boolean, score double").withColumn(
        "predicted", F.when(F.col("score") >= 0.5, F.lit(1)).otherwise(F.lit(0)))


def without_toxic(docs: DataFrame, machine: Machine) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, all columns as they were."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(machine)
    place = docs.columns.index("text")

    def filtered(batches):
        for batch in batches:
            model = shared.value
            good = [model.score(model.places(terms)) < 0.5 for terms in term_sets(batch.column(place))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(filtered, docs.schema)
