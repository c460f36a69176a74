"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into buckets of similar length. A query with a score
``floor`` that it is known to reach needs, in a bucket whose longest vector has
length m, a cosine of at least ``floor / (|q| m)``; that local threshold decides
how the bucket is searched:

* above 1 nothing in it can count: the bucket is left out;
* high: coordinate pruning. In the query's strongest coordinates a vector must
  lie in a bounded interval around the query's direction, or its cosine is too low;
* low: length pruning. The bucket is sorted by length, and only the vectors long
  enough for the threshold are taken.

What remains is verified with exact integer products. Floors come from the
longest vectors, of which a bounded number is sent to all tasks first; they are
scores of real candidates, so no true neighbour is lost.

Queries and vectors meet block by block: a block of vectors is one bucket's
share, a block of queries at most ``QUERY_ROWS`` rows, and a task holds one of
each. Every block keeps k rows per query, and the best k of those are the
result; ties go to the smaller key.

Null vectors and vectors with null or non-finite components take no part, also
not as queries. Vectors of another length than the query's have no product with
it. Repeated keys are separate candidates; a query key that repeats is searched
once, with the vector that comes first by its components. Empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import keep

K = 5
SCALE = 256
BLOCK_ROWS = 4_096
QUERY_ROWS = 1_024
# Vectors whose scores give the floors.
HEAD_ROWS = 2_048
# Local cosine from which coordinates prune, and how many of them.
STEEP = 0.6
COORDINATES = 3


def usable(vector: Column) -> Column:
    """Neither null nor holding null or non-finite components."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & F.coalesce(fine, F.lit(False))


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.int64).reshape(len(column), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products; in floating point while they are exact there."""
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1]) < 2 ** 53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return (a.astype(object) @ b.astype(object).T).astype(np.int64)


def _best(keys: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller key."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
    else:
        some = np.arange(len(scores))
    return some[np.lexsort((keys[some], -scores[some]))][:k]


def search_bucket(queries: np.ndarray, query_keys, floors, vectors: np.ndarray, keys, k: int) -> list[tuple[int, int, int]]:
    """(query, key, score): the best k of one bucket for each query, those below
    the query's floor left out."""
    lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
    order = np.argsort(-lengths, kind="stable")
    vectors, keys, lengths = vectors[order], keys[order], lengths[order]
    sizes = np.sqrt((queries.astype(np.float64) ** 2).sum(1))
    longest = lengths[0] if len(lengths) else 0.0
    out = []
    slack = 1 + 1e-9
    steep, flat = [], []
    for row in range(len(queries)):
        floor = floors[row]
        reach = sizes[row] * longest
        if floor > reach * slack:
            continue
        (steep if floor > 0 and floor > STEEP * reach else flat).append(row)
    for row in steep:
        q, floor = queries[row], float(floors[row])
        # v_f of a vector with product >= floor: |v_f - c| <= width, from Cauchy-Schwarz on the other coordinates.
        chosen = np.argsort(-np.abs(q), kind="stable")[:COORDINATES]
        some = np.arange(int(np.searchsorted(-lengths, -(floor / slack / sizes[row]), "right")))
        for f in chosen:
            rest = np.sqrt(max(sizes[row] ** 2 - float(q[f]) ** 2, 0.0))
            v = vectors[some, f].astype(np.float64)
            most = float(q[f]) * v + rest * np.sqrt(np.maximum(lengths[some] ** 2 - v ** 2, 0.0))
            some = some[most * slack + 1e-6 >= floor]
        if len(some):
            scores = _products(q[None, :], vectors[some])[0]
            out += _kept(query_keys[row], floors[row], keys[some], scores, k)
    if flat:
        # Length pruning for all of them at once: the least length any of them needs.
        need = min(floors[r] / slack / sizes[r] if floors[r] > 0 and sizes[r] > 0 else 0.0 for r in flat)
        upto = int(np.searchsorted(-lengths, -need, "right"))
        scores = _products(queries[flat], vectors[:upto])
        for place, row in enumerate(flat):
            out += _kept(query_keys[row], floors[row], keys[:upto], scores[place], k)
    return out


def _kept(query, floor, keys, scores, k):
    fine = np.flatnonzero((scores >= floor) & (keys != query))
    best = fine[_best(keys[fine], scores[fine], k)]
    return [(int(query), int(keys[i]), int(scores[i])) for i in best]


def top_products(vectors: DataFrame, queries: Column, key: str = "vec_id", vector: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score) for the rows of ``vectors`` where ``queries`` holds, against all rows."""
    spark = vectors.sparkSession
    good = vectors.where(usable(F.col(f"`{vector}`")) & F.col(f"`{key}`").isNotNull())
    rows = good.select(
        F.col(f"`{key}`").cast("long").alias("key"), quantised(F.col(f"`{vector}`")).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    squares = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows = keep(rows.select("key", "v", "asks", F.sqrt(squares).alias("length"), F.size("v").alias("width")), "vectors")

    # A fixed number of the longest vectors of each width gives every query a floor.
    head = rows.orderBy(F.desc("length"), "key").limit(HEAD_ROWS).select("key", "v", "width").toPandas()
    heads = {w: (part["key"].to_numpy(), _matrix(part["v"])) for w, part in head.groupby("width")}
    shared = spark.sparkContext.broadcast(heads)

    def floors(batches):
        for part in batches:
            out = np.full(len(part), np.iinfo(np.int64).min)
            for w, group in part.groupby("width"):
                if w in shared.value:
                    keys, matrix = shared.value[w]
                    scores = _products(_matrix(group["v"]), matrix)
                    for place, (at, own) in enumerate(zip(group.index, group["key"], strict=True)):
                        others = scores[place][keys != own]
                        if len(others) >= k:
                            out[part.index.get_loc(at)] = np.partition(others, len(others) - k)[len(others) - k]
            yield part[["key", "v", "length", "width"]].assign(floor=out)

    asked = rows.where("asks").groupBy("key", "width").agg(F.min("v").alias("v"), F.min("length").alias("length"))
    asked = asked.groupBy("key").agg(F.min(F.struct("v", "length", "width")).alias("x")).select("key", "x.*")
    asked = keep(
        asked.select("key", "v", "length", "width").mapInPandas(floors, "key long, v array<long>, length double, width int, floor long"), "queries")

    # Buckets: rows of like length, in blocks of bounded size.
    counts = rows.groupBy("width").count().collect()
    blocks = sum(-(-r["count"] // BLOCK_ROWS) for r in counts)
    ranged = rows.repartitionByRange(max(1, blocks), "width", "length", F.xxhash64("key"))
    blocked = keep(ranged.select("key", "v", "width", "length", F.spark_partition_id().alias("block")), "blocks")
    bounds = blocked.groupBy("block", "width").agg(F.max("length").alias("longest"))
    groups = max(1, -(-asked.count() // QUERY_ROWS))
    dealt = asked.withColumn("group", F.pmod(F.xxhash64("key"), F.lit(groups)))
    # A block goes to the query groups that can reach their floor in it.
    reach = dealt.groupBy("group", "width").agg(F.min(F.when(F.col("length") > 0, F.col("floor") / F.col("length")).otherwise(F.lit(-1.0))).alias("need"))
    met = bounds.join(reach, "width").where("need <= longest * 1.000001 or need <= 0").select("block", "group", "width")
    left = dealt.join(met, ["group", "width"]).select(
        "block", "group", "width", "key", "v", "floor", F.lit(True).alias("asks"))
    right = blocked.join(met, ["block", "width"]).select(
        "block", "group", "width", "key", "v", F.lit(None).cast("long").alias("floor"), F.lit(False).alias("asks"))

    def search(part: pd.DataFrame) -> pd.DataFrame:
        ask, have = part[part["asks"]], part[~part["asks"]]
        found = []
        if len(ask) and len(have):
            found = search_bucket(
                _matrix(ask["v"]), ask["key"].to_numpy(), ask["floor"].to_numpy().astype(np.int64), _matrix(have["v"]), have["key"].to_numpy(), k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    found = left.unionByName(right).groupBy("block", "group", "width").applyInPandas(search, "query_id long, vec_id long, score long")
    best = found.groupBy("query_id").agg(
        F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


ORACLE = """
with v as (
    select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), s as (
    select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
    from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)
), r as (
    select *, row_number() over (partition by query_id order by score desc, vec_id)::integer as rank from s
)
select query_id, rank, vec_id, score from r where rank <= 5
"""
