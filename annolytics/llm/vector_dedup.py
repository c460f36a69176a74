"""Near-duplicate vectors by PCA-ordered tiled comparison.

Vectors are scaled to length one and turned to the principal axes of a bounded
sample, greatest variance first; the turn keeps all products. A tree over the
leading axes deals them into tiles of bounded size: two vectors whose cosine
reaches the threshold lie at most ``sqrt(2 - 2 t)`` apart, so a vector meets its
own tile and those later ones whose box lies that near, and no others. Each pair
is met once.

Within a tile products are summed over the leading axes first. What the rest
can add is at most the product of the two suffix lengths, so pairs that cannot
reach the threshold any more stop there; the few that stay are summed on, and
the last of them are decided by the cosine of the original components.

Exact copies of a vector are one node with a count. A tile's result is one
count per vector and one edge per vector to the smallest node it reaches in the
tile, however many pairs the tile holds, so groups of copies stay linear. A tile
that many vectors fall into (they cannot be parted by any axis) is dealt into
blocks that meet block by block, and a block is compared strip by strip.

Vectors that are null, zero, or hold null or non-finite components link with
nothing; so do vectors of different lengths. Rows without ``vec_id`` keep their
row with null ids. Rows that share a ``vec_id`` are one vector each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.shared import components, keep, small_batches
from annolytics.llm.topk_search import usable
from annolytics.llm.words import mix

COSINE = 0.95
# Rows of the sample that the axes and the tree are fitted on.
SAMPLE_ROWS = 20_000
TILE_ROWS = 4_096
# Rows that meet a block together, and those of them that are compared at a time.
GROUP_ROWS = 8_192
STRIP_ROWS = 256
# Rows of one Arrow batch that is dealt out.
DEALT_ROWS = 4_096
# Leading axes are summed in steps of this many.
STEP = 16
# What rounding may do to a sum of products of unit vectors.
SLACK = 1e-9


class Tree:
    """Boxes from median cuts along the axis with the widest spread of the sample."""

    def __init__(self, sample: np.ndarray, rows: float, tile: int):
        self.cuts: list[tuple[int, float, int, int] | None] = []
        self._grow(sample, rows, tile)

    def _grow(self, sample: np.ndarray, rows: float, tile: int) -> int:
        here = len(self.cuts)
        self.cuts.append(None)
        if rows <= tile or len(sample) < 4:
            return here
        spread = np.ptp(sample, axis=0)
        axis = int(np.argmax(spread))
        cut = float(np.median(sample[:, axis]))
        low = sample[:, axis] < cut
        if spread[axis] == 0 or not low.any() or low.all():
            return here
        share = low.mean()
        left = self._grow(sample[low], rows * share, tile)
        right = self._grow(sample[~low], rows * (1 - share), tile)
        self.cuts[here] = axis, cut, left, right
        return here

    def tiles(self, points: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(point, tile, own) for a point's own tile and every later one whose box is within ``reach``."""
        found = []

        def walk(node: int, some: np.ndarray, own: np.ndarray, gaps: np.ndarray) -> None:
            cut = self.cuts[node]
            if not len(some):
                return
            if cut is None:
                found.append((some, np.full(len(some), node), own))
                return
            axis, at, left, right = cut
            beyond = points[some, axis] - at
            for child, gap, here in ((left, beyond, beyond < 0), (right, -beyond, beyond >= 0)):
                wider = gaps.copy()
                wider[:, axis] = np.maximum(wider[:, axis], gap)
                near = (wider ** 2).sum(1) <= reach ** 2
                walk(child, some[near], own[near] & here[near], wider[near])

        walk(0, np.arange(len(points)), np.ones(len(points), bool), np.zeros(points.shape))
        if not found:
            return (np.zeros(0, int),) * 3
        point, tile, own = (np.concatenate(x) for x in zip(*found, strict=True))
        home = np.zeros(len(points), int)
        home[point[own]] = tile[own]
        later = tile >= home[point]
        return point[later], tile[later], own[later]


def _unit(vectors: np.ndarray) -> np.ndarray:
    scale = np.abs(vectors).max(1, keepdims=True)
    vectors = vectors / scale
    return vectors / np.sqrt((vectors ** 2).sum(1, keepdims=True))


def similar(a: np.ndarray, b: np.ndarray, threshold: float, step: int = STEP) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) with a[i] . b[j] >= threshold less rounding; columns in order of variance."""
    width = a.shape[1]
    first = min(step, width)
    sums = a[:, :first] @ b[:, :first].T
    rest_a = np.sqrt(np.maximum((a[:, first:] ** 2).sum(1), 0))
    rest_b = np.sqrt(np.maximum((b[:, first:] ** 2).sum(1), 0))
    i, j = np.nonzero(sums + np.outer(rest_a, rest_b) >= threshold - SLACK)
    held = sums[i, j]
    for start in range(first, width, step):
        upto = min(start + step, width)
        held = held + np.einsum("ij,ij->i", a[i, start:upto], b[j, start:upto])
        rest = np.sqrt((a[i, upto:] ** 2).sum(1) * (b[j, upto:] ** 2).sum(1))
        good = held + rest >= threshold - SLACK
        i, j, held = i[good], j[good], held[good]
    return i, j


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of a column of lists of one length."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def link_classes(vectors: DataFrame, threshold: float = COSINE, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of ``vectors``."""
    spark = vectors.sparkSession
    # Single precision stays so while it moves; sums are in double precision.
    kind = vectors.schema[vector].dataType.elementType.simpleString()
    x = F.col(f"`{vector}`").cast("array<float>" if kind == "float" else "array<double>")
    fine = usable(F.col(f"`{vector}`")) & F.coalesce(F.exists(x, lambda v: v != 0), F.lit(False))
    rows = vectors.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.when(fine, x).alias("v"))
    rows = keep(rows.select("vec_id", "v", F.monotonically_increasing_id().alias("row")), "vectors")
    # Copies of a vector are one node, named by its first row.
    nodes = rows.where("v is not null").groupBy("v").agg(F.min("row").alias("node"), F.count(F.lit(1)).alias("copies"))
    nodes = keep(nodes.select("node", "v", "copies", F.size("v").alias("width")), "nodes")
    members = rows.where("v is not null").select("vec_id", "row", "v").join(nodes.select("v", "node", "copies"), "v").select("row", "node", "copies")

    found = None
    for counted in nodes.groupBy("width").count().orderBy("width").collect():
        part = _width_links(nodes.where(F.col("width") == counted["width"]), counted["count"], threshold)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))

    found = keep(found, "tiles")
    label = components(found.select("node", F.explode("edges").alias("to")).select(F.col("node").alias("a"), F.col("to").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    placed = (
        rows.select("vec_id", "row").join(members, "row", "left").join(counts, "node", "left").join(label, "node", "left")
        .select("vec_id", "row", F.coalesce("component", "node", "row").alias("component"),
                F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links")))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    return placed.join(least, "component").select(
        "vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


def _width_links(nodes: DataFrame, count: int, threshold: float) -> DataFrame:
    """(node, links, edges) per node and tile: vectors it links to there, copies counted, and
    the smallest node it reaches there."""
    spark = nodes.sparkSession
    small_batches(spark, "1m")
    drawn = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, SAMPLE_ROWS / count)))
    sample = drawn.limit(SAMPLE_ROWS).select("v").toArrow()["v"]
    axes, tree = None, None
    if len(sample):
        units = _unit(_matrix(sample))
        _, _, axes = np.linalg.svd(units.T @ units)
        tree = Tree(units @ axes.T, count, TILE_ROWS)
    reach = float(np.sqrt(max(0.0, 2 - 2 * threshold))) + 1e-6
    shared = spark.sparkContext.broadcast((axes, tree))

    def met(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        axes, tree = shared.value
        if axes is None:
            return np.arange(len(vectors)), np.zeros(len(vectors), int), np.ones(len(vectors), bool)
        return tree.tiles(_unit(_matrix(vectors)) @ axes.T, reach)

    def count_rows(batches):
        for batch in batches:
            _, tile, own = met(batch.column(0))
            tiles, place = np.unique(tile, return_inverse=True)
            yield pa.record_batch(
                [pa.array(tiles.astype(np.int32)), pa.array(np.bincount(place, own, len(tiles)).astype(np.int64)),
                 pa.array(np.bincount(place, minlength=len(tiles)).astype(np.int64))], ["tile", "residents", "rows"])

    # One row per tile; tiles are bounded by the sample. Residents of a tile come in blocks, those
    # that meet them in groups.
    sizes = nodes.select("v").mapInArrow(count_rows, "tile int, residents long, rows long").groupBy("tile").agg(
        F.ceil(F.sum("residents") / TILE_ROWS).alias("blocks"), F.ceil(F.sum("rows") / GROUP_ROWS).alias("groups")).toArrow()
    blocks, groups = (np.zeros((max(sizes["tile"].to_pylist(), default=0) + 1), np.int64) for _ in range(2))
    blocks[sizes["tile"].to_numpy()], groups[sizes["tile"].to_numpy()] = sizes["blocks"].to_numpy(), sizes["groups"].to_numpy()
    dealing = spark.sparkContext.broadcast((blocks, groups))

    def deal(batches):
        blocks, groups = dealing.value
        for batch in batches:
            point, tile, own = met(batch.column(1))
            node = batch.column(0).to_numpy()[point]
            for resident in (True, False):
                some = np.flatnonzero(own) if resident else np.arange(len(tile))
                here = tile[some]
                times = groups[here] if resident else blocks[here]
                at = np.repeat(np.arange(len(some)), times)
                every = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
                one = (mix(node[some], 5 if resident else 6) % np.maximum(blocks[here] if resident else groups[here], 1).astype(np.uint64)).astype(np.int64)[at]
                block, group = (one, every) if resident else (every, one)
                for first in range(0, len(at), DEALT_ROWS):
                    part = slice(first, first + DEALT_ROWS)
                    rows = batch.take(pa.array(point[some[at[part]]]))
                    yield pa.record_batch(
                        [pa.array(here[at[part]].astype(np.int32)), pa.array(block[part]), pa.array(group[part]), *rows.columns[:1], rows.column(2),
                         rows.column(1), pa.array(own[some[at[part]]]), pa.array(np.full(len(rows), resident))],
                        ["tile", "block", "group", "node", "copies", "v", "own", "resident"])

    kind = nodes.schema["v"].dataType.simpleString()
    dealt = nodes.select("node", "v", "copies").mapInArrow(
        deal, f"tile int, block long, group long, node long, copies long, v {kind}, own boolean, resident boolean")

    def compare(part: pa.Table) -> pa.Table:
        resident = part["resident"].to_numpy()
        have, ask = part.filter(pa.array(resident)), part.filter(pa.array(~resident))
        node, links, label = _links(have, ask, shared.value[0], threshold)
        rows = np.flatnonzero(links)
        edges = pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32), pa.array(node[label[rows]]))
        return pa.table([pa.array(node[rows]), pa.array(links[rows]), edges], ["node", "links", "edges"])

    return dealt.groupBy("tile", "block", "group").applyInArrow(compare, "node long, links long, edges array<long>")


def _links(have: pa.Table, ask: pa.Table, axes: np.ndarray | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(nodes in order, links of each, place of the smallest node that each reaches) of the rows
    of ``ask`` against those of ``have``. A pair that lives in one tile meets twice and counts once."""
    mine, other = ask["node"].to_numpy(), have["node"].to_numpy()
    node, places = np.unique(np.concatenate([mine, other]), return_inverse=True)
    links, label = np.zeros(len(node), np.int64), np.arange(len(node))
    if not len(mine) or not len(other):
        return node, links, label
    a, b = _matrix(ask["v"]), _matrix(have["v"])
    turned_a, turned_b = (_unit(x) if axes is None else _unit(x) @ axes.T for x in (a, b))
    own = ask["own"].to_numpy()
    copies_a, copies_b = ask["copies"].to_numpy(), have["copies"].to_numpy()
    for first in range(0, len(mine), STRIP_ROWS):
        i, j = similar(turned_a[first:first + STRIP_ROWS], turned_b, threshold)
        i = i + first
        once = ~own[i] | (mine[i] < other[j])
        i, j = _decided(a, b, i[once], j[once], threshold)
        p, q = places[i], places[len(mine) + j]
        np.add.at(links, p, copies_b[j])
        np.add.at(links, q, copies_a[i])
        label = _joined(label, p, q)
    return node, links, label


def _decided(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float, rows: int = 100_000):
    """The pairs whose cosine of the original components reaches the threshold."""
    good = np.zeros(len(i), bool)
    for start in range(0, len(i), rows):
        x, y = a[i[start:start + rows]], b[j[start:start + rows]]
        x, y = (v / 2.0 ** np.floor(np.log2(np.abs(v).max(1, keepdims=True))) for v in (x, y))  # exact, and no overflow
        good[start:start + rows] = np.einsum("ij,ij->i", x, y) / (np.sqrt((x ** 2).sum(1)) * np.sqrt((y ** 2).sum(1))) >= threshold
    return i[good], j[good]


def _joined(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``label`` (the smallest place that each place reaches) after the links p - q."""
    while len(p):
        x, y = label[p], label[q]
        apart = x != y
        p, q = p[apart], q[apart]
        least, most = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
        label = label.copy()
        np.minimum.at(label, most, least)
        while not np.array_equal(label[label], label):
            label = label[label]
    return label


ORACLE = """
with recursive v as (
    select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), p as (
    select a.vec_id as a, b.vec_id as b from v a join v b
    on a.vec_id <> b.vec_id and len(a.v) = len(b.v) and list_cosine_similarity(a.v, b.v) >= 0.95
), r as (
    select vec_id, vec_id as other from embeddings
    union
    select r.vec_id, p.b from r join p on p.a = r.other
)
select e.vec_id, coalesce(d.n_links, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e join (select vec_id, min(other) as component_id from r group by vec_id) c using (vec_id)
left join (select a, count(*) as n_links from p group by a) d on d.a = e.vec_id
"""
