"""Greedy selection over a conflict graph.

A node is taken if no taken node precedes it on an incoming edge. Nodes of
different connected components do not touch each other, so the graph is cut
into components first (some log n rounds, whatever the order). A component of
up to ``COMPONENT_EDGES`` edges is decided in place, as one sorted stream of
its edges in one task: it costs a pass, also where every node waits for the one
before. Larger components go in rounds that settle every undecided node without
an undecided predecessor at once; their number is the longest undecided chain.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from annolytics.plans.components import components
from annolytics.plans.skew import join_groups, small_side
from annolytics.plans.storage import settle

# Edges of one component that a single task may stream; it remembers the component's nodes.
COMPONENT_EDGES = 2_000_000


def take_greedily(
    nodes: DataFrame, edges: DataFrame, keys: Sequence[str], limit: int = COMPONENT_EDGES,
) -> DataFrame:
    """``nodes`` (keys, node) with a boolean ``taken``; ``edges`` are (keys, src, dst),
    each pointing from the earlier node to the one it would exclude.

    A column ``turn`` of the edges is the place of ``dst`` in the order of nodes; without it
    nodes are in their own order.
    """
    keys = list(keys)
    if "turn" not in edges.columns:
        edges = edges.withColumn("turn", F.col("dst"))
    edges = settle(edges.select(*keys, "src", "dst", "turn"))
    nodes = nodes.select(*keys, "node")
    touched = edges.select(*keys, F.col("src").alias("node")).unionByName(edges.select(*keys, F.col("dst").alias("node"))).distinct()
    free = nodes.join(touched, [*keys, "node"], "left_anti").withColumn("taken", F.lit(True))
    parts = components(edges, keys)
    owned = edges.join(parts.withColumnRenamed("node", "src"), [*keys, "src"])
    large = settle(owned.groupBy(*keys, "component").count().where(F.col("count") > limit).select(*keys, "component"))
    if large.isEmpty():
        return free.unionByName(_streamed(owned, keys))
    beyond = small_side(large)
    ordinary = join_groups(owned, beyond, [*keys, "component"], "left_anti")
    rest = join_groups(owned, beyond, [*keys, "component"], "left_semi").drop("component", "turn")
    crowded = join_groups(parts, beyond, [*keys, "component"], "left_semi").select(*keys, "node")
    return reduce(DataFrame.unionByName, [free, _streamed(ordinary, keys), _in_rounds(crowded, rest, keys)])


def _streamed(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every node of the edges' components, decided in one pass in order."""
    group = [*keys, "component"]
    # A node's edges come together, and all of its predecessors' before them.
    rows = edges.select(*group, "turn", "dst", "src").repartition(*group).sortWithinPartitions(*group, "turn", "dst", "src")
    schema = edges.select(*keys, F.col("src").alias("node")).withColumn("taken", F.lit(True)).schema
    at = len(group)

    def decide(batches):
        now, dst, excluded = object(), None, False
        taken: dict = {}
        out: list[tuple] = []

        def close():
            if dst is not None:
                taken[dst] = not excluded

        def finish():
            close()
            out.extend((*now[:-1], node, state) for node, state in taken.items())

        def flush():
            columns = zip(*out, strict=True)
            batch = pa.record_batch([pa.array(c, t) for c, t in zip(columns, types, strict=True)], schema.names)
            out.clear()
            return batch

        started, types = False, None
        for batch in batches:
            if types is None:
                types = [*(batch.schema.field(i).type for i in range(len(keys))), batch.schema.field(at + 2).type, pa.bool_()]
            for row in zip(*(c.to_pylist() for i, c in enumerate(batch.columns) if i != at), strict=True):
                own, node, src = row[:at], row[at], row[at + 1]
                if not started or own != now:
                    if started:
                        finish()
                        if len(out) >= 10_000:
                            yield flush()
                    now, dst, started = own, None, True
                    taken.clear()
                if node != dst:
                    close()
                    dst, excluded = node, False
                # A predecessor without incoming edges has none to exclude it.
                excluded |= taken.setdefault(src, True)
        if started:
            finish()
            yield flush()

    return rows.mapInArrow(decide, schema)


def _in_rounds(nodes: DataFrame, edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same by rounds of joins, for components that no task may hold."""
    edges = settle(edges.select(*keys, "src", "dst"))
    blocked_once = edges.select(*keys, F.col("dst").alias("node")).distinct()
    nodes = nodes.select(*keys, "node")
    done = nodes.join(blocked_once, [*keys, "node"], "left_anti").withColumn("taken", F.lit(True))
    open_nodes = settle(blocked_once)
    newly = settle(done)
    decided_parts = [newly]
    while True:
        winners = newly.where("taken").select(*keys, F.col("node").alias("src"))
        dropped = (
            edges.join(winners, [*keys, "src"], "left_semi")
            .select(*keys, F.col("dst").alias("node")).distinct()
            .join(open_nodes, [*keys, "node"], "left_semi")
        )
        dropped = settle(dropped.withColumn("taken", F.lit(False)))
        decided = newly.select(*keys, "node").unionByName(dropped.select(*keys, "node"))
        edges = settle(
            edges
            .join(decided.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti")
            .join(dropped.select(*keys, F.col("node").alias("dst")), [*keys, "dst"], "left_anti")
        )
        open_nodes = open_nodes.join(dropped, [*keys, "node"], "left_anti")
        waiting = edges.select(*keys, F.col("dst").alias("node")).distinct()
        fresh = open_nodes.join(waiting, [*keys, "node"], "left_anti").withColumn("taken", F.lit(True))
        newly = settle(fresh)
        open_nodes = settle(open_nodes.join(newly, [*keys, "node"], "left_anti"))
        decided_parts += [dropped, newly]
        if newly.isEmpty():
            return reduce(DataFrame.unionByName, decided_parts)
