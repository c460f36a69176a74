"""Prefix trie of conversations, built as burst tries.

A turn becomes a code of ``UNIT`` bytes: the MD5 of its role and text and the
UTF-8 length of the text, so a conversation is one byte string, its path, and
two paths share a trie node where they share a prefix of whole codes. Texts do
not move after that. Equal paths are one row with their count, least
conversation and the digest of the conversations that end there.

Paths start as suffixes in one container under the root. Containers are counted
in rounds; one with more than ``LIMIT`` different suffixes bursts: its suffixes
move to containers under new heads, one per next turn. What the suffixes of a
container share beyond its head (the common prefix of its least and greatest
path) is passed in the same round, so a long shared beginning costs one round,
not one a turn. A hot head is counted by partial sums and joined in salted
parts. The containers that remain are shards: one shuffle by head, sorted, and
swept with a stack into nodes, in a stream whose memory is the depth of a path
and the children of the open nodes. Sums of the burst heads come from the tops
of the containers and the heads below them, each sent to the heads above it.

Null roles and texts are empty. Turns come by ``turn``, null first, ties by
their code, so repeated rows are turns of their own and order does not depend
on the input's. Rows without conv_id take no part. A conversation may have no
turn and then ends at the root. An empty table gives no node, not even a root.
Other columns are not looked at. Two different turns of equal MD5 and length
would be taken for one. The codes of one conversation (24 bytes a turn) are one
value of one row.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from annolytics.llm.digests import joined_sha256
from annolytics.llm.shared import keep, own_rows

# Bytes of a turn's code: MD5 of role and text, then the text's length in 8 bytes.
UNIT = 24
# Different suffixes that a container may hold before it bursts.
LIMIT = 256
# Parts in which the suffixes of a bursting container meet its head.
SALTS = 32
NO_ENDS = hashlib.sha256().hexdigest()

_NODE = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string")


def turn_code(role: Column, text: Column) -> Column:
    """48 hex digits of a turn."""
    role, text = F.coalesce(role.cast("string"), F.lit("")), F.coalesce(text.cast("string"), F.lit(""))
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.md5(named), F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0"))


def paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, path) of every conversation."""
    turns = own_rows(conversations, "conv_id", "turn", "role", "text").where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
                 turn_code(F.col("role"), F.col("text")).alias("code")).alias("t"))
    ordered = F.transform(F.array_sort(F.collect_list("t")), lambda t: t["code"])
    return turns.groupBy("conv_id").agg(F.unhex(F.array_join(ordered, "")).alias("path"))


def _turns(path: str, first: str, count: str | None = None) -> Column:
    """Codes from place ``first`` (0-based), ``count`` of them or all that follow."""
    length = f", {UNIT} * ({count})" if count is not None else ""
    return F.expr(f"substring({path}, {UNIT} * ({first}) + 1{length})")


def with_heads_of(rows: DataFrame, donor: Column, turns: Column) -> DataFrame:
    """Paths whose first ``turns`` turns are those of the conversation ``donor``, then their own after as many."""
    own = rows.withColumn("_h", turns.cast("int")).withColumn("_donor", donor)
    donors = rows.select(F.col("conv_id").alias("_donor"), F.col("path").alias("_given"))
    return own.join(donors, "_donor", "left").select("conv_id", F.concat(
        F.coalesce(_turns("_given", "0", "_h"), F.unhex(F.lit(""))), _turns("path", "_h")).alias("path"))


def _head(depth: str = "depth") -> Column:
    return F.md5(_turns("path", "0", depth))


def _common(low: bytes, high: bytes) -> int:
    """Number of leading codes that both paths share."""
    last = min(len(low), len(high)) // UNIT
    at = 0
    while at < last and low[UNIT * at:UNIT * (at + 1)] == high[UNIT * at:UNIT * (at + 1)]:
        at += 1
    return at


def distinct_paths(rows: DataFrame) -> DataFrame:
    """(path, least, n, sha256): different paths with their conversations' least id, number and digest."""
    # Ids are joined in blocks first, so a group of many copies is few rows when it meets.
    ids = F.sort_array(F.collect_list("conv_id"))
    blocks = rows.groupBy("path", F.shiftright("conv_id", 12).alias("block")).agg(ids.alias("ids"))
    pieces = blocks.select("path", "block", F.array_join(F.col("ids").cast("array<string>"), ",").alias("piece"),
                           F.col("ids")[0].alias("least"), F.size("ids").cast("long").alias("n"))
    return joined_sha256(pieces, "path", ["block"], "piece", ",", first=["least"], total="n")


def _burst(active: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame] | None:
    """One round over suffixes: (those that stay, those that end at a burst head, those under new heads, heads)."""
    named = active.withColumn("head", _head())
    big = keep(named.groupBy("head").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > limit).select("head"), "big")
    if big.isEmpty():
        return None
    salted = big.select("head", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"), F.lit(True).alias("bursts"))
    named = named.withColumn("salt", F.pmod(F.xxhash64("path"), F.lit(SALTS)).cast("int"))
    split = keep(named.join(salted, ["head", "salt"], "left"), "split")
    bursting = split.where("bursts")

    def common(batches):
        for batch in batches:
            low, high = batch.column("low").to_pylist(), batch.column("high").to_pylist()
            shared = [_common(a, b) for a, b in zip(low, high, strict=True)]
            yield pa.record_batch(
                [batch.column("head"), batch.column("depth"), pa.array(shared, pa.int32()), batch.column("above"),
                 pa.array([a[:UNIT * m] for a, m in zip(low, shared, strict=True)], pa.binary())],
                ["head", "depth", "bottom", "above", "path"])

    spans = bursting.groupBy("head").agg(
        F.min("path").alias("low"), F.max("path").alias("high"), F.first("depth").alias("depth"), F.first("above").alias("above"))
    heads = keep(spans.mapInArrow(common, "head string, depth int, bottom int, above array<int>, path binary"), "heads")
    bottoms = heads.select("head", "bottom", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    moved = bursting.join(bottoms, ["head", "salt"]).withColumn("above", F.concat("above", F.array("bottom")))
    moved = keep(moved.withColumn("ends", F.octet_length("path") == UNIT * F.col("bottom")).withColumn(
        "depth", F.col("bottom") + 1).select(*active.columns, "ends"), "moved")
    return split.where("bursts is null").select(*active.columns), moved.where("ends").drop("ends"), \
        moved.where("not ends").drop("ends"), heads


class _Sweep:
    """The open nodes from a container's head down to the last path, and the rows made so far."""

    def __init__(self):
        self.stack, self.rows, self.head = [], [], None

    def _close(self):
        depth, size, n, least, children, leaves, saved, sha, waiting = self.stack.pop()
        leaves, saved = leaves or 1, saved + (n - 1) * size
        for row in waiting:
            row[2] = least
            self.rows.append(row)
        row = [least, depth, None, n, children, leaves, saved, sha, None, None]
        if self.stack:
            up = self.stack[-1]
            up[2] += n
            up[3] = least if up[3] is None else min(up[3], least)
            up[4] += 1
            up[5] += leaves
            up[6] += saved
            up[8].append(row)
        else:
            row[8:] = self.top, self.above
            self.rows.append(row)

    def _open(self, path: bytes, depth: int):
        size = int.from_bytes(path[UNIT * depth - 8:UNIT * depth]) if depth else 0
        self.stack.append([depth, size, 0, None, 0, 0, 0, NO_ENDS, []])

    def close_container(self):
        while self.stack:
            self._close()

    def add(self, head, depth, path, n, least, sha, above):
        if head != self.head:
            self.close_container()
            self.head, self.top, self.above = head, path[:UNIT * depth], above
            self._open(path, depth)
            shared = depth
        else:
            shared = _common(self.last, path)
            while self.stack[-1][0] > shared:
                self._close()
        for place in range(shared + 1, len(path) // UNIT + 1):
            self._open(path, place)
        node, self.last = self.stack[-1], path
        node[2] += n
        node[3] = least if node[3] is None else min(node[3], least)
        node[7] = sha


def _swept(containers: DataFrame) -> DataFrame:
    """Nodes of all containers; a container's own head has its path in ``top`` and no parent yet."""
    shape = f"{_NODE}, top binary, above array<int>"
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top", "above"]
    kinds = [*[pa.int64()] * 7, pa.string(), pa.binary(), pa.list_(pa.int32())]

    def sweep(batches):
        state = _Sweep()

        def flush():
            columns = zip(*state.rows, strict=True)
            batch = pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
            state.rows = []
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                state.add(*row)
            if len(state.rows) >= 10_000:
                yield flush()
        state.close_container()
        if state.rows:
            yield flush()

    shards = containers.withColumn("head", _head()).select("head", "depth", "path", "n", "least", "sha256", "above")
    return shards.repartition("head").sortWithinPartitions("head", "path").mapInArrow(sweep, shape)


def build(rows: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Every node of the trie of ``rows`` (conv_id, path): conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    active = keep(distinct_paths(rows).select(
        "path", "n", "least", "sha256", F.lit(0).alias("depth"), F.array().cast("array<int>").alias("above")), "paths")
    containers, ended, heads = [], [], []
    while (round_ := _burst(active, limit)) is not None:
        stay, ends, active, head = round_
        containers.append(stay), ended.append(ends), heads.append(head)
    containers.append(active)
    nodes = keep(_swept(_all(containers)), "nodes")
    inner = nodes.where("top is null")
    tops = nodes.where("top is not null").withColumnRenamed("top", "path")
    if not heads:
        return nodes.drop("top", "above")
    return _with_heads(inner, tops, _all(ended), _all(heads))


def _all(frames: list[DataFrame]) -> DataFrame:
    whole = frames[0]
    for frame in frames[1:]:
        whole = whole.unionByName(frame)
    return whole


def _with_heads(inner: DataFrame, tops: DataFrame, ended: DataFrame, heads: DataFrame) -> DataFrame:
    """The swept nodes with their parents, and the nodes of the burst heads.

    A head stands for the chain of nodes from ``depth`` to ``bottom``, which all
    have the same conversations. ``above`` lists the bottoms of all heads over a row.
    """
    below = tops.select("path", "above", F.col("n_convs").alias("n"), F.col("conv_id").alias("least"),
                        F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"))
    here = ended.select("path", "above", "n", "least", F.lit(0).cast("long").alias("leaves"), F.lit(0).cast("long").alias("saved"))
    sums = below.unionByName(here).select("*", F.explode("above").alias("b")).groupBy(_head("b").alias("key")).agg(
        F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    sizes = F.expr(
        f"transform(sequence(depth, bottom), j -> if(j = 0, 0L, cast(conv(hex(substring(path, {UNIT} * j - 7, 8)), 16, 10) as long)))")
    chains = heads.withColumn("key", _head("bottom")).withColumn("up", F.when(F.col("depth") > 0, _head("depth - 1")))
    chains = keep(chains.withColumn("sizes", sizes).join(sums, "key").withColumn(
        "own", F.expr("transform(sizes, s -> s * (n - 1))")).drop("sizes"), "chains")
    own = F.expr("aggregate(own, 0L, (a, x) -> a + x)")
    added = chains.select("path", own.alias("own"), F.explode(F.concat("above", F.array("bottom"))).alias("b")).groupBy(
        _head("b").alias("key")).agg(F.sum("own").alias("added"))
    children = tops.where("depth > 0").select(_head("depth - 1").alias("key")).unionByName(
        chains.where("up is not null").select(F.col("up").alias("key"))).groupBy("key").agg(F.count(F.lit(1)).alias("children"))
    ends = ended.select(F.md5("path").alias("key"), F.col("sha256").alias("ends"))
    parents = chains.select(F.col("key").alias("up"), F.col("least").alias("parent"))
    full = chains.join(added, "key").join(children, "key", "left").join(ends, "key", "left").join(parents, "up", "left")
    links = full.select("*", F.posexplode(F.sequence("depth", "bottom")).alias("place", "level"))
    last = F.col("level") == F.col("bottom")
    before = F.expr("aggregate(slice(own, 1, place), 0L, (a, x) -> a + x)")
    chain_nodes = links.select(
        F.col("least").alias("conv_id"), F.col("level").cast("long").alias("depth"),
        F.when(F.col("place") > 0, F.col("least")).otherwise(F.col("parent")).alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"),
        F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("added") - before).alias("saved_tokens"),
        F.when(last, F.coalesce("ends", F.lit(NO_ENDS))).otherwise(NO_ENDS).alias("ends_sha256"))
    under = tops.withColumn("up", _head("depth - 1")).join(parents, "up", "left").withColumn("parent_conv_id", F.col("parent"))
    return inner.select(*chain_nodes.columns).unionByName(under.select(*chain_nodes.columns)).unionByName(chain_nodes)
