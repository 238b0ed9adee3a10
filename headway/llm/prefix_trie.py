"""The trie of conversations: one node per distinct sequence of first turns.

Turns are cut into blocks of a fixed number, and a block's digest covers all that comes before it. Conversations are
grouped by successive block digests first. Only in blocks where siblings part, or where a conversation ends, are the
turns' own boundaries looked at, and there over the distinct blocks, not over conversations. A block that all
conversations before it share is cut into its nodes as it is.

What a node sums up over its subtree follows from sums over its members: each node belongs to its smallest member,
so that a conversation owns the nodes of its way from some depth to its end.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import written

BLOCK = 4
#: Ids of ends are listed by ranges of so many bits before they are hashed one after the other.
END_BITS = 16


def _root() -> Column:
    """The digest of no turns."""
    return F.lit(b"")


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, place, digest, bytes for every turn of the conversations (conv_id, turn, role, text).

    `place` counts a conversation's turns from 0 in the order of `turn`, null first; equal ones are ordered by role and
    digest. Null roles and texts are empty. Rows without conv_id belong to no conversation and are left out. The texts
    stay where they are: only digests are shuffled.
    """
    role, text = (F.coalesce(name, F.lit("")) for name in ("role", "text"))
    hashed = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"),
        F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return hashed.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "digest", "bytes")


def rebuild(turns: DataFrame, ids: DataFrame, group: int = 5, lent: int = 9) -> DataFrame:
    """Turns of conversations that begin as the first one of their group does.

    Conversation c takes the first h turns of conversation c - c % group, and its own after its first h; h is the
    crc32 of its number as text modulo `lent`. Places keep their order and may leave gaps.
    """
    def borrowed(conv_id: Column) -> Column:
        return F.crc32(conv_id.cast("string").cast("binary")) % lent

    own = turns.where(F.col("place") >= borrowed(F.col("conv_id")))
    first = turns.where(F.col("place") < lent - 1).withColumnRenamed("conv_id", "base")
    takers = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), borrowed(F.col("conv_id")).alias("h"))
    taken = takers.join(first, "base").where("place < h")
    return own.unionByName(taken.select(*turns.columns))


def block_chain(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, block, before, after, turns, sizes, last: a row per block of a conversation's turns.

    `after` is the digest of all turns up to the block's end, `before` that of those ahead of it. A conversation's
    turns pass through one task in order, some at a time.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, number, before, digests, sizes = None, 0, b"", [], []
        for batch in batches:
            rows: list[tuple] = []

            def close(last: bool) -> bytes:
                after = md5(before + b"".join(digests)).digest()
                rows.append((conv, number, before, after, digests, sizes, last))
                return after

            for own, digest, size in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if own != conv:
                    if digests:
                        close(True)
                    conv, number, before, digests, sizes = own, 0, b"", [], []
                elif len(digests) == block:
                    before = close(False)
                    number, digests, sizes = number + 1, [], []
                digests.append(digest)
                sizes.append(size)
            yield _batch(rows)
        if digests:
            after = md5(before + b"".join(digests)).digest()
            yield _batch([(conv, number, before, after, digests, sizes, True)])

    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "digest", "bytes")
    return ordered.mapInArrow(run, _BLOCKS)


_BLOCKS = (
    "conv_id long, block int, before binary, after binary, turns array<binary>, sizes array<long>, last boolean"
)
_ARROW = pa.schema([
    ("conv_id", pa.int64()), ("block", pa.int32()), ("before", pa.binary()), ("after", pa.binary()),
    ("turns", pa.list_(pa.binary())), ("sizes", pa.list_(pa.int64())), ("last", pa.bool_()),
])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(_ARROW)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


def prefix_trie(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie: node, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256.

    turns: (conv_id, place, digest, bytes), places distinct within a conversation. ids: the distinct conv_ids, also of
    conversations without turns, which are members of the root only. `node` and `parent` are digests; the turns that a
    node stands for are the first `depth` ones of its conv_id. `saved_tokens` are the bytes of last texts that the
    node's subtree needs but once. No conversations give no node.
    """
    blocks = written(block_chain(turns, block), "blocks")
    smallest, total = ids.agg(F.min("conv_id"), F.count("*")).first()
    if not total:
        return blocks.sparkSession.createDataFrame([], _NODES)
    members = {"conv_id": F.min, "n_convs": F.sum}
    nodes = _nodes(blocks.withColumn("n_convs", F.lit(1).cast("long")), members, total, block)
    root = ids.sparkSession.range(1).select(
        _root().alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("depth"),
        F.lit(0).cast("long").alias("bytes"), F.lit(smallest).cast("long").alias("conv_id"), F.lit(total).cast("long").alias("n_convs"),
    )
    nodes = written(nodes.unionByName(root), "nodes")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_children"))
    nodes = written(nodes.join(children, "node", "left").fillna(0, ["n_children"]).withColumn(
        "saved", (F.col("n_convs") - 1) * F.col("bytes")
    ), "nodes")

    # What each conversation owns, summed over the members of every node.
    owned = written(nodes.groupBy("conv_id").agg(
        F.sum("saved").alias("owned"), F.max((F.col("n_children") == 0).cast("long")).alias("leaves")
    ), "owned")
    valued = blocks.join(owned, "conv_id", "left").fillna(0, ["owned", "leaves"]).withColumn("n_convs", F.lit(1).cast("long"))
    sums = _nodes(valued, {"n_convs": F.sum, "owned": F.sum, "leaves": F.sum}, total, block).select("node", "owned", "leaves")
    whole = owned.agg(_root().alias("node"), F.sum("owned").alias("owned"), F.sum("leaves").alias("leaves"))

    above = Window.partitionBy("conv_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.withColumn("above", F.coalesce(F.sum("saved").over(above), F.lit(0)))
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    turnless = ids.join(blocks.where("block = 0").select("conv_id"), "conv_id", "left_anti")
    ends = end_hashes(blocks.where("last").select(F.col("after").alias("node"), "conv_id").unionByName(
        turnless.select(_root().alias("node"), "conv_id")
    ))
    return (
        placed.join(sums.unionByName(whole), "node").join(parents, "parent", "left").join(ends, "node", "left")
        .select(
            "node", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"),
            (F.col("owned") - F.col("above")).alias("saved_tokens"),
            F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


_NODES = (
    "node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)


def _nodes(blocks: DataFrame, sums: dict, total: int, block: int) -> DataFrame:
    """node, parent, depth, bytes and the sums for all nodes but the root, from blocks with these columns and n_convs."""
    groups = written(blocks.groupBy("block", "before", "after").agg(
        F.any_value("turns").alias("turns"), F.any_value("sizes").alias("sizes"), *(f(c).alias(c) for c, f in sums.items())
    ), "groups")
    shared = groups.select(F.col("after").alias("before"), F.col("n_convs").alias("before_convs")).unionByName(
        groups.sparkSession.range(1).select(_root().alias("before"), F.lit(total).cast("long").alias("before_convs"))
    )
    cut = groups.join(shared, "before").select(
        "*", (F.col("n_convs") == F.col("before_convs")).alias("whole"),
        F.explode(F.sequence(F.lit(1), F.size("turns"))).alias("k"),
    )

    def digest(k: Column) -> Column:
        own = F.aggregate(F.slice("turns", 1, k), F.col("before"), lambda joined, turn: F.concat(joined, turn))
        return F.unhex(F.md5(own))

    nodes = cut.select(
        F.when(F.col("k") == F.size("turns"), F.col("after")).otherwise(digest(F.col("k"))).alias("node"),
        F.when(F.col("k") == 1, F.col("before")).otherwise(digest(F.col("k") - 1)).alias("parent"),
        (F.col("block").cast("long") * block + F.col("k")).alias("depth"), F.get("sizes", F.col("k") - 1).alias("bytes"),
        *sums, "whole",
    )
    refined = nodes.where("NOT whole").groupBy("node").agg(
        *(F.any_value(c).alias(c) for c in ("parent", "depth", "bytes")), *(f(c).alias(c) for c, f in sums.items())
    )
    return nodes.where("whole").drop("whole").unionByName(refined)


def end_hashes(ends: DataFrame) -> DataFrame:
    """node, ends_sha256 from (node, conv_id): the hash of a node's ids in order, joined by commas.

    A node's ids are listed by ranges side by side; its ranges are then hashed one after the other by one task, which
    holds but one batch of them.
    """
    listed = ends.groupBy("node", F.shiftright("conv_id", END_BITS).alias("range")).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, hashed = None, None
        for batch in batches:
            done: list[tuple] = []
            for own, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if own == node:
                    hashed.update(b"," + ids.encode())
                else:
                    if hashed:
                        done.append((node, hashed.hexdigest()))
                    node, hashed = own, sha256(ids.encode())
            yield pa.RecordBatch.from_arrays(
                [pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["node", "ends_sha256"]
            )
        if hashed:
            yield pa.RecordBatch.from_arrays(
                [pa.array([node], pa.binary()), pa.array([hashed.hexdigest()], pa.string())], ["node", "ends_sha256"]
            )

    ordered = listed.repartition("node").sortWithinPartitions("node", "range").select("node", "ids")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def rebuilt_trie(conversations: DataFrame) -> DataFrame:
    """The trie of the conversations as `rebuild` makes them; every conv_id of the table is one, with turns or without."""
    turns = written(turn_digests(conversations), "turns")
    ids = turns.select("conv_id").distinct()
    return prefix_trie(rebuild(turns, ids), ids)
