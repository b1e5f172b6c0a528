"""The trie of conversations' beginnings, and what storing shared beginnings once saves.

A node is a distinct sequence of first turns (role, text); the root is the empty one.  A node is known by a digest of
its parent's digest and its turn, so equal beginnings meet without being compared turn by turn.  Distinct whole
conversations are put in lexicographic order of these digests by one distributed sort; their rank gives every node the
interval of conversations that begin with it, [start, stop).  In order of (start, depth) a node comes right before its
subtree, so its place and the end of its subtree, and with them the subtree's leaves and savings, are differences of
prefix sums over ranks, which are computed in blocks.  Only as much of a conversation goes into its sort key as it
shares with others, and one turn more.

Cases.  Turns are ordered by turn (null first); ties by the digest of role and text.  Null roles and texts are empty.
Rows without a conversation are left out.  Repeated rows are repeated turns.  A conversation of any number of turns is
read one turn after another by one task and never held as a whole but for its sort key.  Ids that end at one node are
hashed in pieces, however many they are.  An empty table has no node.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import store

#: Ranks whose sums are made together, and ids that are joined to one piece of text.
BLOCK, PIECE = 4096, 4096
ROOT = bytes(16)
#: Turns at most that a conversation takes from the first one of its group, and the size of a group.
HEAD, GROUP = 3, 20


def numbered(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, words): each turn's place in its conversation, from 1, its digest and its number of words."""
    own_role, own_text = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(own_role).cast("string"), F.lit(":"), own_role, own_text).cast("binary")))
    words = F.size(F.array_remove(F.split(own_text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), key.alias("key"), words.alias("words")).where("conv_id is not null")
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "key")
    return rows.select("conv_id", F.row_number().over(order).cast("long").alias("pos"), "key", "words")


def with_roots(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """``turns`` and a row at place 0, without a key, for each of the conversations."""
    return turns.unionByName(conversations.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("key"), F.lit(0).cast("long").alias("words")))


def shared_heads(turns: DataFrame, group: int = GROUP, most: int = HEAD) -> DataFrame:
    """Conversations rebuilt with another one's beginning, as with_roots() gives them; places keep order only.

    c begins with the first h turns of the first conversation of its group (c - c % group) instead of its own first h; h is
    the CRC-32 of the id as text, modulo ``most`` + 1.
    """
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    conversations = turns.select("conv_id").distinct()
    first = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") <= most))
    first = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "key", "words"))).alias("head"))
    asked = conversations.select("conv_id", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), h.cast("int").alias("h")).where("h > 0")
    heads = asked.join(first, "base").select("conv_id", F.explode(F.slice("head", F.lit(1), F.col("h"))).alias("x")).select("conv_id", "x.*")
    own = turns.where(F.col("pos") > h).withColumn("pos", F.col("pos") + most)
    return with_roots(own.unionByName(heads), conversations)


def steps(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words, last): the node that each turn of with_roots() leads to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "depth", "node", "parent", "words", "last"]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
        held: list[list] = [[] for _ in names]
        depth, node = 0, ROOT

        def given(last_of_all: bool) -> Iterator[pa.RecordBatch]:
            ready = held if last_of_all else [c[:-1] for c in held]
            if ready[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(ready, kinds, strict=True)], names=names)
            for c in held:
                del c[: len(c) if last_of_all else len(c) - 1]

        for batch in batches:
            for conv, key, words in zip(*(batch.column(k).to_pylist() for k in ("conv_id", "key", "words")), strict=True):
                if key is None:  # the root row of the next conversation
                    if held[5]:
                        held[5][-1] = True
                    depth, node, parent = 0, ROOT, None
                else:
                    depth, node, parent = depth + 1, hashlib.md5(node + key).digest(), node
                for c, v in zip(held, (conv, depth, node, parent, words, False), strict=True):
                    c.append(v)
            yield from given(False)
        if held[5]:
            held[5][-1] = True
        yield from given(True)

    # dealt by a hash of the id, not by the id: the parts of a union that are each dealt by it already count as dealt
    # together, and the shuffle is left out, although adaptive execution may have coalesced each part in its own way
    ordered = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "pos", "key", "words").repartition(F.xxhash64("conv_id")).sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, "conv_id long, depth long, node binary, parent binary, words long, last boolean")


def positions(df: DataFrame, *keys: str) -> tuple[DataFrame, int]:
    """``df`` stored in order of the keys with its row numbers, from 0, as ``at``; and how many rows there are.

    Rows are dealt by ranges of the keys, numbered in each partition, and partitions' sizes are added up.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = store(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    sizes = sorted(held.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before, at = [], 0
    for r in sizes:
        before.append((r.part, at))
        at += r.n
    first = F.broadcast(df.sparkSession.createDataFrame(before, "part long, before long"))
    placed = held.withColumn("part", part).join(first, "part").withColumn("at", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    return placed.drop("part", "before"), at


def prefix_sums(df: DataFrame, at: str, names: list[str], rows: int) -> DataFrame:
    """``df`` (a row for each number ``at`` below ``rows``) with names replaced by sums over all smaller numbers."""
    block = f"__of_{at}"
    smaller = Window.partitionBy(block).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    blocked = df.withColumn(block, F.expr(f"{at} div {BLOCK}"))
    within = blocked.select(*[F.coalesce(F.sum(c).over(smaller), F.lit(0)).alias(c) if c in names else F.col(c) for c in blocked.columns])
    if rows <= BLOCK:
        return within.drop(block)
    totals = blocked.groupBy(block).agg(*[F.sum(c).alias(f"__{c}") for c in names])
    before = prefix_sums(totals, block, [f"__{c}" for c in names], -(-rows // BLOCK))
    return within.join(before, block).select(*[(F.col(c) + F.col(f"__{c}")).alias(c) if c in names else F.col(c) for c in df.columns])


def end_digests(ends: DataFrame, piece: int = PIECE) -> DataFrame:
    """(node, ends_sha256): a digest of the ids of ``ends`` (node, conv_id), ascending and joined by commas.

    Ids are put in order over all tasks and joined to pieces there; a node's digest is fed piece by piece.
    """
    n = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, node, ids = TaskContext.get().partitionId(), 0, None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([part], pa.int64()), pa.array([seq], pa.int64()), pa.array([",".join(map(str, ids))])], names=["node", "part", "seq", "ids"])

        for batch in batches:
            for own, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if ids and (own != node or len(ids) >= piece):
                    yield out()
                    seq, ids = seq + 1, []
                node = own
                ids.append(conv)
        if ids:
            yield out()

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, h = None, None
        for batch in batches:
            nodes, found = [], []
            for own, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                if own != node:
                    if h is not None:
                        nodes.append(node)
                        found.append(h.hexdigest())
                    node, h = own, hashlib.sha256(ids.encode())
                else:
                    h.update(b"," + ids.encode())
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(found)], names=["node", "ends_sha256"])
        if h is not None:
            yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([h.hexdigest()])], names=["node", "ends_sha256"])

    cut = ends.select("node", "conv_id").repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(pieces, "node binary, part long, seq long, ids string")
    return cut.repartition("node").sortWithinPartitions("node", "part", "seq").mapInArrow(digests, "node binary, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """A row for each node of the conversations in ``turns`` (as with_roots() gives them).

    conv_id is the smallest member of a node, place its number in preorder, from 0, and stop that of the first node after its
    subtree; saved_tokens counts words that needn't be stored again in its subtree.
    """
    every = store(steps(turns))
    members = every.groupBy("node").agg(F.min("depth").alias("depth"), F.min("parent").alias("parent"), F.min("words").alias("words"), F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    ends = every.where("last").select("node", "conv_id")
    # one conversation for each distinct one: what it shares with others is its sort key
    chosen = ends.groupBy("node").agg(F.min("conv_id").alias("conv_id")).select("conv_id")
    paths = store(every.join(chosen, "conv_id", "left_semi").select("conv_id", "depth", "node", "parent"))
    shared = paths.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("node").alias("parent"))
    branching = paths.where("depth = 1").unionByName(paths.where("depth > 1").join(shared, "parent", "left_semi"))
    sort_key = branching.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("depth", "node"))), lambda x: F.hex(x["node"])), "").alias("key"))
    # the empty conversation, if there is one, comes first
    keyed = paths.where("depth = 0").select("conv_id").join(sort_key, "conv_id", "left").select("conv_id", F.unhex(F.coalesce("key", F.lit(""))).alias("key"))
    order, n_paths = positions(keyed, "key", "conv_id")
    begin = paths.select("conv_id", "node").join(order.select("conv_id", "at"), "conv_id").groupBy("node").agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("width"))
    children = members.where("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = store(
        members.join(begin, "node").join(children, "node", "left").select("*", F.coalesce("n_children", F.lit(0)).alias("children"), (F.col("start") + F.col("width")).alias("end"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved")).drop("n_children", "width")
    )
    # each rank brings in a chain of nodes: sums over ranks, and along a chain
    own = {"nodes": F.lit(1).cast("long"), "leaves": (F.col("children") == 0).cast("long"), "saved": F.col("saved")}
    chains = nodes.groupBy(F.col("start").alias("rank")).agg(*[F.sum(v).alias(k) for k, v in own.items()])
    after_all = nodes.sparkSession.createDataFrame([(n_paths, 0, 0, 0)], chains.schema)
    upto = store(prefix_sums(chains.unionByName(after_all), "rank", list(own), n_paths + 1))
    above = Window.partitionBy("start").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    placed = nodes.select("*", *[F.coalesce(F.sum(v).over(above), F.lit(0)).alias(f"above_{k}") for k, v in own.items()])
    before = upto.select(F.col("rank").alias("start"), *[F.col(k).alias(f"before_{k}") for k in own])
    until = upto.select(F.col("rank").alias("end"), *[F.col(k).alias(f"until_{k}") for k in own])
    summed = placed.join(before, "start").join(until, "end")
    inside = lambda k: F.col(f"until_{k}") - F.col(f"before_{k}") - F.col(f"above_{k}")
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = summed.join(parents, "parent", "left").join(end_digests(ends), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.col("children").alias("n_children"), inside("leaves").alias("n_leaves"), inside("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        (F.col("before_nodes") + F.col("above_nodes")).alias("place"), F.col("until_nodes").alias("stop"),
    )
