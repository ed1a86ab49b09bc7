"""Conversation prefix trie, built and rolled up level by level.

Conversations that open alike share the nodes of their common turns. Building
goes down: at each depth the live conversations, those that share their node
with another, are grouped by (parent node, next turn), and the least conv_id of
a group names its node. A conversation alone in its node is live no longer: what
is left of it is a chain that needs no grouping. Rolling up goes back: level by
level, each node joins the sums of its children. So there are as many rounds as
turns that two conversations share, whatever the longest one has.

A turn is compared by the SHA-256 of its role and text, so no text is shuffled
after the turns are numbered. Turns are numbered, and the conversations that
end in a node listed, over ranges, so no conversation or node has to fit in a
task; only the SHA-256 of a node's list runs in one, over a row per 4,096 ids.

Defined cases: a null conv_id has no conversation, its rows take no part; null
role or text is empty; a null turn comes first; ties on turn go by role, then
text, and repeated rows stay as turns of their own; other columns are not read;
a conversation without a turn left is a member of the root; an empty table has
no root and gives no rows. ``%`` has the sign of its left side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize
from .tables import numbered

EMPTY = hashlib.sha256(b"").hexdigest()
LIST = 4096  # conv_ids in a row of a node's list


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, bytes of every turn, in order."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    said = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long"),
        F.col("turn").alias("_turn"),
        role.alias("_role"),
        text.alias("_text"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("bytes"),
    )
    return numbered(said, "conv_id", [F.col("_turn").asc_nulls_first(), F.col("_role"), F.col("_text")], "pos", ["digest", "bytes"])


def borrowed(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first of its five."""
    return F.crc32(conv_id.cast("string").cast("binary")) % 9


def rebuilt(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All conversations with their lengths, and their turns after each took its first ones from conversation c - c % 5."""
    ids = materialize(own.select("conv_id").distinct(), "conversations")
    c = F.col("_c")
    takers = own.where("pos <= 8").withColumn("_c", F.explode(F.expr("transform(sequence(-4, 4), x -> try_add(conv_id, cast(x as bigint)))")))
    heads = (
        takers.where((c - c % 5 == F.col("conv_id")) & (F.col("pos") <= borrowed(c)))
        .select(c.alias("conv_id"), "pos", "digest", "bytes")
        .join(ids, "conv_id", "left_semi")
    )
    taken = heads.groupBy("conv_id").agg(F.count("*").alias("_taken"))
    tails = own.where(F.col("pos") > borrowed(F.col("conv_id"))).join(taken, "conv_id", "left")
    tails = tails.withColumn("pos", F.col("pos") - borrowed(F.col("conv_id")) + F.coalesce("_taken", F.lit(0))).drop("_taken")
    # in order of depth, so that a level reads the files of its depth alone
    turns = materialize(heads.unionByName(tails).repartitionByRange("pos", "conv_id").sortWithinPartitions("pos", "conv_id"), "turns")
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("len"))
    return ids.join(lengths, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0)).cast("long").alias("len")), turns


def levels(convs: DataFrame, turns: DataFrame) -> tuple[list[DataFrame], int]:
    """Per depth, from 0, the conversations that were live above it: conv_id, len, node, parent, n_convs, bytes; and how many there are."""
    first, n = convs.agg(F.min("conv_id"), F.count("*")).first()
    if not n:
        return [], 0
    null = F.lit(None).cast("long")
    root = [F.lit(first).cast("long").alias("node"), null.alias("parent"), F.lit(n).cast("long").alias("n_convs"), F.lit(0).cast("long").alias("bytes")]
    out, live = [convs.select("conv_id", "len", *root)], convs.select("conv_id", "len", F.lit(first).cast("long").alias("node"))
    while True:
        depth = len(out)
        at = turns.where(F.col("pos") == depth).select("conv_id", "digest", "bytes")
        step = materialize(live.where(F.col("len") >= depth).withColumnRenamed("node", "parent").join(at, "conv_id"), f"step-{depth}")
        nodes = step.groupBy("parent", "digest").agg(F.min("conv_id").alias("node"), F.count("*").alias("n_convs"))
        level = materialize(step.join(nodes, ["parent", "digest"]).select("conv_id", "len", "node", "parent", "n_convs", "bytes"), f"level-{depth}")
        drop_materialized(step)
        out.append(level)
        live = level.where("n_convs > 1").select("conv_id", "len", "node")
        if live.where(F.col("len") > depth).isEmpty():
            return out, n


def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's list; its parts come in order, whatever batches they are in."""
    now, digest = None, None

    def row() -> pa.RecordBatch:
        return pa.record_batch([pa.array([now[0]], pa.int64()), pa.array([now[1]], pa.int64()), pa.array([digest.hexdigest()])], ["depth", "node", "ends_sha256"])

    for batch in batches:
        for depth, node, part in zip(*(batch.column(c).to_pylist() for c in ("depth", "node", "part"))):
            if (depth, node) != now:
                if now:
                    yield row()
                now, digest = (depth, node), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(part.encode())
    if now:
        yield row()


def ends(levels: list[DataFrame]) -> DataFrame:
    """depth, node, ends_sha256 of nodes with several members, of which some end there."""
    each = None
    for depth, level in enumerate(levels):
        here = level.where(F.col("len") == depth).where("n_convs > 1 or parent is null").select(F.lit(depth).cast("long").alias("depth"), "node", "conv_id")
        each = here if each is None else each.unionByName(here)
    order = ["depth", "node", "conv_id"]
    placed = each.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_part", F.floor(F.monotonically_increasing_id() / LIST))
    ids = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    parts = placed.groupBy("depth", "node", "_part").agg(F.min("conv_id").alias("_first"), ids.alias("part"))
    sorted_parts = parts.repartition("depth", "node").sortWithinPartitions("depth", "node", "_first").select("depth", "node", "part")
    return sorted_parts.mapInArrow(listed, "depth long, node long, ends_sha256 string")


def rolled_up(levels: list[DataFrame]) -> list[DataFrame]:
    """Per depth, nodes with several members (and the root): node, parent, n_convs, n_children, n_leaves, saved_tokens."""
    out: list[DataFrame] = []
    below = None  # parent, n_leaves, saved of the nodes one level down
    for depth in reversed(range(len(levels))):
        nodes = levels[depth].where("conv_id = node").select("node", "parent", "n_convs", "bytes")
        many = nodes.where("n_convs > 1 or parent is null")
        own = (F.col("n_convs") - 1) * F.col("bytes")
        if below is None:
            stats = many.select("node", "parent", "n_convs", F.lit(0).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), own.alias("saved_tokens"))
        else:
            sums = below.groupBy("parent").agg(F.count("*").alias("n_children"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved"))
            stats = many.join(sums.withColumnRenamed("parent", "_of"), F.col("node") == F.col("_of"), "left").select(
                "node",
                "parent",
                "n_convs",
                F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.coalesce("_leaves", F.lit(1)).alias("n_leaves"),
                (own + F.coalesce("_saved", F.lit(0))).alias("saved_tokens"),
            )
        stats = materialize(stats, f"stats-{depth}")
        out.insert(0, stats)
        alone = nodes.where("n_convs = 1 and parent is not null").select("parent", F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"))
        below = stats.select("parent", "n_leaves", "saved_tokens").unionByName(alone)
    return out


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations."""
    convs, turns = rebuilt(turns_of(conversations))
    convs = materialize(convs, "lengths")
    built, n = levels(convs, turns)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if not n:
        return convs.select(*[F.lit(None).cast("string" if c == "ends_sha256" else "long").alias(c) for c in columns]).limit(0)
    long = lambda v: F.lit(v).cast("long")
    shared = alone = None
    for depth, (level, stats) in enumerate(zip(built, rolled_up(built))):
        here = stats.withColumn("depth", long(depth))
        shared = here if shared is None else shared.unionByName(here)
        if depth:
            # a conversation alone in its node, and the chain of what follows
            chain = level.where("n_convs = 1").withColumn("depth", F.explode(F.sequence(long(depth), "len")))
            chain = chain.withColumn("parent", F.when(F.col("depth") == depth, F.col("parent")).otherwise(F.col("conv_id")))
            alone = chain if alone is None else alone.unionByName(chain)
    digests = ends(built).withColumnsRenamed({"depth": "_depth", "node": "_node"})
    shared = shared.join(digests, (F.col("depth") == F.col("_depth")) & (F.col("node") == F.col("_node")), "left").select(
        F.col("node").alias("conv_id"),
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"),
    )
    last = F.col("depth") == F.col("len")
    alone = alone.select(
        "conv_id",
        "depth",
        F.col("parent").alias("parent_conv_id"),
        "n_convs",
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        long(1).alias("n_leaves"),
        long(0).alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(EMPTY).alias("ends_sha256"),
    )
    return shared.unionByName(alone)


def op12(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return trie(conversations)
