"""Connected components of a graph whose edges stay in Spark.

Each round contracts every partition's edges by a union-find over that
partition alone, then alternates the large-star and small-star steps: all
neighbours of a node are linked to the least of them, the larger ones first,
then the smaller. Rounds end when every edge leads to a root, after a number of
rounds that grows with the logarithm of the longest path. A node of many
neighbours is an aggregate (combined before the shuffle) and a join that adaptive
execution splits; nothing is gathered per node.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import drop_materialized, materialize

BATCH_EDGES = 500_000
WORTH = 0.75  # of the pairs offered have to link for another such round
PICKS = 3  # rounds in which each component verifies its likeliest pair alone


def union(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and the least node of their component, roots left out."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jump = new[new]
            if (jump == new).all():
                break
            new = jump
        if (new == root).all():
            break
        root = new
    loose = root != np.arange(len(nodes))
    return nodes[loose], nodes[root[loose]]


def contracted(edges: DataFrame) -> DataFrame:
    """The same components by at most one edge per node and batch of a partition's edges."""
    schema = pa.schema([("node", pa.int64()), ("root", pa.int64())])

    def flush(parts):
        a = np.concatenate([p.column(0).to_numpy() for p in parts])
        b = np.concatenate([p.column(1).to_numpy() for p in parts])
        node, root = union(a, b)
        return pa.RecordBatch.from_arrays([pa.array(node), pa.array(root)], schema=schema)

    def run(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BATCH_EDGES:
                held = [flush(held)]
                n = 0
                if held[0].num_rows > BATCH_EDGES // 2:
                    yield from held
                    held = []
        if held:
            yield flush(held)

    return edges.select("node", "root").mapInArrow(run, "node long, root long")


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (node > root)."""
    if large:
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.least(F.min("root"), F.col("node")).alias("m"))
        return both.where("root > node").join(least, "node").select(F.col("root").alias("node"), F.col("m").alias("root")).distinct()
    least = edges.groupBy("node").agg(F.min("root").alias("m"))
    moved = edges.join(least, "node").where("root <> m").select(F.col("root").alias("node"), F.col("m").alias("root"))
    return moved.unionByName(least.select("node", F.col("m").alias("root"))).distinct()


def parents(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (a, b) but the roots; root is the least node. Written."""
    pair = edges.select(F.least("a", "b").alias("root"), F.greatest("a", "b").alias("node")).where("root < node")
    now = materialize(contracted(pair), "edges")
    tasks = -(-now.count() // BATCH_EDGES)
    nxt = materialize(contracted(now.coalesce(max(1, tasks))), "edges")
    drop_materialized(now)
    now = nxt
    if tasks <= 1:  # one batch holds them all and is contracted whole
        return now
    for _ in range(rounds):
        # done when no node has two roots and no root is itself a node
        roots = now.groupBy("node").agg(F.count("*").alias("n"))
        chained = now.select("root").distinct().join(roots.select(F.col("node").alias("root")), "root", "left_semi")
        if roots.where("n > 1").isEmpty() and chained.isEmpty():
            return now
        nxt = materialize(contracted(star(star(now, True), False)).distinct(), "edges")
        drop_materialized(now)
        now = nxt
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of an edge (a, b), roots included; root is the least node."""
    now = parents(edges, rounds)
    return now.unionByName(now.select(F.col("root").alias("node"), "root").distinct())


def still_apart(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The pairs (a, b, far) whose ends stand in two components, with these as ra and rb."""
    if labels is None:
        return pairs.select("a", "b", "far", F.col("a").alias("ra"), F.col("b").alias("rb"))
    a, b = (labels.select(F.col("node").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
    named = pairs.join(a, "a", "left").join(b, "b", "left").withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
    return named.where("ra <> rb").select("a", "b", "far", "ra", "rb")


def moved_on(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs (a, b, far, ra, rb) under later labels; two components are looked up once, not once per pair between them."""
    a, b = (labels.select(F.col("node").alias(f"r{x}"), F.col("root").alias(f"n{x}")) for x in "ab")
    two = pairs.select("ra", "rb").distinct().join(a, "ra", "left").join(b, "rb", "left").withColumns({"na": F.coalesce("na", "ra"), "nb": F.coalesce("nb", "rb")})
    return pairs.join(two.where("na <> nb"), ["ra", "rb"]).select("a", "b", "far", F.col("na").alias("ra"), F.col("nb").alias("rb"))


def connected(pairs: DataFrame, verify: Callable[[DataFrame], DataFrame], links: DataFrame | None = None, labels: DataFrame | None = None) -> tuple[DataFrame | None, DataFrame | None]:
    """(links, labels) once every candidate pair (a, b, far) is verified or lies inside a component; labels leave out the roots.

    Pairs that stand between two components of ``labels`` may carry these as ra and rb.

    Each round every component offers the pair out of it that seems the nearest
    (least ``far``, of the nearest ones of each two components), these are verified, and the components are made anew: pairs
    of a group of copies fall inside after a few rounds, a component's worth of
    pairs at a time, without being verified. Once few of those offered link, or
    after ``PICKS`` rounds, all that is left is verified. ``verify`` takes (a, b)
    and gives those that link, written.
    """
    worth = True
    pairs = pairs if "ra" in pairs.columns else still_apart(pairs, labels)
    for step in range(PICKS + 1):
        pairs = materialize(moved_on(pairs, labels) if step else pairs, "apart")
        if pairs.isEmpty():
            drop_materialized(pairs)
            break
        last = step == PICKS or not worth
        if not last:
            nearest = pairs.groupBy(F.least("ra", "rb").alias("ra"), F.greatest("ra", "rb").alias("rb")).agg(F.min(F.struct("far", "a", "b")).alias("pair"))
            each = nearest.select(F.explode(F.array("ra", "rb")).alias("root"), "pair")
            picks = materialize(each.groupBy("root").agg(F.min("pair").alias("pair")).select("pair.a", "pair.b").distinct(), "picks")
        else:
            picks = pairs.select("a", "b")
        found = verify(picks)
        links = found if links is None else links.unionByName(found)
        labels = parents(links)
        if last:
            break
        worth = found.count() >= WORTH * picks.count()
        pairs = pairs.join(picks, ["a", "b"], "left_anti")
    return links, labels
