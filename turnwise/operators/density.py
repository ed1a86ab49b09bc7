"""Density clusters per group: mutual reachability, minimum spanning trees, condensed trees; and projections.

The core distance of a point is that to its ``least``-th neighbour, itself
included; two points are as far apart as the greatest of their distance and
their core distances. Borůvka rounds build each group's minimum spanning tree:
every component takes its lightest edge out, and components that edges join
become one, so rounds grow with the logarithm of a group's points. Edges come
from lists of nearest neighbours, found in blocks. A list that ends inside its
component tells only that what is outside is no nearer than its last entry; the
points whose lists leave the lightest edge open are searched again against all
points outside, so the tree is exact whatever the lists hold.

Distances are compared in tiles, blocks of askers against blocks of points. A
group has ``SIDE`` blocks of each at most, so a point is copied so many times and
what is shuffled grows as the points do, until blocks hold ``MOST`` rows: from
there on there are more of them, so memory stays bounded. The work within tiles
grows with the square of a group. A matrix product bounds the distances of a
tile; those that may be among the nearest are then taken exactly. The condensed
tree of a group is cut in one task, from one edge (three numbers) per point.

Points are (group, id, v: array<double>). Defined cases: points with a null id,
a null or empty vector or a null or non-finite part take no part; ids are unique
in a group; a null group is a group; points at one place are at distance zero;
equal edges go by their ids; groups below the least size are noise; vectors of
one group have one length. Distances are rounded to ``DIGITS``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize

BLOCK = 250  # rows of a block where a group has fewer than ``SIDE`` of them
SIDE = 4  # blocks of a group, each way
MOST = 50_000  # rows of a block
STEP = 1 << 21  # distances bounded at once
EXACT = 1 << 16  # differences of vectors taken at once
LISTED = 15  # neighbours in a list at least
DIGITS = 9
PARTS = 64  # partial sums of a group's moments


def finite(points: DataFrame) -> DataFrame:
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return points.where(F.col("id").isNotNull() & (F.size("v") > 0) & ~F.coalesce(bad, F.lit(True)))


def unit(v: Column) -> Column:
    """A vector of length one; zero stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / F.when(norm == 0, 1.0).otherwise(norm))


def blocks(rows: Column) -> Column:
    return F.greatest(F.least(F.ceil(rows / BLOCK), F.lit(SIDE)), F.ceil(rows / MOST)).cast("int")


def tiles(asks: DataFrame, points: DataFrame) -> DataFrame:
    """The rows of each tile (group, rb, qb): a block of points and one of those that ask."""
    salt = F.xxhash64(F.lit(7), "id")
    sizes = points.groupBy("group").agg(blocks(F.count("*")).alias("nr"))
    sizes = sizes.join(asks.groupBy(F.col("group").alias("_g")).agg(blocks(F.count("*")).alias("nq")), F.col("group").eqNullSafe(F.col("_g")))
    sizes = sizes.select(F.col("group").alias("_g"), "nr", "nq")
    columns = ["group", "id", "v", "core", "comp", "rb", "qb"]
    own = F.col("group").eqNullSafe(F.col("_g"))
    each = points.join(sizes, own).withColumns({"rb": F.pmod(salt, "nr").cast("int"), "qb": F.explode(F.sequence(F.lit(0), F.col("nq") - 1))})
    asked = asks.join(sizes, own).withColumns({"qb": F.pmod(salt, "nq").cast("int"), "rb": F.explode(F.sequence(F.lit(0), F.col("nr") - 1))})
    return asked.select(*columns, F.lit(True).alias("asks")).unionByName(each.select(*columns, F.lit(False).alias("asks")))


def nearest(q: np.ndarray, q_core: np.ndarray, q_comp: np.ndarray, x: np.ndarray, core: np.ndarray, comp: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of q, row of x, w): the k nearest of another component of each row of q, by mutual reachability, then by id."""
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    with np.errstate(over="ignore", invalid="ignore"):
        q2, x2, core2 = (q**2).sum(1), (x**2).sum(1), core**2
        # a product of d terms is off by its rounding, at most
        off = 1e-15 * (q.shape[1] + 8) * (q2.max() + x2.max())
    step = max(1, STEP // len(x))
    for at in range(0, len(q), step):
        part = slice(at, at + step)
        other = q_comp[part, None] != comp
        if np.isfinite(off):
            far = q[part] @ x.T
            far *= -2
            far += x2
            far += q2[part, None]
            np.maximum(far, core2, out=far)
            np.maximum(far, q_core[part, None] ** 2, out=far)
            far[~other] = np.inf
            last = np.partition(far, k - 1, axis=1)[:, k - 1] if k < len(x) else np.full(len(far), np.inf)
            # what rounds to the k-th distance may be it as well
            room = (np.sqrt(np.maximum(last, 0) + off) + 2 * 10.0**-DIGITS) ** 2 + off
            row, col = np.nonzero((far <= room[:, None]) & other)
        else:  # beyond what squares can hold
            row, col = np.nonzero(other)
        row += at
        d = np.zeros(len(row))
        with np.errstate(over="ignore"):
            for i in range(0, len(row), EXACT):
                # differences and not products: equal points have distance zero, and both directions one distance
                d[i : i + EXACT] = np.sqrt(((x[col[i : i + EXACT]] - q[row[i : i + EXACT]]) ** 2).sum(1))
        w = np.round(np.maximum(np.maximum(d, q_core[row]), core[col]), DIGITS)
        order = np.lexsort((ids[col], w, row))
        row, col, w = row[order], col[order], w[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        found.append((row[place < k], col[place < k], w[place < k]))
    return tuple(np.concatenate(f) for f in zip(*found, strict=True))


def search(asks: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """group, id, other, w of the k points of another component that each asking point is nearest to by mutual reachability.

    Both have group, id, v, core and comp.
    """

    def best(tile: pd.DataFrame) -> pd.DataFrame:
        q, e = tile[tile["asks"]], tile[~tile["asks"]]
        columns = ["group", "id", "other", "w"]
        if not len(q) or not len(e):
            return pd.DataFrame([], columns=columns)
        vectors = [np.array(part["v"].tolist(), np.float64) for part in (q, e)]
        ids = e["id"].to_numpy()
        row, col, w = nearest(vectors[0], q["core"].to_numpy(), q["comp"].to_numpy(), vectors[1], e["core"].to_numpy(), e["comp"].to_numpy(), ids, k)
        return pd.DataFrame(zip([e["group"].iloc[0]] * len(row), q["id"].to_numpy()[row], ids[col], w, strict=True), columns=columns)

    kind = asks.schema["group"].dataType.simpleString()
    found = tiles(asks, points).groupBy("group", "rb", "qb").applyInPandas(best, f"group {kind}, id long, other long, w double")
    ordered = F.slice(F.sort_array(F.collect_list(F.struct("w", "other"))), 1, k)
    return found.groupBy("group", "id").agg(ordered.alias("_n")).select("group", "id", F.inline("_n")).select("group", "id", "other", "w")


def with_cores(points: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Points with core, and with bound (what is not in their list is no nearer); and the lists as edges (group, a, b, w), both ways.

    Points of groups smaller than ``least`` go.
    """
    k = max(least - 1, LISTED)
    counts = points.groupBy("group").agg(F.count("*").alias("_n")).withColumnRenamed("group", "_g")
    large = materialize(points.join(counts.where(F.col("_n") >= least), F.col("group").eqNullSafe(F.col("_g"))).drop("_g"), "points")
    lists = materialize(search(*[large.withColumns({"core": F.lit(0.0), "comp": F.col("id")})] * 2, k), "lists")
    last = lists.groupBy(F.col("group").alias("_g"), F.col("id").alias("_i")).agg(F.sort_array(F.collect_list("w")).alias("_w"))
    core = F.lit(0.0) if least < 2 else F.get("_w", F.lit(least - 2))
    bound = F.when(F.size("_w") < F.col("_n") - 1, F.greatest(core, F.element_at("_w", -1))).otherwise(float("inf"))
    cored = large.join(last, F.col("group").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_i")), "left")
    cored = materialize(cored.select("group", "id", "v", F.coalesce(core, F.lit(0.0)).alias("core"), F.coalesce(bound, F.lit(float("inf"))).alias("bound")), "cores")
    of = cored.select(F.col("group").alias("_g"), F.col("id").alias("_i"), F.col("core").alias("_c"))
    one = lists.join(of, F.col("group").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_i"))).select("group", "id", "other", F.greatest("w", "_c").alias("w"))
    two = one.join(of, F.col("group").eqNullSafe(F.col("_g")) & (F.col("other") == F.col("_i"))).select("group", "id", "other", F.greatest("w", "_c").alias("w"))
    return cored, materialize(both_ways(two.withColumnsRenamed({"id": "a", "other": "b"})), "edges")


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("group", F.col("b").alias("a"), F.col("a").alias("b"), "w")).distinct()


def placed(rows: DataFrame, comps: DataFrame, on: str, name: str) -> DataFrame:
    """rows with the component of their point ``on``."""
    named = comps.select(F.col("group").alias("_g"), F.col("id").alias("_i"), F.col("comp").alias(name))
    return rows.join(named, F.col("group").eqNullSafe(F.col("_g")) & (F.col(on) == F.col("_i"))).drop("_g", "_i")


def spanning(points: DataFrame, least: int, most: float = float("inf")) -> tuple[DataFrame, DataFrame]:
    """Trees (group, a, b, w) and components (group, id, core, comp: the least id) over edges of ``most`` at most."""
    cored, edges = with_cores(points, least)
    edges = edges.where(F.col("w") <= most)
    comps = cored.select("group", "id", "core", "bound", F.col("id").alias("comp"))
    taken: list[DataFrame] = []
    while True:
        comps = materialize(comps, "comps")
        out = placed(placed(edges, comps, "a", "ca"), comps, "b", "cb").where("ca <> cb")
        least_out = F.min(F.struct("w", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "cb")).alias("e")
        lightest = materialize(out.groupBy("group", "ca").agg(least_out).select(F.col("group").alias("_g"), F.col("ca").alias("_c"), "e"), "lightest")
        mine = F.col("group").eqNullSafe(F.col("_g")) & (F.col("comp") == F.col("_c"))
        open_ = comps.join(lightest, mine, "left").where((F.col("bound") < F.coalesce(F.col("e.w"), F.lit(float("inf")))) & (F.col("bound") <= most)).select("group", "id")
        open_ = materialize(open_, "open")
        if not open_.isEmpty():
            # search these anew outside their components; what they find holds for good, as components only grow
            whole = materialize(placed(cored.drop("bound"), comps, "id", "comp"), "whole")
            asking = whole.join(open_.withColumnsRenamed({"group": "_g", "id": "_i"}), F.col("group").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_i")), "left_semi")
            found = materialize(search(asking, whole, 1), "found")
            nearer = found.where(F.col("w") <= most).select("group", F.col("id").alias("a"), F.col("other").alias("b"), "w")
            edges = materialize(edges.unionByName(both_ways(nearer)).distinct(), "edges")
            # nothing outside is nearer than what was found; a point without anything outside is done
            far = found.select(F.col("group").alias("_g"), F.col("id").alias("_i"), F.col("w").alias("_w"))
            raised = comps.join(open_.withColumnsRenamed({"group": "_og", "id": "_oi"}).withColumn("_o", F.lit(True)), F.col("group").eqNullSafe(F.col("_og")) & (F.col("id") == F.col("_oi")), "left")
            raised = raised.join(far, F.col("group").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_i")), "left")
            bound = F.when(F.col("_o"), F.coalesce("_w", F.lit(float("inf")))).otherwise(F.col("bound"))
            comps = raised.select("group", "id", "core", bound.alias("bound"), "comp")
            continue
        chosen = lightest.where(F.col("e.w") <= most)
        if chosen.isEmpty():
            trees = edges.where("false")
            for t in taken:
                trees = trees.unionByName(t)
            return trees, comps.select("group", "id", "core", "comp")
        taken.append(materialize(chosen.select(F.col("_g").alias("group"), F.col("e.lo").alias("a"), F.col("e.hi").alias("b"), F.col("e.w").alias("w")).distinct(), "taken"))
        heads = joined(chosen.select(F.col("_g").alias("group"), F.col("_c").alias("c"), F.col("e.cb").alias("to")))
        named = heads.select(F.col("group").alias("_g"), F.col("c").alias("_c"), F.col("to").alias("_to"))
        comps = comps.join(named, F.col("group").eqNullSafe(F.col("_g")) & (F.col("comp") == F.col("_c")), "left")
        comps = comps.select("group", "id", "core", "bound", F.coalesce("_to", "comp").alias("comp"))


def joined(links: DataFrame) -> DataFrame:
    """group, c, to: the least of the components that links (group, c, to: one a component) join.

    Each component points to another; two that point to one another close every
    tree. The lesser of the two becomes its head, and pointers are doubled. A
    component that is pointed to and has no link of its own is a head as well.
    """
    pointed = links.select("group", F.col("to").alias("c")).distinct()
    known = links.select(F.col("group").alias("_g"), F.col("c").alias("_c"), F.col("to").alias("_t"))
    own = F.col("group").eqNullSafe(F.col("_g"))
    back = links.join(known, own & (F.col("to") == F.col("_c")), "left")
    head = F.coalesce((F.col("_t") == F.col("c")) & (F.col("c") < F.col("to")), F.lit(False))
    tree = back.select("group", "c", F.when(head, F.col("c")).otherwise(F.col("to")).alias("to"))
    tree = tree.unionByName(pointed.join(known, own & (F.col("c") == F.col("_c")), "left_anti").select("group", "c", F.col("c").alias("to")))
    while True:
        tree = materialize(tree, "pointers")
        up = tree.select(F.col("group").alias("_g"), F.col("c").alias("_c"), F.col("to").alias("_t"))
        doubled = materialize(tree.join(up, own & (F.col("to") == F.col("_c"))).select("group", "c", "to", F.col("_t").alias("next")), "doubled")
        if doubled.where("to <> next").isEmpty():
            break
        tree = doubled.select("group", "c", F.col("next").alias("to"))
    names = doubled.groupBy("group", "to").agg(F.min("c").alias("name")).select(F.col("group").alias("_g"), F.col("to").alias("_t"), "name")
    return materialize(doubled.join(names, own & (F.col("to") == F.col("_t"))).select("group", "c", F.col("name").alias("to")), "heads")


def condensed(a: np.ndarray, b: np.ndarray, w: np.ndarray, least: int) -> dict[int, int]:
    """Cluster of each point (-1 noise) from a tree's edges: the condensed tree's most stable clusters, never its root.

    Going down from the root, a branch below ``least`` points falls off its
    cluster, two larger branches end it and are clusters of their own. A cluster's
    stability sums, over its points, how much closer (1 / distance) they got
    before they left it; it is taken where it beats what its children hold.
    Clusters are numbered by their least points.
    """
    ids, n = np.unique(np.concatenate([a, b])), len(a) + 1
    order = np.lexsort((np.maximum(a, b), np.minimum(a, b), w))
    left, right = np.searchsorted(ids, a[order]), np.searchsorted(ids, b[order])
    closeness = 1 / np.maximum(w[order], 10.0**-DIGITS)
    parent, size = np.arange(2 * n - 1), np.ones(2 * n - 1, np.int64)
    children = np.zeros((2 * n - 1, 2), np.int64)

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for k in range(n - 1):
        p, q = find(int(left[k])), find(int(right[k]))
        node = n + k
        parent[p] = parent[q] = node
        children[node], size[node] = (p, q), size[p] + size[q]
    born, stable, below = [0.0], [0.0], [[]]  # per cluster, the root first
    leaves = np.full(n, 0)  # the last cluster of each point
    todo = [(2 * n - 2, 0)]

    def drop(node: int, cluster: int) -> None:
        stack = [node]
        while stack:
            x = stack.pop()
            if x < n:
                leaves[x] = cluster
            else:
                stack += children[x].tolist()

    while todo:
        node, cluster = todo.pop()
        if node < n:
            leaves[node] = cluster
            continue
        near = closeness[node - n]
        large = [c for c in children[node].tolist() if size[c] >= least]
        small = [c for c in children[node].tolist() if size[c] < least]
        for c in small:
            stable[cluster] += (near - born[cluster]) * size[c]
            drop(c, cluster)
        if len(large) == 1:
            todo.append((large[0], cluster))
        for c in large if len(large) == 2 else ():
            stable[cluster] += (near - born[cluster]) * size[c]
            born.append(near)
            stable.append(0.0)
            below.append([])
            below[cluster].append(len(born) - 1)
            todo.append((c, len(born) - 1))
    chosen = np.zeros(len(born), bool)
    for c in range(len(born) - 1, 0, -1):  # children have higher numbers
        held = sum(stable[x] for x in below[c])
        if not below[c] or stable[c] >= held:
            chosen[c] = True
        else:
            stable[c] = held
    within = np.full(len(born), -1)
    for c in range(len(born)):
        for x in below[c]:
            within[x] = within[c] if within[c] >= 0 else x if chosen[x] else -1
    own = within[leaves]
    names = {c: i for i, c in enumerate(sorted(set(own.tolist()) - {-1}, key=lambda c: ids[own == c][0]))}
    return {int(i): names.get(int(c), -1) for i, c in zip(ids, own, strict=True)}


def clustered(points: DataFrame, least: int = 8) -> DataFrame:
    """group, id, cluster of every point; -1 is noise."""
    sound = materialize(finite(points).select("group", "id", "v"), "sound")
    trees, _ = spanning(sound, max(2, least))
    kind = points.schema["group"].dataType.simpleString()

    def cut(edges: pd.DataFrame) -> pd.DataFrame:
        own = condensed(edges["a"].to_numpy(), edges["b"].to_numpy(), edges["w"].to_numpy(), max(2, least))
        return pd.DataFrame({"group": [edges["group"].iloc[0]] * len(own), "id": list(own), "cluster": list(own.values())})

    labels = trees.groupBy("group").applyInPandas(cut, f"group {kind}, id long, cluster int")
    named = labels.select(F.col("group").alias("_g"), F.col("id").alias("_i"), "cluster")
    every = sound.select("group", "id").join(named, F.col("group").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_i")), "left")
    return every.select("group", "id", F.coalesce("cluster", F.lit(-1)).alias("cluster"))


def projected(points: DataFrame, dims: int, fewest: int = 4) -> DataFrame:
    """group, id, at: the first ``dims`` principal coordinates, fewer if vectors are shorter; below ``fewest`` points the first parts as they are.

    Sums, second moments and counts are added up in parts of a group, their
    matrices in one task: the eigenvectors are of the vectors' length. A
    direction's sign makes its largest part positive.
    """
    sound = materialize(finite(points).select("group", "id", "v"), "sound")
    kind = points.schema["group"].dataType.simpleString()

    def moments(part: pd.DataFrame) -> pd.DataFrame:
        x = np.array(part["v"].tolist(), np.float64)
        return pd.DataFrame({"group": [part["group"].iloc[0]], "n": [len(x)], "s": [x.sum(0)], "m": [(x.T @ x).ravel()]})

    def directions(parts: pd.DataFrame) -> pd.DataFrame:
        n, s = parts["n"].sum(), np.sum(parts["s"].tolist(), 0)
        d = len(s)
        if n < fewest:
            rows, mean = np.eye(d)[:dims], np.zeros(d)
        else:
            mean = s / n
            _, vectors = np.linalg.eigh(np.sum(parts["m"].tolist(), 0).reshape(d, d) / n - np.outer(mean, mean))
            rows = vectors[:, ::-1].T[:dims]
            rows = rows * np.sign(rows[np.arange(len(rows)), np.abs(rows).argmax(1)])[:, None]
        return pd.DataFrame({"_g": [parts["group"].iloc[0]], "mean": [mean], "axes": [[r.tolist() for r in rows]]})

    salt = F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(PARTS)).alias("_p")
    partial = sound.groupBy("group", salt).applyInPandas(moments, f"group {kind}, n long, s array<double>, m array<double>")
    axes = partial.groupBy("group").applyInPandas(directions, f"_g {kind}, mean array<double>, axes array<array<double>>")
    dot = F.expr("transform(axes, r -> aggregate(zip_with(r, zip_with(v, mean, (x, y) -> x - y), (x, y) -> x * y), 0D, (s, x) -> s + x))")
    return sound.join(axes, F.col("group").eqNullSafe(F.col("_g"))).select("group", "id", dot.alias("at"))

