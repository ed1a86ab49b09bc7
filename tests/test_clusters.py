"""Density clusters and projections against plain loops: trees, condensed trees, eigenvectors."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.operators import density
from turnwise.plans import clusters


def reach(x, least):
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), density.DIGITS)
    core = np.sort(d, axis=1)[:, least - 1]
    return np.maximum(np.maximum(d, core[:, None]), core[None])


def prim(w):
    left, tree = set(range(1, len(w))), []
    near = {i: (w[0, i], 0) for i in left}
    while left:
        i = min(left, key=lambda j: near[j])
        tree.append((near[i][1], i, near[i][0]))
        left.remove(i)
        for j in left:
            near[j] = min(near[j], (w[i, j], i))
    return tree


def by_hand(tree, least):
    """Clusters by taking the heaviest edge away again and again, over plain sets."""

    def sides(nodes, edges):
        seen, todo = set(), [min(nodes)]
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += [b if a == x else a for a, b, _ in edges if x in (a, b)]
        return seen, nodes - seen

    def grow(nodes, edges, born):
        """(stability, clusters chosen below) of a cluster that starts as these nodes."""
        first, stable, start = set(nodes), 0.0, set(nodes)
        while True:
            if len(nodes) == 1:
                return stable, []
            heavy = max(edges, key=lambda e: (e[2], min(e[:2]), max(e[:2])))
            edges = [e for e in edges if e is not heavy]
            a, b = sides(nodes, edges)
            near = 1 / max(heavy[2], 10.0**-density.DIGITS)
            large = [s for s in (a, b) if len(s) >= least]
            stable += sum((near - born) * len(s) for s in (a, b) if len(s) < least or len(large) == 2)
            if len(large) == 2:
                held, chosen = 0.0, []
                for s in large:
                    own, below = grow(s, [e for e in edges if e[0] in s], near)
                    deeper = sum(x for x, _ in below)
                    if below and own < deeper:
                        held, chosen = held + deeper, chosen + below
                    else:
                        held, chosen = held + own, [*chosen, (own, s)]
                return stable, chosen
            if not large:
                return stable, []
            nodes = large[0]
            edges = [e for e in edges if e[0] in nodes]
            assert nodes < first and start

    _, chosen = grow({x for e in tree for x in e[:2]}, tree, 0.0)
    out = {}
    for k, (_, s) in enumerate(sorted(chosen, key=lambda c: min(c[1]))):
        out.update(dict.fromkeys(s, k))
    return [out.get(i, -1) for i in range(len(tree) + 1)]


def blobs(seed, n=90, d=3):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(c, s, (n // 3, d)) for c, s in ((0, 0.2), (3, 0.4), (6, 0.1))]
    return np.concatenate([*parts, rng.uniform(-2, 8, (12, d))])


@pytest.mark.parametrize("seed", range(3))
def test_condensed_tree(seed):
    x = blobs(seed)
    tree = prim(reach(x, 8))
    a, b, w = map(np.array, zip(*tree))
    got = density.condensed(a, b, w, 8)
    want = by_hand(tree, 8)
    assert [got[i] for i in range(len(x))] == want
    assert len(set(want)) == 4 and all(len(set(want[k * 30 : k * 30 + 30]) - {-1}) == 1 for k in range(3))


def test_trees_are_least_whatever_the_lists_hold(spark, monkeypatch):
    monkeypatch.setattr(density, "LISTED", 3)
    monkeypatch.setattr(density, "BLOCK", 25)
    x = blobs(5, 45)
    rows = [("g", i, v.tolist()) for i, v in enumerate(x)] + [(None, i, [float(i), 0.0]) for i in (1, 2, 3, 5, 8, 13, 21, 34)] + [("small", i, [1.0]) for i in range(2)]
    trees, comps = density.spanning(spark.createDataFrame(rows, "group string, id long, v array<double>").repartition(3), 4)
    got = [(r.group, r.w) for r in trees.collect()]
    assert sorted(w for g, w in got if g == "g") == sorted(w for *_, w in prim(reach(x, 4)))
    assert len([g for g, _ in got if g is None]) == 7 and {(r.group, r.comp) for r in comps.collect()} == {("g", 0), (None, 1)}


def test_search_copies_points_a_fixed_number_of_times(spark, monkeypatch):
    """However many blocks' worth of points a group has, each goes to ``SIDE`` tiles each way, and tiles that find the nearest whatever their ties."""
    monkeypatch.setattr(density, "BLOCK", 5)
    monkeypatch.setattr(density, "SIDE", 3, raising=False)
    monkeypatch.setattr(density, "STEP", 64, raising=False)
    monkeypatch.setattr(density, "EXACT", 7, raising=False)
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(0, 1, (120, 4)), np.repeat(rng.normal(0, 1, (3, 4)), 20, axis=0), rng.normal(0, 1e-6, (20, 4)) + 1e6, rng.choice([-1e200, 1e200], (10, 4))])
    core, comp = np.round(rng.uniform(0, 2, len(x)), 9), rng.integers(0, 40, len(x))
    for rows in (x[:200], x):  # squares of the last ten are beyond all numbers
        df = spark.createDataFrame([("g", i, v.tolist(), float(core[i]), int(comp[i])) for i, v in enumerate(rows)], "group string, id long, v array<double>, core double, comp long").repartition(3)
        asks = df.where("id % 3 = 0")
        copies = density.tiles(asks, df).count()
        assert copies == 3 * (asks.count() + df.count())
        for k in (1, 4):
            got = {}
            for r in density.search(asks, df, k).collect():
                got.setdefault(r.id, []).append((r.w, r.other))
            with np.errstate(over="ignore"):
                for i in range(0, len(rows), 3):
                    w = np.round(np.maximum(np.maximum(np.sqrt(((rows - rows[i]) ** 2).sum(1)), core[i]), core[: len(rows)]), density.DIGITS)
                    want = sorted((float(w[j]), j) for j in range(len(rows)) if comp[j] != comp[i])[:k]
                    assert sorted(got[i]) == want


def test_clusters_with_odd_points(spark):
    x = blobs(1, 60)
    rows = [(1, i, v.tolist()) for i, v in enumerate(x)]
    rows += [(2, i, [0.5, 0.5, 0.5]) for i in range(9)] + [(3, 0, [1.0, 2.0, 3.0])]
    rows += [(1, 1000, [float("nan"), 0.0, 0.0]), (1, 1001, None), (1, 1002, []), (1, None, [0.0, 0.0, 0.0]), (1, 1003, [None, 0.0, 0.0]), (1, 1004, [float("inf"), 0.0, 0.0])]
    got = {(r.group, r.id): r.cluster for r in density.clustered(spark.createDataFrame(rows, "group int, id long, v array<double>").repartition(3)).collect()}
    assert [got[1, i] for i in range(len(x))] == by_hand(prim(reach(x, 8)), 8)
    assert {v for (g, _), v in got.items() if g > 1} == {-1} and len(got) == len(x) + 10
    assert density.clustered(spark.createDataFrame([], "group int, id long, v array<double>")).count() == 0


def test_projection_is_the_singular_value_decomposition(spark):
    x = blobs(2) @ np.diag([3.0, 1.0, 0.2])
    few = [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
    rows = [(1, i, v.tolist()) for i, v in enumerate(x)] + [(2, i, v) for i, v in enumerate(few)] + [(3, i, [float(i)]) for i in range(5)]
    got = {(r.group, r.id): r["at"] for r in density.projected(spark.createDataFrame(rows, "group int, id long, v array<double>").repartition(3), 2).collect()}
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    axes = axes[:2] * np.sign(axes[np.arange(2), np.abs(axes[:2]).argmax(1)])[:, None]
    assert np.allclose([got[1, i] for i in range(len(x))], (x - x.mean(0)) @ axes.T)
    assert [got[2, i] for i in range(2)] == [v[:2] for v in few] and [got[3, i] for i in range(5)] == [[i - 2.0] for i in range(5)]


def test_themes_of_long_vectors_and_small_groups(spark):
    rng = np.random.default_rng(3)
    two = np.concatenate([rng.normal(c, 0.05, (20, 16)) for c in (1, -1)])
    rows = [("a", i, v.tolist()) for i, v in enumerate(two)] + [("b", i, [1.0, float(i)]) for i in range(5)] + [("c", 1, [2.0])]
    got = {(r.group, r.id): (r.cluster, r.x, r.y) for r in clusters.themes(spark.createDataFrame(rows, "group string, id long, v array<double>")).collect()}
    assert len(got) == 46 and [got["a", i][0] for i in range(40)] == [0] * 20 + [1] * 20
    assert {got["b", i][0] for i in range(5)} == {-1} and got["c", 1] == (-1, 2.0, 0.0)


def test_recluster_replaces_one_lever(spark):
    rng = np.random.default_rng(9)
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/assigned"
    vectors = {f"c{i:02}": (rng.normal(0, 0.02, 4) + np.eye(4)[i % 2]).tolist() for i in range(40)}
    day = F.timestamp_seconds(F.col("d") * 86400)
    calls = spark.createDataFrame([(c, "a" if i < 38 else None, 100 if i != 7 else None, 99 if i != 5 else 1) for i, c in enumerate(vectors)] + [("old", "a", 1, 100)], "id string, agent_id string, d long, m long")
    calls = calls.select("id", "agent_id", day.alias("started_at"), F.timestamp_seconds(F.col("m") * 86400).alias("created_at"))
    rows = [(c, f, v) for c, v in vectors.items() for f in ("summary", "root_cause")] + [("old", "summary", [1.0, 0.0, 0.0, 0.0]), ("gone", "summary", [1.0, 0.0, 0.0, 0.0]), ("c00", "summary", vectors["c00"])]
    told = spark.createDataFrame(rows, "call_id string, field string, embedding array<double>")
    now = F.timestamp_seconds(F.lit(101 * 86400))

    def kept(lever):
        return {r.call_id: (r.agent_id, r.cluster_key) for r in spark.read.parquet(path).where(F.col("lever") == lever).collect()}

    for lever in ("summary", "root_cause"):
        clusters.recluster(calls, told, lever, now, path)
    before, other = kept("summary"), kept("root_cause")
    assert set(before) == set(vectors) and before["c39"] == ("", None) and {before[f"c{i:02}"][1] for i in range(0, 38, 2)} != {before[f"c{i:02}"][1] for i in range(1, 38, 2)}
    clusters.recluster(calls.where("id < 'c30'"), told, "summary", now, path)
    assert set(kept("summary")) == {c for c in vectors if c < "c30"} and kept("root_cause") == other
    sizes = [(r.agent_id, r.lever, r["size"], r.exemplars[0]) for r in clusters.cluster_rows(spark.read.parquet(path)).collect()]
    assert sorted(sizes) == [("a", "root_cause", 19, "c00"), ("a", "root_cause", 19, "c01"), ("a", "summary", 15, "c00"), ("a", "summary", 15, "c01")]
