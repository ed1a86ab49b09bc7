"""Queries that once read a part of their tables read all of them."""

import numpy as np
from pyspark.sql import functions as F

from turnwise.plans import calls, talk, timeline


def test_knn_asks_for_every_hundredth(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(talk, "KNN_ROWS", 64)
    monkeypatch.setattr(talk, "KNN_QUERIES", 1)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 8))
    label = np.arange(900) // 300
    rows = [(i, int(label[i]), x[i].tolist()) for i in range(900)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {}
    for q in range(0, 900, 100):
        near = sorted((-round(float(u[q] @ u[i]), 6), i) for i in range(900) if i != q and label[i] == label[q])[:5]
        want |= {(q, n): i for n, (_, i) in enumerate(near, 1)}
    assert {(r.query_id, r["rank"]): r.vec_id for r in talk.knn(spark, str(tmp_path)).collect()} == want


def test_live_merge_has_every_order(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet")
    last = orders.agg(F.max("o_orderkey")).first()[0]
    keys = sorted(r.o_orderkey for r in calls.live_merge(spark, sf).collect())
    assert keys == sorted([r.o_orderkey for r in orders.select("o_orderkey").collect()] + list(range(last + 1, last + 11)))


def test_tree_has_every_event(spark, sf):
    got = {r.event_id: (r.depth, r.path) for r in timeline.tree_depth(spark, sf).collect()}
    ids = {r.event_id for r in spark.read.parquet(f"{sf}/events.parquet").select("event_id").collect()}
    assert set(got) == ids
    for i in ids:
        chain = [i]
        while chain[0] // 4 in ids - {0}:
            chain.insert(0, chain[0] // 4)
        assert got[i] == (len(chain) - 1, "/".join(f"{x:019d}" for x in chain))


def test_transcript_lines_are_whole(spark, tmp_path):
    long = "word " * 30 + "end"
    rows = [(1, 0, "system", "s"), (1, 1, "user", long), (1, 2, "assistant", long + "!"), (1, 3, "user", " ")]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = [(r.line, r.said) for r in talk.transcript_lines(spark, str(tmp_path)).orderBy("line").collect()]
    assert got == [(0, "caller: " + long), (1, "agent: " + long + "!")]


def test_scatter_keeps_clusters_of_3000(spark, tmp_path):
    rows = spark.range(3000 + 3001).select(F.col("id").alias("vec_id"), (F.col("id") >= 3000).cast("int").alias("label"), F.array(F.lit(0.5)).alias("embedding"))
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    kept = {r.label: r["count"] for r in talk.scatter(spark, str(tmp_path)).groupBy("label").count().collect()}
    assert kept == {0: 3000, 1: 1501}
    few = talk.scatter(spark, str(tmp_path), 1000).where("label = 0").select("vec_id").collect()
    assert sorted(r.vec_id for r in few) == list(range(0, 3000, 4))
