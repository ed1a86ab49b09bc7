"""Streams driven by files, to completion."""

import tempfile
import time

import pytest
from pyspark.sql import functions as F

from turnwise.streaming import assemble


def fragments(spark, rows):
    df = spark.createDataFrame(rows, "call_id string, batch_id string, seq int, span_id string, is_root boolean, is_media boolean")
    return df.withColumn("received_at", F.lit("2024-01-01 00:00:00").cast("timestamp"))


def drive(spark, stream, mode, name):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    return spark.table(name).collect()


def test_duplicates_are_dropped(spark):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/f"
    rows = [("c1", "b1", 0, "s1", True, False), ("c1", "b1", 0, "s1", True, False), ("c1", "b2", 0, "s2", False, False)]
    fragments(spark, rows).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(assemble.FRAGMENT).parquet(path)
    assert sorted(r.span_id for r in drive(spark, assemble.once(stream), "append", "once_out")) == ["s1", "s2"]


def test_ready_by_media(spark):
    pytest.importorskip("google.protobuf", reason="the state server's protocol")
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/f"
    rows = [("c1", "b1", 0, "s1", True, False), ("c1", "b2", 0, "s2", False, True), ("c2", "b3", 0, "s3", False, True), ("c3", "b4", 0, "s4", True, True)]
    fragments(spark, rows).coalesce(1).write.parquet(path)
    stream = spark.readStream.schema(assemble.FRAGMENT).parquet(path)
    erased = spark.createDataFrame([("c3",)], "call_id string")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    q = assemble.ready_calls(stream, erased).writeStream.format("memory").queryName("ready_out").outputMode("update")
    q = q.option("checkpointLocation", tempfile.mkdtemp(prefix="spark-", dir="/tmp")).start()
    try:  # timers keep such a stream going, so wait for its row and not for its end
        end = time.time() + 90
        while not (out := spark.table("ready_out").collect()) and time.time() < end and q.exception() is None:
            time.sleep(1)
    finally:
        q.stop()
    assert [(r.call_id, r.why, r.spans) for r in out] == [("c1", "media", 2)]


def test_board(spark, sf):
    path = tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/e"
    batch = spark.read.parquet(sf + "/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    batch.coalesce(1).write.parquet(path)
    facts = spark.readStream.schema(batch.schema).parquet(path)
    got = {r.bucket: (r.calls, r.failures) for r in drive(spark, assemble.board_stream(facts), "append", "board_out")}
    want = {r.w.start: (r.n, r.f) for r in batch.groupBy(F.window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("f")).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 2


def test_settled_objects(spark):
    rows = [("a", "u1", "2024-01-01 00:00:00"), ("a", "u2", "2024-01-01 01:00:00"), ("b", "u3", "2024-01-01 00:30:00"), ("c", "u4", "2024-01-01 02:00:00")]
    df = spark.createDataFrame(rows, "call_id string, uri string, modified string").withColumn("modified", F.col("modified").cast("timestamp"))
    first = assemble.changed_objects(df, None, "2024-01-01 01:30:00").collect()
    assert [(r.call_id, r.uris) for r in first] == [("b", ["u3"]), ("a", ["u1", "u2"])]
    assert [r.call_id for r in assemble.changed_objects(df, "2024-01-01 00:30:00", "2024-01-01 01:30:00").collect()] == ["a"]
