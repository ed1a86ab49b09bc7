"""Exactly-once assembly: stop, restart, redelivery, replay, quiet and late calls, state that goes."""

import tempfile

import pytest

from turnwise.streaming import ingest

STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIRST = [
    ("t1", None, "b1", 0, 3, False, False, 1),
    ("t1", "call-1", "b2", 0, 2, True, None, 2),
    ("t1", None, "b2", 1, 1, False, True, 3),
    ("t2", None, "b3", 0, 4, True, False, 4),
    ("t3", None, "b4", 0, 9, False, True, 5),
    (None, "call-4", "b5", 0, 1, True, True, 6),
    (None, None, "b6", 0, 1, True, True, 7),
    ("t5", "erased", "b7", 0, 1, True, True, 8),
]
SECOND = [*FIRST, ("t1", None, "b8", 0, 5, False, False, 9), ("t2", "call-2", "b9", None, 0, False, False, 10), ("t2", "call-2", "b9", None, 0, False, False, 10)]


def start(spark, source, out, checkpoint, keep_s):
    erased = spark.createDataFrame([("erased",)], "call_id string")
    stream = spark.readStream.schema(ingest.FRAGMENT).parquet(source)
    writer = ingest.analysed(stream, erased, grace_s=1.0, keep_s=keep_s).writeStream.foreachBatch(ingest.sink(out)).outputMode("update")
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime="200 milliseconds").start()


def found(spark, out):
    try:
        return {(r.trace_id, r.version): (r.call_id, r.why, r.fragments, r.spans) for r in ingest.analyses(spark, out).collect()}
    except Exception as error:
        if "PATH_NOT_FOUND" in str(error) or "FileNotFound" in str(error):
            return {}
        raise


def test_restart_and_redelivery_leave_every_result_once(spark):
    pytest.importorskip("google.protobuf", reason="the state server's protocol")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    source, out, checkpoint = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x" for _ in range(3))
    spark.createDataFrame(FIRST, ingest.FRAGMENT).coalesce(1).write.mode("append").parquet(source)
    query = start(spark, source, out, checkpoint, 3600.0)
    try:
        assert ingest.settled(lambda: ("t2", 1) in found(spark, out) or query.exception() is not None, 120), query.exception()
    finally:
        query.stop()
    want = {("t1", 1): ("call-1", "media", 3, 6), ("t2", 1): ("t2", "quiet", 1, 4), ("call-4", 1): ("call-4", "media", 1, 1)}
    assert found(spark, out) == want
    spark.createDataFrame(SECOND, ingest.FRAGMENT).coalesce(1).write.mode("append").parquet(source)
    query = start(spark, source, out, checkpoint, 3600.0)
    try:
        assert ingest.settled(lambda: {("t1", 2), ("t2", 2)} <= set(found(spark, out)) or query.exception() is not None, 120), query.exception()
    finally:
        query.stop()
    want |= {("t1", 2): ("call-1", "late", 4, 11), ("t2", 2): ("call-2", "late", 2, 4)}
    assert found(spark, out) == want
    # a repeated micro-batch writes its folder anew
    rows = ingest.analyses(spark, out)
    number = rows.first().batch
    same = rows.where(rows.batch == number).drop("batch").toPandas()
    ingest.sink(out)(spark.createDataFrame(same, ingest.RESULT), number)
    assert found(spark, out) == want and ingest.analyses(spark, out).count() == len(want)
    batch = {tuple(r) for r in ingest.assembled(spark.createDataFrame(FIRST + SECOND, ingest.FRAGMENT).repartition(3)).where("call_id <> 'erased'").collect()}
    assert {tuple(r) for r in ingest.latest(ingest.analyses(spark, out)).collect()} == batch


def test_finished_calls_leave_the_state(spark):
    pytest.importorskip("google.protobuf", reason="the state server's protocol")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    source, out, checkpoint = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x" for _ in range(3))
    spark.createDataFrame(FIRST, ingest.FRAGMENT).coalesce(1).write.mode("append").parquet(source)
    query = start(spark, source, out, checkpoint, 4.0)
    held = []

    def empty():
        held.extend(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
        return query.exception() is not None or (held and max(held) > 0 and held[-1] == 0)

    try:
        assert ingest.settled(empty, 120) and query.exception() is None
    finally:
        query.stop()
    assert max(held) > 0 and found(spark, out)["t2", 1][1] == "quiet"
