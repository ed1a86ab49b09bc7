"""A board stream writes on change alone, also after a stop."""

import tempfile
import time

from pyspark.sql import functions as F

from turnwise.streaming import boards
from turnwise.streaming.ingest import settled


def test_snapshots_only_on_change(spark):
    source, out, checkpoint = (tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/x" for _ in range(3))

    def add(*rows):
        spark.createDataFrame(list(rows), "kind string, at long").coalesce(1).write.mode("append").parquet(source)

    def snapshots():
        try:
            rows = spark.read.option("basePath", out).parquet(out).collect()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER" in str(error) or "does not exist" in str(error):
                return []
            raise
        return sorted((r.snapshot, r.kind, r.n) for r in rows)

    def start():
        draw = boards.on_change(lambda s: s.read.parquet(source), lambda df: df.groupBy("kind").agg(F.count("*").alias("n")).coalesce(1), out, "at")
        ticks = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
        return ticks.writeStream.foreachBatch(draw).option("checkpointLocation", checkpoint).trigger(processingTime="300 milliseconds").start()

    add(("a", 1), ("b", 2))
    query = start()
    try:
        assert settled(lambda: len(snapshots()) == 2, 60), query.exception()
        first = snapshots()
        batch = query.lastProgress["batchId"]
        assert settled(lambda: query.lastProgress["batchId"] >= batch + 3, 60)
        assert snapshots() == first
        add(("a", 1))
        assert settled(lambda: len(snapshots()) == 4, 60)
    finally:
        query.stop()
    second = snapshots()
    assert [r[1:] for r in second] == [("a", 1), ("b", 1), ("a", 2), ("b", 1)]
    query = start()
    try:
        assert settled(lambda: query.lastProgress is not None and query.lastProgress["batchId"] > second[-1][0] + 2, 60)
        time.sleep(1)
        assert snapshots() == second
    finally:
        query.stop()
    boards.on_change(lambda s: s.read.parquet(source), lambda df: df.groupBy("kind").agg(F.count("*").alias("n")), out, "at")(spark.range(1), second[-1][0])
    assert snapshots() == second
