"""A board that is drawn anew only when what it shows has changed.

A stream of ticks, or of the facts themselves, drives it. Each micro-batch takes
a cheap fingerprint of the facts; if it is that of the last snapshot nothing is
written. The fingerprint is kept with the snapshot, in a folder that the
micro-batch's number names, so a stream that starts again goes on from the last
snapshot, and a repeated micro-batch writes its own folder anew.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fingerprint(facts: DataFrame, *times: str) -> str:
    """Rows and the latest of each time: one row of counters, whatever the facts."""
    return "|".join(map(str, facts.agg(F.count("*"), *[F.max(t) for t in times]).first()))


def last_shown(spark: SparkSession, path: str, before: int) -> str | None:
    """The fingerprint of the last snapshot that an earlier micro-batch left."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(conf).exists(folder):
        return None
    marks = spark.read.option("basePath", path).parquet(path).where(F.col("snapshot") < before)
    last = marks.select("snapshot", "fingerprint").distinct().agg(F.max_by("fingerprint", "snapshot")).first()
    return last[0]


def on_change(facts: Callable[[SparkSession], DataFrame], board: Callable[[DataFrame], DataFrame], path: str, *times: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that leaves a board of the facts where they changed since the last one."""

    def draw(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        now = facts(spark)
        mark = fingerprint(now, *times)
        if mark != last_shown(spark, path, number):
            board(now).withColumn("fingerprint", F.lit(mark)).write.mode("overwrite").parquet(f"{path}/snapshot={number}")

    return draw
