"""Small helpers that several operators share."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def small_table(spark: SparkSession, rows: Iterable[dict], schema: str) -> DataFrame:
    """A table of driver-made rows (of a bounded number), as a literal in the plan."""
    array = F.from_json(F.lit(json.dumps(list(rows))), f"array<struct<{schema}>>")
    return spark.range(1).select(F.inline(array))


def salt(buckets: int, *cols: Column | str) -> Column:
    """A bucket number; a row's values decide it, so recomputed tasks agree."""
    return F.pmod(F.xxhash64(F.lit(7), *cols), F.lit(buckets)).cast("int")


def buckets_for(rows: int, least: int) -> int:
    """Buckets that hold a million rows each at most, or ``least`` if that is more."""
    return max(least, -(-rows // 1_000_000))


def rank_within(df: DataFrame, key: str, order: list[Column], buckets: int, tie: list[str], name: str = "rank") -> DataFrame:
    """Number the rows of each key from 0 without gathering a key in one task.

    Rows are dealt over ``buckets`` (see ``buckets_for``) per key, counted per (key, bucket), and a
    window inside each bucket adds the sum of the buckets before it. ``df`` has
    to be materialized: two reads of it must give the same rows. The counts have
    at most ``distinct keys x buckets`` rows; callers have a bounded key.
    """
    from pyspark.sql import Window as W

    dealt = df.withColumn("_bucket", salt(buckets, *tie))
    counts = dealt.groupBy(key, "_bucket").agg(F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = W.partitionBy(key, "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_row", F.row_number().over(inside) - 1)
        .join(offsets, [key, "_bucket"])
        .withColumn(name, F.col("_before") + F.col("_row"))
        .drop("_bucket", "_before", "_row")
    )


def numbered(df: DataFrame, key: str, order: list[Column], name: str, keep: list[str]) -> DataFrame:
    """``key``, ``name`` and ``keep`` of each row, ``name`` numbering a key's rows from 1 in ``order``.

    The rows are sorted over ranges of (key, order), so a key with many rows lies
    in several tasks, and each adds the rows of the key in the ranges before its
    own; of these there is one row per key and range. The result is materialized.
    """
    from pyspark.sql import Window as W

    ranges = df.repartitionByRange(key, *order).sortWithinPartitions(key, *order)
    placed = materialize(ranges.select(key, *keep, F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")), "numbered")
    counts = placed.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = W.partitionBy(key).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    row = (F.col("_at") - F.col("_first") + F.col("_before") + 1).alias(name)
    return materialize(placed.join(offsets, [key, "_range"]).select(key, row, *keep), "numbers")


SIFT_WORDS = 1 << 16


def sift(rows: DataFrame, key: str, wanted: DataFrame, inside: bool = True) -> DataFrame:
    """The rows whose key may be among ``wanted`` (one column of that name), and few others; or, not ``inside``, the rest.

    A bitmap of 4 million bits, half a megabyte whatever the input, is broadcast
    so that rows nobody wants stay out of the shuffle of the join that follows.
    With very many keys it fills up and lets more rows pass; none is lost.
    """

    def places(df: DataFrame) -> DataFrame:
        h = F.xxhash64(F.lit(9), key)
        return df.withColumns({"_word": F.shiftrightunsigned(h, 6) % SIFT_WORDS, "_bit": F.call_function("shiftleft", F.lit(1).cast("long"), (h.bitwiseAND(F.lit(63))).cast("int"))})

    bits = places(wanted).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hit = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
    joined = places(rows).join(F.broadcast(bits), "_word", "inner" if inside else "left")
    return joined.where(hit if inside else ~hit).drop("_word", "_bit", "_bits")
