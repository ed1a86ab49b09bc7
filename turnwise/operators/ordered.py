"""Joins by order instead of equality, as windows over one sorted stream per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize


def latest_before(df: DataFrame, keys: list[str], order: list[Column], probe: Column, build: Column, value: Column, name: str, fallback: str | None = None) -> DataFrame:
    """Probe rows with the value of the last build row up to them; ``fallback='last'`` takes the key's last build row where none precedes."""
    own = W.partitionBy(*keys)
    upto = own.orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    picked = F.last(F.when(build, value), ignorenulls=True).over(upto)
    if fallback == "last":
        whole = own.orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        picked = F.coalesce(picked, F.last(F.when(build, value), ignorenulls=True).over(whole))
    return df.withColumn(name, picked).where(probe)


def first_within_next(df: DataFrame, keys: list[str], time: str, tie: str, opens: Column, answers: Column) -> DataFrame:
    """For each opening row, the time of the first answer at or after it and before the next opening.

    A running count of openings puts every answer under the last opening before it.
    """
    order = W.partitionBy(*keys).orderBy(F.col(time), F.when(opens, 0).otherwise(1), F.col(tie)).rowsBetween(W.unboundedPreceding, 0)
    turn = F.sum(F.when(opens, 1).otherwise(0)).over(order)
    found = df.withColumn("_turn", turn).where(F.col("_turn") > 0)
    return found.groupBy(*keys, "_turn").agg(
        F.min(F.when(opens, F.col(tie))).alias("opening"), F.min(F.when(opens, F.col(time))).alias("opened_at"), F.min(F.when(answers, F.col(time))).alias("answered_at")
    )


def islands(df: DataFrame, keys: list[str], time: str, tie: str, gap_s: float) -> DataFrame:
    """Rows with the number of their island: a new one where the step in seconds is over ``gap_s``."""
    order = W.partitionBy(*keys).orderBy(time, tie)
    step = F.unix_micros(F.col(time)) - F.unix_micros(F.lag(time).over(order))
    new = F.when(step.isNull() | (step > int(gap_s * 1e6)), 1).otherwise(0)
    return df.withColumn("_new", new).withColumn("island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)) - 1).drop("_new")


def position(keys: list[str], *order: Column) -> Column:
    """Dense place from 0 in the canonical order."""
    return F.row_number().over(W.partitionBy(*keys).orderBy(*order)) - 1


def ranked(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows with their place from 1 within the keys, however many rows one key has.

    Rows are dealt by ranges of keys and order, so a hot key spreads over tasks;
    places are counted within a range, and the counts of a key's earlier ranges
    are added. Orders sort nulls first; equal rows get places in any order. Keys
    are not null.
    """
    dealt = materialize(rows.repartitionByRange(*keys, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    before = W.partitionBy(*keys).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)  # a row per range of a key
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    counts = counts.select(*keys, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(W.partitionBy(*keys, "_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(counts, [*keys, "_part"]).withColumn(name, F.col("_own") + F.col("_before")).select(*rows.columns, name)
