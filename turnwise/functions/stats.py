"""Percentile definitions that differ from Spark's own.

The Column forms take a sorted array and suit small groups such as the turns of
one call. ``group_percentiles`` is for groups of any size: values are counted
before the shuffle and ranked as distinct values, never gathered in an array.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sorted_values(value: Column) -> Column:
    """Non-null values of a small group in order."""
    return F.sort_array(F.collect_list(value))


def nearest_index(p: float) -> Callable[[Column], Column]:
    """Round-half-even(p * (n - 1))."""
    return lambda n: F.bround(F.lit(p) * (n - 1)).cast("long")


def floor_index(p: float) -> Callable[[Column], Column]:
    """min(n - 1, floor(p * n))."""
    return lambda n: F.least(n - 1, F.floor(F.lit(p) * n))


def half_index() -> Callable[[Column], Column]:
    """n // 2, the upper median."""
    return lambda n: F.floor(n / 2)


def pick(values: Column, index: Callable[[Column], Column]) -> Column:
    return F.get(values, index(F.size(values)).cast("int"))


def nearest_rank(values: Column, p: float) -> Column:
    return pick(values, nearest_index(p))


def upper_median(values: Column) -> Column:
    return pick(values, half_index())


def floor_rank(values: Column, p: float) -> Column:
    return pick(values, floor_index(p))


def cell_of(value: Column) -> Column:
    """A whole number that never falls where the value grows: a 64th of a doubling each, zero and not-a-number alone."""
    v = value.cast("double")
    size = F.floor(F.log2(F.abs(v)) * 64) + (1 << 17)
    finite = F.when(v == 0, 0).when(v > 0, size).otherwise(-size)
    return F.when(F.isnan(v), 1 << 40).when(F.abs(v) == float("inf"), F.when(v > 0, 1 << 39).otherwise(-(1 << 39))).otherwise(finite).cast("long")


def group_percentiles(df: DataFrame, keys: list[str], value: Column, wanted: Mapping[str, Callable[[Column], Column]]) -> DataFrame:
    """keys and one column per wanted index into the group's sorted non-null values.

    Equal values are counted before the shuffle. The counts of value ranges, a
    bounded number, tell which range holds an index; only the different values of
    that range are ranked, so no task holds a group.
    """
    counts = df.select(*keys, value.alias("_v")).where("_v is not null").groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_cell", cell_of(F.col("_v")))
    group = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    cells = counts.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn"))
    upto = F.coalesce(F.sum("_cn").over(group.orderBy("_cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    placed = cells.withColumns({"_before": upto, "_all": F.sum("_cn").over(group)})
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), index(F.col("_all")).alias("at")) for name, index in wanted.items()]))
    holding = placed.withColumn("_w", each).where((F.col("_w.at") >= F.col("_before")) & (F.col("_w.at") < F.col("_before") + F.col("_cn")))
    named = {k: f"_key_{i}" for i, k in enumerate(keys)}
    holding = holding.select(*[F.col(k).alias(n) for k, n in named.items()], F.col("_cell").alias("_c"), F.col("_w.name").alias("_name"), (F.col("_w.at") - F.col("_before")).alias("_at"))
    same = F.col("_cell") == F.col("_c")
    for k, n in named.items():
        same &= F.col(k).eqNullSafe(F.col(n))
    inside = W.partitionBy(*named.values(), "_c", "_name").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    ranked = counts.join(holding, same).withColumn("_upto", F.sum("_n").over(inside))
    picks = [F.min(F.when((F.col("_name") == name) & (F.col("_upto") > F.col("_at")), F.col("_v"))).alias(name) for name in wanted]
    return ranked.groupBy(*keys).agg(*picks)


def half_even(x: Column, digits: int) -> Column:
    """A double rounded as its exact binary value says: 2.675 is below its half, 0.125 is one and goes to even.

    The factors of the product are split into halves of their bits, so that its
    distance from the half has its exact sign.
    """
    tens = F.lit(10.0**digits)
    x = x.cast("double")
    upper = x * 134217729.0 - (x * 134217729.0 - x)
    low = F.floor(x * tens).cast("double")
    apart = (upper * tens - (low + 0.5)) + (x - upper) * tens
    up = F.when(apart > 0, low + 1).when(apart < 0, low).otherwise(low + F.pmod(low, F.lit(2.0)))
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) >= 1e12), x).otherwise(up / tens)


def safe_rate(part: Column, whole: Column, digits: int = 4) -> Column:
    """part / whole rounded, 0 for an empty whole."""
    return F.when(whole > 0, F.round(part / whole, digits)).otherwise(F.lit(0.0))
