"""Interval algebra on half-open (start, end) rows per key, and on arrays of them.

The row form works by windows over a key's intervals in order of start; a key is
one call or one user, so a window holds one timeline. The array form
works inside one row. Touching intervals merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def merged(df: DataFrame, *keys: str) -> DataFrame:
    """The union of each key's intervals as disjoint rows (keys, start, end)."""
    order = W.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    marked = df.where(F.col("end") > F.col("start")).select(*keys, "start", "end", F.when(reach >= F.col("start"), 0).otherwise(1).alias("_new"))
    island = F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return marked.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def gaps(union: DataFrame, bounds: DataFrame, *keys: str) -> DataFrame:
    """What disjoint intervals leave of each key's (lo, hi), ends included; a key without intervals is one gap."""
    order = W.partitionBy(*keys).orderBy("start")
    edges = union.select(*keys, "start", "end").unionByName(bounds.select(*keys, F.col("hi").alias("start"), F.col("hi").alias("end")))
    before = F.max("end").over(order.orderBy("start", "end").rowsBetween(W.unboundedPreceding, -1))
    open_ = edges.withColumn("_from", before).join(bounds, list(keys))
    cut = open_.select(*keys, F.greatest(F.coalesce("_from", "lo"), "lo").alias("start"), F.least("start", "hi").alias("end"))
    return cut.where("end > start")


def between(union: DataFrame, *keys: str) -> DataFrame:
    """The gaps between neighbours of disjoint intervals; what lies before the first or after the last is none."""
    order = W.partitionBy(*keys).orderBy("start")
    return union.select(*keys, F.col("end").alias("start"), F.lead("start").over(order).alias("end")).where("end > start")


def swept(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """keys, start, end, in_a, in_b between neighbouring edges of two sets of disjoint intervals.

    One pass over the edges in order of time, with a running count per side, so
    the work grows with the intervals and not with their pairs.
    """

    def edges(rows: DataFrame, side: str) -> DataFrame:
        some = rows.where(F.col("end") > F.col("start"))
        ends = F.array(*[F.struct(F.col(at).alias("t"), F.lit(d if side == "a" else 0).alias("da"), F.lit(d if side == "b" else 0).alias("db")) for at, d in (("start", 1), ("end", -1))])
        return some.select(*keys, F.inline(ends))

    at = edges(a, "a").unionByName(edges(b, "b")).groupBy(*keys, "t").agg(F.sum("da").alias("da"), F.sum("db").alias("db"))
    order = W.partitionBy(*keys).orderBy("t")
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    return at.select(*keys, F.col("t").alias("start"), F.lead("t").over(order).alias("end"), (F.sum("da").over(upto) > 0).alias("in_a"), (F.sum("db").over(upto) > 0).alias("in_b"))


def intersected(a: DataFrame, b: DataFrame, *keys: str) -> DataFrame:
    """Overlaps of two sets of disjoint intervals."""
    return swept(a, b, *keys).where("in_a and in_b").select(*keys, "start", "end")


def subtracted(base: DataFrame, cut: DataFrame, *keys: str) -> DataFrame:
    """base (disjoint) without cut (disjoint)."""
    return swept(base, cut, *keys).where("in_a and not in_b").select(*keys, "start", "end")


def length(df: DataFrame, *keys: str, name: str = "total") -> DataFrame:
    return df.groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def array_merged(intervals: Column) -> Column:
    """The union of an array<struct<start, end>>."""
    kept = F.array_sort(F.filter(intervals, lambda x: x.end > x.start))
    empty = F.filter(kept, lambda x: F.lit(False))

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        joined = F.concat(F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.struct(last.start.alias("start"), F.greatest(last.end, x.end).alias("end"))))
        return F.when((F.size(done) > 0) & (x.start <= last.end), joined).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(kept, empty, add)


def array_total(intervals: Column) -> Column:
    return F.aggregate(intervals, F.lit(0.0), lambda a, x: a + (x.end - x.start))


def array_clipped(intervals: Column, lo: Column, hi: Column) -> Column:
    cut = F.transform(intervals, lambda x: F.struct(F.greatest(x.start, lo).alias("start"), F.least(x.end, hi).alias("end")))
    return F.filter(cut, lambda x: x.end > x.start)


def array_intersected(a: Column, b: Column) -> Column:
    pairs = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x.start, y.start).alias("start"), F.least(x.end, y.end).alias("end")))))
    return F.filter(pairs, lambda x: x.end > x.start)


def array_gaps(union: Column, lo: Column, hi: Column) -> Column:
    """What a merged array leaves of (lo, hi)."""
    starts = F.concat(F.array(lo), F.transform(union, lambda x: x.end))
    ends = F.concat(F.transform(union, lambda x: x.start), F.array(hi))
    pairs = F.zip_with(starts, ends, lambda s, e: F.struct(F.greatest(s, lo).alias("start"), F.least(e, hi).alias("end")))
    return F.filter(pairs, lambda x: x.end > x.start)


def array_subtracted(base: Column, cut: Column) -> Column:
    return F.flatten(F.transform(base, lambda x: array_gaps(array_clipped(cut, x.start, x.end), x.start, x.end)))
