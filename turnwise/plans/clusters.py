"""Themes of calls: density clusters of their embeddings per group, with a picture of each.

Labels of ``embeddings`` stand in for an agent's lever. Where vectors are longer
than ``REDUCED`` parts, clusters are sought among their first principal
coordinates, which stand for a learned reduction; the picture is the first two.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import half_even
from ..operators import density
from ..session import materialize

REDUCED = 10
LEAST_CLUSTER = 8
LEAST_ROWS = 6  # a group with fewer rows has no clusters
CUT, CUT_LEAST = 1.28, 5


def points_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("label").alias("group"), F.col("vec_id").alias("id"), density.unit(F.transform("embedding", lambda x: x.cast("double"))).alias("v"))


def themes(points: DataFrame, least: int = LEAST_CLUSTER) -> DataFrame:
    """group, id, cluster (-1 noise), x, y of points of unit length."""
    known = points.select("group", "id", "v")
    flat = density.projected(known, 2).select(F.col("group").alias("_g"), F.col("id").alias("_i"), F.get("at", F.lit(0)).alias("x"), F.coalesce(F.get("at", F.lit(1)), F.lit(0.0)).alias("y"))
    sizes = known.groupBy(F.col("group").alias("_g")).agg(F.count("*").alias("_n"))
    large = known.join(sizes.where(F.col("_n") >= LEAST_ROWS), F.col("group").eqNullSafe(F.col("_g")), "left_semi")
    short = large.where(F.size("v") <= REDUCED)
    # coordinates of vectors that are short enough would only turn them
    reduced = density.projected(large.where(F.size("v") > REDUCED), REDUCED, fewest=LEAST_ROWS).select("group", "id", F.col("at").alias("v"))
    found = density.clustered(short.unionByName(reduced), least)
    whole = flat.join(found, F.col("group").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_i")), "left")
    return whole.select(F.col("_g").alias("group"), F.col("_i").alias("id"), F.coalesce("cluster", F.lit(-1)).alias("cluster"), "x", "y")


def density_cut(spark: SparkSession, sf_dir: str, cut: float = CUT, least: int = CUT_LEAST) -> DataFrame:
    """Single linkage by mutual reachability, cut at a distance: each vector's component by its least vec_id, -1 where its core is sparser."""
    sound = materialize(density.finite(points_of(spark, sf_dir)), "sound")
    _, comps = density.spanning(sound, least, cut)
    named = comps.select(F.col("group").alias("_g"), F.col("id").alias("_i"), F.when(F.col("core") <= cut, F.col("comp")).alias("comp"))
    rows = sound.join(named, F.col("group").eqNullSafe(F.col("_g")) & (F.col("id") == F.col("_i")), "left")
    return rows.select(F.col("group").alias("label"), F.col("id").alias("vec_id"), F.coalesce("comp", F.lit(-1)).cast("long").alias("cluster"))


def density_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = themes(points_of(spark, sf_dir))
    return found.select(F.col("group").alias("label"), F.col("id").alias("vec_id"), "cluster", *[half_even(F.col(c), 6).alias(c) for c in "xy"])


WINDOW_DAYS = 90


def in_window(calls: DataFrame, now: Column, days: int = WINDOW_DAYS) -> DataFrame:
    """Calls that started, or were made where no start is known, in the days up to now."""
    return calls.where(F.coalesce("started_at", "created_at") >= now - F.make_dt_interval(F.lit(days)))


def recluster(calls: DataFrame, embeddings: DataFrame, lever: str, now: Column, path: str, days: int = WINDOW_DAYS, least: int = LEAST_CLUSTER) -> None:
    """Write call_id, agent_id, cluster_key (null: noise), x, y of a lever's embedded calls in the window, as its folder of ``path``.

    Only the lever's folder is replaced, whatever the run before left there, so a
    run that is repeated changes nothing else. Agents are clustered apart, calls
    of none together; one vector per call counts.
    """
    recent = in_window(calls, now, days).select(F.col("id").alias("call_id"), "agent_id")
    told = embeddings.where(F.col("field") == lever).groupBy("call_id").agg(F.min("embedding").alias("embedding")).join(recent, "call_id")
    points = materialize(told.select(F.coalesce("agent_id", F.lit("")).alias("group"), F.xxhash64("call_id").alias("id"), "call_id", density.unit("embedding").alias("v")), "points")
    found = themes(points, least).withColumnsRenamed({"group": "_g", "id": "_i"})
    rows = points.join(found, (F.col("group") == F.col("_g")) & (F.col("id") == F.col("_i")))
    rows = rows.select("call_id", F.col("group").alias("agent_id"), F.when(F.col("cluster") >= 0, F.col("cluster")).alias("cluster_key"), "x", "y", F.lit(lever).alias("lever"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("lever").parquet(path)


def cluster_rows(assigned: DataFrame) -> DataFrame:
    """agent_id, lever, cluster_key, size, exemplars (the five least call_ids), largest first."""
    some = assigned.where("cluster_key is not null")
    # five per hash part first, so that a cluster of any size leaves few rows for the second step
    part = F.pmod(F.xxhash64("call_id"), F.lit(64))
    firsts = some.groupBy("agent_id", "lever", "cluster_key", part.alias("_p")).agg(F.count("*").alias("_n"), F.slice(F.array_sort(F.collect_set("call_id")), 1, 5).alias("_e"))
    whole = firsts.groupBy("agent_id", "lever", "cluster_key").agg(F.sum("_n").alias("size"), F.slice(F.array_sort(F.flatten(F.collect_list("_e"))), 1, 5).alias("exemplars"))
    return whole.orderBy(F.desc("size"), "agent_id", "lever", "cluster_key")


QUERIES = {"density_cut": density_cut, "density_clusters": density_clusters}

ORACLE_SQL = {
    "density_cut": f"""with recursive v as (select label, vec_id, cast(embedding as double[]) as e from embeddings),
u as (select label, vec_id, [x / case when list_inner_product(e, e) = 0 then 1 else sqrt(list_inner_product(e, e)) end for x in e] as e from v),
d as (select a.label, a.vec_id as a, b.vec_id as b, round(list_distance(a.e, b.e), 9) as d from u a join u b on a.label = b.label and a.vec_id <> b.vec_id),
c as (select label, a, list_sort(list(d))[{CUT_LEAST - 1}] as core from d group by 1, 2),
l as (select d.label, d.a, d.b from d join c x on d.label = x.label and d.a = x.a join c y on d.label = y.label and d.b = y.a where greatest(d, x.core, y.core) <= {CUT}),
r as (select label, a, a as b from c union select r.label, r.a, l.b from r join l on r.label = l.label and r.b = l.a),
m as (select label, a, min(b) as cluster from r group by 1, 2)
select v.label, v.vec_id, coalesce(case when core <= {CUT} then cluster end, -1) as cluster from v left join c on v.label = c.label and v.vec_id = c.a left join m on m.label = c.label and m.a = c.a"""
}
