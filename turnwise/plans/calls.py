"""Call lists, rollups, security and history on orders and lines: an order is a call, its lines are turns.

``l_quantity`` stands in for a turn's latency, ``l_returnflag = 'R'`` for an
interrupted turn, ``l_linestatus = 'F'`` for an opening one, the customer's
nation for the agent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import floor_index, group_percentiles, nearest_rank, sorted_values, upper_median
from .pricing import priced, price_rows
from .security import Scope, secured, secured_through

VISIBLE = (3, 7, 11)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer")


def list_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 50 failed or pending calls whose customer or priority matches a needle, by any case."""
    rows = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "P")).join(customers(spark, sf_dir), F.col("o_custkey") == F.col("c_custkey"))
    found = rows.where(F.col("c_name").ilike("%1%") | F.col("o_orderpriority").ilike("%urg%"))
    return found.orderBy(F.col("o_orderdate").desc_nulls_last(), F.col("o_orderkey").desc()).limit(50).select("o_orderkey", "c_name", "o_orderstatus", F.round("o_totalprice", 2).alias("total"))


def turn_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns, barge-ins and upper median latency of uninterrupted turns per call."""
    cut = F.col("l_returnflag") == "R"
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("turns"), F.count_if(cut).alias("barge_ins"), sorted_values(F.when(~cut, F.col("l_quantity"))).alias("v")
    )
    return found.select("l_orderkey", "turns", "barge_ins", upper_median(F.col("v")).alias("median_ms"))


def tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Floor-rank tiles over the calls' medians: half, nineteen in twenty, barge-in rate, calls without latency."""
    calls = turn_stats(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    found = calls.groupBy("o_orderstatus").agg(F.sum("barge_ins").alias("b"), F.sum("turns").alias("t"), F.count_if(F.col("median_ms").isNull()).alias("silent"))
    ranks = group_percentiles(calls, ["o_orderstatus"], F.col("median_ms"), {"p50": floor_index(0.5), "p95": floor_index(0.95)})
    return found.join(ranks, "o_orderstatus", "left").select("o_orderstatus", "p50", "p95", F.round(F.col("b") / F.col("t"), 4).alias("barge_in_rate"), "silent")


SERIES = {"response_ms": "l_quantity", "cost": "l_extendedprice", "discount": "l_discount"}


def tall_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nearest-rank p90 of each series per call, one row per metric, with availability and reason."""
    measured = F.col("l_linestatus") != "F"
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[sorted_values(F.when(measured, F.col(c))).alias(m) for m, c in SERIES.items()])
    wide = rows.select("l_orderkey", *[nearest_rank(F.col(m), 0.9).alias(m) for m in SERIES])
    tall = wide.unpivot("l_orderkey", list(SERIES), "name", "value")
    return tall.select(
        "l_orderkey", "name", F.round("value", 1).alias("value"), F.col("value").isNotNull().alias("available"), F.when(F.col("value").isNull(), "timing_missing").alias("reason")
    )


def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost sums per day from priced usage: lines' models are their part's, tokens their quantity."""
    usage = table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.element_at(F.array(*[F.lit(x) for x in ("model-a", "model-b", "model-x")]), (F.col("l_partkey") % 3 + 1).cast("int")).alias("llm_model"),
        F.when(F.col("l_suppkey") % 2 == 0, "voice-a").alias("tts_model"),
        F.lit("ear-a").alias("stt_model"),
        (F.col("l_quantity") * 1000).alias("tokens_in"),
        (F.col("l_quantity") * 100).alias("tokens_out"),
        F.when(F.col("l_linenumber") == 1, F.col("l_quantity") * 400).alias("tokens_cached"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity") * 10).alias("tts_chars"),
        F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).alias("stt_seconds"),
    )
    found = priced(usage, price_rows(spark)).groupBy("llm_model").agg(*[F.sum(c).alias(c) for c in ("cost_llm", "cost_stt", "cost_tts", "cost_total")], F.count("cost_llm").alias("priced_turns"))
    return found.select("llm_model", *[F.round(c, 4).alias(c) for c in ("cost_llm", "cost_stt", "cost_tts", "cost_total")], "priced_turns")


def shard_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices per call key: the call id if there is one, else the trace id, else none."""
    e = table(spark, sf_dir, "events")
    call = F.when(F.col("event_type") == "purchase", "").otherwise(F.concat(F.lit("call-"), F.col("user_id").cast("string")))
    trace = F.when(F.col("event_id") % 7 != 0, F.concat(F.lit("trace-"), (F.col("event_id") % 50).cast("string")))
    key = F.coalesce(F.nullif(call, F.lit("")), trace, F.lit(""))
    return e.groupBy(key.alias("shard_key")).agg(F.count("*").alias("spans"), F.min("event_id").alias("first_span"))


def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Redelivered spans: the last copy by (batch, seq) stays."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    copies = e.withColumn("batch", F.lit(0)).unionByName(e.where(F.col("event_id") % 3 == 0).select("event_id", (F.col("value") + 1).alias("value"), F.lit(1).alias("batch")))
    copies = copies.unionByName(e.where(F.col("event_id") % 5 == 0).select("event_id", (F.col("value") + 2).alias("value"), F.lit(2).alias("batch")))
    return copies.groupBy("event_id").agg(F.max_by("value", "batch").alias("value"))


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's latest order and its reasons, kept only if it ended partial."""
    last = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_orderpriority"), F.struct("o_orderdate", "o_orderkey")).alias("r"))
    return last.select("o_custkey", "r.o_orderkey", F.when(F.col("r.o_orderstatus") == "P", F.split("r.o_orderpriority", "-")[1]).alias("reason"))


def active_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Version in force at each order: urgent orders of a customer are new script versions."""
    own = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(W.unboundedPreceding, 0)
    new = F.when(F.col("o_orderpriority").startswith("1"), 1).otherwise(0)
    rows = table(spark, sf_dir, "orders").withColumn("version", F.sum(new).over(own))
    return rows.select("o_orderkey", F.when(F.col("version") > 0, F.col("version")).alias("version"))


def changed_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Versions written only when the content changes: a new one where the digest differs from the last."""
    own = W.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    sha = F.sha2("o_orderstatus", 256)
    rows = table(spark, sf_dir, "orders").withColumn("sha", sha).withColumn("was", F.lag("sha").over(own)).where("was is null or was <> sha")
    return rows.select("o_custkey", "o_orderkey", F.row_number().over(own).alias("version"), "sha")


def with_agent(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir).select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("agent_id"))
    return table(spark, sf_dir, "orders").join(c, "o_custkey")


def row_secured(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = secured(with_agent(spark, sf_dir), Scope.of(VISIBLE), "agent_id", "o_orderkey")
    return calls.groupBy("agent_id").agg(F.count("*").alias("calls"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def row_secured_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = secured(with_agent(spark, sf_dir), Scope.of(VISIBLE), "agent_id", "o_orderkey").select(F.col("o_orderkey").alias("l_orderkey"))
    return secured_through(table(spark, sf_dir, "lineitem"), calls, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("turns"))


def fail_closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No scope and an empty one see nothing; no grants at all means every agent."""
    calls = with_agent(spark, sf_dir)
    cases = {"unset": Scope(None), "empty": Scope.of(()), "grants": Scope.granted(()), "bound": Scope.of(VISIBLE, call_id=7)}
    out = None
    for name, scope in cases.items():
        one = secured(calls, scope, "agent_id", "o_orderkey").agg(F.count("*").alias("calls")).select(F.lit(name).alias("scope"), "calls")
        out = one if out is None else out.unionByName(one)
    return out


def params_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uploaded keys that match calls, per upload file: customers upload their numbers, orders are the calls."""
    keys = customers(spark, sf_dir).select("c_custkey", "c_mktsegment")
    hit = keys.join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    both = keys.groupBy("c_mktsegment").agg(F.count("*").alias("rows_uploaded")).join(hit.groupBy("c_mktsegment").agg(F.count("*").alias("matched")), "c_mktsegment", "left")
    return both.select("c_mktsegment", "rows_uploaded", F.coalesce("matched", F.lit(0)).alias("matched"))


def tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without the erased ones (multiples of 13), by status."""
    orders = table(spark, sf_dir, "orders")
    erased = orders.where(F.col("o_orderkey") % 13 == 0).select("o_orderkey")
    return orders.join(erased, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("calls"))


def live_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fetched rows merged with live ones, live preferred; ten live keys lie beyond the last fetched one."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    last = orders.agg(F.coalesce(F.max("o_orderkey"), F.lit(0)).cast("long").alias("last"))
    new = last.select(F.explode(F.sequence(F.col("last") + 1, F.col("last") + 10)).alias("o_orderkey"))
    live = orders.where("o_orderkey % 4 = 0").select("o_orderkey").unionByName(new).withColumn("live_status", F.lit("live"))
    return orders.join(live, "o_orderkey", "full").select("o_orderkey", F.coalesce("live_status", "o_orderstatus").alias("status"))


def fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return orders.agg(F.count("*").alias("n"), F.date_format(F.max(F.col("o_orderdate").cast("timestamp")), "yyyy-MM-dd HH:mm:ss").alias("latest"), F.max("o_orderkey").alias("max_key"))


def volume_bucket(n: Column) -> Column:
    return F.when(n <= 0, "0").when(n == 1, "1").when(n <= 10, "2-10").when(n <= 100, "11-100").when(n <= 1000, "101-1k").otherwise("1k+")


def volume_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    per = customers(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))
    return per.groupBy(volume_bucket(F.col("n")).alias("bucket")).agg(F.count("*").alias("customers"))


QUERIES = {
    "call_list_topk": list_calls,
    "call_turn_stats": turn_stats,
    "client_percentile_tiles": tiles,
    "turn_series_p90_tall": tall_metrics,
    "cost_rollup": cost_rollup,
    "shard_by_key": shard_by_key,
    "dedupe_last_wins": last_wins,
    "latest_run": latest_run,
    "active_version_asof": active_version,
    "changed_versions": changed_versions,
    "row_secured_calls": row_secured,
    "row_secured_children": row_secured_children,
    "scope_fail_closed": fail_closed,
    "params_coverage": params_coverage,
    "tombstone_filter": tombstones,
    "live_merge": live_merge,
    "change_fingerprint": fingerprint,
    "volume_buckets": volume_buckets,
}

_V = "v[cast({i} as integer) + 1]"
_STATS = """select l_orderkey, count(*) as turns, count(*) filter (l_returnflag = 'R') as barge_ins,
list_sort(list(l_quantity) filter (l_returnflag <> 'R')) as v from lineitem group by 1"""
_AGENT = "select o.*, c_nationkey as agent_id from orders o join customer on o_custkey = c_custkey"

ORACLE_SQL = {
    "call_list_topk": """select o_orderkey, c_name, o_orderstatus, round(o_totalprice, 2) as total from orders join customer on o_custkey = c_custkey
where o_orderstatus in ('F', 'P') and (c_name ilike '%1%' or o_orderpriority ilike '%urg%') order by o_orderdate desc nulls last, o_orderkey desc limit 50""",
    "call_turn_stats": f"select l_orderkey, turns, barge_ins, v[len(v) // 2 + 1] as median_ms from ({_STATS})",
    "client_percentile_tiles": f"""with s as (select *, v[len(v) // 2 + 1] as m from ({_STATS})),
g as (select o_orderstatus, list_sort(list(m) filter (m is not null)) as v, sum(barge_ins) as b, sum(turns) as t, count(*) filter (m is null) as silent from s join orders on l_orderkey = o_orderkey group by 1)
select o_orderstatus, v[cast(least(len(v) - 1, floor(0.5 * len(v))) as integer) + 1] as p50, v[cast(least(len(v) - 1, floor(0.95 * len(v))) as integer) + 1] as p95, round(b / t, 4) as barge_in_rate, silent from g""",
    "turn_series_p90_tall": """with n as (select l_orderkey, unnest(['response_ms', 'cost', 'discount']) as name, unnest([l_quantity, l_extendedprice, l_discount]) as x, l_linestatus from lineitem),
g as (select l_orderkey, name, list_sort(list(x) filter (l_linestatus <> 'F')) as v from n group by 1, 2),
p as (select l_orderkey, name, v[cast(round_even(0.9 * (len(v) - 1), 0) as integer) + 1] as value from g)
select l_orderkey, name, round(value, 1) as value, value is not null as available, case when value is null then 'timing_missing' end as reason from p""",
    "cost_rollup": """with u as (select case l_partkey % 3 when 0 then 'model-a' when 1 then 'model-b' else 'model-x' end as llm_model, l_suppkey % 2 = 0 as voiced,
l_quantity * 1000 as ti, l_quantity * 100 as tout, case when l_linenumber = 1 then l_quantity * 400 else 0 end as tc, case when l_returnflag <> 'R' then l_quantity * 10 else 0 end as ch, case when l_linestatus = 'O' then l_quantity else 0 end as secs from lineitem),
c as (select llm_model, case llm_model when 'model-a' then (greatest(ti - tc, 0) * 0.4 + tout * 1.6 + tc * 0.1) / 1e6 when 'model-b' then (greatest(ti - tc, 0) * 2.5 + tout * 10.0 + tc * 1.25) / 1e6 end as cost_llm,
secs / 60 * 0.0043 as cost_stt, case when voiced then ch * 15.0 / 1e6 end as cost_tts from u)
select llm_model, round(sum(cost_llm), 4) as cost_llm, round(sum(cost_stt), 4) as cost_stt, round(sum(cost_tts), 4) as cost_tts,
round(sum(coalesce(cost_llm, 0) + coalesce(cost_stt, 0) + coalesce(cost_tts, 0)), 4) as cost_total, count(cost_llm) as priced_turns from c group by 1""",
    "shard_by_key": """select coalesce(nullif(case when event_type = 'purchase' then '' else 'call-' || user_id end, ''), case when event_id % 7 <> 0 then 'trace-' || (event_id % 50) end, '') as shard_key,
count(*) as spans, min(event_id) as first_span from events group by 1""",
    "dedupe_last_wins": """with c as (select event_id, value, 0 as b from events union all select event_id, value + 1, 1 from events where event_id % 3 = 0 union all select event_id, value + 2, 2 from events where event_id % 5 = 0)
select event_id, value from (select *, row_number() over (partition by event_id order by b desc) as n from c) where n = 1""",
    "latest_run": """select o_custkey, o_orderkey, case when o_orderstatus = 'P' then split_part(o_orderpriority, '-', 2) end as reason from
(select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1""",
    "active_version_asof": """select o_orderkey, nullif(sum(case when o_orderpriority like '1%' then 1 else 0 end) over (partition by o_custkey order by o_orderdate, o_orderkey rows unbounded preceding), 0) as version from orders""",
    "changed_versions": """with a as (select *, lag(o_orderstatus) over (partition by o_custkey order by o_orderdate, o_orderkey) as was from orders)
select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as version, sha256(o_orderstatus) as sha from a where was is null or was <> o_orderstatus""",
    "row_secured_calls": f"select agent_id, count(*) as calls, round(sum(o_totalprice), 2) as total from ({_AGENT}) where agent_id in (3, 7, 11) group by 1",
    "row_secured_children": f"select l_returnflag, count(*) as turns from lineitem where l_orderkey in (select o_orderkey from ({_AGENT}) where agent_id in (3, 7, 11)) group by 1",
    "scope_fail_closed": f"""select 'unset' as scope, 0 as calls union all select 'empty', 0 union all select 'grants', (select count(*) from ({_AGENT}))
union all select 'bound', (select count(*) from ({_AGENT}) where agent_id in (3, 7, 11) and o_orderkey = 7)""",
    "params_coverage": """select c_mktsegment, count(*) as rows_uploaded, count(*) filter (c_custkey in (select o_custkey from orders)) as matched from customer group by 1""",
    "tombstone_filter": "select o_orderstatus, count(*) as calls from orders where o_orderkey % 13 <> 0 group by 1",
    "live_merge": """select o_orderkey, case when o_orderkey % 4 = 0 then 'live' else o_orderstatus end as status from orders
union all select unnest(range(m + 1, m + 11)), 'live' from (select max(o_orderkey) as m from orders)""",
    "change_fingerprint": "select count(*) as n, strftime(max(o_orderdate), '%Y-%m-%d %H:%M:%S') as latest, max(o_orderkey) as max_key from orders",
    "volume_buckets": """with p as (select c_custkey, count(o_orderkey) as n from customer left join orders on c_custkey = o_custkey group by 1)
select case when n <= 0 then '0' when n = 1 then '1' when n <= 10 then '2-10' when n <= 100 then '11-100' when n <= 1000 then '101-1k' else '1k+' end as bucket, count(*) as customers from p group by 1""",
}
