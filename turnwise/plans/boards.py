"""Dashboard buckets: one scoped read of the facts, grouped per bucket, joined on a full spine.

Driver tables stand in for calls: an event is a call, ``error`` a failed one,
``value`` its latency or cost, ``user_id`` the agent. Now is the latest event.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import group_percentiles, half_even, nearest_index, safe_rate

RANGE_S, BUCKET_S = 7 * 86400, 6 * 3600


def events(spark: SparkSession, sf_dir: str, since: int | None = None) -> DataFrame:
    """The facts, from an epoch second on; zone-less times are UTC, as is the session's zone.

    The bound is compared with the time as it is stored, so it reaches the scan.
    """
    facts = spark.read.parquet(f"{sf_dir}/events.parquet")
    if since is not None:
        facts = facts.where(F.col("ts") >= F.timestamp_seconds(F.lit(since)).cast(facts.schema["ts"].dataType))
    return facts.withColumn("ts", F.col("ts").cast("timestamp"))


def bucket_of(ts: Column, width_s: int = BUCKET_S) -> Column:
    """Epoch seconds of the bucket that holds ts."""
    return (F.floor(F.unix_timestamp(ts) / width_s) * width_s).cast("long")


class Bounds(NamedTuple):
    """The epoch seconds that a board covers; none for a board without facts."""

    since: int | None
    until: int | None


def window_of(facts: DataFrame, range_s: int = RANGE_S) -> Bounds:
    """The range up to the latest fact: one number goes to the driver and comes back as a literal."""
    until = facts.agg(F.unix_timestamp(F.max("ts").cast("timestamp"))).first()[0]
    return Bounds(None if until is None else until - range_s, until)


def spine(spark: SparkSession, bounds: Bounds, width_s: int = BUCKET_S) -> DataFrame:
    """Every bucket from floor(since) while it starts before until + width."""
    if bounds.until is None:
        return spark.range(0).withColumnRenamed("id", "bucket")
    first, last = bounds.since // width_s * width_s, -(-bounds.until // width_s) * width_s
    return spark.range(first, last + 1, width_s, 1).withColumnRenamed("id", "bucket")


def scoped(facts: DataFrame, bounds: Bounds, width_s: int = BUCKET_S) -> DataFrame:
    """Facts inside the range with their bucket."""
    inside = F.lit(False) if bounds.since is None else F.col("ts") >= F.timestamp_seconds(F.lit(bounds.since))
    return facts.where(inside).withColumn("bucket", bucket_of(F.col("ts"), width_s))


def recent(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Bounds]:
    """The facts of the board's range, and the range."""
    bounds = window_of(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return events(spark, sf_dir, bounds.since), bounds


def on_spine(spark: SparkSession, sf_dir: str, *aggs: Column) -> DataFrame:
    facts, bounds = recent(spark, sf_dir)
    return spine(spark, bounds).join(scoped(facts, bounds).groupBy("bucket").agg(*aggs), "bucket", "left")


def volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    return on_spine(spark, sf_dir, F.count("*").alias("n")).select("bucket", F.coalesce("n", F.lit(0)).alias("calls"))


def failure_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = on_spine(spark, sf_dir, F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("f"))
    calls, failures = F.coalesce("n", F.lit(0)), F.coalesce("f", F.lit(0))
    return found.select("bucket", calls.alias("calls"), failures.alias("failures"), safe_rate(failures, calls).alias("failure_rate"))


P = {"p50": nearest_index(0.5), "p95": nearest_index(0.95)}


def measurable() -> Column:
    return F.when(F.col("event_type") != "error", F.col("value"))


def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts, bounds = recent(spark, sf_dir)
    return spine(spark, bounds).join(group_percentiles(scoped(facts, bounds), ["bucket"], measurable(), P), "bucket", "left")


def cost_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ("purchase", "click", "view")
    sums = [F.sum(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in kinds]
    found = on_spine(spark, sf_dir, F.sum("value").alias("total"), *sums)
    return found.select("bucket", *[F.round(F.coalesce(c, F.lit(0.0)), 4).alias(f"cost_{c}") for c in ("total", *kinds)])


def disposition_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = ("purchase", "signup", "click")
    label = F.when(F.col("event_type").isin(*known), F.col("event_type")).otherwise("none")
    return events(spark, sf_dir).select(label.alias("disposition")).groupBy("disposition").agg(F.count("*").alias("calls"))


def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scoped(*recent(spark, sf_dir)).withColumn("board", F.lit(1))
    found = rows.groupBy("board").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures"), F.sum("value").alias("cost"))
    both = found.join(group_percentiles(rows, ["board"], measurable(), P), "board", "left")
    return both.select("calls", "failures", safe_rate(F.col("failures"), F.col("calls")).alias("failure_rate"), F.round("cost", 2).alias("cost"), "p50", "p95")


def tool_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls and their error rate per bucket: clicks and errors stand in for tool spans."""
    tool = F.col("event_type").isin("click", "error")
    found = on_spine(spark, sf_dir, F.count_if(tool).alias("n"), F.count_if(F.col("event_type") == "error").alias("e"))
    calls, errors = F.coalesce("n", F.lit(0)), F.coalesce("e", F.lit(0))
    return found.select("bucket", calls.alias("tool_calls"), errors.alias("tool_errors"), safe_rate(errors, calls).alias("tool_error_rate"))


def exact_rate(part: Column, whole: Column) -> Column:
    """part / whole to four digits, halves to even; 0 for an empty whole."""
    return F.when(whole > 0, half_even(part / whole, 4)).otherwise(F.lit(0.0))


def snapshot(calls: DataFrame, judged: DataFrame, latencies: DataFrame, tools: DataFrame, bounds: Bounds, width_s: int = BUCKET_S) -> DataFrame:
    """Every board series per bucket, and the totals in one more row of bucket null.

    calls: ts, failed, cost; judged: ts, disposition, violation; latencies: ts,
    value of measurable turns; tools: ts, error. A call that failed and was judged
    other than connected counts as a failure twice, so a rate may be above 1. All
    facts are one union of counters, added up before the one shuffle; buckets
    without facts have zeros, and null percentiles.
    """

    def counters(rows: DataFrame, **named: Column) -> DataFrame:
        zero = F.lit(0).cast("long")
        cells = [named.get(c, zero).cast("long").alias(c) for c in COUNTERS]
        return scoped(rows, bounds, width_s).select("bucket", *cells, named.get("cost", F.lit(0.0)).cast("double").alias("cost"))

    one, unlike = F.lit(1), F.coalesce(F.col("disposition") != "connected", F.lit(False))
    facts = counters(calls, calls=one, failures=F.coalesce("failed", F.lit(False)), cost=F.coalesce("cost", F.lit(0.0)))
    facts = facts.unionByName(counters(judged, failures=unlike, judged=F.col("violation").isNotNull(), violations=F.coalesce("violation", F.lit(False))))
    facts = facts.unionByName(counters(tools, tool_calls=one, tool_errors=F.coalesce("error", F.lit(False))))
    each = facts.groupBy("bucket").agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "cost")])
    waits = scoped(latencies, bounds, width_s)
    series = spine(calls.sparkSession, bounds, width_s).join(each, "bucket", "left").join(group_percentiles(waits, ["bucket"], F.col("value"), P), "bucket", "left")
    total = each.agg(*[F.sum(c).alias(c) for c in (*COUNTERS, "cost")]).withColumns({"bucket": F.lit(None).cast("long"), "board": F.lit(1)})
    total = total.join(group_percentiles(waits.withColumn("board", F.lit(1)), ["board"], F.col("value"), P), "board", "left").drop("board")
    rows = series.unionByName(total).withColumns({c: F.coalesce(c, F.lit(0)) for c in COUNTERS})
    rates = {"failure_rate": exact_rate(F.col("failures"), F.col("calls")), "violation_rate": exact_rate(F.col("violations"), F.col("judged")), "tool_error_rate": exact_rate(F.col("tool_errors"), F.col("tool_calls"))}
    return rows.withColumns({**rates, "cost": F.round(F.coalesce("cost", F.lit(0.0)), 4)})


COUNTERS = ("calls", "failures", "judged", "violations", "tool_calls", "tool_errors")


def snapshot_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite board: judgments follow from the event's number, a value above 150 is a violation."""
    (facts, bounds), n = recent(spark, sf_dir), F.col("event_id")
    error = F.col("event_type") == "error"
    label = F.when(n % 5 == 0, "no_answer").when(n % 5 == 1, None).when(n % 5 == 2, "unknown").otherwise("connected")
    judged = facts.where(n % 3 != 0).select("ts", label.alias("disposition"), F.when(n % 4 != 0, F.col("value") > 150).alias("violation"))
    return snapshot(
        facts.select("ts", error.alias("failed"), F.col("value").alias("cost")), judged, facts.where(~error).select("ts", "value"),
        facts.where(F.col("event_type").isin("click", "error")).select("ts", error.alias("error")), bounds,
    )


def client_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composite board as the client draws it: rates in per cent to one digit by their exact binary value, halves up; totals left out."""
    rows = snapshot_of_events(spark, sf_dir).where("bucket is not null")
    shares = {}
    for c in ("failure_rate", "violation_rate"):
        x = F.col(c) * 100
        # with one digit only odd quarters are exact halves
        shares[c] = F.when(F.pmod(x * 4, F.lit(2.0)) == 1, (F.floor(x * 10) + 1) / 10).otherwise(half_even(x, 1))
    return rows.withColumns(shares).select("bucket", F.col("calls").alias("volume"), *shares, "p50", "p95", "tool_calls", "tool_errors", "cost")


QUERIES = {
    "board_snapshot": snapshot_of_events,
    "board_client_rows": client_rows,
    "board_volume_6h": volume,
    "board_failure_rate": failure_rate,
    "board_latency_p50_p95": latency,
    "board_cost_sums": cost_sums,
    "board_disposition_mix": disposition_mix,
    "board_totals": totals,
    "tool_error_rate": tool_errors,
}

_SCOPE = """with b as (select cast(floor(epoch(max(ts))) as bigint) as until from events),
w as (select until - 604800 as since, until from b),
spine as (select unnest(generate_series(since // 21600 * 21600, (until + 21599) // 21600 * 21600, 21600)) as bucket from w),
f as (select cast(floor(epoch(ts)) as bigint) // 21600 * 21600 as bucket, event_type, value from events, w where floor(epoch(ts)) >= since)
"""
_P = "v[cast(round_even({p} * (len(v) - 1), 0) as integer) + 1]"

_SNAPSHOT = (
    _SCOPE
    + f""", e as (select cast(floor(epoch(ts)) as bigint) // 21600 * 21600 as bucket, event_id as n, event_type = 'error' as bad, event_type in ('click', 'error') as tool, value from events, w where floor(epoch(ts)) >= since),
x as (select *, n % 3 <> 0 and n % 5 in (0, 2) as unlike, n % 3 <> 0 and n % 4 <> 0 and value is not null as judged, n % 3 <> 0 and n % 4 <> 0 and value > 150 as viol from e),
k as (select s.bucket, x.* exclude (bucket) from spine s left join x using (bucket)),
g as (select bucket, count(n) as calls, count(*) filter (bad) + count(*) filter (unlike) as failures, count(*) filter (judged) as judged, count(*) filter (viol) as violations,
count(*) filter (tool) as tool_calls, count(*) filter (bad) as tool_errors, coalesce(sum(value), 0) as c, list_sort(list(value) filter (not bad and value is not null)) as v from k group by rollup (bucket)),
board as (select bucket, calls, failures, judged, violations, tool_calls, tool_errors, round(c, 4) as cost, {_P.format(p=0.5)} as p50, {_P.format(p=0.95)} as p95,
case when calls > 0 then round_even(failures / calls, 4) else 0.0 end as failure_rate, case when judged > 0 then round_even(violations / judged, 4) else 0.0 end as violation_rate,
case when tool_calls > 0 then round_even(tool_errors / tool_calls, 4) else 0.0 end as tool_error_rate from g)
"""
)

ORACLE_SQL = {
    "board_snapshot": _SNAPSHOT + "select * from board",
    "board_client_rows": _SNAPSHOT
    + """select bucket, calls as volume, case when failure_rate * 400 % 2 = 1 then (floor(failure_rate * 100 * 10) + 1) / 10 else cast(printf('%.1f', failure_rate * 100) as double) end as failure_rate,
case when violation_rate * 400 % 2 = 1 then (floor(violation_rate * 100 * 10) + 1) / 10 else cast(printf('%.1f', violation_rate * 100) as double) end as violation_rate, p50, p95, tool_calls, tool_errors, cost from board where bucket is not null""",
    "board_volume_6h": _SCOPE + "select s.bucket, count(f.event_type) as calls from spine s left join f using (bucket) group by 1",
    "board_failure_rate": _SCOPE
    + """select s.bucket, count(f.event_type) as calls, count(*) filter (event_type = 'error') as failures,
coalesce(round(count(*) filter (event_type = 'error') / nullif(count(f.event_type), 0), 4), 0.0) as failure_rate from spine s left join f using (bucket) group by 1""",
    "board_latency_p50_p95": _SCOPE
    + f""", g as (select s.bucket, list_sort(list(value) filter (event_type <> 'error')) as v from spine s left join f using (bucket) group by 1)
select bucket, {_P.format(p=0.5)} as p50, {_P.format(p=0.95)} as p95 from g""",
    "board_cost_sums": _SCOPE
    + """select s.bucket, round(coalesce(sum(value), 0), 4) as cost_total, round(coalesce(sum(value) filter (event_type = 'purchase'), 0), 4) as cost_purchase,
round(coalesce(sum(value) filter (event_type = 'click'), 0), 4) as cost_click, round(coalesce(sum(value) filter (event_type = 'view'), 0), 4) as cost_view
from spine s left join f using (bucket) group by 1""",
    "board_disposition_mix": "select case when event_type in ('purchase', 'signup', 'click') then event_type else 'none' end as disposition, count(*) as calls from events group by 1",
    "board_totals": _SCOPE
    + f""", g as (select count(*) as calls, count(*) filter (event_type = 'error') as failures, sum(value) as c, list_sort(list(value) filter (event_type <> 'error')) as v from f)
select calls, failures, round(failures / calls, 4) as failure_rate, round(c, 2) as cost, {_P.format(p=0.5)} as p50, {_P.format(p=0.95)} as p95 from g""",
    "tool_error_rate": _SCOPE
    + """select s.bucket, count(*) filter (event_type in ('click', 'error')) as tool_calls, count(*) filter (event_type = 'error') as tool_errors,
coalesce(round(count(*) filter (event_type = 'error') / nullif(count(*) filter (event_type in ('click', 'error')), 0), 4), 0.0) as tool_error_rate from spine s left join f using (bucket) group by 1""",
}
