"""What clients make of rows: ranges, tabs, searches, transcripts with what was heard in vain, shares, extents, tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import floor_index, group_percentiles, half_even
from ..operators.ordered import ranked

#: fixed values: seconds of the ranges that exports and clusters know, and boards
EXPORT_RANGES = {"24h": 86400, "7d": 7 * 86400, "30d": 30 * 86400, "90d": 90 * 86400}
BOARD_RANGES = {k: EXPORT_RANGES[k] for k in ("24h", "7d", "30d")}
#: fixed values: event names of words that were heard and not used
LOST = "overheard|dropped|carried|promoted"
LEAST_EXTENT = 0.001


def in_range(started: str, created: str, key: str | None, until: Column, ranges: dict[str, int], default: str | None = None) -> Column:
    """Whether a call is of the range: begun, or where that is not known made, since then.

    A key that is not known is the default one, without one there is no bound. As
    two comparisons with columns as they are stored it reaches the scan.
    """
    seconds = ranges.get(key or "", ranges.get(default or ""))
    if seconds is None:
        return F.lit(True)
    since = until - F.make_dt_interval(secs=F.lit(seconds))
    return (F.col(started) >= since) | (F.col(started).isNull() & (F.col(created) >= since))


def tabs() -> dict[str, Column]:
    """Conditions on calls (analysed, status); one of no status is pending until it is analysed."""
    status, analysed = F.coalesce("status", F.lit("")), F.coalesce("analysed", F.lit(False))
    return {"all": F.lit(True), "analysed": analysed, "pending": ~analysed & (status != "unsupported"), "failed": status == "failed", "unsupported": status == "unsupported"}


def matches(needle: str, *fields: str, labels: str = "labels") -> Column:
    """Whether the fields and the labels' values, joined by blanks, hold the needle in any case; a null is an empty field, an empty needle matches."""
    wanted = needle.strip().lower()
    values = F.transform(F.coalesce(F.map_values(labels), F.array().cast("array<string>")), lambda v: F.coalesce(v, F.lit("")))
    every = F.concat(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), values)
    return F.lit(True) if not wanted else F.contains(F.lower(F.array_join(every, " ")), F.lit(wanted))


def heard_transcript(turns: DataFrame, events: DataFrame) -> DataFrame:
    """(call_id, place, kind, who, t, text): callers' and agents' lines with the words that were heard and not used, by time.

    turns: call_id, turn_index, caller_transcript, llm_spoken, llm_raw, cut_reason
    and anchors; events: call_id, place (their order), name, t_offset_s,
    content_text. Lines of one time, and those of none, which come last, stand as
    they are listed: turns, each with its caller first, then events. A call's
    lines are ranked in ranges, so a call of any length is ordered.
    """
    heard = F.coalesce("caller_utt_end_s", "committed_at", "stt_final_at")
    begun = F.coalesce("agent_utt_start_s", "tts_first_audio_at", "tts_start_at", "llm_first_token_at", heard + 0.001)
    index, said = F.col("turn_index").cast("string"), F.coalesce("llm_spoken", "llm_raw")  # an empty spoken text is one
    cut = F.when(F.coalesce("cut_reason", F.lit("")) != "", F.concat(F.lit(" · cut by "), F.regexp_replace("cut_reason", "^([^_]*)_", "$1-"))).otherwise("")
    fields = ("kind", "who", "t", "text")

    def line(*values: Column) -> Column:
        return F.struct(*[v.alias(f) for v, f in zip(values, fields, strict=True)])

    two = F.array(
        line(F.lit("caller"), F.concat(F.lit("caller · turn "), index), heard, F.col("caller_transcript")), line(F.lit("agent"), F.concat(F.lit("agent · turn "), index, cut), begun, said)
    )
    spoken = turns.select("call_id", F.lit(0).alias("_list"), F.col("turn_index").cast("long").alias("_at"), F.posexplode(two).alias("_half", "_line"))
    ghost = line(F.lit("ghost"), F.concat(F.lit("heard but not used · "), F.col("name")), F.col("t_offset_s"), F.col("content_text"))
    lost = events.where(F.col("name").rlike(LOST)).select("call_id", F.lit(1).alias("_list"), F.col("place").cast("long").alias("_at"), F.lit(0).alias("_half"), ghost.alias("_line"))
    rows = spoken.unionByName(lost).where("_line.text <> '' and call_id is not null").select("call_id", "_list", "_at", "_half", "_line.*").withColumn("_none", F.col("t").isNull())
    return ranked(rows, ["call_id"], ["_none", "t", "_list", "_at", "_half"], "place").select("call_id", "place", *fields)


def shares(counts: DataFrame, name: str) -> DataFrame:
    """(name, n, share) of the classes that are not empty; few rows, one per class."""
    kept = counts.where("n > 0")
    return kept.select(name, "n", half_even(F.col("n") / F.sum("n").over(W.partitionBy()), 4).alias("share"))


def extent(spans: DataFrame) -> DataFrame:
    """Seconds that a call's picture spans: the last end, open spans ending as they start, and a thousandth at least."""
    return spans.groupBy("call_id").agg(F.greatest(F.max(F.col("t_start_s") + F.coalesce("duration_s", F.lit(0.0))), F.lit(LEAST_EXTENT)).alias("extent_s"))


def latency_tiles(turns: DataFrame) -> DataFrame:
    """(call_id, median, p90, most) of the response latencies of a call's turns that are neither opening nor interrupted; calls without any go."""
    fit = turns.where("trigger is distinct from 'opening' and not coalesce(interrupted, false) and response_latency_ms is not null")
    ranks = group_percentiles(fit, ["call_id"], F.col("response_latency_ms"), {"median": floor_index(0.5), "p90": floor_index(0.9)})
    return ranks.join(fit.groupBy("call_id").agg(F.max("response_latency_ms").alias("most")), "call_id")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def range_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls in each range up to the latest, of exports and boards, with unknown keys; every fifth has no start but was made a day later."""
    orders = table(spark, sf_dir, "orders")
    until = F.lit(orders.agg(F.max("o_orderdate")).first()[0]).cast(orders.schema["o_orderdate"].dataType)
    fifth = F.col("o_orderkey") % 5 == 0
    calls = orders.select(F.when(~fifth, F.col("o_orderdate")).alias("started_at"), F.when(fifth, F.col("o_orderdate") + F.make_dt_interval(F.lit(1))).otherwise(F.col("o_orderdate")).alias("created_at"))
    keys = [("export", k, EXPORT_RANGES, None) for k in (*EXPORT_RANGES, "", "year")] + [("board", k, BOARD_RANGES, "7d") for k in (*BOARD_RANGES, "90d")]
    sums = [F.count_if(in_range("started_at", "created_at", k, until, known, default)).alias(f"{scope}_{k or 'none'}") for scope, k, known, default in keys]
    return calls.agg(*sums)


def call_tabs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls with customer labels: calls of each tab that match each of three needles."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "P", "unsupported").when(F.col("o_orderkey") % 4 != 0, "ingested")
    calls = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("id"), F.lit("Live").alias("source"), F.lit(None).cast("string").alias("environment"), status.alias("status"), (F.col("o_orderkey") % 3 == 0).alias("analysed"),
        F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("priority"), F.col("o_orderpriority")).alias("labels"),
    )
    needles = {"none": "  ", "urgent": " 1-urg", "across": "live  failed", "number": "99"}
    found = [F.count_if(F.col(f"_tab_{t}") & matches(n, "id", "source", "environment", "status")).alias(f"{t}_{k}") for t in tabs() for k, n in needles.items()]
    return calls.withColumns({f"_tab_{t}": c for t, c in tabs().items()}).agg(*found)


def heard_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as its call: clicks and views are turns with some anchors, errors events that heard something."""
    n, value = F.col("event_id"), F.col("value")
    e = table(spark, sf_dir, "events").withColumn("t", n % 512 / 8)

    def some(m: int, x: Column = F.col("t")) -> Column:
        return F.when(n % m == 0, x)

    turns = e.where("event_type in ('click', 'view')").select(
        F.col("user_id").alias("call_id"), n.alias("turn_index"), F.when(F.col("event_type") == "click", F.col("props")).alias("caller_transcript"), some(5, F.lit("")).alias("llm_spoken"), some(2, F.col("event_type")).alias("llm_raw"),
        some(7, F.lit("barge_in_x")).alias("cut_reason"), some(2).alias("caller_utt_end_s"), some(3, F.col("t") + 1).alias("committed_at"), some(5, F.col("t") + 2).alias("stt_final_at"),
        some(4, F.col("t") + 3).alias("agent_utt_start_s"), *[F.lit(None).cast("double").alias(c) for c in ("tts_first_audio_at", "tts_start_at")], some(6, F.col("t") + 4).alias("llm_first_token_at"),
    )
    names = F.when(n % 3 == 0, "stt.overheard").when(n % 3 == 1, "turn.dropped")
    events = e.where("event_type = 'error'").select(F.col("user_id").alias("call_id"), n.alias("place"), names.alias("name"), F.when(value > 5, F.col("t")).alias("t_offset_s"), F.col("props").alias("content_text"))
    return heard_transcript(turns, events).withColumn("t", half_even(F.col("t"), 3))


def label_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of each label, those of every seventh without one, with their share."""
    label = F.when(F.col("vec_id") % 7 != 0, F.col("label").cast("string"))
    return shares(table(spark, sf_dir, "embeddings").groupBy(F.coalesce(label, F.lit("unclustered")).alias("cluster")).agg(F.count("*").alias("n")), "cluster")


def call_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as spans in eighths of a second; every third is open, those of every tenth order never move."""
    still = F.col("l_orderkey") % 10 == 0
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call_id"), F.when(still, 0.0).otherwise(F.col("l_linenumber") / 8).alias("t_start_s"), F.when((F.col("l_partkey") % 3 != 0) & ~still, F.col("l_quantity") / 8).alias("duration_s"))
    return extent(spans)


def latency_by_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    trigger = F.when(F.col("l_linenumber") == 1, "opening").when(F.col("l_linenumber") != 2, "caller")
    return latency_tiles(rows.select(F.col("l_orderkey").alias("call_id"), trigger.alias("trigger"), (F.col("l_returnflag") == "R").alias("interrupted"), F.when(F.col("l_partkey") % 9 != 0, F.col("l_quantity")).alias("response_latency_ms")))


QUERIES = {
    "range_counts": range_counts,
    "call_tabs": call_tabs,
    "heard_transcript": heard_lines,
    "cluster_shares": label_shares,
    "call_extents": call_extents,
    "call_latency_tiles": latency_by_call,
}

_TABS = {"all": "true", "analysed": "a", "pending": "not a and s <> 'unsupported'", "failed": "s = 'failed'", "unsupported": "s = 'unsupported'"}
_NEEDLES = {"none": "", "urgent": "1-urg", "across": "live  failed", "number": "99"}
ORACLE_SQL = {
    "range_counts": "with c as (select case when o_orderkey % 5 = 0 then o_orderdate + interval 1 day else o_orderdate end as begun, (select max(o_orderdate) from orders) as u from orders) select "
    + ", ".join(f"count(*) filter (begun >= u - interval {d} day) as {n}" for n, d in {"export_24h": 1, "export_7d": 7, "export_30d": 30, "export_90d": 90, "board_24h": 1, "board_7d": 7, "board_30d": 30, "board_90d": 7}.items())
    + ", count(*) as export_none, count(*) as export_year from c",
    "call_tabs": "with c as (select o_orderkey % 3 = 0 as a, case o_orderstatus when 'F' then 'failed' when 'P' then 'unsupported' else case when o_orderkey % 4 <> 0 then 'ingested' else '' end end as s, lower(o_orderkey || ' Live  ' || s || ' ' || c_mktsegment || ' ' || o_orderpriority) as t from orders join customer on o_custkey = c_custkey) select "
    + ", ".join(f"count(*) filter (({c}) and contains(t, '{n}')) as {t}_{k}" for t, c in _TABS.items() for k, n in _NEEDLES.items())
    + " from c",
    "heard_transcript": """with e as (select *, event_id as n, event_id % 512 / 8 as t from events),
u as (select *, coalesce(case when n % 2 = 0 then t end, case when n % 3 = 0 then t + 1 end, case when n % 5 = 0 then t + 2 end) as h from e where event_type in ('click', 'view')),
r as (select user_id as call_id, 0 as l, n, 0 as half, 'caller' as kind, 'caller · turn ' || n as who, h as t, props as text from u where event_type = 'click'
union all select user_id, 0, n, 1, 'agent', 'agent · turn ' || n || case when n % 7 = 0 then ' · cut by barge-in_x' else '' end, coalesce(case when n % 4 = 0 then t + 3 end, case when n % 6 = 0 then t + 4 end, h + 0.001), case when n % 5 = 0 then '' when n % 2 = 0 then event_type end from u
union all select user_id, 1, n, 0, 'ghost', 'heard but not used · ' || case n % 3 when 0 then 'stt.overheard' else 'turn.dropped' end, case when value > 5 then t end, props from e where event_type = 'error' and n % 3 <> 2)
select call_id, row_number() over (partition by call_id order by t nulls last, l, n, half) as place, kind, who, round_even(t, 3) as t, text from r where text <> ''""",
    "cluster_shares": "select coalesce(case when vec_id % 7 <> 0 then cast(label as varchar) end, 'unclustered') as cluster, count(*) as n, round_even(count(*) / sum(count(*)) over (), 4) as share from embeddings group by 1",
    "call_extents": "select l_orderkey as call_id, greatest(max(case when l_orderkey % 10 = 0 then 0 else l_linenumber / 8 + case when l_partkey % 3 <> 0 then l_quantity / 8 else 0 end end), 0.001) as extent_s from lineitem group by 1",
    "call_latency_tiles": """with f as (select l_orderkey as call_id, l_quantity as v from lineitem where l_linenumber <> 1 and l_returnflag <> 'R' and l_partkey % 9 <> 0),
g as (select call_id, list_sort(list(v)) as v, count(*) as n from f group by 1)
select call_id, v[least(n - 1, cast(floor(0.5 * n) as bigint)) + 1] as median, v[least(n - 1, cast(floor(0.9 * n) as bigint)) + 1] as p90, v[n] as most from g""",
}
