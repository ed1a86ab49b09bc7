"""The trace path from export payloads to turns, metrics and trust, on payloads made of the conversations table.

Every row of a conversation is one payload, as a fragment of its call; one more
holds the call's root. Times follow from the turn's number: a turn begins at
``SLOT_MS`` times its number, and ``v`` milliseconds, by conversation and turn,
vary some of them. System rows are left out. (conv_id, turn) is a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from ..sources import otlp
from . import trace

SLOT_MS, BEGAN_MS = 20_000, 1_700_000_000_000


def text_attr(key: str, value: Column) -> Column:
    return F.struct(F.lit(key).alias("key"), F.struct(value.cast("string").alias("stringValue")).alias("value"))


def span(trace_id: Column, name: str, own: Column, parent: Column, first: Column, last: Column, attrs: list[Column], events: Column | None = None) -> Column:
    def nano(ms: Column) -> Column:
        return ((ms + BEGAN_MS) * 1_000_000).cast("string")

    marks = F.array().cast("array<struct<name:string,timeUnixNano:string>>") if events is None else F.array(F.struct(F.lit("llm.first_token").alias("name"), nano(events).alias("timeUnixNano")))
    pairs = F.array(*attrs) if attrs else F.array().cast("array<struct<key:string,value:struct<stringValue:string>>>")
    return F.struct(
        trace_id.alias("traceId"), own.alias("spanId"), parent.alias("parentSpanId"), F.lit(name).alias("name"), nano(first).alias("startTimeUnixNano"), nano(last).alias("endTimeUnixNano"),
        pairs.alias("attributes"), marks.alias("events"),
    )


def payload(spans: list[Column]) -> Column:
    return F.to_json(F.struct(F.array(F.struct(F.array(F.struct(F.array(*spans).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans")))


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(payload) of the calls' fragments: ids in capitals, as some exporters write them."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role in ('user', 'assistant')")
    call, turn, size = F.col("conv_id"), F.col("turn"), F.length("text")
    b, v = turn * SLOT_MS, F.pmod(call, F.lit(7)) * 10 + F.pmod(turn, F.lit(5))
    trace_id, root = F.concat(F.lit("CA-"), call), F.lit("ROOT")

    def own(kind: str) -> Column:
        return F.concat(F.lit(kind), turn.cast("string"))

    heard = [
        span(trace_id, "user_turn", own("U"), root, b + 6000, b + 6500, [text_attr("lk.pii.user_transcript", F.col("text"))]),
        span(trace_id, "user_speaking", own("S"), own("U"), b + 1000, b + 5000 + v, []),
        span(trace_id, "eou_detection", own("E"), own("U"), b + 5300, b + 5700 + v, []),
    ]
    tokens, chars = F.coalesce(F.pmod(size, F.lit(10)) * 10, F.lit(0)), F.coalesce(size, F.lit(0))
    said = [
        span(trace_id, "agent_turn", own("A"), root, b + 100, b + 15_000, [text_attr("lk.pii.response.text", F.col("text"))]),
        span(trace_id, "llm_request", own("L"), own("A"), b + 200, b + 3000, [text_attr("lk.llm_metrics", F.concat(F.lit('{"completion_tokens": '), tokens, F.lit("}")))], b + 900 + v),
        span(trace_id, "tts_request", own("T"), own("A"), b + 1500, b + 9000, [text_attr("lk.tts_metrics", F.concat(F.lit('{"ttfb": 0.25, "characters_count": '), chars, F.lit("}")))]),
    ]
    parts = rows.select(F.when(F.col("role") == "user", payload(heard)).otherwise(payload(said)).alias("payload"))
    ends = rows.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    roots = ends.select(payload([span(trace_id, "agent_session", root, F.lit(""), F.lit(0), b + SLOT_MS, [text_attr("voice.call_id", F.concat(F.lit("call-"), call))])]).alias("payload"))
    return parts.unionByName(roots)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return otlp.spans_of(payloads(spark, sf_dir))


def adapted(spark: SparkSession, sf_dir: str) -> DataFrame:
    received = materialize(trace.with_call(spans(spark, sf_dir)), "received")
    return materialize(trace.adapted(trace.timed(trace.latest(received, "ord"))), "spans")


def stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans per call and stage, their seconds and their events."""
    length = F.sum(F.round(F.col("t_end") * 1000) - F.round(F.col("t_start") * 1000)).cast("long")
    return adapted(spark, sf_dir).groupBy("call_id", "dialect", "stage").agg(F.count("*").alias("n_spans"), length.alias("span_ms"), F.sum(F.size("events")).alias("n_events"), F.count_if("error").alias("n_errors"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    waits = ("stt_lag_ms", "endpointing_ms", "llm_ttft_ms", "assembly_ms", "tts_ttfb_ms", "response_latency_ms", "unattributed_ms")
    digests = [F.sha2(c, 256).alias(f"{c}_sha") for c in ("transcript", "llm_spoken")]
    return trace.pipeline(spans(spark, sf_dir)).select("call_id", "turn_index", "turn_id", *waits, "tokens_out", "tts_chars", *digests)


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace.turn_metrics(materialize(trace.pipeline(spans(spark, sf_dir)), "turns"))


def trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trust per call: every third call has no recording, every fifth an incomplete one, every fourth lost spans, every seventh is direct."""
    found = trace.paired(trace.with_turns(adapted(spark, sf_dir)))
    n = F.col("conv_id")
    known = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id").distinct()
    coverage = F.when(F.pmod(n, F.lit(3)) != 0, F.when(F.pmod(n, F.lit(5)) == 0, 0.5).otherwise(0.95))
    calls = known.select(
        F.concat(F.lit("call-"), n).alias("call_id"), F.when(F.pmod(n, F.lit(7)) == 0, "s2s").otherwise("cascade").alias("engine"), F.lit(False).alias("derived"),
        (F.pmod(n, F.lit(2)) == 0).alias("audio_enabled"), coverage.alias("coverage"), F.when(F.pmod(n, F.lit(4)) == 0, 3).otherwise(0).alias("dropped"),
    )
    out = trace.trust(calls, found)
    return out.select("call_id", "coverage", F.array_join("reasons", ",").alias("reasons"), F.array_join("layers_run", ",").alias("layers_run"), "span_dropped_events", "unattributed_spans")


def timeline(found: DataFrame) -> DataFrame:
    """Rows of a call's timeline: each span in order, then its events by time, those without one last; names of events cut to 48 characters."""
    first = found.select("call_id", "span_id", "ord", "t_start", F.lit(0).alias("part"), F.col("name").alias("row_name"), F.col("t_start").alias("t"), F.when(F.col("error"), True).alias("error"))
    marks = found.select("call_id", "span_id", "ord", "t_start", F.explode("events").alias("e"))
    marks = marks.select("call_id", "span_id", "ord", "t_start", F.lit(1).alias("part"), F.substring("e.name", 1, 48).alias("row_name"), F.col("e.t").alias("t"), F.lit(None).cast("boolean").alias("error"))
    place = F.row_number().over(W.partitionBy("call_id").orderBy(F.col("t_start").asc_nulls_last(), "span_id", "part", F.col("t").asc_nulls_last(), "row_name")) - 1
    return first.unionByName(marks).select("call_id", place.alias("position"), "span_id", "row_name", "t", "error")


def timeline_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timeline(adapted(spark, sf_dir)).select("call_id", "position", "span_id", "row_name", F.round(F.col("t") * 1000).cast("long").alias("t_ms"), "error")


def support(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which calls can be analysed: every seventh's root never came, every fifth's says nothing known."""
    number = F.regexp_extract("trace_id", "([0-9]+)$", 1).cast("long")
    root = F.col("parent_span_id").isNull()
    rows = spans(spark, sf_dir).where(~(root & (number % 7 == 0))).withColumn("name", F.when(root & (number % 5 == 0), "session").otherwise(F.col("name")))
    return trace.supported(trace.with_call(rows))


QUERIES = {"trace_support": support, "trace_stages": stages, "trace_turns": turns, "trace_metrics": metrics, "trace_trust": trust, "trace_timeline": timeline_rows}

_ROWS = """with r as (select *, turn * 20000 as b, conv_id % 7 * 10 + turn % 5 as v, 'call-' || conv_id as call_id, coalesce(length(text), 0) as size
from conversations where role in ('user', 'assistant')),
"""
#: an answer belongs to the last caller row before it, else to the call's last; without any it is a turn of its own
_TURNS = (
    _ROWS
    + """u as (select * from r where role = 'user'),
a as (select r.*, coalesce((select max(u.turn) from u where u.conv_id = r.conv_id and u.turn < r.turn), (select max(u.turn) from u where u.conv_id = r.conv_id)) as heard from r where role = 'assistant'),
f as (select conv_id, heard, coalesce(heard, turn) as key, arg_min(b, turn) as ab, arg_min(v, turn) as av, arg_min(size, turn) as size, arg_min(text, turn) filter (text <> '') as text from a group by all),
k as (select conv_id, turn as key from u union select conv_id, key from f),
t as (select 'call-' || k.conv_id as call_id, row_number() over (partition by k.conv_id order by k.key) - 1 as turn_index,
  case when u.turn is null then 'a' else 'u' end || k.key as turn_id, 400 + u.v as stt_lag_ms, 300 - u.v as endpointing_ms, 700 + f.av as llm_ttft_ms, 600 - f.av as assembly_ms,
  case when f.ab is not null then 250 end as tts_ttfb_ms, case when f.ab > u.b then f.ab + 1750 - u.b - 5000 - u.v end as response_latency_ms,
  case when f.ab > u.b then f.ab + 1750 - u.b - 5000 - u.v - 2250 end as unattributed_ms, f.size % 10 * 10 as tokens_out, f.size as tts_chars,
  sha256(nullif(u.text, '')) as transcript_sha, sha256(f.text) as llm_spoken_sha
  from k left join u on u.conv_id = k.conv_id and u.turn = k.key left join f on f.conv_id = k.conv_id and f.key = k.key)
"""
)

ORACLE_SQL = {
    "trace_support": """select distinct case when conv_id % 7 = 0 then 'ca-' else 'call-' end || conv_id as call_id, case when conv_id % 7 <> 0 and conv_id % 5 <> 0 then 'livekit' end as dialect,
case when conv_id % 7 = 0 then 'no root span' when conv_id % 5 = 0 then 'no known dialect' end as problem from conversations where role in ('user', 'assistant')""",
    "trace_stages": _ROWS
    + """s as (select call_id, unnest(case when role = 'user' then [{'stage': 'turn', 'ms': 500, 'n': 0}, {'stage': 'speech', 'ms': 4000 + v, 'n': 0}, {'stage': 'stt', 'ms': 400 + v, 'n': 0}]
  else [{'stage': 'turn', 'ms': 14900, 'n': 0}, {'stage': 'llm', 'ms': 2800, 'n': 1}, {'stage': 'tts', 'ms': 7500, 'n': 0}] end) as x from r
  union all select call_id, {'stage': 'call', 'ms': max(b) + 20000, 'n': 0} from r group by 1)
select call_id, 'livekit' as dialect, x.stage as stage, count(*) as n_spans, cast(sum(x.ms) as bigint) as span_ms, cast(sum(x.n) as bigint) as n_events, 0 as n_errors from s group by all""",
    "trace_turns": _TURNS
    + """select call_id, turn_index, turn_id, cast(stt_lag_ms as double) as stt_lag_ms, cast(endpointing_ms as double) as endpointing_ms, cast(llm_ttft_ms as double) as llm_ttft_ms,
cast(assembly_ms as double) as assembly_ms, cast(tts_ttfb_ms as double) as tts_ttfb_ms, cast(response_latency_ms as double) as response_latency_ms,
cast(unattributed_ms as double) as unattributed_ms, tokens_out, tts_chars, transcript_sha, llm_spoken_sha from t""",
    "trace_metrics": _TURNS
    + """, m as (unpivot (select call_id, cast(response_latency_ms as double) as response_latency_ms, cast(llm_ttft_ms as double) as llm_ttft_ms, cast(assembly_ms as double) as assembly_ms,
  cast(tts_ttfb_ms as double) as tts_ttfb_ms, cast(unattributed_ms as double) as unattributed_ms, cast(null as double) as llm_ttft_reported_ms, cast(tts_ttfb_ms as double) as tts_ttfb_reported_ms from t)
  on columns(* exclude call_id) into name name value x),
g as (select call_id, name, list_sort(list(x)) as l from m group by all),
w as (select call_id, n.name, n.reason, l[cast(round_even(0.9 * (len(l) - 1), 0) as integer) + 1] as value_num from (select distinct call_id from t)
  cross join (select unnest(['response_latency_ms', 'llm_ttft_ms', 'assembly_ms', 'tts_ttfb_ms', 'unattributed_ms', 'llm_ttft_reported_ms', 'tts_ttfb_reported_ms']) as name, 'no spans carried this segment' as reason) n
  left join g using (call_id, name)
  union all select call_id, 'tokens_per_turn', 'vendor sent no usage', round_even(avg(tokens_out), 1) from t group by 1
  union all select call_id, 'truncation_rate', 'no tts chars', case when sum(tts_chars) > 0 then cast(0 as double) end from t group by 1
  union all select distinct call_id, 'cut_reason', 'no truncated turns', cast(null as double) from t)
select call_id, name, value_num, cast(null as varchar) as value_text, value_num is not null as available, case when value_num is null then reason end as reason from w""",
    "trace_trust": """with c as (select conv_id, count(*) filter (role in ('user', 'assistant')) as n from conversations group by 1),
f as (select *, case when conv_id % 3 <> 0 then case when conv_id % 5 = 0 then 0.5 else 0.95 end end as coverage from c)
select 'call-' || conv_id as call_id, cast(coverage as double) as coverage, array_to_string(list_filter([case when coverage is null and conv_id % 2 <> 0 then 'audio_disabled' end, case when coverage is null and conv_id % 2 = 0 then 'audio_missing' end,
  case when n = 0 and conv_id % 7 = 0 then 'trace_not_applicable' end, case when n = 0 and conv_id % 7 <> 0 then 'trace_missing' end, case when coverage < 0.8 then 'audio_partial' end,
  case when conv_id % 4 = 0 then 'telemetry_truncated' end], lambda x: x is not null), ',') as reasons,
  array_to_string(list_filter([case when coverage is not null then 'audio' end, case when n > 0 then 'events' end], lambda x: x is not null), ',') as layers_run,
  case when conv_id % 4 = 0 then 3 else 0 end as span_dropped_events, 0 as unattributed_spans from f""",
    "trace_timeline": _ROWS
    + """s as (select call_id, unnest(case when role = 'user' then [{'id': 'u' || turn, 'p': 0, 'name': 'user_turn', 'at': b + 6000, 't': b + 6000}, {'id': 's' || turn, 'p': 0, 'name': 'user_speaking', 'at': b + 1000, 't': b + 1000},
    {'id': 'e' || turn, 'p': 0, 'name': 'eou_detection', 'at': b + 5300, 't': b + 5300}]
  else [{'id': 'a' || turn, 'p': 0, 'name': 'agent_turn', 'at': b + 100, 't': b + 100}, {'id': 'l' || turn, 'p': 0, 'name': 'llm_request', 'at': b + 200, 't': b + 200},
    {'id': 'l' || turn, 'p': 1, 'name': 'llm.first_token', 'at': b + 200, 't': b + 900 + v}, {'id': 't' || turn, 'p': 0, 'name': 'tts_request', 'at': b + 1500, 't': b + 1500}] end) as x from r
  union all select distinct call_id, {'id': 'root', 'p': 0, 'name': 'agent_session', 'at': 0, 't': 0} from r)
select call_id, row_number() over (partition by call_id order by x.at, x.id, x.p, x.t, x.name) - 1 as position, x.id as span_id, x.name as row_name, x.t as t_ms, cast(null as boolean) as error from s""",
}
