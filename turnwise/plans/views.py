"""What callers read: ten curated views under a scope, and a call's whole analysis in one row.

Views are column lists over base tables, each with the way its rows are scoped.
The detail row gathers what belongs to a call; a call's turns, metrics and spans
fit into a row, as they are shown together.

Defined cases: a view whose table is not given is left out; a listed column that
a table lacks is null; a call of which nothing is known has empty lists and a
null judgment; turns without an index and spans without a position come last, and ties go by
what the rows say.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .security import Scope, secured, secured_through

# View, base table, how it is scoped, columns.
VIEWS = {
    "calls": ("call", "call", """id external_call_id agent_id source environment engine carrier stt_provider llm_provider tts_provider voice campaign_id started_at ended_at
        duration_s status terminal_reason hangup_by cost_llm cost_stt cost_tts cost_total cost_currency tokens_in tokens_out tokens_cached stt_seconds bookmarked created_at"""),
    "events": ("event", "via_call", "call_id span_id parent_span_id turn_id t_offset_s kind type name duration_s error content_text content_kind"),
    "turns": ("turn", "via_call", """call_id turn_index trigger interrupted abandoned response_latency_ms stt_lag_ms endpointing_ms llm_ttft_ms assembly_ms dispatch_ms tts_ttfb_ms
        playout_ms e2e_latency_ms language stt_confidence tokens_in tokens_out finish_reason tts_cancelled cut_reason caller_transcript llm_spoken"""),
    "utterances": ("utterance", "via_call", "call_id channel t_start_s t_end_s"),
    "metrics": ("metric", "via_call", "call_id name value_num value_text available reason"),
    "judgments": ("judgment", "via_call", """call_id disposition status sentiment objective_achieved answered_by primary_language secondary_languages script_adherence
        escalation_requested callback_requested callback_time guardrail_violation guardrail_violation_points is_failure root_cause model_fault model_fault_detail
        hallucination hallucination_detail suggested_fix summary judged_at"""),
    "clusters": ("cluster", "own", "lever cluster_key label size updated_at"),
    "call_clusters": ("call_cluster", "own_call", "call_id lever cluster_key x y"),
    "call_embeddings": ("call_embedding", "via_call", "call_id field embedding model"),
    "agents": ("agent", "agent", "id name slug"),
}
#: what the header and a turn never show
HEADER_SKIP, TURN_SKIP = ("id", "tenant_id", "prompt_id"), ("id", "call_id", "tenant_id")


def listed(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns.split()])


def agent_views(tables: Mapping[str, DataFrame], scope: Scope) -> dict[str, DataFrame]:
    """The views over the given base tables that a scope sees, by name; they go into ``security.run_sql`` as they are."""
    everywhere = Scope(scope.agents)
    out = {}
    for view, (table, how, columns) in VIEWS.items():
        if table not in tables or (how == "via_call" and "call" not in tables):
            continue
        base = tables[table]
        if how == "call":
            rows = secured(base, scope, "agent_id", "id")
        elif how == "agent":
            rows = secured(base, everywhere, "id")
        elif how == "own_call":
            rows = secured(base, scope, "agent_id", "call_id")
        elif how == "own":
            rows = secured(base, everywhere, "agent_id")
        else:
            rows = secured_through(base, secured(tables["call"], scope, "agent_id", "id").select(F.col("id").alias("call_id")), "call_id")
        out[view] = listed(rows, columns)
    return out


def shown(df: DataFrame, skip: tuple[str, ...]) -> list[str]:
    return [c for c in df.columns if c not in skip]


def metric_value(number: Column, text: Column) -> Column:
    return F.coalesce(number.cast("string"), text)


def run_reasons(status: Column, error: Column) -> Column:
    """The reasons of a partial run, blank ones left out."""
    told = F.filter(F.transform(F.split(F.coalesce(error, F.lit("")), ","), lambda r: F.trim(r)), lambda r: r != "")
    return F.when(status == "partial", told).otherwise(F.array().cast("array<string>"))


def details(call: DataFrame, turn: DataFrame, metric: DataFrame, event: DataFrame, run: DataFrame, judgment: DataFrame) -> DataFrame:
    """id, header, turns, metrics, trust, spans, judgment: one row per call.

    call: id, external_call_id, spans_complete, media_ready and more; turn: call_id,
    turn_index and more; metric: call_id, name, value_num, value_text, available,
    reason; event: call_id, kind (span or event), span_id, position, t_offset_s,
    name and more; run: call_id, started_at, status, error; judgment: call_id and
    more, one a call.
    """
    def last(c: str) -> Column:
        return F.struct(F.col(c).isNull().alias("_none"), F.col(c).alias("_at"))

    def in_order(rows: DataFrame, by: Column, fields: list[Column | str], name: str) -> DataFrame:
        placed = rows.select("call_id", by.alias("_by"), F.struct(*fields).alias("_row"))
        each = F.collect_list(F.struct("_by", "_row"))

        def tie(a: Column, b: Column) -> Column:
            x, y = F.to_json(a["_row"]), F.to_json(b["_row"])
            return F.when(x < y, -1).when(x > y, 1).otherwise(0)

        # what rows say is spelled out for ties alone
        ordered = F.array_sort(each, lambda a, b: F.when(a["_by"] < b["_by"], -1).when(a["_by"] > b["_by"], 1).otherwise(tie(a, b)))
        return placed.groupBy("call_id").agg(F.transform(ordered, lambda x: x["_row"]).alias(name))

    turns = in_order(turn, last("turn_index"), shown(turn, TURN_SKIP), "turns")
    metrics = in_order(metric, F.col("name"), ["name", metric_value(F.col("value_num"), F.col("value_text")).alias("value"), "available", "reason"], "metrics")
    place = F.struct(F.col("position").isNull().alias("_none"), F.col("position").alias("_at"), F.col("t_offset_s").alias("_t"))
    # a span and its events meet where their call's spans do, so they are shuffled once
    inner = F.when(F.col("kind") == "event", F.struct(place.alias("_by"), F.struct("name", "t_offset_s").alias("_row")))
    met = event.where("kind in ('span', 'event')").repartition("call_id").groupBy("call_id", "span_id").agg(
        F.transform(F.array_sort(F.collect_list(inner)), lambda x: x["_row"]).alias("_events"), F.collect_list(F.when(F.col("kind") == "span", F.struct(*shown(event, ("call_id", "span_id", "kind"))))).alias("_spans")
    )
    known = F.col("call_id").isNotNull() & F.col("span_id").isNotNull()  # an event of no span is in none
    nested = met.select("call_id", "span_id", F.when(known, F.col("_events")).otherwise(F.filter("_events", lambda x: F.lit(False))).alias("events"), F.inline("_spans"))
    fields = [*shown(event, ("call_id", "kind", "position")), "events"]
    spans = in_order(nested, place, fields, "spans")
    latest = run.groupBy("call_id").agg(F.max_by(F.struct("status", "error"), F.struct(F.col("started_at").isNotNull().alias("_some"), "started_at")).alias("_r"))
    covered = metric.where("name = 'capture_coverage'").select("call_id").distinct().withColumn("_audio", F.lit(True))
    judged = judgment.select("call_id", F.struct(*shown(judgment, ("call_id",))).alias("judgment"))
    header = F.struct(F.col("external_call_id").alias("id"), *shown(call, HEADER_SKIP))
    out = call.select("id", header.alias("header"), "spans_complete", "media_ready")
    for part in (turns, metrics, spans, latest, covered, judged):
        out = out.join(part.withColumnRenamed("call_id", "_of"), F.col("id") == F.col("_of"), "left").drop("_of")
    trust = F.struct("spans_complete", "media_ready", F.coalesce("_audio", F.lit(False)).alias("audio_analysis"), F.coalesce(run_reasons(F.col("_r.status"), F.col("_r.error")), F.array().cast("array<string>")).alias("reasons"))
    empty = {c: F.coalesce(c, F.array().cast(out.schema[c].dataType)) for c in ("turns", "metrics", "spans")}
    return out.withColumns(empty).select("id", "header", "turns", "metrics", trust.alias("trust"), "spans", "judgment")


def lines_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, place (unique in a call), said, long of order lines."""
    read = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    rows = read.repartition("l_orderkey").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_quantity").alias("q"))
    return rows.select(F.col("l_orderkey").alias("call_id"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("place"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("said"), (F.col("q") > 25).alias("long"))


def base_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Driver tables as base tables: orders are calls of their customer's nation, lines their turns and spans, every third order is judged."""
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("orders", "customer", "nation", "embeddings")}
    owner, lines = read["customer"].select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("agent_id")), lines_of(spark, sf_dir)
    calls = read["orders"].join(owner, "o_custkey").select(
        F.col("o_orderkey").alias("id"), F.concat(F.lit("call-"), F.col("o_orderkey").cast("string")).alias("external_call_id"), "agent_id", F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("cost_total"), (F.col("o_orderstatus") == "F").alias("spans_complete"), (F.col("o_orderkey") % 2 == 0).alias("media_ready"), F.lit("hidden").alias("prompt_id"),
    )
    told = [F.lit(True).alias("available"), F.lit(None).cast("string").alias("reason")]
    number, text, call = F.lit(None).cast("double"), F.lit(None).cast("string"), F.col("id").alias("call_id")
    metrics = calls.where("id % 2 = 0").select(call, F.lit("capture_coverage").alias("name"), (F.col("id") % 7 / 8).alias("value_num"), text.alias("value_text"), *told)
    metrics = metrics.unionByName(calls.select(call, F.lit("barge_in").alias("name"), number.alias("value_num"), F.col("status").alias("value_text"), *told))
    spans = lines.select("call_id", F.lit("span").alias("kind"), F.col("place").cast("string").alias("span_id"), "place", "said")
    inner = lines.where("long").select("call_id", F.lit("event").alias("kind"), F.col("place").cast("string").alias("span_id"), "place", F.concat(F.lit("e"), "said").alias("said"))
    themes = read["embeddings"].select(F.col("label").alias("agent_id"), F.col("vec_id").alias("call_id"), F.lit("summary").alias("lever"), (F.col("vec_id") % 3).alias("cluster_key"))
    return {
        "call": calls,
        "turn": lines.select("call_id", F.col("place").alias("turn_index"), F.col("said").alias("caller_transcript")),
        "event": spans.unionByName(inner).select("call_id", "kind", "span_id", F.when(F.col("place") % 5 != 0, F.col("place")).alias("position"), F.col("place").cast("double").alias("t_offset_s"), F.col("said").alias("name")),
        "metric": metrics,
        "judgment": calls.where("id % 3 = 0").select(call, F.lit("connected").alias("disposition"), (F.col("id") % 9 == 0).alias("is_failure")),
        "call_cluster": themes,
        "cluster": themes.groupBy("agent_id", "lever", "cluster_key").agg(F.count("*").alias("size")),
        "agent": read["nation"].select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")),
    }


VISIBLE = (3, 7, 11)


def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of every view, for members of three agents, and for one call of them."""
    tables, out = base_tables(spark, sf_dir), None
    for name, scope in (("agents", Scope.of(VISIBLE)), ("call", Scope.of(VISIBLE, call_id=33)), ("none", Scope(None))):
        for view, rows in agent_views(tables, scope).items():
            one = rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("scope"), F.lit(view).alias("view"), "n", F.lit(len(rows.columns)).alias("columns"))
            out = one if out is None else out.unionByName(one)
    return out


def call_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every call's analysis with its parts as text."""
    tables = base_tables(spark, sf_dir)
    run = tables["call"].select(F.col("id").alias("call_id"), F.lit(None).cast("timestamp").alias("started_at"), F.when(F.col("id") % 4 == 0, "partial").otherwise("ok").alias("status"), F.concat(F.lit(" a,, "), "status").alias("error"))
    rows = details(tables["call"], tables["turn"], tables["metric"], tables["event"], run, tables["judgment"])
    span = F.transform("spans", lambda s: F.concat(s.span_id, F.lit(":"), s["name"], F.lit("("), F.array_join(F.transform(s.events, lambda e: e["name"]), ","), F.lit(")")))
    trust = [F.col(f"trust.{c}").cast("string") for c in ("spans_complete", "media_ready", "audio_analysis")]
    return rows.select(
        "id",
        F.concat_ws("|", "header.id", "header.status").alias("header"),
        F.array_join(F.transform("turns", lambda t: F.concat(t.turn_index.cast("string"), F.lit(":"), t.caller_transcript)), ",").alias("turns"),
        F.array_join(F.transform("metrics", lambda m: F.concat_ws("=", m["name"], m["value"])), ",").alias("metrics"),
        F.concat_ws("|", *trust, F.array_join("trust.reasons", ",")).alias("trust"),
        F.array_join(span, ";").alias("spans"),
        F.concat_ws("|", "judgment.disposition", F.col("judgment.is_failure").cast("string")).alias("judgment"),
    )


QUERIES = {"agent_views": view_counts, "call_detail": call_detail}

_WIDTHS = ", ".join(f"('{view}', {len(columns.split())})" for view, (_, _, columns) in VIEWS.items())
_LINES = """with l as (select l_orderkey as id, l_linenumber * 100000000 + l_partkey as place, 'p' || l_partkey as said, max(l_quantity) > 25 as long from lineitem group by l_orderkey, l_linenumber, l_partkey),
c as (select o_orderkey as id, c_nationkey as agent_id, o_orderstatus as status from orders join customer on c_custkey = o_custkey)"""
ORACLE_SQL = {
    "agent_views": f"""{_LINES}, s as (select 'agents' as scope, [3, 7, 11] as a, null as one union all select 'call', [3, 7, 11], 33 union all select 'none', [], null),
v as (select scope, c.id from s join c on list_contains(a, agent_id) and (one is null or id = one)),
n as (select scope, 'calls' as view, id as x from v union all select scope, 'turns', id from v join l using (id) union all select scope, 'events', id from v join l using (id)
union all select scope, 'events', id from v join l using (id) where long union all select scope, 'metrics', id from v union all select scope, 'metrics', id from v where id % 2 = 0
union all select scope, 'judgments', id from v where id % 3 = 0 union all select scope, 'call_clusters', vec_id from s join embeddings on list_contains(a, label) and (one is null or vec_id = one)
union all (select distinct on (scope, label, vec_id % 3) scope, 'clusters', label from s join embeddings on list_contains(a, label)) union all select scope, 'agents', n_nationkey from s join nation on list_contains(a, n_nationkey)),
w as (select * from (values {_WIDTHS}) t(view, columns))
select s.scope, w.view, count(n.x) as n, w.columns from s cross join w left join n on n.scope = s.scope and n.view = w.view where w.view not in ('utterances', 'call_embeddings') group by all""",
    "call_detail": f"""{_LINES}, t as (select id, string_agg(place || ':' || said, ',' order by place) as turns,
string_agg(place || ':' || said || '(' || case when long then 'e' || said else '' end || ')', ';' order by place % 5 = 0, place) as spans from l group by 1)
select id, 'call-' || id || '|' || status as header, coalesce(turns, '') as turns, 'barge_in=' || status || case when id % 2 = 0 then ',capture_coverage=' || cast(id % 7 / 8 as double) else '' end as metrics,
(status = 'F') || '|' || (id % 2 = 0) || '|' || (id % 2 = 0) || '|' || case when id % 4 = 0 then 'a,' || status else '' end as trust, coalesce(spans, '') as spans,
case when id % 3 = 0 then 'connected|' || (id % 9 = 0) else '' end as judgment from c left join t using (id)""",
}
