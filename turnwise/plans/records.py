"""Call records: upserts, rewrites, erasure, versions, rollups and object rules as table plans.

A write is a new table from the old one and a batch, so a lost executor repeats
its part and a repeated batch changes nothing. Events and order lines stand in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import half_even


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BACKFILLED = ("trace_id", "agent_id")
#: what a call gets at its creation and keeps, with the value for none
FIXED = {"source": "unknown", "environment": "prod"}


def upserted(batches: DataFrame, scripts: DataFrame | None = None) -> DataFrame:
    """Calls from their batches: call_id, trace_id, agent_id, source, environment, has_root, at, ord.

    Known calls are batches of lower order. A batch whose call_id is its trace_id
    names no call: it belongs to the call of its trace. Calls of one trace are one
    call under the last name that a batch gave it, so a call first known by its
    trace takes its real id and keeps it when later batches name none. Trace and
    agent are the first known ones, source and environment those of the first
    batch. A root seen once completes the spans. ``scripts`` (agent_id, prompt_id,
    one row an agent) gives the prompt in force. Rows without a call id go. A call
    of many batches is added up before each of the two shuffles.
    """
    named = F.nullif("call_id", F.coalesce("trace_id", F.lit("")))
    # a first value keeps its own order, by which the calls of a trace are compared
    dated = [F.min(F.when(F.col(c).isNotNull(), F.struct("ord", c))).alias(c) for c in BACKFILLED]
    dated += [F.min(F.struct("ord", *FIXED)).alias("made"), F.max(F.when(named.isNotNull(), F.struct("ord", named.alias("name")))).alias("named")]
    summed = [F.max("has_root").alias("has_root"), F.max("at").alias("at")]
    known = batches.where("call_id is not null").groupBy("call_id").agg(*dated, *summed)
    key = F.struct(F.col("trace_id").isNull().alias("alone"), F.coalesce("trace_id.trace_id", "call_id").alias("id"))
    calls = known.groupBy(key.alias("key")).agg(*[F.min(c).alias(c) for c in (*BACKFILLED, "made")], F.max("named").alias("named"), *summed)
    out = calls.select(
        F.coalesce("named.name", "key.id").alias("call_id"),
        *[F.col(f"{c}.{c}") for c in BACKFILLED],
        *[F.coalesce(f"made.{c}", F.lit(default)).alias(c) for c, default in FIXED.items()],
        F.coalesce("has_root", F.lit(False)).alias("spans_complete"),
        F.col("at").alias("last_activity_at"),
    )
    return out if scripts is None else out.join(scripts.select("agent_id", "prompt_id"), "agent_id", "left")


def replaced(existing: DataFrame, derived: DataFrame, key: str, recomputed: DataFrame) -> DataFrame:
    """Existing rows of other calls, and the new rows of the recomputed ones; a recomputed call without rows has none."""
    done = recomputed.select(key).distinct()
    kept = existing.join(done, key, "left_anti")
    return kept.unionByName(derived.join(done, key, "left_semi").select(*existing.columns))


def erased(tables: dict[str, DataFrame], tombstones: DataFrame, key: str) -> dict[str, DataFrame]:
    """Every table without the rows of erased calls. Rows of a null key stay."""
    return {name: rows.join(tombstones, key, "left_anti") for name, rows in tables.items()}


def bumped(configs: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """(key, body, version) after updates (key, body, ord): each adds one to its key's version and the last one's body stays."""
    new = updates.groupBy(key).agg(F.max_by("body", "ord").alias("_body"), F.count("*").alias("_n"))
    both = configs.join(new, key, "full")
    version = F.coalesce("version", F.lit(0)) + F.coalesce("_n", F.lit(0))
    return both.select(key, F.when(F.col("_n").isNotNull(), F.col("_body")).otherwise(F.col("body")).alias("body"), version.cast("long").alias("version"))


def by_first_rule(objects: DataFrame, path: str, rules: list[tuple[str, str]]) -> DataFrame:
    """Objects with kind and call_id by the first rule (kind, pattern with one group) that matches.

    An object whose first matching rule captures nothing goes, as does one that
    no rule matches; later rules are not asked.
    """
    found = F.lit(None).cast("struct<kind:string,call_id:string>")
    for kind, pattern in reversed(rules):
        hit = F.struct(F.lit(kind).alias("kind"), F.regexp_extract(path, pattern, 1).alias("call_id"))
        found = F.when(F.col(path).rlike(pattern), hit).otherwise(found)
    return objects.withColumn("_rule", found).where("_rule.call_id <> ''").select("*", "_rule.kind", "_rule.call_id").drop("_rule")


def rolled_up(spans: DataFrame) -> DataFrame:
    """Models and engine per call from spans (call_id, ord, stage, model).

    The first named model of a stage counts, for speech to text that of a turn
    span where none of its own has one. Separate STT or TTS beside LLM spans make
    a cascade, LLM spans alone s2s; without one the engine is null.
    """

    def model(stage: str) -> Column:
        named = (F.col("stage") == stage) & (F.coalesce("model", F.lit("")) != "")
        return F.min_by("model", F.when(named, F.col("ord")))

    def has(*stages: str) -> Column:
        return F.coalesce(F.max(F.col("stage").isin(*stages)), F.lit(False))

    engine = F.when(has("llm"), F.when(has("stt", "tts"), "cascade").otherwise("s2s"))
    return spans.groupBy("call_id").agg(F.coalesce(model("stt"), model("turn")).alias("stt_provider"), model("llm").alias("llm_provider"), model("tts").alias("tts_provider"), engine.alias("engine"))


def token_sums(turns: DataFrame, *fields: str) -> DataFrame:
    """Sums per call; a sum of zero is null."""
    return turns.groupBy("call_id").agg(*[F.nullif(F.coalesce(F.sum(c), F.lit(0)), F.lit(0)).alias(c) for c in fields])


def clock_residuals(turns: DataFrame) -> DataFrame:
    """Signed milliseconds from the heard start to the span's, per call in turn order, with their mean; turns without both times give none."""
    off = half_even((F.col("tts_first_audio_at") - F.col("audio_out_start_s")) * 1000, 1)
    rows = turns.select("call_id", "turn_index", off.alias("off")).where("off is not null")
    series = F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "off"))), lambda x: x.off)
    return rows.groupBy("call_id").agg(series.alias("residuals_ms"), half_even(F.avg("off"), 1).alias("mean_ms"))


def agreement(heard: Column, told: Column) -> Column:
    """The smaller of two counts over the larger: 1 when both are zero, null when one is unknown."""
    most = F.greatest(heard, told)
    return F.when(heard.isNull() | told.isNull(), None).when(most == 0, 1.0).otherwise(half_even(F.least(heard, told) / most, 4))


def slug(name: Column, fallback: str = "org") -> Column:
    """Lower-case runs of ASCII letters and digits joined by hyphens."""
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", "-"), F.lit("-"))
    return F.when(clean == "", fallback).otherwise(clean)


def tolerant_int(text: Column) -> Column:
    """A whole number with blanks around it and single underscores between digits; anything else, 4.2 as well, is null."""
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+(_[0-9]+)*\s*$"), F.regexp_replace(text, r"[\s_]", "").try_cast("bigint"))


def params_rows(uploads: DataFrame, key: str) -> DataFrame:
    """(upload_id, key, params) from rows (upload_id, cells: map): blanks around values go, rows whose key is blank or missing too."""
    clean = F.transform_values("cells", lambda _, v: F.trim(v))
    return uploads.select("upload_id", clean.alias("params")).withColumn("key", F.try_element_at("params", F.lit(key))).where("key <> ''")


def call_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as batches of their user's calls: every 16th user's are provisional and known by the trace until a purchase names them."""
    n, user = F.col("event_id"), F.col("user_id").cast("string")
    trace_id, buys = F.concat(F.lit("trace-"), user), F.col("event_type") == "purchase"
    batches = table(spark, sf_dir, "events").select(
        F.when((F.col("user_id") % 16 == 0) & ~buys, trace_id).otherwise(F.concat(F.lit("call-"), user)).alias("call_id"),
        F.when((F.col("user_id") % 16 == 0) | (n % 3 == 0), trace_id).alias("trace_id"), F.when(n % 4 == 0, F.col("event_type")).alias("agent_id"),
        F.when(n % 5 != 0, F.col("event_type")).alias("source"), F.when(n % 7 == 0, "dev").alias("environment"), buys.alias("has_root"), n.alias("at"), n.alias("ord"),
    )
    kinds = spark.createDataFrame([("click", "p1"), ("view", "p2")], "agent_id string, prompt_id string")
    return upserted(batches, kinds)


def derived_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every tenth order are computed anew: only those above ten pieces stay."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    again = table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("l_orderkey"))
    return replaced(lines, lines.where("l_quantity > 10"), "l_orderkey", again)


def erase_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and their lines after every 13th order is erased."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call"), F.col("o_totalprice").alias("amount"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("call"), F.col("l_quantity").alias("amount"))
    left = erased({"calls": orders, "turns": lines}, orders.where("call % 13 = 0").select("call"), "call")
    parts = [rows.agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("amount")).select(F.lit(name).alias("name"), "n", "amount") for name, rows in left.items()]
    return parts[0].unionByName(parts[1])


def config_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of customers with debts are configs of version 1, orders of all are updates and make new ones."""
    old = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("agent_id"), F.col("c_mktsegment").alias("body"), F.lit(1).alias("version"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("agent_id"), F.col("o_orderpriority").alias("body"), F.col("o_orderkey").alias("ord"))
    return bumped(old, new, "agent_id")


#: kinds with their patterns, the first match counts
RULES = [("tagged", r"/en/([0-9]*)\?utm"), ("english", r"/en/([0-9]+)"), ("spanish", r"/es/([0-9]+)"), ("other", r"/([0-9]+)(?:[?#]|$)")]


def manifest_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = by_first_rule(table(spark, sf_dir, "pages").select("page_id", "url"), "url", RULES)
    return found.select("page_id", "kind", "call_id")


def call_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as spans: the line number gives the stage, returned lines name no model; quantities are tokens."""
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "call_id")
    stage = F.element_at(F.array(*map(F.lit, ("turn", "llm", "stt", "tts"))), (F.col("l_linenumber") % 4 + 1).cast("int"))
    ord_ = F.struct("l_linenumber", "l_partkey")
    spans = lines.select("call_id", ord_.alias("ord"), stage.alias("stage"), F.when(F.col("l_returnflag") != "R", F.concat(F.lit("m-"), F.col("l_partkey").cast("string"))).alias("model"))
    turns = lines.select("call_id", F.col("l_quantity").cast("long").alias("tokens_out"), F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("long")).alias("tokens_cached"))
    return rolled_up(spans).join(token_sums(turns, "tokens_out", "tokens_cached"), "call_id")


def residual_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residuals per user over its events: times in eighths of a second, every seventh unheard."""
    n = F.col("event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("call_id"), n.alias("turn_index"), (n % 16 / 8).alias("tts_first_audio_at"), F.when(n % 7 != 0, n % 5 / 4).alias("audio_out_start_s")
    )
    return clock_residuals(rows).withColumn("residuals_ms", F.array_join(F.transform("residuals_ms", lambda x: x.cast("long").cast("string")), ","))


def barge_in_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as heard and errors as told barge-ins of a user; users without a purchase have no audio."""
    kind = F.col("event_type")
    per = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(kind == "click").alias("heard"), F.count_if(kind == "error").alias("told"), F.count_if(kind == "purchase").alias("audio"))
    return per.select("user_id", agreement(F.when(F.col("audio") > 0, F.col("heard")), F.col("told")).alias("agreement"))


def slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages").select("page_id", slug(F.regexp_replace("url", "^https?", "")).alias("slug"))
    return rows.withColumn("identifier", F.regexp_replace(F.lower("slug"), "[^a-z0-9_]", "_"))


def tolerant_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id").cast("string")
    forms = F.array(n, F.concat(F.lit(" +"), n, F.lit(" ")), F.concat(n, F.lit(".5")), F.concat(F.lit("1_0"), n), F.concat(n, F.lit("_")), F.lit(""), F.lit(None))
    return table(spark, sf_dir, "events").select("event_id", tolerant_int(F.get(forms, (F.col("event_id") % 7).cast("int"))).alias("number"))


QUERIES = {
    "call_upsert": call_upsert,
    "derived_replace": derived_replace,
    "erase_calls": erase_calls,
    "config_versions": config_versions,
    "manifest_rules": manifest_rules,
    "call_rollup": call_rollup,
    "clock_residuals": residual_series,
    "barge_in_agreement": barge_in_agreement,
    "slugs": slugs,
    "tolerant_ints": tolerant_ints,
}

ORACLE_SQL = {
    "call_upsert": """with b as (select event_id as n, user_id, case when user_id % 16 <> 0 or event_type = 'purchase' then 'call-' || user_id end as name,
case when user_id % 16 = 0 or event_id % 3 = 0 then 'trace-' || user_id end as trace_id, case when event_id % 4 = 0 then event_type end as agent_id,
coalesce(case when event_id % 5 <> 0 then event_type end, 'unknown') as source, case when event_id % 7 = 0 then 'dev' else 'prod' end as environment, event_type = 'purchase' as buys from events),
c as (select coalesce(arg_max(name, n) filter (name is not null), max(trace_id)) as call_id, max(trace_id) as trace_id, arg_min(agent_id, n) filter (agent_id is not null) as agent_id,
arg_min(source, n) as source, arg_min(environment, n) as environment, bool_or(buys) as spans_complete, max(n) as last_activity_at from b group by user_id)
select c.*, case agent_id when 'click' then 'p1' when 'view' then 'p2' end as prompt_id from c""",
    "derived_replace": "select l_orderkey, l_linenumber, l_quantity from lineitem where not coalesce(l_orderkey in (select o_orderkey from orders where o_orderkey % 10 = 0), false) or l_quantity > 10",
    "erase_calls": """select 'calls' as name, count(*) as n, round(sum(o_totalprice), 2) as amount from orders where o_orderkey % 13 <> 0
union all select 'turns', count(*), round(sum(l_quantity), 2) from lineitem where l_orderkey not in (select o_orderkey from orders where o_orderkey % 13 = 0)""",
    "config_versions": """with n as (select o_custkey, arg_max(o_orderpriority, o_orderkey) as body, count(*) as k from orders group by 1), o as (select * from customer where c_acctbal < 0)
select coalesce(c_custkey, o_custkey) as agent_id, coalesce(body, c_mktsegment) as body, coalesce(k, 0) + case when c_custkey is null then 0 else 1 end as version from o full join n on c_custkey = o_custkey""",
    "manifest_rules": r"""with r as (select page_id, case when regexp_matches(url, '/en/([0-9]*)\?utm') then ['tagged', regexp_extract(url, '/en/([0-9]*)\?utm', 1)] when regexp_matches(url, '/en/([0-9]+)') then ['english', regexp_extract(url, '/en/([0-9]+)', 1)]
when regexp_matches(url, '/es/([0-9]+)') then ['spanish', regexp_extract(url, '/es/([0-9]+)', 1)] when regexp_matches(url, '/([0-9]+)(?:[?#]|$)') then ['other', regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1)] end as m from pages)
select page_id, m[1] as kind, m[2] as call_id from r where m[2] <> ''""",
    "call_rollup": """with s as (select l_orderkey as call_id, (['turn', 'llm', 'stt', 'tts'])[l_linenumber % 4 + 1] as stage, case when l_returnflag <> 'R' then 'm-' || l_partkey end as model, row(l_linenumber, l_partkey) as o, l_quantity, l_linestatus from lineitem)
select call_id, coalesce(arg_min(model, o) filter (stage = 'stt' and model is not null), arg_min(model, o) filter (stage = 'turn' and model is not null)) as stt_provider, arg_min(model, o) filter (stage = 'llm' and model is not null) as llm_provider,
arg_min(model, o) filter (stage = 'tts' and model is not null) as tts_provider, case when bool_or(stage = 'llm') then case when bool_or(stage in ('stt', 'tts')) then 'cascade' else 's2s' end end as engine,
cast(nullif(sum(l_quantity), 0) as bigint) as tokens_out, cast(nullif(sum(l_quantity) filter (l_linestatus = 'F'), 0) as bigint) as tokens_cached from s group by 1""",
    "clock_residuals": """with r as (select user_id as call_id, event_id as n, (event_id % 16 / 8 - event_id % 5 / 4) * 1000 as d from events where event_id % 7 <> 0)
select call_id, string_agg(cast(d as bigint), ',' order by n) as residuals_ms, round_even(avg(d), 1) as mean_ms from r group by 1""",
    "barge_in_agreement": """with p as (select user_id, count(*) filter (event_type = 'click') as h, count(*) filter (event_type = 'error') as t, count(*) filter (event_type = 'purchase') as a from events group by 1)
select user_id, case when a = 0 then null when greatest(h, t) = 0 then 1.0 else round_even(least(h, t) / greatest(h, t), 4) end as agreement from p""",
    "slugs": """with s as (select page_id, coalesce(nullif(trim(regexp_replace(lower(regexp_replace(coalesce(url, ''), '^https?', '')), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'org') as slug from pages)
select page_id, slug, regexp_replace(slug, '[^a-z0-9_]', '_', 'g') as identifier from s""",
    "tolerant_ints": """select event_id, case event_id % 7 when 0 then event_id when 1 then event_id when 3 then cast('10' || event_id as bigint) end as number from events""",
}
