"""What producers register: artifacts, prompts, transcripts, calls without spans, discrepancies, agents' names.

Each write is a new table from the old one and a batch of arrivals in an order
(``ord``), so a repeated batch changes nothing. A batch has the outcome of its
rows taken one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import ranked
from .records import replaced, slug
from .truth import first_audio, material

MEDIA = ("call_id", "kind", "uri", "sha256")
#: fixed values of a call that is made for its recording alone
AUDIO_ONLY = {"source": "backfill", "environment": "prod", "status": "awaiting_media", "analysis_mode": "audio-only"}
LONGEST = 18  # digits of a suffix that can be reached


def last(value: str, counts: Column) -> Column:
    """The value of the last row by ``ord`` that counts."""
    return F.max_by(value, F.when(counts, F.col("ord")))


def registered(calls: DataFrame, media: DataFrame, arrivals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls and media after arrivals (call_id, kind, uri, sha256, channel_map, sample_rate, t0_offset_s, at, ord).

    A call, kind and digest stands once: the one stored, else the first to come;
    a missing digest equals a missing one. Arrivals of unknown calls go. A new
    recording, whose kind begins with audio, makes its call ready and, where its
    spans are complete, ingested; an empty channel map or rate keeps the old one.
    """
    key = ["call_id", "kind", F.coalesce("sha256", F.lit("")).alias("_sha"), F.col("sha256").isNull().alias("_none")]
    told = arrivals.join(calls.select("call_id"), "call_id", "left_semi").groupBy(*key).agg(F.min_by(F.struct(*arrivals.columns), "ord").alias("_row"))
    new = told.join(media.select(*key), ["call_id", "kind", "_sha", "_none"], "left_anti").select("_row.*")
    sound = F.col("kind").startswith("audio")
    change = new.groupBy("call_id").agg(
        F.max(sound).alias("_sound"),
        last("channel_map", sound & (F.col("channel_map") != "")).alias("_map"),
        last("sample_rate", sound & (F.col("sample_rate") != 0)).alias("_rate"),
        last("t0_offset_s", sound & F.col("t0_offset_s").isNotNull()).alias("_t0"),
        F.max("at").alias("_at"),
    )
    sound = F.coalesce("_sound", F.lit(False))
    after = {
        "media_ready": F.when(sound, True).otherwise(F.col("media_ready")),
        "channel_map": F.coalesce("_map", "channel_map"),
        "sample_rate": F.coalesce("_rate", "sample_rate"),
        "t0_offset_s": F.coalesce("_t0", "t0_offset_s"),
        "status": F.when(sound & F.col("spans_complete"), "ingested").otherwise(F.col("status")),
        "last_activity_at": F.coalesce("_at", "last_activity_at"),
    }
    return calls.join(change, "call_id", "left").withColumns(after).select(*calls.columns), media.select(*MEDIA).unionByName(new.select(*MEDIA))


def prompts_added(prompts: DataFrame, arrivals: DataFrame) -> DataFrame:
    """(template_sha256, text, created): stored prompts, and of each digest not stored the first arrival (template_sha256, text, ord); without a digest none."""
    new = arrivals.where("template_sha256 is not null").groupBy("template_sha256").agg(F.min_by("text", "ord").alias("text"))
    new = new.join(prompts, "template_sha256", "left_anti")
    return prompts.select("template_sha256", "text", F.lit(False).alias("created")).unionByName(new.withColumn("created", F.lit(True)))


def transcripts_replaced(stored: DataFrame, uploads: DataFrame) -> DataFrame:
    """(call_id, source, format, content, uri): of each call the last upload (by ord) as a whole, its nulls too, else what is stored."""
    fields = ["source", "format", "content", "uri"]
    new = uploads.where("call_id is not null").groupBy("call_id").agg(F.max_by(F.struct(*fields), "ord").alias("_row")).select("call_id", "_row.*")
    return stored.select("call_id", *fields).join(new, "call_id", "left_anti").unionByName(new)


def discrepancies(existing: DataFrame, checks: DataFrame, analysed: DataFrame) -> DataFrame:
    """Discrepancies after calls were analysed again: theirs are the material checks alone. A call whose checks failed is not among the analysed and keeps its own."""
    return replaced(existing, material(checks), "call_id", analysed)


def ensured(calls: DataFrame, wanted: DataFrame) -> DataFrame:
    """Calls, and one for each id of wanted (external_call_id, agent_id, at, ord) that there is none of; the first asker's agent counts."""
    new = wanted.where("external_call_id is not null").groupBy("external_call_id").agg(F.min_by(F.struct("agent_id", "at"), "ord").alias("_row"))
    new = new.join(calls, "external_call_id", "left_anti")
    made = {"agent_id": F.col("_row.agent_id"), "last_activity_at": F.col("_row.at"), **{c: F.lit(v) for c, v in AUDIO_ONLY.items()}}
    return calls.unionByName(new.withColumns(made).drop("_row"), allowMissingColumns=True).select(*calls.columns)


def unsent(calls: DataFrame, since: Column, sent: DataFrame, agent_id: object = None) -> DataFrame:
    """Calls made since then that are done, for better or worse, and not among those sent (call_id)."""
    done = calls.where((F.col("created_at") >= since) & F.col("status").isin("ingested", "failed"))
    return (done if agent_id is None else done.where(F.col("agent_id") == agent_id)).join(sent.select("call_id"), "call_id", "left_anti")


def free_slugs(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (org, name, ord) with the slug that each gets: its own, or the first free of -2, -3 and so on.

    A batch is taken in the order of ord, but a row that asks for a slug such as
    a-2 goes before one that would be given it. Then what a slug's rows find
    taken is known beforehand: taken (org, slug), and all slugs asked for. The
    k-th row of a slug gets its k-th free number: with the numbers taken sorted
    by how many free ones lie below, that is its place among both, so a slug that
    any number of rows ask for is ranked in ranges. Rows of no org go.
    """
    asked = wanted.where("org is not null").withColumn("base", slug(F.col("name")))
    bases = asked.select("org", "base").distinct()
    names = taken.where("org is not null and slug is not null").select("org", "slug").distinct()
    suffixed = names.union(bases.select("org", F.col("base").alias("slug"))).distinct().select("org", F.regexp_extract("slug", rf"^(.*)-([1-9][0-9]{{0,{LONGEST - 1}}})$", 1).alias("base"), F.regexp_extract("slug", rf"-([1-9][0-9]{{0,{LONGEST - 1}}})$", 1).try_cast("long").alias("m"))
    held = suffixed.where("m >= 2").union(names.select("org", F.col("slug").alias("base"), F.lit(1).cast("long").alias("m"))).join(bases, ["org", "base"], "left_semi")
    held = ranked(held, ["org", "base"], ["m"], "i").select("org", "base", (F.col("m") - F.col("i")).alias("below"), F.lit(0).alias("asks"), F.col("i").cast("long").alias("tie"), F.lit(None).cast(wanted.schema["name"].dataType).alias("name"), F.lit(None).cast(wanted.schema["ord"].dataType).alias("ord"))
    rows = ranked(asked.select("org", "base", "name", "ord"), ["org", "base"], ["ord", "name"], "k")
    rows = rows.select("org", "base", (F.col("k") - 1).cast("long").alias("below"), F.lit(1).alias("asks"), F.col("k").cast("long").alias("tie"), "name", "ord")
    both = ranked(held.unionByName(rows), ["org", "base"], ["below", "asks", "tie"], "number").where("asks = 1")
    return both.select("org", "name", "ord", F.when(F.col("number") == 1, F.col("base")).otherwise(F.concat("base", F.lit("-"), F.col("number").cast("string"))).alias("slug"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max("l_suppkey").alias("s"), F.max("l_quantity").alias("q"))
    return rows.select(F.col("l_orderkey").alias("call_id"), (F.col("l_linenumber") * 100_000_000 + F.col("l_partkey")).alias("ord"), F.col("l_partkey").alias("p"), "s", "q")


def artifact_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as artifacts of their orders, of a call's few digests; those of every fifth supplier are stored."""
    kinds = F.array(*map(F.lit, ("audio", "audio_caller", "otlp", "transcript")))
    told = lines(spark, sf_dir).select(
        "call_id", F.get(kinds, (F.col("p") % 4).cast("int")).alias("kind"), F.col("ord").cast("string").alias("uri"), F.when(F.col("p") % 7 != 0, F.concat(F.lit("s"), (F.col("s") % 3).cast("string"))).alias("sha256"),
        F.when(F.col("p") % 3 == 0, "").when(F.col("p") % 3 == 1, F.concat(F.lit("m"), F.col("p").cast("string"))).alias("channel_map"), ((F.col("q") % 4) * 8000).cast("long").alias("sample_rate"),
        F.when(F.col("p") % 5 == 0, F.col("q") / 8).alias("t0_offset_s"), F.col("ord").alias("at"), "ord", "s",
    )
    orders = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("call_id"), F.col("o_orderstatus").alias("status"), (F.col("o_orderkey") % 2 == 0).alias("spans_complete"), F.lit(False).alias("media_ready"), F.lit("old").alias("channel_map"),
        F.lit(16000).cast("long").alias("sample_rate"), F.lit(None).cast("double").alias("t0_offset_s"), F.lit(0).cast("long").alias("last_activity_at"),
    )
    calls, media = registered(orders, told.where("s % 5 = 0").dropDuplicates(["call_id", "kind", "sha256"]).select(*MEDIA), told.where("s % 5 <> 0").drop("s"))
    return calls.join(media.groupBy("call_id").agg(F.count("*").alias("n_media")), "call_id", "left")


def prompt_register(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as prompts under their digests: every third document's is stored, all others arrive."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("template_sha256"), F.col("doc_id").cast("string").alias("text"), F.col("doc_id").alias("ord"))
    stored = docs.where("doc_id % 3 = 0").groupBy("template_sha256").agg(F.min_by("text", "ord").alias("text"))
    return prompts_added(stored, docs.where("doc_id % 3 <> 0"))


def discrepancy_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as turns whose audio is told and heard in eighths of a second; every tenth order is analysed anew with later times."""
    turns = lines(spark, sf_dir).select("call_id", F.col("ord").alias("turn_index"), (F.col("q") / 8).alias("audio_out_start_s"), F.when(F.col("p") % 6 != 0, (F.col("q") + F.col("p") % 4) / 8).alias("tts_first_audio_at"))
    again = turns.where("call_id % 10 = 0").withColumn("tts_first_audio_at", F.col("tts_first_audio_at") - 0.125)
    return discrepancies(material(first_audio(turns)), first_audio(again), table(spark, sf_dir, "orders").where("o_orderkey % 10 = 0").select(F.col("o_orderkey").alias("call_id")))


def audio_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders that are done are calls; the recordings of all lines ask for theirs."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(
        F.col("o_orderkey").alias("external_call_id"), F.col("o_custkey").alias("agent_id"), F.lit("live").alias("source"), F.lit("dev").alias("environment"), F.lit("ingested").alias("status"), F.lit("spans").alias("analysis_mode"), F.lit(0).cast("long").alias("last_activity_at")
    )
    return ensured(done, lines(spark, sf_dir).select(F.col("call_id").alias("external_call_id"), F.col("p").alias("agent_id"), F.col("ord").alias("at"), "ord"))


def unsent_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as calls of a backfill that began in 1997; every fourth was sent."""
    status = F.when(F.col("o_orderstatus") == "F", "failed").when(F.col("o_orderstatus") == "O", "ingested").otherwise("open")
    calls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("call_id"), F.col("o_orderdate").alias("created_at"), status.alias("status"))
    return unsent(calls, F.lit("1997-01-01").cast("timestamp_ntz"), calls.where("call_id % 4 = 0")).select("call_id", "status")


def agent_slugs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers without debts as agents of their nation, named by segment, some with a number; customers with debts hold names."""
    c, name = table(spark, sf_dir, "customer"), F.lower("c_mktsegment")
    held = c.where("c_acctbal < 0").select(F.col("c_nationkey").alias("org"), F.when(F.col("c_custkey") % 9 == 0, name).otherwise(F.concat(name, F.lit("-"), (F.col("c_custkey") % 9 + 1).cast("string"))).alias("slug"))
    asks = F.when(F.col("c_custkey") % 4 == 0, F.concat(F.initcap("c_mktsegment"), F.lit(" "), (F.col("c_custkey") % 6).cast("string"))).otherwise(F.col("c_mktsegment"))
    return free_slugs(c.where("c_acctbal >= 0").select(F.col("c_nationkey").alias("org"), asks.alias("name"), F.col("c_custkey").alias("ord")), held)


QUERIES = {
    "artifact_register": artifact_register,
    "prompt_register": prompt_register,
    "discrepancy_rewrite": discrepancy_rewrite,
    "audio_calls": audio_calls,
    "unsent_calls": unsent_calls,
    "agent_slugs": agent_slugs,
}

_LINES = "l as (select l_orderkey as id, l_linenumber * 100000000 + l_partkey as o, l_partkey as p, max(l_suppkey) as s, max(l_quantity) as q from lineitem group by l_orderkey, l_linenumber, l_partkey)"
ORACLE_SQL = {
    "artifact_register": f"""with {_LINES}, a as (select *, (['audio', 'audio_caller', 'otlp', 'transcript'])[p % 4 + 1] as kind, case when p % 7 <> 0 then 's' || (s % 3) end as sha, cast(q % 4 * 8000 as bigint) as rate,
case p % 3 when 1 then 'm' || p end as map, case when p % 5 = 0 then q / 8 end as t0 from l where id in (select o_orderkey from orders)),
m as (select *, row_number() over (partition by id, kind, sha order by s % 5 <> 0, o) as first from a), n as (select * from m where first = 1), w as (select * from n where s % 5 <> 0),
c as (select id, bool_or(kind like 'audio%') as sound, arg_max(map, o) filter (kind like 'audio%' and map is not null) as map, arg_max(rate, o) filter (kind like 'audio%' and rate <> 0) as rate,
arg_max(t0, o) filter (kind like 'audio%' and t0 is not null) as t0, max(o) as latest from w group by 1), k as (select id, count(*) as n from n group by 1)
select o_orderkey as call_id, case when sound and o_orderkey % 2 = 0 then 'ingested' else o_orderstatus end as status, o_orderkey % 2 = 0 as spans_complete, coalesce(sound, false) as media_ready, coalesce(map, 'old') as channel_map,
coalesce(rate, 16000) as sample_rate, t0 as t0_offset_s, coalesce(latest, 0) as last_activity_at, k.n as n_media from orders left join c on c.id = o_orderkey left join k on k.id = o_orderkey""",
    "prompt_register": "with d as (select sha256(text) as template_sha256, doc_id, doc_id % 3 = 0 as stored from documents where text is not null) select template_sha256, cast(coalesce(min(doc_id) filter (stored), min(doc_id)) as varchar) as text, not bool_or(stored) as created from d group by 1",
    "discrepancy_rewrite": f"""with {_LINES}, d as (select id as call_id, o as turn_index, (q / 8 - ((q + p % 4) / 8 - case when id % 10 = 0 and id in (select o_orderkey from orders) then 0.125 else 0 end)) * 1000 as delta from l where p % 6 <> 0)
select call_id, turn_index, 'first_audio' as "check", cast(delta as double) as delta, 'material' as verdict from d where abs(delta) > 150""",
    "audio_calls": f"""with {_LINES}, w as (select id, arg_min(p, o) as p, min(o) as o from l group by 1)
select o_orderkey as external_call_id, o_custkey as agent_id, 'live' as source, 'dev' as environment, 'ingested' as status, 'spans' as analysis_mode, 0 as last_activity_at from orders where o_orderstatus = 'F'
union all select id, p, 'backfill', 'prod', 'awaiting_media', 'audio-only', o from w where id not in (select o_orderkey from orders where o_orderstatus = 'F')""",
    "unsent_calls": "select o_orderkey as call_id, case o_orderstatus when 'F' then 'failed' else 'ingested' end as status from orders where o_orderdate >= timestamp '1997-01-01' and o_orderstatus in ('F', 'O') and o_orderkey % 4 <> 0",
    "agent_slugs": """with a as (select c_nationkey as org, c_custkey as ord, case when c_custkey % 4 = 0 then upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' ' || (c_custkey % 6) else c_mktsegment end as name from customer where c_acctbal >= 0),
w as (select *, replace(lower(name), ' ', '-') as base, row_number() over (partition by org, lower(name) order by ord) as k from a),
h as (select c_nationkey as org, lower(c_mktsegment) || case when c_custkey % 9 = 0 then '' else '-' || (c_custkey % 9 + 1) end as slug from customer where c_acctbal < 0),
b as (select org, base, count(*) as n from w group by all), g as (select org, base, unnest(range(1, n + 40)) as m from b),
f as (select *, row_number() over (partition by org, base order by m) as k from g where not case when m = 1 then exists (from h where h.org = g.org and h.slug = g.base)
else exists (from h where h.org = g.org and h.slug = g.base || '-' || m) or exists (from b where b.org = g.org and b.base = g.base || '-' || m) end)
select org, name, ord, base || case when m = 1 then '' else '-' || m end as slug from w join f using (org, base, k)""",
}
