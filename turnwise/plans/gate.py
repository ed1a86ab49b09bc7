"""Before a call is judged: which transcript counts, whether the call qualifies, and what the judge is told.

Defined cases: an uploaded transcript counts even if it holds nothing; a call
without turns has no lines; an agent that is not known asks for no parameters;
empty parameters are parameters, but are not told; of several active guardrails
of an agent the one of the least prompt id counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .talk import disposition

LINES = "array<struct<turn_index:bigint,role:string,text:string>>"
#: fixed wording of the judge's message
NONE, EMPTY = "(none provided)", "(empty)"
PARAMS_HEAD = "CALL PARAMETERS (the real values this call's prompt was rendered with — treat these as ground truth, not errors, if the agent speaks them):\n"


def derived_lines(turns: DataFrame) -> DataFrame:
    """(call_id, lines) from turns (call_id, turn_index, caller_transcript, llm_spoken, llm_raw): caller, then agent, without empty ones."""
    agent = F.coalesce(F.nullif("llm_spoken", F.lit("")), F.nullif("llm_raw", F.lit("")))
    each = turns.select("call_id", "turn_index", F.posexplode(F.array(F.nullif("caller_transcript", F.lit("")), agent)).alias("half", "text")).where("text is not null")
    row = F.struct("turn_index", "half", F.when(F.col("half") == 0, "caller").otherwise("agent").alias("role"), "text")
    said = F.transform(F.array_sort(F.collect_list(row)), lambda x: F.struct(x.turn_index.cast("long").alias("turn_index"), x.role.alias("role"), x.text.alias("text")))
    return each.groupBy("call_id").agg(said.alias("lines"))


def transcript_of(calls: DataFrame, uploads: DataFrame, turns: DataFrame, files: DataFrame) -> DataFrame:
    """(call_id, source, format, text, lines) of every call: the upload (call_id, source, format, content, uri) if there is one, else its turns' lines.

    An upload without text takes that of its uri from files (uri, text).
    """
    at = F.when(F.col("content").isNull(), F.col("uri"))
    sent = uploads.select("*", at.alias("_uri")).join(files.select(F.col("uri").alias("_uri"), F.col("text").alias("_file")), "_uri", "left")
    sent = sent.select("call_id", F.coalesce(F.nullif("source", F.lit("")), F.lit("byo")).alias("source"), F.coalesce(F.nullif("format", F.lit("")), F.lit("text")).alias("format"), F.coalesce("content", "_file").alias("text"))
    plain = calls.select("call_id").join(sent.select("call_id"), "call_id", "left_anti").join(derived_lines(turns), "call_id", "left")
    lines = F.coalesce("lines", F.array().cast(LINES)).alias("lines")
    derived = plain.select("call_id", F.lit("derived").alias("source"), F.lit("turns").alias("format"), F.lit(None).cast("string").alias("text"), lines)
    return calls.select("call_id").join(sent, "call_id").select("call_id", "source", "format", "text", F.array().cast(LINES).alias("lines")).unionByName(derived)


def caller_spoke(text: Column, lines: Column) -> Column:
    return F.coalesce(F.exists(lines, lambda x: (x.role == "caller") & (x.text != "")), F.lit(False)) | (F.coalesce(text, F.lit("")) != "")


def rendered(text: Column, lines: Column) -> Column:
    """The lines, each with its role; without any the text; without that a word for it."""
    said = F.array_join(F.transform(lines, lambda x: F.concat(x.role, F.lit(": "), x.text)), "\n")
    return F.when(F.coalesce(F.size(lines), F.lit(0)) > 0, said).otherwise(F.coalesce(F.nullif(text, F.lit("")), F.lit(EMPTY)))


def params_block(params: Column) -> Column:
    """A line per parameter in the map's order under a heading; nothing for none."""
    each = F.transform(F.map_entries(params), lambda e: F.concat(F.lit("- "), e.key, F.lit(": "), F.coalesce(e.value, F.lit("None"))))
    return F.when(F.size(params) > 0, F.concat(F.lit(PARAMS_HEAD), F.array_join(each, "\n"), F.lit("\n\n"))).otherwise("")


def gated(calls: DataFrame, transcripts: DataFrame, agents: DataFrame, params: DataFrame, prompts: DataFrame, guardrails: DataFrame) -> DataFrame:
    """call_id, disposition, status (skipped or ready), error, message.

    calls: call_id, external_call_id, agent_id, prompt_id, duration_s, status;
    agents: agent_id, params_required; params: agent_id, call_key, params (a map);
    prompts: prompt_id, text; guardrails: agent_id, prompt_id, active. A call that
    is not connected is skipped; so is one whose agent asks for parameters that it
    lacks, with ``no_params``. The others get the judge's message: the script that
    the call is pinned to, the agent's guardrails in force, parameters, transcript.
    """
    wants = agents.select("agent_id", F.col("params_required").alias("_wants"))
    values = params.select("agent_id", F.col("call_key").alias("external_call_id"), F.col("params").alias("_params"), F.lit(True).alias("_given"))
    script = prompts.select("prompt_id", F.col("text").alias("_script"))
    rule = guardrails.where("active").groupBy("agent_id").agg(F.min("prompt_id").alias("_rule_id"))
    rule = rule.join(prompts.select(F.col("prompt_id").alias("_rule_id"), F.col("text").alias("_rules")), "_rule_id").drop("_rule_id")
    rows = calls.join(transcripts.select("call_id", "text", "lines"), "call_id", "left").join(wants, "agent_id", "left")
    rows = rows.join(values, ["agent_id", "external_call_id"], "left").join(script, "prompt_id", "left").join(rule, "agent_id", "left")
    told = disposition(caller_spoke(F.col("text"), F.col("lines")), F.col("duration_s"), F.coalesce(F.col("status") == "failed", F.lit(False)))
    lacks = F.coalesce("_wants", F.lit(False)) & F.col("_given").isNull()
    part = [F.lit("SCRIPT:\n"), F.coalesce(F.nullif("_script", F.lit("")), F.lit(NONE)), F.lit("\n\nGUARDRAILS:\n"), F.coalesce(F.nullif("_rules", F.lit("")), F.lit(NONE)), F.lit("\n\n")]
    part += [params_block(F.col("_params")), F.lit("TRANSCRIPT:\n"), rendered(F.col("text"), F.col("lines"))]
    ready = (F.col("disposition") == "connected") & ~F.col("_lacks")
    return rows.withColumns({"disposition": told, "_lacks": lacks}).select(
        "call_id", "disposition", F.when(ready, "ready").otherwise("skipped").alias("status"), F.when((F.col("disposition") == "connected") & F.col("_lacks"), "no_params").alias("error"), F.when(ready, F.concat(*part)).alias("message")
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as calls: users are callers, others agents. Every fourth has an upload, every eighth one by the uri of a page, every sixteenth an empty one."""
    talk, n = table(spark, sf_dir, "conversations"), F.col("conv_id")
    calls = talk.groupBy(F.col("conv_id").alias("call_id")).agg(F.max("text").alias("longest"))
    user = F.col("role") == "user"
    turns = talk.select(n.alias("call_id"), F.col("turn").alias("turn_index"), F.when(user, F.col("text")).alias("caller_transcript"), F.when(~user & (n % 3 == 0), F.col("text")).otherwise("").alias("llm_spoken"), F.when(~user, F.col("text")).alias("llm_raw"))
    page = F.when(F.col("call_id") % 8 == 0, F.concat(F.lit("page-"), F.col("call_id").cast("string")))
    uploads = calls.where("call_id % 4 = 0").select("call_id", F.when(F.col("call_id") % 12 == 0, "desk").alias("source"), F.lit("").alias("format"), F.when(F.col("call_id") % 16 == 0, "").when(F.col("call_id") % 8 != 0, F.col("longest")).alias("content"), page.alias("uri"))
    files = table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), F.col("page_id").cast("string")).alias("uri"), F.col("url").alias("text"))
    return transcript_of(calls, uploads, turns, files)


def transcript_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select("call_id", "source", "format", "text", F.size("lines").cast("long").alias("n_lines"), rendered(F.col("text"), F.col("lines")).alias("rendered"))


def judge_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's agent is the nation of the customer of its number; even customers' parameters are known, every third nation asks for them."""
    customer, nation, region = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    owner = customer.select(F.col("c_custkey").alias("call_id"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey")).alias("agent_id"))
    number = F.col("call_id")
    calls = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("call_id")).distinct().join(owner, "call_id", "left").select(
        "call_id", F.concat(F.lit("call-"), number.cast("string")).alias("external_call_id"), "agent_id", F.when(number % 3 != 0, number % 5).alias("prompt_id"), (number % 32).alias("duration_s"), F.when(number % 13 == 0, "failed").otherwise("ingested").alias("status")
    )
    fields = F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.when(F.col("c_custkey") % 10 != 0, F.col("c_name")))
    given = customer.where("c_custkey % 2 = 0").select(F.col("c_nationkey").alias("agent_id"), F.concat(F.lit("call-"), F.col("c_custkey").cast("string")).alias("call_key"), F.when(F.col("c_custkey") % 6 == 0, F.create_map().cast("map<string,string>")).otherwise(fields).alias("params"))
    agents = nation.select(F.col("n_nationkey").alias("agent_id"), (F.col("n_nationkey") % 3 == 0).alias("params_required"))
    rules = nation.select(F.col("n_nationkey").alias("agent_id"), F.col("n_regionkey").cast("long").alias("prompt_id"), (F.col("n_nationkey") % 2 == 0).alias("active"))
    return gated(calls, transcripts(spark, sf_dir), agents, given, region.select(F.col("r_regionkey").cast("long").alias("prompt_id"), F.col("r_name").alias("text")), rules)


QUERIES = {"transcript_source": transcript_source, "judge_gate": judge_gate}

_SOURCE = """s as (select conv_id as c, max(text) as longest, coalesce(string_agg(case role when 'user' then 'caller' else 'agent' end || ': ' || text, chr(10) order by turn) filter (text <> ''), '') as lines, count(*) filter (text <> '') as n,
coalesce(bool_or(role = 'user' and text <> ''), false) as spoke from conversations group by 1),
t as (select c, c % 4 = 0 as up, case when c % 4 <> 0 then null when c % 16 = 0 then '' when c % 8 = 0 then url else longest end as text, lines, n, spoke from s left join pages on page_id = c),
r as (select c, up, text, case when up then 0 else n end as n, case when not up then spoke else coalesce(text, '') <> '' end as spoke, case when not up and n > 0 then lines else coalesce(nullif(text, ''), '(empty)') end as rendered from t)"""
ORACLE_SQL = {
    "transcript_source": f"with {_SOURCE} select c as call_id, case when not up then 'derived' when c % 12 = 0 then 'desk' else 'byo' end as source, case when up then 'text' else 'turns' end as format, text, n as n_lines, rendered from r",
    "judge_gate": f"""with {_SOURCE}, g as (select r.*, case when c_custkey % 11 <> 0 then c_nationkey end as a, c_name, c_mktsegment from r left join customer on c_custkey = c),
d as (select g.*, case when spoke then 'connected' when c % 13 = 0 or c % 32 = 0 then 'no_answer' else 'unknown' end as disposition, a is not null and c % 2 = 0 as given, coalesce(a % 3 = 0, false) as wants from g)
select c as call_id, disposition, case when disposition = 'connected' and (given or not wants) then 'ready' else 'skipped' end as status, case when disposition = 'connected' and wants and not given then 'no_params' end as error,
case when disposition = 'connected' and (given or not wants) then 'SCRIPT:' || chr(10) || coalesce(s.r_name, '(none provided)') || chr(10) || chr(10) || 'GUARDRAILS:' || chr(10) || coalesce(case when a % 2 = 0 then q.r_name end, '(none provided)') || chr(10) || chr(10)
|| case when given and c % 6 <> 0 then '{PARAMS_HEAD.replace("'", "''").rstrip(chr(10))}' || chr(10) || '- segment: ' || c_mktsegment || chr(10) || '- name: ' || case when c % 10 = 0 then 'None' else c_name end || chr(10) || chr(10) else '' end
|| 'TRANSCRIPT:' || chr(10) || rendered end as message
from d left join region s on c % 3 <> 0 and s.r_regionkey = c % 5 left join nation on n_nationkey = a left join region q on q.r_regionkey = n_regionkey""",
}
