"""Judgments: the failure block made consistent, and training rows for export.

Driver tables stand in: labelled documents are judged calls, conversations are
calls with turns, and a reply's correction follows from the conversation's number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .talk import coerced

#: fixed values: the models that can be at fault
FAULTS = ("none", "asr", "llm", "tts", "other")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def outcome(objective: Column) -> Column:
    """achieved for yes, failed for no, uncertain for anything else and for null."""
    return F.when(objective == "yes", "achieved").when(objective == "no", "failed").otherwise("uncertain")


def consistent(judged: DataFrame) -> DataFrame:
    """The judgment with its conditional fields emptied, in this order.

    An unknown fault is other, a missing one none. Without a failure there is no
    cause, fix, fault or hallucination; without a fault no detail of one; without
    a hallucination no detail; corrections stay for faults of the language model
    only, violation points only with a violation. A null flag counts as false.
    """
    c = F.col
    fails = F.coalesce(c("is_failure"), F.lit(False))
    rows = judged.withColumns(
        {
            "is_failure": fails,
            "model_fault": F.when(fails & c("model_fault").isNotNull(), coerced(c("model_fault"), FAULTS, "other")).otherwise("none"),
            "hallucination": fails & F.coalesce(c("hallucination"), F.lit(False)),
            "guardrail_violation": F.coalesce(c("guardrail_violation"), F.lit(False)),
        }
    )
    out = {name: F.when(c("is_failure"), c(name)) for name in ("root_cause", "suggested_fix")}
    out["model_fault_detail"] = F.when(c("model_fault") != "none", c("model_fault_detail"))
    out["hallucination_detail"] = F.when(c("hallucination"), c("hallucination_detail"))
    empty = F.array().cast("array<string>")
    out["llm_corrections"] = F.when(c("model_fault") == "llm", F.coalesce("llm_corrections", empty)).otherwise(empty)
    out["guardrail_violation_points"] = F.when(c("guardrail_violation"), F.coalesce("guardrail_violation_points", empty)).otherwise(empty)
    return rows.withColumns(out)


def message(role: str | Column, content: Column, tools: Column | None = None) -> Column:
    calls = F.lit(None).cast("array<struct<type:string,function:struct<name:string,arguments:string>>>") if tools is None else tools
    return F.struct((F.lit(role) if isinstance(role, str) else role).alias("role"), content.alias("content"), calls.alias("tool_calls"))


def corrected_message(correction: Column) -> Column:
    """The reply to train toward: a tool call where the correction names a tool, else its text."""
    call = F.struct(F.lit("function").alias("type"), F.struct(correction.corrected_tool.alias("name"), F.coalesce(correction.corrected_args, F.lit("{}")).alias("arguments")).alias("function"))
    named = F.coalesce(correction.corrected_tool, F.lit("")) != ""
    return F.when(named, message("assistant", F.lit(None).cast("string"), F.array(call))).otherwise(message("assistant", F.coalesce(correction.corrected, F.lit(""))))


def fault_position(said: Column, observed: Column) -> Column:
    """Place of the first assistant message that holds the first 60 characters of what was observed, or whose own stand in it; without one, the end."""
    clean = F.trim(F.coalesce(observed, F.lit("")))
    hits = F.transform(said, lambda m, i: F.when((m.role == "assistant") & (F.contains(m.content, F.substring(clean, 1, 60)) | F.contains(clean, F.substring(m.content, 1, 60))), i))
    return F.when(clean == "", F.size(said)).otherwise(F.coalesce(F.array_min(hits), F.size(said)))


def training_rows(judged: DataFrame, turns: DataFrame, shape: str = "sft", dialect: str = "trl") -> DataFrame:
    """(call_id, turn_id, row): one JSON row per correction that has a target, of calls where the language model was at fault.

    judged: call_id, agent_id, model_fault, objective, script, corrections (turn_id, kind,
    observed, corrected, corrected_tool, corrected_args); turns: call_id,
    turn_index, caller, agent. The context is the script and what was said before
    the faulty reply. ``shape`` is sft or dpo, ``dialect`` trl or openai. Empty
    sides of a turn give no message; a call without turns keeps its script alone.
    """
    each = F.array(F.struct(F.lit(0).alias("side"), F.lit("user").alias("role"), F.col("caller").alias("content")), F.struct(F.lit(1).alias("side"), F.lit("assistant").alias("role"), F.col("agent").alias("content")))
    parts = turns.select("call_id", "turn_index", F.inline(each)).where("content <> ''")
    talks = parts.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn_index", "side", "role", "content"))).alias("said"))
    asked = judged.where("model_fault = 'llm'").withColumn("fix", F.explode("corrections")).drop("corrections")
    asked = asked.where("coalesce(fix.corrected, '') <> '' or coalesce(fix.corrected_tool, '') <> ''")
    rows = asked.join(talks, "call_id", "left").withColumn("said", F.coalesce("said", F.expr("cast(array() as array<struct<turn_index:int,side:int,role:string,content:string>>)")))
    fix = F.col("fix")
    place = fault_position(F.col("said"), fix.observed)
    before = F.transform(F.slice("said", F.lit(1), place), lambda m: message(m.role, m.content))
    context = F.concat(F.array(message("system", F.coalesce("script", F.lit("")))), before)
    target, observed = corrected_message(fix), message("assistant", F.coalesce(fix.observed, F.lit("")))
    about = F.struct(
        F.col("call_id"), F.col("agent_id"), fix.turn_id.alias("turn_id"), fix.kind.alias("kind"), F.col("model_fault").alias("fault_dim"),
        F.coalesce(F.col("objective") != "yes", F.lit(True)).alias("recoverable"), outcome(F.col("objective")).alias("outcome"), F.lit("judge_unverified").alias("gt_source"),
    ).alias("meta")
    if shape == "sft":
        made = F.struct(F.concat(context, F.array(target)).alias("messages"), about)
    elif dialect == "openai":
        made = F.struct(F.struct(context.alias("messages")).alias("input"), F.array(target).alias("preferred_output"), F.array(observed).alias("non_preferred_output"), about)
    else:
        made = F.struct(context.alias("prompt"), F.array(target).alias("chosen"), F.array(observed).alias("rejected"), about)
    # to_json leaves null fields out; the key is never part of a text, where quotes are escaped
    text = F.replace(F.to_json(made), F.lit('{"role":"assistant","tool_calls":'), F.lit('{"role":"assistant","content":null,"tool_calls":'))
    return rows.select("call_id", fix.turn_id.alias("turn_id"), text.alias("row"))


def failure_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    n = F.col("doc_id")
    raw = F.get(F.array(F.lit(" LLM "), F.lit("asr"), F.lit("None"), F.lit("network"), F.lit("tts"), F.lit(None)), (n % 6).cast("int"))
    judged = rows.select(
        "doc_id", (F.col("quality") == 0).alias("is_failure"), raw.alias("model_fault"), F.lit("detail").alias("model_fault_detail"), (n % 2 == 0).alias("hallucination"), F.lit("seen").alias("hallucination_detail"),
        F.lit("cause").alias("root_cause"), F.lit("fix").alias("suggested_fix"), F.array(F.col("lang")).alias("llm_corrections"), (F.col("toxic") == 1).alias("guardrail_violation"), F.array(F.col("source")).alias("guardrail_violation_points"),
    )
    clean = consistent(judged)
    return clean.withColumns({c: F.array_join(c, ",") for c in ("llm_corrections", "guardrail_violation_points")})


def exported(spark: SparkSession, sf_dir: str, shape: str, dialect: str = "trl") -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    turns = rows.where("role in ('user', 'assistant')").select(
        F.col("conv_id").alias("call_id"), F.col("turn").cast("int").alias("turn_index"), F.when(F.col("role") == "user", F.col("text")).alias("caller"), F.when(F.col("role") == "assistant", F.col("text")).alias("agent")
    )
    last = rows.where("role = 'assistant' and text is not null").groupBy("conv_id").agg(F.max_by("text", "turn").alias("observed"), F.max("turn").alias("turn"))
    n = F.col("conv_id")
    text = F.when(n % 3 == 0, F.concat(F.lit("fixed: "), "observed")).otherwise("")
    args = F.when(n % 2 == 0, F.concat(F.lit('{"id": '), n.cast("string"), F.lit("}")))
    fix = F.struct(
        F.concat(F.lit("t"), F.col("turn").cast("string")).alias("turn_id"), F.lit("response").alias("kind"), F.col("observed"), text.alias("corrected"),
        F.when(n % 3 == 1, "lookup").alias("corrected_tool"), args.alias("corrected_args"),
    )
    objective = F.when(n % 4 == 0, "yes").when(n % 4 == 1, "no").when(n % 4 == 2, "partial")
    judged = last.select(n.alias("call_id"), (n % 11).alias("agent_id"), F.when(n % 5 != 0, "llm").otherwise("asr").alias("model_fault"), objective.alias("objective"), F.when(n % 7 != 0, "Be brief.").alias("script"), F.array(fix).alias("corrections"))
    return training_rows(judged, turns, shape, dialect)


QUERIES = {
    "failure_block": failure_block,
    "export_sft": lambda spark, sf_dir: exported(spark, sf_dir, "sft"),
    "export_dpo_trl": lambda spark, sf_dir: exported(spark, sf_dir, "dpo"),
    "export_dpo_openai": lambda spark, sf_dir: exported(spark, sf_dir, "dpo", "openai"),
}

_EXPORT = """with n as (select *, row_number() over (partition by conv_id order by turn) - 1 as i, count(*) over (partition by conv_id) as c from conversations where role in ('user', 'assistant') and text <> ''),
l as (select conv_id, max_by(text, turn) as observed, max(turn) as last from conversations where role = 'assistant' and text is not null group by 1),
f as (select l.*, 't' || last as turn_id, coalesce((select min(i) from n where n.conv_id = l.conv_id and role = 'assistant' and trim(observed) <> ''
  and (contains(text, substr(trim(observed), 1, 60)) or contains(trim(observed), substr(text, 1, 60)))), (select count(*) from n where n.conv_id = l.conv_id)) as at
  from l where conv_id % 5 <> 0 and conv_id % 3 <> 2 and (conv_id % 3 = 1 or observed is not null)),
p as (select f.*, '[{"role":"system","content":' || case when conv_id % 7 <> 0 then '"Be brief."' else '""' end || '}'
  || coalesce((select string_agg(',{"role":"' || role || '","content":' || to_json(text) || '}', '' order by i) from n where n.conv_id = f.conv_id and i < f.at), '') as context,
  case when conv_id % 3 = 1 then '{"role":"assistant","content":null,"tool_calls":[{"type":"function","function":{"name":"lookup","arguments":' || to_json(case when conv_id % 2 = 0 then '{"id": ' || conv_id || '}' else '{}' end) || '}}]}'
  else '{"role":"assistant","content":' || to_json('fixed: ' || observed) || '}' end as target,
  '{"role":"assistant","content":' || to_json(observed) || '}' as rejected,
  '"meta":{"call_id":' || conv_id || ',"agent_id":' || conv_id % 11 || ',"turn_id":"' || turn_id || '","kind":"response","fault_dim":"llm","recoverable":' || (conv_id % 4 <> 0) || ',"outcome":"' || case conv_id % 4 when 0 then 'achieved' when 1 then 'failed' else 'uncertain' end || '","gt_source":"judge_unverified"}' as meta from f)
select conv_id as call_id, turn_id, """

ORACLE_SQL = {
    "failure_block": """with r as (select *, ([' LLM ', 'asr', 'None', 'network', 'tts', null])[doc_id % 6 + 1] as raw from documents join labels using (doc_id)),
f as (select *, quality = 0 as is_failure, case when quality <> 0 or raw is null then 'none' when lower(trim(raw)) in ('none', 'asr', 'llm', 'tts', 'other') then lower(trim(raw)) else 'other' end as model_fault, quality = 0 and doc_id % 2 = 0 as hallucination from r)
select doc_id, is_failure, model_fault, case when model_fault <> 'none' then 'detail' end as model_fault_detail, hallucination, case when hallucination then 'seen' end as hallucination_detail,
case when is_failure then 'cause' end as root_cause, case when is_failure then 'fix' end as suggested_fix, case when model_fault = 'llm' then coalesce(lang, '') else '' end as llm_corrections,
toxic = 1 as guardrail_violation, case when toxic = 1 then coalesce(source, '') else '' end as guardrail_violation_points from f""",
    "export_sft": _EXPORT + """'{"messages":' || context || ',' || target || '],' || meta || '}' as row from p""",
    "export_dpo_trl": _EXPORT + """'{"prompt":' || context || '],"chosen":[' || target || '],"rejected":[' || rejected || '],' || meta || '}' as row from p""",
    "export_dpo_openai": _EXPORT + """'{"input":{"messages":' || context || ']},"preferred_output":[' || target || '],"non_preferred_output":[' || rejected || '],' || meta || '}' as row from p""",
}
