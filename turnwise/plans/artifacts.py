"""Calls out of several stored artifacts: a decoder per object, a tenant's mapping of paths, one header and one list of spans.

A mapping names, per target, where its fields lie in the decoded data: ``call``
fields become the header, ``spans`` and ``turns`` take each element of a list. It
is checked as a whole before anything runs and then compiled to Columns, so a
mapping costs what a projection costs. An object that cannot be decoded, or whose
mapping gives nothing, leaves its call unsupported, with the reason; the call's
other objects still count.

Fragments of a call are merged field by field in the order of its objects: the
first value that is not null stays. Spans of traces and lines of transcripts are
one list; lines are numbered per call and have no clock but their own.

Defined cases: null content cannot be decoded; bytes that are no text in their
charset are replaced, not refused; blank lines of records are passed over;
objects of one place in the order go by their uri; an empty table gives no calls.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PATH = re.compile(r"\$(\.[A-Za-z_][A-Za-z0-9_]*|\[[0-9]+\])*")
LONGEST_PATH = 512
DECODERS = ("json", "text", "records")
#: fixed values: the stage and content name of a speaker's line; header defaults
SPEAKER = {"caller": ("stt", "transcript"), "agent": ("tts", "llm_spoken")}
DEFAULTS = {"source": "files", "environment": "prod"}
FIELDS = {"spans": ("span_id", "parent_span_id", "name", "stage", "t_start", "t_end"), "turns": ("speaker", "text", "t_start", "t_end", "sequence")}


def decoded(objects: DataFrame) -> DataFrame:
    """objects (call_id, ord, uri, decoder, encoding, content) with data: variant, null where decoding failed.

    json is the document, text an object with ``text``, records an array of the lines' documents.
    """
    charset = F.lower(F.coalesce("encoding", F.lit("utf-8")))
    utf8 = F.make_valid_utf8(F.col("content").cast("string"))
    text = F.when(charset.isin("utf-8", "utf8"), utf8)
    for name in ("iso-8859-1", "us-ascii", "utf-16"):
        text = F.when(charset == name, F.decode("content", name)).otherwise(text)
    lines = F.filter(F.split(utf8, "\r?\n"), lambda x: F.trim(x) != "")
    listed = F.when(~F.exists(lines, lambda x: F.try_parse_json(x).isNull()), F.try_parse_json(F.concat(F.lit("["), F.array_join(lines, ","), F.lit("]"))))
    data = F.when(F.col("decoder") == "json", F.try_parse_json(utf8)).when(F.col("decoder") == "text", F.try_parse_json(F.to_json(F.struct(text.alias("text")))))
    return objects.withColumn("data", data.when(F.col("decoder") == "records", listed))


def checked(mapping: Mapping) -> Mapping:
    """The mapping, if every target, field and path of it is one; the error names the first that is not."""

    def path(where: str, value: object) -> None:
        if not isinstance(value, str) or len(value) > LONGEST_PATH or not PATH.fullmatch(value):
            raise ValueError(f"{where}: {value!r} is no path")

    for target, what in mapping.items():
        if target == "call":
            for field, at in what.items():
                path(f"call.{field}", at)
        elif target in FIELDS:
            path(f"{target}.each", what.get("each"))
            for field, at in what.get("fields", {}).items():
                if field not in FIELDS[target]:
                    raise ValueError(f"{target}.{field} is no field")
                path(f"{target}.{field}", at)
        else:
            raise ValueError(f"{target} is no target")
    return mapping


def said(data: Column | str, at: str) -> Column:
    return F.try_variant_get(data, at, "string")


def header_values(data: str, mapping: Mapping) -> Column:
    """map of the mapping's call fields that have a value."""
    pairs = [F.struct(F.lit(field).alias("key"), said(data, at).alias("value")) for field, at in mapping.get("call", {}).items()]
    some = F.filter(F.array(*pairs), lambda p: p.value.isNotNull()) if pairs else F.array().cast("array<struct<key:string,value:string>>")
    return F.map_from_entries(some)


def elements(data: str, mapping: Mapping, target: str) -> Column:
    """array of structs of the mapping's list target; a field without a path is null."""
    what = mapping.get(target)
    kind = f"array<struct<{','.join(f'{f}:string' for f in FIELDS[target])}>>"
    if what is None:
        return F.array().cast(kind)
    each = F.coalesce(F.try_variant_get(data, what["each"], "array<variant>"), F.array().cast("array<variant>"))
    fields = what.get("fields", {})
    return F.transform(each, lambda v: F.struct(*[(said(v, fields[f]) if f in fields else F.lit(None).cast("string")).alias(f) for f in FIELDS[target]])).cast(kind)


def mapped(objects: DataFrame, mappings: Mapping[str, Mapping]) -> DataFrame:
    """call_id, ord, uri, header, spans, turns, problem of objects with ``rule``, the name of their mapping."""
    known = {name: checked(m) for name, m in mappings.items()}
    rows = decoded(objects)
    out = {"header": F.lit(None).cast("map<string,string>"), "spans": None, "turns": None}
    for name, mapping in known.items():
        mine = F.col("rule") == name
        out["header"] = F.when(mine, header_values("data", mapping)).otherwise(out["header"])
        for target in FIELDS:
            value = F.when(mine, elements("data", mapping, target))
            out[target] = value if out[target] is None else value.otherwise(out[target])
    found = rows.select("call_id", "ord", "uri", "rule", "decoder", "data", *[v.alias(k) for k, v in out.items()])
    nothing = (F.cardinality("header") == 0) & (F.size("spans") == 0) & (F.size("turns") == 0)
    problem = F.when(~F.col("rule").isin(*known), F.lit("no mapping")).when(~F.col("decoder").isin(*DECODERS), "no decoder").when(F.col("data").isNull(), "not decoded").when(nothing, "nothing mapped")
    return found.withColumn("problem", F.when(F.col("rule").isNull(), "no mapping").otherwise(problem)).drop("data")


def headers(fragments: DataFrame) -> DataFrame:
    """call_id, header: of every field the first value in the order of a call's objects; defaults for what none has."""
    each = fragments.select("call_id", "ord", "uri", F.explode("header").alias("field", "value"))
    first = each.groupBy("call_id", "field").agg(F.min(F.struct("ord", "uri", "value")).alias("_f"))
    whole = first.groupBy("call_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "_f.value")))).alias("_h"))
    calls = fragments.select("call_id").distinct().join(whole, "call_id", "left")
    own = F.coalesce("_h", F.create_map().cast("map<string,string>"))
    missing = F.map_filter(F.create_map(*[F.lit(x) for pair in DEFAULTS.items() for x in pair]), lambda k, _: ~F.map_contains_key(own, k))
    return calls.select("call_id", F.map_concat(own, missing).alias("header"))


def spans(fragments: DataFrame) -> DataFrame:
    """call_id, span_id, parent_span_id, name, stage, t_start, t_end, turn_id, kind, text: spans and lines of all fragments."""
    traced = fragments.select("call_id", F.inline("spans"))
    null = F.lit(None).cast("string")
    traced = traced.where("span_id is not null").select(
        "call_id", "span_id", "parent_span_id", F.coalesce("name", "span_id").alias("name"), F.coalesce("stage", F.lit("unknown")).alias("stage"),
        F.col("t_start").try_cast("double").alias("t_start"), F.col("t_end").try_cast("double").alias("t_end"), null.alias("turn_id"), null.alias("kind"), null.alias("text"),
    )
    lines = fragments.select("call_id", "ord", "uri", F.posexplode("turns").alias("_at", "t"))
    number = F.row_number().over(W.partitionBy("call_id").orderBy("ord", "uri", "_at")) - 1
    stage, kind = F.lit("unknown"), F.lit("text")
    for who, (its_stage, its_kind) in SPEAKER.items():
        stage, kind = F.when(F.col("t.speaker") == who, its_stage).otherwise(stage), F.when(F.col("t.speaker") == who, its_kind).otherwise(kind)
    numbered = lines.withColumn("_n", number)
    turn = F.concat(F.col("call_id").cast("string"), F.lit(":t"), F.coalesce("t.sequence", F.col("_n").cast("string")))
    said_ = numbered.select(
        "call_id", F.concat(F.col("call_id").cast("string"), F.lit("-tr-"), F.col("_n").cast("string")).alias("span_id"), null.alias("parent_span_id"), F.lit("transcript.line").alias("name"), stage.alias("stage"),
        F.col("t.t_start").try_cast("double").alias("t_start"), F.col("t.t_end").try_cast("double").alias("t_end"), turn.alias("turn_id"), kind.alias("kind"), F.col("t.text").alias("text"),
    )
    return traced.unionByName(said_)


def problems(fragments: DataFrame) -> DataFrame:
    """call_id, reasons of the calls that are unsupported, with the objects to blame."""
    bad = fragments.where("problem is not null")
    return bad.groupBy("call_id").agg(F.array_sort(F.collect_set(F.concat("uri", F.lit(": "), "problem"))).alias("reasons"))


MAPPINGS = {
    "meta": {"call": {"source": "$.meta.source", "carrier": "$.meta.carrier"}},
    "trace": {"call": {"carrier": "$[0].via"}, "spans": {"each": "$", "fields": {"span_id": "$.id", "stage": "$.kind", "t_start": "$.t"}}},
    "talk": {"call": {"source": "$.from"}, "turns": {"each": "$.lines", "fields": {"speaker": "$.who", "text": "$.said"}}},
}


def assembled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as three objects each: a header, records of their turns, and a transcript of users and assistants; every 11th header is cut off."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").alias("call_id"), "turn", "role", F.sha2("text", 256).alias("text"))
    whole = talk.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    meta = F.to_json(F.struct(F.struct(F.when(F.col("call_id") % 3 == 0, "web").alias("source"), F.when(F.col("call_id") % 2 == 0, "line").alias("carrier")).alias("meta")))
    meta = F.when(F.col("call_id") % 11 == 0, F.substring(meta, 1, 5)).otherwise(meta)
    record = F.transform("m", lambda x: F.to_json(F.struct(x.turn.cast("string").alias("id"), x.role.alias("kind"), (x.turn / 2).alias("t"), F.lit("sip").alias("via"))))
    who = lambda x: F.when(x.role == "user", "caller").when(x.role == "assistant", "agent").otherwise(x.role)
    lines = F.to_json(F.struct(F.lit("talk").alias("from"), F.transform("m", lambda x: F.struct(who(x).alias("who"), x.text.alias("said"))).alias("lines")))
    parts = [("meta", "json", meta), ("trace", "records", F.array_join(record, "\n\n")), ("talk", "json", lines)]
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), F.lit(rule).alias("uri"), F.lit(rule).alias("rule"), F.lit(how).alias("decoder"), F.encode(text, "utf-8").alias("content")) for k, (rule, how, text) in enumerate(parts)]))
    fragments = mapped(whole.select("call_id", one.alias("o")).select("call_id", "o.*", F.lit(None).cast("string").alias("encoding")), MAPPINGS)
    per = spans(fragments).groupBy("call_id").agg(F.count_if(F.col("kind").isNull()).alias("spans"), F.count_if(F.col("stage") == "stt").alias("heard"), F.count_if(F.col("kind") == "text").alias("others"), F.max("t_start").alias("last_s"))
    out = headers(fragments).join(per, "call_id", "left").join(problems(fragments), "call_id", "left")
    return out.select("call_id", *[F.col("header")[c].alias(c) for c in ("source", "environment", "carrier")], "spans", "heard", "others", "last_s", F.array_join("reasons", ",").alias("reasons"))


QUERIES = {"artifact_assembly": assembled_calls}
ORACLE_SQL = {
    "artifact_assembly": """with c as (select conv_id as call_id, count(*) as spans, count(*) filter (role = 'user') as heard, count(*) filter (role not in ('user', 'assistant')) as others, max(turn) / 2 as last_s from conversations group by 1)
select call_id, case when call_id % 3 = 0 and call_id % 11 <> 0 then 'web' else 'talk' end as source, 'prod' as environment, case when call_id % 2 = 0 and call_id % 11 <> 0 then 'line' else 'sip' end as carrier,
spans, heard, others, last_s, case when call_id % 11 = 0 then 'meta: not decoded' when call_id % 3 <> 0 and call_id % 2 <> 0 then 'meta: nothing mapped' end as reasons from c"""
}
