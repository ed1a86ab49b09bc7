"""Turns of a recording alone: recognised words and diarized segments to speakers, utterances and turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.ordered import position


def roles(segments: DataFrame, agent: DataFrame | None = None) -> DataFrame:
    """(call_id, speaker, role): the speaker who starts first is the agent, unless ``agent`` (call_id, speaker) names another."""
    first = segments.groupBy("call_id").agg(F.min_by("speaker", F.struct("start", "end", "speaker")).alias("_first"))
    named = segments.select("call_id", "speaker").distinct().join(first, "call_id")
    if agent is not None:
        named = named.join(agent.select("call_id", F.col("speaker").alias("_named")), "call_id", "left").withColumn("_first", F.coalesce("_named", "_first"))
    return named.select("call_id", "speaker", F.when(F.col("speaker") == F.col("_first"), "agent").otherwise("caller").alias("role"))


def diarized(segments: DataFrame, speaking: DataFrame) -> DataFrame:
    """(call_id, channel, t_start, t_end) of segments that have a length."""
    found = segments.where("end > start").join(speaking, ["call_id", "speaker"])
    return found.select("call_id", F.col("role").alias("channel"), F.col("start").alias("t_start"), F.col("end").alias("t_end"))


def attributed(words: DataFrame, segments: DataFrame, speaking: DataFrame) -> DataFrame:
    """words (call_id, start, end, text) with the role of the first segment that holds their middle; caller where none does.

    An equi-join on the call with a range test: a call has few segments.
    """
    middle = (F.col("start") + F.col("end")) / 2
    named = segments.join(speaking, ["call_id", "speaker"]).select("call_id", F.col("start").alias("_s"), F.col("end").alias("_e"), "role")
    w = words.withColumns({"_m": middle, "_w": F.struct("start", "end", "text")})
    hit = w.join(named, "call_id").where("_m between _s and _e").groupBy("call_id", "_w").agg(F.min_by("role", F.struct("_s", "_e")).alias("role"))
    return w.join(hit, ["call_id", "_w"], "left").select("call_id", "start", "end", "text", F.coalesce("role", F.lit("caller")).alias("channel"))


def spoken(utterances: DataFrame, words: DataFrame) -> DataFrame:
    """Utterances with the words (call_id, channel, start, end, text) whose middle they hold, in order."""
    middle = (F.col("start") + F.col("end")) / 2
    said = words.select("call_id", "channel", middle.alias("_m"), F.col("start").alias("_s"), "text")
    both = utterances.join(said, ["call_id", "channel"], "left")
    inside = F.col("_m").between(F.col("t_start"), F.col("t_end"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(inside, F.struct("_s", "text")))), lambda x: x.text), " ")
    return both.groupBy("call_id", "channel", "t_start", "t_end").agg(text.alias("text"))


def turns(said: DataFrame) -> DataFrame:
    """Caller text opens a turn, a later one replaces it while unanswered, the agent's text closes it; a trailing caller stays."""
    own = W.partitionBy("call_id").orderBy("t_start", "t_end", "channel")
    rows = said.where("text <> ''").withColumns({c: F.lag(k).over(own) for c, k in (("_side", "channel"), ("_text", "text"), ("_end", "t_end"))})
    rows = rows.withColumn("_next", F.lead("channel").over(own))
    agent, heard = F.col("channel") == "agent", F.col("_side") == "caller"
    kept = rows.where(agent | F.col("_next").isNull())
    return kept.select(
        "call_id",
        position(["call_id"], F.col("t_start"), F.col("t_end")).alias("turn_index"),
        F.when(agent & heard, F.col("_text")).when(~agent, F.col("text")).alias("transcript"),
        F.when(agent, F.col("text")).alias("llm_spoken"),
        F.when(agent & heard, F.round((F.col("t_start") - F.col("_end")) * 1000, 1)).alias("response_ms"),
    )
