"""What span and attribute names mean in each producer's traces, as small tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAGES = ("call", "turn", "speech", "stt", "llm", "tts", "playout", "tool", "net", "unknown")


@dataclass(frozen=True)
class Dialect:
    """``root`` names the span whose presence chooses the dialect."""

    name: str
    root: str
    stages: dict[str, str]
    aliases: dict[str, str] = field(default_factory=dict)
    content: dict[str, str] = field(default_factory=dict)
    blobs: dict[str, dict[str, str]] = field(default_factory=dict)
    llm_ttfb_is_ttft: bool = False
    sibling_turns: bool = False


# The names that the producers put on the wire and the canonical
# names they stand for.
LIVEKIT = Dialect(
    name="livekit",
    root="agent_session",
    stages={
        "agent_session": "call", "start_agent_activity": "call", "on_enter": "call", "on_exit": "call", "drain_agent_activity": "call",
        "user_turn": "turn", "agent_turn": "turn", "user_speaking": "speech", "agent_speaking": "playout", "eou_detection": "stt",
        "llm_request": "llm", "llm_request_run": "llm", "llm_node": "llm",
        "tts_node": "tts", "tts_request": "tts", "tts_request_run": "tts", "tts_stream_adapter": "tts", "function_tool": "tool",
    },
    aliases={
        "lk.interrupted": "turn.interrupted", "lk.interruption.probability": "turn.interruption_probability",
        "lk.response.ttft": "metrics.ttft", "lk.response.ttfb": "metrics.ttfb", "lk.e2e_latency": "metrics.e2e_latency",
        "lk.end_of_turn_delay": "endpointing.delay", "lk.transcript_confidence": "stt.confidence",
    },
    content={"lk.pii.user_transcript": "transcript", "lk.pii.response.text": "llm_spoken"},
    blobs={
        "lk.llm_metrics": {
            "$.ttft": "metrics.ttft", "$.completion_tokens": "gen_ai.usage.output_tokens", "$.prompt_tokens": "gen_ai.usage.input_tokens",
            "$.prompt_cached_tokens": "gen_ai.usage.cached_tokens", "$.total_tokens": "llm.total_tokens", "$.tokens_per_second": "llm.tokens_per_second",
            "$.duration": "llm.duration_s", "$.cancelled": "llm.cancelled", "$.metadata.model_name": "gen_ai.request.model",
        },
        "lk.tts_metrics": {
            "$.ttfb": "metrics.ttfb", "$.characters_count": "tts.chars", "$.audio_duration": "tts.audio_duration_s", "$.duration": "tts.duration_s",
            "$.input_tokens": "tts.input_tokens", "$.output_tokens": "tts.output_tokens", "$.streamed": "tts.streamed", "$.cancelled": "tts.cancelled",
            "$.metadata.model_name": "gen_ai.request.model",
        },
    },
    sibling_turns=True,
)

PIPECAT = Dialect(
    name="pipecat",
    root="conversation",
    stages={
        "conversation": "call", "turn": "turn", "stt": "stt", "llm": "llm", "llm_setup": "llm", "llm_response": "llm",
        "llm_tool_call": "tool", "llm_tool_result": "tool", "tts": "tts",
    },
    aliases={
        "turn.number": "turn.index", "turn.was_interrupted": "turn.interrupted", "language": "stt.language", "metrics.character_count": "tts.chars",
        "gen_ai.usage.cache_read.input_tokens": "gen_ai.usage.cached_tokens",
    },
    content={"transcript": "transcript", "text": "llm_spoken"},
    llm_ttfb_is_ttft=True,
)

DIALECTS = {d.name: d for d in (LIVEKIT, PIPECAT)}


def by_name(table: dict[str, str], c: Column, otherwise: Column) -> Column:
    if not table:
        return otherwise
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), c), otherwise)


def stage_of(d: Dialect, name: Column) -> Column:
    return by_name(d.stages, name, F.lit("unknown"))


def without(m: Column, *keys: str) -> Column:
    return F.map_filter(m, lambda k, v: ~k.isin(*keys)) if keys else m


def filled(attrs: Column, found: dict[str, Column]) -> Column:
    """attrs (without null values) with further entries whose names it lacks."""
    some = F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in found.items()])
    return F.map_concat(attrs, F.map_from_entries(F.filter(some, lambda x: x.value.isNotNull() & ~F.map_contains_key(attrs, x.key))))


def canonical(df: DataFrame, d: Dialect) -> DataFrame:
    """df with ``attrs`` under canonical names: content taken out, aliases renamed, JSON metrics spread.

    Own values win over an alias's, and both over a JSON metric's. A metrics
    text that is no JSON stays as it is. One column per step, so that no step's
    expression is written out again inside the next.
    """
    df = df.withColumn("_raw", F.map_filter("attrs", lambda k, v: v.isNotNull()))
    df = df.withColumn("attrs", filled(without(F.col("_raw"), *d.content, *d.aliases), {new: F.try_element_at("_raw", F.lit(old)) for old, new in d.aliases.items()}))
    for blob, keys in d.blobs.items():
        df = df.withColumn("_json", F.try_parse_json(F.try_element_at("attrs", F.lit(blob)))).withColumn("_rest", without(F.col("attrs"), blob))
        spread = filled(F.col("_rest"), {new: F.try_variant_get("_json", path, "string") for path, new in keys.items()})
        df = df.withColumn("attrs", F.when(F.col("_json").isNotNull(), spread).otherwise(F.col("attrs"))).drop("_json", "_rest")
    if d.llm_ttfb_is_ttft:
        moved = filled(without(F.col("attrs"), "metrics.ttfb"), {"metrics.ttft": F.try_element_at("attrs", F.lit("metrics.ttfb"))})
        df = df.withColumn("attrs", F.when((F.col("stage") == "llm") & ~F.map_contains_key("attrs", "metrics.ttft"), moved).otherwise(F.col("attrs")))
    return df.drop("_raw")


def content_of(d: Dialect, attrs: Column) -> dict[str, Column]:
    out = {}
    for old, new in d.content.items():
        out[new] = F.nullif(F.try_element_at(attrs, F.lit(old)), F.lit(""))
    return out
