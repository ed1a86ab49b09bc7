"""From spans to turns: call identity, span tree, turn pairing, waterfall and call metrics.

Everything is a grouped aggregate or a window per call, so calls of any number
run side by side; the span tree is walked by doubling pointers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import half_even, nearest_rank
from ..operators import intervals as iv
from ..session import materialize
from .dialects import DIALECTS, Dialect, canonical, content_of, stage_of

CALL_KEYS = ("voice.call_id",)


def latest(spans: DataFrame, *order: str) -> DataFrame:
    """Redelivered spans: of each (call, span id) the last by delivery order."""
    rest = [c for c in spans.columns if c not in ("call_id", "span_id")]
    return spans.groupBy("call_id", "span_id").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("x")).select("call_id", "span_id", "x.*")


def with_call(spans: DataFrame) -> DataFrame:
    """call_id: the hint on the resource, the root or any span of the trace, else the trace id."""

    def hint(m: str) -> Column:
        return F.coalesce(*[F.nullif(F.try_element_at(m, F.lit(k)), F.lit("")) for k in CALL_KEYS])

    trace = W.partitionBy("trace_id")
    root = F.max(F.when(F.col("parent_span_id").isNull(), hint("attrs"))).over(trace)
    first = F.struct("start_ns", "ord")
    found = F.coalesce(F.min_by(hint("resource"), F.when(hint("resource").isNotNull(), first)).over(trace), root, F.min_by(hint("attrs"), F.when(hint("attrs").isNotNull(), first)).over(trace))
    return spans.withColumn("call_id", F.coalesce(found, F.col("trace_id"), F.lit("")))


def timed(spans: DataFrame) -> DataFrame:
    """t_start, t_end in seconds from the root's start; calls without a root are left out."""
    root = spans.where("parent_span_id is null").groupBy("call_id").agg(F.min("start_ns").alias("t0"))

    def second(ns: Column) -> Column:
        return half_even((ns - F.col("t0")) / 1e9, 6)

    events = F.transform("events", lambda e: F.struct(e["name"].alias("name"), second(e.ns).alias("t"), e.attrs.alias("attrs")))
    return spans.join(root, "call_id").withColumns({"t_start": second(F.col("start_ns")), "t_end": second(F.col("end_ns")), "events": events}).drop("t0")


def dialect_of(spans: DataFrame) -> DataFrame:
    """(call_id, dialect) by the root span's name, first match."""
    has = {n: F.bool_or(F.col("name") == d.root) for n, d in DIALECTS.items()}
    choice = F.coalesce(*[F.when(c, n) for n, c in has.items()])
    return spans.groupBy("call_id").agg(choice.alias("dialect")).where("dialect is not null")


def supported(spans: DataFrame) -> DataFrame:
    """call_id, dialect, problem of every call: one without a root span or of no known dialect has a problem and is not analysed."""
    has = {n: F.bool_or(F.col("name") == d.root) for n, d in DIALECTS.items()}
    choice = F.coalesce(*[F.when(c, n) for n, c in has.items()])
    found = spans.groupBy("call_id").agg(F.bool_or(F.col("parent_span_id").isNull()).alias("_root"), choice.alias("_dialect"))
    problem = F.when(~F.col("_root"), "no root span").when(F.col("_dialect").isNull(), "no known dialect")
    return found.select("call_id", F.when(problem.isNull(), F.col("_dialect")).alias("dialect"), problem.alias("problem"))


def errored() -> Column:
    attrs = F.col("attrs")
    raised = F.exists("events", lambda e: e["name"] == "exception")
    return F.coalesce(F.contains("status", F.lit("ERROR")), F.lit(False)) | F.map_contains_key(attrs, "error.type") | raised


def spelled(spans: DataFrame, d: Dialect) -> DataFrame:
    """Spans of one dialect under canonical stages, attributes and contents."""
    stage = stage_of(d, F.col("name"))
    named = spans.withColumns({"stage": stage, "error": errored()})
    texts = content_of(d, F.col("attrs"))
    said = {f"said_{k}": texts.get(k, F.lit(None).cast("string")) for k in ("transcript", "llm_spoken", "llm_raw")}
    return canonical(named.withColumns(said), d)


def adapted(spans: DataFrame) -> DataFrame:
    """Spans of all known dialects; calls of none are left out."""
    by_call = spans.join(dialect_of(spans), "call_id")
    out = None
    for name, d in DIALECTS.items():
        one = spelled(by_call.where(F.col("dialect") == name), d)
        out = one if out is None else out.unionByName(one)
    return out


def with_turns(spans: DataFrame) -> DataFrame:
    """turn_id of every span: its own attribute, else that of its nearest TURN ancestor, itself included.

    Pointers double: each round a span without a turn takes its ancestor's turn
    or else its ancestor's ancestor, until no pointer is left, so the rounds grow
    with the logarithm of the depth. A pointer that comes back to its span is a
    cycle without a turn and is dropped, as is one that outlives as many
    doublings as ids have bits. Only ids take part. ``spans`` is read often, so
    it should be a written table.
    """
    own = F.try_element_at("attrs", F.lit("turn.id"))
    given = F.when(F.col("stage") == "turn", F.coalesce(own, F.col("span_id")))
    now = spans.select("call_id", "span_id", given.alias("turn_id"), F.when(given.isNull(), F.col("parent_span_id")).alias("up"))
    for _ in range(64):
        now = materialize(now, "tree")
        if now.where("up is not null").isEmpty():
            break
        above = now.select("call_id", F.col("span_id").alias("up"), F.col("turn_id").alias("_t"), F.col("up").alias("_u"))
        stepped = now.join(above, ["call_id", "up"], "left")
        found = F.coalesce("turn_id", "_t")
        now = stepped.select("call_id", "span_id", found.alias("turn_id"), F.when(found.isNull() & (F.col("_u") != F.col("span_id")), F.col("_u")).alias("up"))
    named = now.select("call_id", "span_id", F.col("turn_id").alias("_given"))
    return spans.join(named, ["call_id", "span_id"]).withColumn("turn_id", F.coalesce(own, "_given")).drop("_given")


def paired(spans: DataFrame) -> DataFrame:
    """Agent turns join the caller turn that starts last before them; one that none precedes joins the last of the call."""
    halves = spans.where("name in ('user_turn', 'agent_turn') and dialect = 'livekit'").select("call_id", "span_id", "name", "t_start", "turn_id")
    order = W.partitionBy("call_id").orderBy(F.col("t_start").asc_nulls_last(), F.when(F.col("name") == "user_turn", 0).otherwise(1), "span_id")
    caller = F.when(F.col("name") == "user_turn", F.col("turn_id"))
    before = F.last(caller, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    last = F.last(caller, ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    moved = halves.withColumn("to_turn", F.coalesce(before, last)).where("name = 'agent_turn' and to_turn is not null")
    moves = moved.select("call_id", F.col("turn_id"), "to_turn")
    return spans.join(moves, ["call_id", "turn_id"], "left").withColumn("turn_id", F.coalesce("to_turn", "turn_id")).drop("to_turn")


def on_audio(t: Column) -> Column:
    """Call clock to audio clock."""
    return half_even(t - F.coalesce(F.col("t0_offset_s"), F.lit(0.0)), 4)


def ms(a: Column, b: Column) -> Column:
    """Milliseconds from a to b; unknown when b is before a."""
    return F.when(b - a >= 0, half_even((b - a) * 1000, 1))


def reported_ms(c: Column) -> Column:
    return half_even(c.try_cast("double") * 1000, 1)


def yes(c: Column) -> Column:
    return F.coalesce(F.lower(c).isin("true", "1"), F.lit(False))


def turns(spans: DataFrame, utterances: DataFrame | None = None) -> DataFrame:
    """One row per exchange with its waterfall.

    ``spans`` have turn_id and, optionally, t0_offset_s (call clock minus audio
    clock). ``utterances`` (call_id, channel, t_start, t_end) add what was heard.
    """
    if "t0_offset_s" not in spans.columns:
        spans = spans.withColumn("t0_offset_s", F.lit(None).cast("double"))
    order = F.struct(F.col("t_start").isNull(), F.col("t_start"), F.col("ord"))
    stage, has = F.col("stage"), F.col

    def attr(key: str, *stages: str) -> Column:
        """The first value in order over the turn's spans of these stages, or of any."""
        v = F.nullif(F.try_element_at("attrs", F.lit(key)), F.lit(""))
        fits = v.isNotNull() & stage.isin(*stages) if stages else v.isNotNull()
        return F.min_by(v, F.when(fits, order))

    def first(c: str, name: str) -> Column:
        return F.min_by(F.col(c), F.when(stage == name, order))

    def event(name: str) -> Column:
        return F.min(F.array_min(F.transform(F.filter("events", lambda e: e["name"] == name), lambda e: e.t)))

    def text(kind: str, *stages: str) -> Column:
        c = has(f"said_{kind}")
        return F.min_by(c, F.when(c.isNotNull() & (stage.isin(*stages) if stages else F.lit(True)), order))

    turn_span = F.when(stage == "turn", F.struct((F.col("name") == "agent_turn"), order))
    stages = F.filter(
        F.collect_list(F.when(stage.isin("stt", "llm", "tts"), F.struct(on_audio(F.col("t_start")).alias("start"), on_audio(F.col("t_end")).alias("end")))),
        lambda x: x.start.isNotNull() & x.end.isNotNull(),
    )
    # events that name the turn in an attribute count for it as well
    tagged = spans.select("call_id", "t0_offset_s", F.explode("events").alias("e")).where(F.map_contains_key(F.col("e.attrs"), "turn.id"))
    tagged = tagged.groupBy("call_id", F.col("e.attrs")["turn.id"].alias("turn_id")).agg(
        *[F.min(F.when(F.col("e.name") == n, F.col("e.t"))).alias(c) for c, n in (("x_token", "llm.first_token"), ("x_audio", "tts.first_audio"), ("x_commit", "turn.committed"))]
    )
    grouped = spans.where("turn_id is not null").groupBy("call_id", "turn_id").agg(
        F.count_if(stage == "turn").alias("n_turn_spans"),
        F.max("t0_offset_s").alias("t0_offset_s"),
        F.min_by("t_start", turn_span).alias("turn_start"),
        F.min_by("t_end", turn_span).alias("turn_end"),
        attr("turn.index", "turn").alias("index_attr"),
        attr("turn.trigger", "turn").alias("trigger"),
        F.max(F.when(stage == "speech", F.col("t_end"))).alias("speech_end"),
        first("t_start", "stt").alias("stt_start"),
        first("t_end", "stt").alias("stt_end"),
        first("t_start", "llm").alias("llm_start"),
        F.min(F.when(stage == "tts", F.col("t_start"))).alias("tts_start"),
        F.min(F.when((stage == "tts") & F.map_contains_key("attrs", "tts.chars"), F.col("t_start"))).alias("tts_request"),
        event("llm.first_token").alias("e_token"),
        event("tts.first_audio").alias("e_audio"),
        event("turn.committed").alias("e_commit"),
        F.count_if(stage == "tts").alias("n_tts"),
        stages.alias("stage_intervals"),
        attr("metrics.ttft", "llm").alias("ttft"),
        attr("metrics.ttfb", "tts").alias("ttfb"),
        attr("endpointing.delay").alias("hold"),
        F.bool_or(yes(F.try_element_at("attrs", F.lit("turn.interrupted")))).alias("interrupted"),
        F.coalesce(F.bool_or((stage == "tts") & yes(F.try_element_at("attrs", F.lit("tts.cancelled")))), F.lit(False)).alias("tts_cancelled"),
        attr("tts.cut_reason", "tts").alias("cut_attr"),
        attr("stt.language", "stt").alias("language"),
        F.coalesce(attr("stt.confidence", "stt"), attr("stt.confidence")).try_cast("double").alias("stt_confidence"),
        attr("gen_ai.usage.input_tokens", "llm").try_cast("long").alias("tokens_in"),
        attr("gen_ai.usage.output_tokens", "llm").try_cast("long").alias("tokens_out"),
        attr("gen_ai.usage.cached_tokens", "llm").try_cast("long").alias("tokens_cached"),
        attr("gen_ai.request.model", "llm").alias("llm_model"),
        attr("tts.chars", "tts").try_cast("long").alias("tts_chars"),
        attr("tts.chars_cut", "tts").try_cast("long").alias("tts_chars_cut"),
        attr("turn.interruption_probability").try_cast("double").alias("interruption_probability"),
        reported_ms(attr("metrics.e2e_latency")).alias("e2e_latency_ms"),
        F.coalesce(text("transcript", "stt"), text("transcript")).alias("transcript"),
        F.coalesce(text("llm_raw", "llm"), text("llm_raw")).alias("llm_raw"),
        F.coalesce(text("llm_spoken", "tts"), text("llm_spoken")).alias("llm_spoken"),
    ).where("n_turn_spans > 0")
    t = grouped.join(tagged, ["call_id", "turn_id"], "left")

    clock = {c: on_audio(F.col(c)) for c in ("turn_start", "turn_end", "speech_end", "stt_start", "stt_end", "llm_start", "tts_start", "tts_request")}
    clock |= {"first_token_at": on_audio(F.least("e_token", "x_token")), "first_audio_at": on_audio(F.least("e_audio", "x_audio")), "committed": on_audio(F.least("e_commit", "x_commit"))}
    t = t.withColumns(clock)
    if utterances is not None:
        heard = t.select("call_id", "turn_id", F.coalesce("turn_start", F.lit(0.0)).alias("lo"), F.col("turn_end").alias("hi")).join(utterances, "call_id")
        agent = heard.groupBy("call_id", "turn_id").agg(
            F.min(F.when((F.col("channel") == "agent") & (F.col("t_start") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("t_start") <= F.col("hi"))), F.col("t_start"))).alias("agent_onset")
        )
        caller = heard.join(agent, ["call_id", "turn_id"]).groupBy("call_id", "turn_id").agg(
            F.max(F.when((F.col("channel") == "caller") & (F.col("t_end") <= F.coalesce("agent_onset", "hi")), F.col("t_end"))).alias("caller_end")
        )
        t = t.join(agent, ["call_id", "turn_id"], "left").join(caller, ["call_id", "turn_id"], "left")
    else:
        t = t.withColumns({"agent_onset": F.lit(None).cast("double"), "caller_end": F.lit(None).cast("double")})

    c = F.col
    t = t.withColumns({"llm_ttft_reported_ms": reported_ms(c("ttft")), "tts_ttfb_reported_ms": reported_ms(c("ttfb")), "committed": F.coalesce("committed", "turn_start")})
    t = t.withColumns(
        {
            "stt_lag_ms": ms(c("stt_start"), c("stt_end")),
            "endpointing_ms": F.coalesce(ms(c("speech_end"), c("stt_start")), reported_ms(c("hold"))),
            "llm_ttft_ms": F.coalesce(ms(c("llm_start"), c("first_token_at")), c("llm_ttft_reported_ms")),
            "tts_ttfb_ms": F.coalesce(ms(c("tts_start"), c("first_audio_at")), c("tts_ttfb_reported_ms")),
            "token": F.coalesce("first_token_at", half_even(c("llm_start") + c("llm_ttft_reported_ms") / 1000, 4)),
            "caller_stop": F.coalesce("speech_end", "stt_end"),
            "playout_ms": ms(c("first_audio_at"), c("agent_onset")),
        }
    )
    t = t.withColumn("agent_out", F.coalesce("first_audio_at", half_even(c("tts_start") + c("tts_ttfb_ms") / 1000, 4), c("tts_start")))
    # the hold between speech and recognition has no span of its own
    hold = F.when(c("stt_start") > c("speech_end"), F.array(F.struct(c("speech_end").alias("start"), c("stt_start").alias("end")))).otherwise(F.slice("stage_intervals", 1, 0))
    covered = iv.array_total(iv.array_merged(iv.array_clipped(F.concat("stage_intervals", hold), c("caller_stop"), c("agent_out"))))
    span = c("agent_out") - c("caller_stop")
    t = t.withColumns(
        {
            "assembly_ms": ms(c("token"), c("tts_start")),
            "dispatch_ms": ms(c("token"), c("tts_request")),
            "response_latency_ms": ms(c("caller_stop"), c("agent_out")),
            "unattributed_ms": F.when(span >= 0, half_even(F.greatest(F.lit(0.0), span - covered) * 1000, 1)),
            "cut_reason": F.coalesce("cut_attr", F.when(c("tts_cancelled"), F.when(c("interrupted"), "barge_in").otherwise("hangup"))),
            "tts_span_present": c("n_tts") > 0,
            "trigger": F.coalesce("trigger", F.lit("endpoint")),
        }
    )
    place = F.row_number().over(W.partitionBy("call_id").orderBy(F.coalesce(c("index_attr").try_cast("int"), F.lit(10**9)), c("turn_start").asc_nulls_last(), "turn_id")) - 1
    t = t.withColumn("turn_index", F.coalesce(c("index_attr").try_cast("int"), place))
    return t.withColumnsRenamed({"stt_end": "stt_final_at", "first_token_at": "llm_first_token_at", "first_audio_at": "tts_first_audio_at", "agent_onset": "audio_out_start_s", "caller_end": "audio_start_s"}).drop(
        "n_turn_spans", "index_attr", "e_token", "e_audio", "e_commit", "x_token", "x_audio", "x_commit", "n_tts", "stage_intervals", "ttft", "ttfb", "hold", "cut_attr", "token", "llm_start", "tts_request"
    )


#: fixed values: the series and names of the call's turn metrics, and why one is missing
SERIES = ("response_latency_ms", "llm_ttft_ms", "assembly_ms", "tts_ttfb_ms", "unattributed_ms", "llm_ttft_reported_ms", "tts_ttfb_reported_ms")
NO_EVIDENCE = {"tokens_per_turn": "vendor sent no usage", "truncation_rate": "no tts chars", "cut_reason": "no truncated turns"}
NO_SEGMENT = "no spans carried this segment"


def turn_metrics(t: DataFrame) -> DataFrame:
    """Tall metrics per call: p90 of each series, mean tokens, cut share of all characters, cut reasons, with availability and reason."""
    aggs = [nearest_rank(F.sort_array(F.collect_list(s)), 0.9).alias(s) for s in SERIES]
    chars, cut = F.sum("tts_chars"), F.coalesce(F.sum("tts_chars_cut"), F.lit(0))
    wide = t.groupBy("call_id").agg(
        *aggs, F.avg("tokens_out").alias("tokens_per_turn"), F.when(chars > 0, cut / chars).alias("truncation_rate"), F.array_join(F.array_sort(F.collect_set("cut_reason")), ",").alias("reasons")
    )
    nums = [*SERIES, "tokens_per_turn", "truncation_rate"]
    tall = wide.select("call_id", *[half_even(F.col(c).cast("double"), 4 if c == "truncation_rate" else 1).alias(c) for c in nums]).unpivot("call_id", nums, "name", "value_num")
    text = wide.select("call_id", F.lit("cut_reason").alias("name"), F.lit(None).cast("double").alias("value_num"), F.nullif("reasons", F.lit("")).alias("value_text"))
    both = tall.withColumn("value_text", F.lit(None).cast("string")).unionByName(text)
    there = F.coalesce(F.col("value_num").cast("string"), F.col("value_text")).isNotNull()
    why = F.lit(NO_SEGMENT)
    for name, reason in NO_EVIDENCE.items():
        why = F.when(F.col("name") == name, reason).otherwise(why)
    return both.withColumns({"available": there, "reason": F.when(~there, why)})


def pipeline(payload_spans: DataFrame, utterances: DataFrame | None = None) -> DataFrame:
    """Turns of raw span rows."""
    named = with_call(payload_spans)
    named = materialize(named, "received")
    once = latest(named, *(["delivered", "ord"] if "delivered" in named.columns else ["ord"]))
    return turns(paired(with_turns(materialize(adapted(timed(once)), "spans"))), utterances)


#: fixed values: reasons in the order that a report lists them
REASONS = (
    "turns_derived",
    "audio_disabled",
    "audio_missing",
    "timing_missing",
    "trace_not_applicable",
    "trace_missing",
    "audio_partial",
    "telemetry_truncated",
)


def trust(calls: DataFrame, spans: DataFrame, coverage_least: float = 0.80) -> DataFrame:
    """Why a call's numbers are to be trusted less, per call.

    ``calls`` has call_id, engine, derived (turns come from events),
    audio_enabled, coverage (least of its channels, null without audio) and
    dropped (spans the producer counts as lost). ``spans`` are its adapted spans
    with turn_id; one without a turn counts as unattributed, but for CALL spans.
    """
    clocked = F.col("t_start").isNotNull() | F.exists("events", lambda e: e.t.isNotNull())
    seen = spans.groupBy("call_id").agg(
        F.count("*").alias("n_spans"), F.bool_or(clocked).alias("clocked"), F.count_if(F.col("turn_id").isNull() & (F.col("stage") != "call")).alias("unattributed")
    )
    c = calls.join(seen, "call_id", "left").withColumns({"n_spans": F.coalesce("n_spans", F.lit(0)), "unattributed": F.coalesce("unattributed", F.lit(0))})
    audio, traced = F.col("coverage").isNotNull(), F.col("n_spans") > 0
    direct = F.coalesce(F.lower("engine") == "s2s", F.lit(False))
    flags = (
        F.col("derived"),
        ~audio & ~F.col("audio_enabled"),
        ~audio & F.col("audio_enabled"),
        traced & ~F.coalesce("clocked", F.lit(False)),
        ~traced & direct,
        ~traced & ~direct,
        F.col("coverage") < coverage_least,
        F.col("dropped") > 0,
    )
    reasons = F.array_compact(F.array(*[F.when(f, r) for f, r in zip(flags, REASONS, strict=True)]))
    layers = F.array_compact(F.array(F.when(audio, "audio"), F.when(traced, "events")))
    return c.select("call_id", "coverage", reasons.alias("reasons"), layers.alias("layers_run"), F.col("dropped").alias("span_dropped_events"), F.col("unattributed").alias("unattributed_spans"))
