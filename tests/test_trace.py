"""The trace path on a hand-made call with known answers."""

import gzip
import json

import pytest
from pyspark.sql import functions as F

from turnwise.functions.stats import half_even
from turnwise.plans import trace
from turnwise.sources import otlp

BEGAN = 1_600_000_000
TRACE = "0f" * 16
STARTED, ANSWER = 250, 4_750
#: id, parent, name, first and last millisecond, attributes, events
CALL = [
    ("root", None, "agent_session", 0, 9_000, {"voice.call_id": "order-17"}, []),
    ("ask", "root", "user_turn", 2_100, 2_350, {"turn.index": 4, "lk.end_of_turn_delay": 0.15, "lk.pii.user_transcript": "two tickets please"}, []),
    ("mic", "ask", "user_speaking", STARTED, 2_000, {}, []),
    ("end", "ask", "eou_detection", 2_100, 2_300, {"lk.transcript_confidence": 0.5}, []),
    ("say", "root", "agent_turn", 2_350, 6_000, {"lk.interrupted": False, "lk.pii.response.text": "sure, for which day"}, []),
    ("think", "say", "llm_request", 2_400, 4_000, {"lk.llm_metrics": json.dumps({"ttft": 0.8, "completion_tokens": 11, "prompt_tokens": 70, "prompt_cached_tokens": 20, "metadata": {"model_name": "small-1"}})}, [("llm.first_token", 3_000)]),
    ("voice", "say", "tts_request", 4_250, 6_000, {"lk.tts_metrics": json.dumps({"ttfb": 0.5, "characters_count": 19})}, []),
    ("out", "say", "agent_speaking", ANSWER, 6_000, {}, []),
]
KINDS = ((bool, "boolValue"), (int, "intValue"), (float, "doubleValue"), (str, "stringValue"))


def wire(pairs):
    out = []
    for key, x in pairs.items():
        kind = next(name for of, name in KINDS if isinstance(x, of))
        out.append({"key": key, "value": {kind: str(x) if kind == "intValue" else x}})
    return out


def nano(at):
    return str((BEGAN * 1000 + at) * 10**6)


def payload(rows):
    spans = []
    for name_of, parent, name, first, last, pairs, marks in rows:
        one = {"traceId": TRACE.upper(), "spanId": name_of, "name": name, "startTimeUnixNano": nano(first), "endTimeUnixNano": nano(last), "attributes": wire(pairs)}
        one["events"] = [{"name": n, "timeUnixNano": nano(t), "attributes": []} for n, t in marks]
        spans.append(one | {"parentSpanId": parent or ""})
    return json.dumps({"resourceSpans": [{"resource": {"attributes": wire({"service.name": "desk"})}, "scopeSpans": [{"spans": spans}]}]})


@pytest.fixture(scope="module")
def turn(spark):
    # out of order, one span delivered twice
    rows = [(payload(CALL[4:]), 1), (payload(CALL[:5]), 2), ("no json", 3)]
    spans = otlp.spans_of(spark.createDataFrame(rows, "payload string, delivered int"), "payload", "delivered")
    found = trace.pipeline(spans)
    out = found.collect()
    assert len(out) == 1
    return out[0], trace.turn_metrics(found).collect()


def test_one_turn(turn):
    t, _ = turn
    assert (t.call_id, t.turn_index, t.transcript, t.llm_spoken, t.llm_model) == ("order-17", 4, "two tickets please", "sure, for which day", "small-1")
    # the caller stops at 2.0 s; speech request at 4.25 s plus 0.5 s is the answer's first sound
    assert t.response_latency_ms == float(ANSWER - 2_000)
    # from 2.0 s to 4.75 s: 0.1 s until recognition is a hold, 2.3 to 2.4 s and 4.0 to 4.25 s belong to nothing
    assert t.unattributed_ms == 350.0
    assert (t.llm_ttft_ms, t.tts_ttfb_ms, t.stt_lag_ms, t.endpointing_ms) == (600.0, 500.0, 200.0, 100.0)
    assert (t.tokens_in, t.tokens_out, t.tokens_cached, t.tts_chars) == (70, 11, 20, 19)
    assert t.stt_confidence == 0.5 and t.interrupted is False and t.cut_reason is None


def test_metrics(turn):
    _, metrics = turn
    by = {m.name: m for m in metrics}
    assert set(by) == {*trace.SERIES, "tokens_per_turn", "truncation_rate", "cut_reason"}
    assert by["response_latency_ms"].value_num == 2750.0 and by["response_latency_ms"].available
    assert by["unattributed_ms"].value_num == 350.0 and by["llm_ttft_reported_ms"].value_num == 800.0
    assert by["tokens_per_turn"].value_num == 11.0
    # no character was cut, which is a rate of zero and not an unknown one
    assert by["truncation_rate"].value_num == 0.0 and by["truncation_rate"].available
    assert not by["cut_reason"].available and by["cut_reason"].reason == "no truncated turns"


def test_tree_of_any_depth(spark):
    """A chain of 40 spans below a turn, a cycle, and an ancestor with a turn.id that is no turn."""
    schema = "call_id string, span_id string, parent_span_id string, stage string, attrs map<string, string>"
    rows = [("c", "t", None, "turn", {})] + [("c", f"s{i}", f"s{i - 1}" if i else "t", "llm", {}) for i in range(40)]
    rows += [("c", "x", "y", "llm", {}), ("c", "y", "x", "llm", {}), ("c", "own", "t", "llm", {"turn.id": "given"}), ("c", "below", "own", "llm", {})]
    got = {r.span_id: r.turn_id for r in trace.with_turns(spark.createDataFrame(rows, schema)).collect()}
    assert all(got[f"s{i}"] == "t" for i in range(40)) and got["x"] is None and got["y"] is None
    assert got["own"] == "given" and got["below"] == "t"


def test_half_even(spark):
    cases = [(0.25, 1), (2.675, 2), (0.125, 2), (0.375, 2), (1.005, 2), (-0.25, 1), (2.5, 0), (3.5, 0), (0.1 + 0.2, 1), (1e6 + 0.05, 1), (700.05, 1), (0.0, 1)]
    rows = spark.createDataFrame([(x, d) for x, d in cases], "x double, d int")
    for digits in {d for _, d in cases}:
        for r in rows.where(F.col("d") == digits).select("x", half_even(F.col("x"), digits).alias("y")).collect():
            assert r.y == round(r.x, digits), (r.x, digits, r.y)


def test_stored_files(spark):
    text = payload(CALL).encode()
    raw = [("a.json", text), ("b.json.gz", gzip.compress(text)), ("c.json", b"{"), ("d.bin", b"\xff\xff"), ("e.json", b"")]
    files = spark.createDataFrame(raw, "path string, content binary")
    got = {r.path: r.payload for r in otlp.decoded(files).collect()}
    assert json.loads(got["a.json"]) == json.loads(got["b.json.gz"]) == json.loads(text)
    assert got["c.json"] is None and got["d.bin"] is None and got["e.json"] == "{}"


def test_protobuf():
    def field(n, kind, body):
        return bytes([n << 3 | kind]) + (bytes([len(body)]) if kind == 2 else b"") + body

    pair = field(1, 2, b"k") + field(2, 2, field(3, 0, b"\x05"))
    one = field(1, 2, b"\xab" * 16) + field(2, 2, b"\xcd" * 8) + field(5, 2, b"turn") + field(7, 1, (7).to_bytes(8, "little")) + field(9, 2, pair)
    body = field(1, 2, field(2, 2, field(2, 2, one)))
    got = otlp.proto_payload(body)["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    assert got["traceId"] == "ab" * 16 and got["name"] == "turn" and got["startTimeUnixNano"] == "7"
    assert got["attributes"] == [{"key": "k", "value": {"intValue": "5"}}]


def test_trust(spark):
    calls = spark.createDataFrame(
        [("a", None, False, True, 0.9, 0), ("b", None, True, True, 0.4, 3), ("c", "S2S", False, False, None, 0), ("d", "cascade", False, True, None, 0)],
        "call_id string, engine string, derived boolean, audio_enabled boolean, coverage double, dropped int",
    )
    spans = spark.createDataFrame(
        [("a", "llm", "t", 1.0, []), ("a", "llm", None, None, []), ("a", "call", None, 0.0, []), ("b", "stt", "t", None, [(None,)])],
        "call_id string, stage string, turn_id string, t_start double, events array<struct<t: double>>",
    )
    got = {r.call_id: (r.reasons, r.layers_run, r.unattributed_spans) for r in trace.trust(calls, spans).collect()}
    assert got == {
        "a": ([], ["audio", "events"], 1),
        "b": (["turns_derived", "timing_missing", "audio_partial", "telemetry_truncated"], ["audio", "events"], 0),
        "c": (["audio_disabled", "trace_not_applicable"], [], 0),
        "d": (["audio_missing", "trace_missing"], [], 0),
    }
