"""What clients show, and what a judge is told, on gaps, ties and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from turnwise.plans import gate, shown

TURN = "call_id string, turn_index int, caller_transcript string, llm_spoken string, llm_raw string, cut_reason string, " + ", ".join(
    f"{c} double" for c in ("caller_utt_end_s", "committed_at", "stt_final_at", "agent_utt_start_s", "tts_first_audio_at", "tts_start_at", "llm_first_token_at")
)
EVENT = "call_id string, place int, name string, t_offset_s double, content_text string"


def test_heard_transcript(spark):
    turns = [
        ("a", 2, "late", None, None, None, None, None, 5.0, None, None, None, None),
        ("a", 1, "hi", "", "unsaid", None, 1.0, 9.0, None, None, None, None, None),
        ("a", 3, "same", "reply", None, "barge_in_x", None, 5.0, None, None, None, None, None),
        ("a", 4, None, None, "no time", None, None, None, None, None, None, None, None),
        ("a", 5, "", "early", None, "", None, None, None, None, None, 0.25, 7.0),
    ]
    events = [("a", 1, "turn.dropped", 5.0, "lost"), ("a", 0, "stt.overheard", None, "when"), ("a", 2, "stt.final", 1.0, "used"), ("a", 3, "x.carried", 1.0, None), ("a", 4, None, 1.0, "x"), ("b", 0, "promoted", 1.0, "alone")]
    got = shown.heard_transcript(spark.createDataFrame(turns, TURN), spark.createDataFrame(events, EVENT)).orderBy("call_id", "place").collect()
    assert [(r.call_id, r.kind, r.text) for r in got] == [
        ("a", "agent", "early"), ("a", "caller", "hi"), ("a", "caller", "late"), ("a", "caller", "same"), ("a", "ghost", "lost"), ("a", "agent", "reply"),
        ("a", "agent", "no time"), ("a", "ghost", "when"), ("b", "ghost", "alone"),
    ]
    assert got[5].t == 5.001 and got[5].who == "agent · turn 3 · cut by barge-in_x"
    assert shown.heard_transcript(spark.createDataFrame([], TURN), spark.createDataFrame([], EVENT)).count() == 0


def test_ranges_tabs_and_search(spark):
    day = dt.datetime(2024, 5, 1)
    rows = spark.createDataFrame([(None, day), (day - dt.timedelta(days=8), day), (None, None), (day - dt.timedelta(hours=24), None)], "s timestamp_ntz, c timestamp_ntz")
    until = F.lit(day)

    def n(key, known, default=None):
        return rows.where(shown.in_range("s", "c", key, until, known, default)).count()

    assert (n("24h", shown.EXPORT_RANGES), n("30d", shown.EXPORT_RANGES), n("year", shown.EXPORT_RANGES), n(None, shown.EXPORT_RANGES)) == (2, 3, 4, 4)
    assert (n("90d", shown.BOARD_RANGES, "7d"), n(None, shown.BOARD_RANGES, "7d"), n("30d", shown.BOARD_RANGES, "7d")) == (2, 2, 3)

    calls = spark.createDataFrame([("1", "Api", None, "failed", True, {"k": "Blue"}), ("2", None, None, None, None, None), ("3", "x", "y", "unsupported", False, {"k": None})], "id string, source string, environment string, status string, analysed boolean, labels map<string,string>")
    seen = {t: sorted(r.id for r in calls.where(c).collect()) for t, c in shown.tabs().items()}
    assert seen == {"all": ["1", "2", "3"], "analysed": ["1"], "pending": ["2"], "failed": ["1"], "unsupported": ["3"]}

    def found(needle):
        return sorted(r.id for r in calls.where(shown.matches(needle, "id", "source", "environment", "status")).collect())

    assert (found(" BLUE "), found("api  failed"), found(""), found("k"), found("100%")) == (["1"], ["1"], ["1", "2", "3"], [], [])


def test_extent_tiles_shares(spark):
    spans = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.5, None), ("b", 0.0, None), ("c", None, 4.0)], "call_id string, t_start_s double, duration_s double")
    assert {r.call_id: r.extent_s for r in shown.extent(spans).collect()} == {"a": 3.0, "b": 0.001, "c": 0.001}
    turns = spark.createDataFrame([("a", "opening", False, 9.0), ("a", None, None, 1.0), ("a", "x", False, 3.0), ("a", "x", True, 8.0), ("a", "x", False, 2.0), ("b", "x", False, None)], "call_id string, trigger string, interrupted boolean, response_latency_ms double")
    assert [(r.call_id, r["median"], r.p90, r.most) for r in shown.latency_tiles(turns).collect()] == [("a", 2.0, 3.0, 3.0)]
    counts = spark.createDataFrame([("x", 3), ("y", 0), ("z", 1)], "d string, n long")
    assert {r.d: r.share for r in shown.shares(counts, "d").collect()} == {"x": 0.75, "z": 0.25}


def test_transcripts_and_gate(spark):
    make = spark.createDataFrame
    ids = ("derived", "inline", "byfile", "nofile", "silent", "failed", "lacks", "given", "stray")
    calls = make([(c, "x-" + c, None if c == "stray" else "free" if c not in ("lacks", "given") else "asks", "p1" if c == "given" else "gone", 0 if c == "silent" else 5, "failed" if c == "failed" else None) for c in ids], "call_id string, external_call_id string, agent_id string, prompt_id string, duration_s int, status string")
    uploads = make([("inline", "", None, "said", "f"), ("byfile", "desk", "srt", None, "f"), ("nofile", None, None, None, "none"), ("unknown", None, None, "x", None)], "call_id string, source string, format string, content string, uri string")
    said = [("derived", 2, None, None, "raw"), ("derived", 1, "hello", "spoken", "raw"), ("derived", 3, "", "", ""), ("inline", 1, "not this", None, None), ("silent", 1, None, "only agent", None)]
    said += [(c, 1, "yes", None, None) for c in ("lacks", "given", "stray")]
    turns = make(said, "call_id string, turn_index int, caller_transcript string, llm_spoken string, llm_raw string")
    found = gate.transcript_of(calls, uploads, turns, make([("f", "of the file")], "uri string, text string"))
    shown_as = {r.call_id: (r.source, r.format, r.out) for r in found.select("*", gate.rendered(F.col("text"), F.col("lines")).alias("out")).collect()}
    assert set(shown_as) == set(ids)
    assert shown_as["derived"] == ("derived", "turns", "caller: hello\nagent: spoken\nagent: raw")
    assert (shown_as["inline"], shown_as["byfile"]) == (("byo", "text", "said"), ("desk", "srt", "of the file"))
    assert (shown_as["nofile"], shown_as["failed"]) == (("byo", "text", "(empty)"), ("derived", "turns", "(empty)"))

    agents = make([("asks", True), ("free", None)], "agent_id string, params_required boolean")
    params = make([("asks", "x-given", {"due": "May", "sum": None}), ("free", "x-given", {"no": "no"})], "agent_id string, call_key string, params map<string,string>")
    prompts = make([("p1", "the script"), ("p2", "the rules"), ("p3", "other rules")], "prompt_id string, text string")
    rules = make([("asks", "p3", True), ("asks", "p2", True), ("free", "p2", False)], "agent_id string, prompt_id string, active boolean")
    got = {r.call_id: r for r in gate.gated(calls, found, agents, params, prompts, rules).collect()}
    assert {c: (r.disposition, r.status, r.error) for c, r in got.items()} == {
        "derived": ("connected", "ready", None), "inline": ("connected", "ready", None), "byfile": ("connected", "ready", None), "nofile": ("unknown", "skipped", None),
        "silent": ("no_answer", "skipped", None), "failed": ("no_answer", "skipped", None), "lacks": ("connected", "skipped", "no_params"), "given": ("connected", "ready", None), "stray": ("connected", "ready", None),
    }
    head = gate.PARAMS_HEAD
    assert got["given"].message == f"SCRIPT:\nthe script\n\nGUARDRAILS:\nthe rules\n\n{head}- due: May\n- sum: None\n\nTRANSCRIPT:\ncaller: yes"
    assert got["inline"].message == "SCRIPT:\n(none provided)\n\nGUARDRAILS:\n(none provided)\n\nTRANSCRIPT:\nsaid"
    assert got["lacks"].message is None


@pytest.mark.parametrize("name", sorted({**gate.QUERIES, **shown.QUERIES}))
def test_plans_need_no_python(spark, sf, name):
    plan = {**gate.QUERIES, **shown.QUERIES}[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "CartesianProduct" not in plan
