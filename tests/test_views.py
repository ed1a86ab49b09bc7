"""Curated views under scopes, also through ad-hoc SQL, and details of calls with gaps."""

from turnwise.plans import views
from turnwise.plans.security import Scope, run_sql


def tables(spark):
    make = spark.createDataFrame
    return {
        "call": make([("1", "x1", "a", "secret", True, False), ("2", "x2", "b", "secret", False, None)], "id string, external_call_id string, agent_id string, prompt_id string, spans_complete boolean, media_ready boolean"),
        "turn": make([("1", 2, "later"), ("1", None, "last"), ("1", 1, "first"), ("9", 1, "stray")], "call_id string, turn_index int, caller_transcript string"),
        "metric": make([("1", "b", 1.5, None, True, None), ("1", "capture_coverage", None, "t", False, "why")], "call_id string, name string, value_num double, value_text string, available boolean, reason string"),
        "event": make([("1", "span", "s1", 1, 0.5, "root"), ("1", "event", "s1", 3, 0.9, "two"), ("1", "event", "s1", 2, 0.7, "one"), ("1", "span", "s0", None, 0.1, "old"), ("1", "event", "gone", 1, 0.1, "lost")], "call_id string, kind string, span_id string, position int, t_offset_s double, name string"),
        "run": make([("1", 5, "ok", "x"), ("1", 7, "partial", "a, b,,"), ("1", None, "partial", "never")], "call_id string, started_at int, status string, error string"),
        "judgment": make([("1", "connected")], "call_id string, disposition string"),
        "cluster": make([("a", "summary", 1)], "agent_id string, lever string, cluster_key int"),
        "agent": make([("a", "A"), ("b", "B")], "id string, name string"),
    }


def test_views_hold_their_scope(spark):
    base = tables(spark)
    seen = views.agent_views(base, Scope.of(["a"]))
    assert set(seen) == {"calls", "events", "turns", "metrics", "judgments", "clusters", "agents"}
    assert {v: df.count() for v, df in seen.items()} == {"calls": 1, "events": 5, "turns": 3, "metrics": 2, "judgments": 1, "clusters": 1, "agents": 1}
    assert "prompt_id" not in seen["calls"].columns and [r.carrier for r in seen["calls"].collect()] == [None]
    assert {df.count() for df in views.agent_views(base, Scope(None)).values()} == {0}
    bound = views.agent_views(base, Scope.of(None, call_id="2"))
    assert {v: df.count() for v, df in bound.items()} == {"calls": 1, "events": 0, "turns": 0, "metrics": 0, "judgments": 0, "clusters": 1, "agents": 2}
    out = run_sql(spark, seen, "select t.caller_transcript from turns t join calls c on c.id = t.call_id order by t.turn_index nulls last", seconds=60.0)
    assert out["rows"] == [["first"], ["later"], ["last"]]
    assert "error" in run_sql(spark, seen, "select prompt_id from calls")


def test_details(spark):
    t = tables(spark)
    got = {r.id: r for r in views.details(t["call"], t["turn"], t["metric"], t["event"], t["run"], t["judgment"]).collect()}
    one, two = got["1"], got["2"]
    assert (one.header.id, "prompt_id" in one.header.asDict()) == ("x1", False)
    assert [x.caller_transcript for x in one.turns] == ["first", "later", "last"] and "call_id" not in one.turns[0].asDict()
    assert [(m.name, m.value) for m in one.metrics] == [("b", "1.5"), ("capture_coverage", "t")]
    assert [(s.name, [e.name for e in s.events]) for s in one.spans] == [("root", ["one", "two"]), ("old", [])]
    assert (one.trust.audio_analysis, one.trust.reasons, one.judgment.disposition) == (True, ["a", "b"], "connected")
    assert (two.turns, two.metrics, two.spans, two.judgment, two.trust.reasons, two.trust.audio_analysis) == ([], [], [], None, [], False)


def test_a_detail_shuffles_each_line_once(spark, sf):
    """Spans, their events and the lines of a call meet by call; no shuffle is by span or carries rows spelled out."""
    from turnwise.plans import views

    plan = views.call_detail(spark, sf)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert shuffles and not [line for line in shuffles if "span_id" in line or "l_linenumber" in line]


def test_events_without_a_span_are_in_none(spark):
    from turnwise.plans import views

    def rows(schema, *values):
        return spark.createDataFrame(list(values), schema)

    call = rows("id long, external_call_id string, spans_complete boolean, media_ready boolean", (1, "c", True, True))
    event = rows(
        "call_id long, kind string, span_id string, position int, t_offset_s double, name string",
        (1, "span", None, 1, 0.0, "x"), (1, "event", None, 1, 0.0, "lost"), (1, "span", "s", 2, 0.0, "y"), (1, "span", "s", 2, 0.0, "a"), (1, "event", "s", None, 2.0, "q"), (1, "event", "s", 3, 5.0, "p"),
    )
    turn = rows("call_id long, turn_index int", (1, 0))
    metric = rows("call_id long, name string, value_num double, value_text string, available boolean, reason string", (1, "m", 1.0, None, True, None))
    run = rows("call_id long, started_at timestamp, status string, error string", (1, None, "ok", None))
    judgment = rows("call_id long, disposition string", (1, "connected"))
    (got,) = views.details(call, turn, metric, event, run, judgment).collect()
    assert [(s.name, [e.name for e in s.events]) for s in got.spans] == [("x", []), ("a", ["p", "q"]), ("y", ["p", "q"])]
