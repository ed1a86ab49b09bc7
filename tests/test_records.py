"""Record plans and judgments on small cases: gaps, promotions, nulls, empty tables."""

import json

from pyspark.sql import functions as F

from turnwise.plans import judged, records


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


BATCH = "call_id string, trace_id string, agent_id string, source string, environment string, has_root boolean, at long, ord long"


def test_upsert_promotes_and_fills_gaps(spark):
    made = spark.createDataFrame(
        [
            ("t1", "t1", None, "unknown", "prod", False, 1, 1),
            ("real", "t1", "a", "other", "dev", None, 9, 2),
            ("t1", "t1", "b", None, None, True, 5, 0),
            ("alone", None, None, None, None, None, None, 3),
            ("t2", None, "a", "s", "prod", None, 4, 4),
            ("t3", "t3", None, "s", "prod", None, 1, 10),
            ("named", "t3", "first", "s", "prod", None, 1, 11),
            ("t3", "t3", "later", "s", "prod", None, 1, 12),
            ("named", "t3", "last", "s", "prod", None, 1, 13),
            (None, "t9", "a", "s", "prod", True, 1, 5),
        ],
        BATCH,
    )
    scripts = spark.createDataFrame([("b", "p")], "agent_id string, prompt_id string")
    got = rows(records.upserted(made, scripts), "call_id", "trace_id", "agent_id", "source", "spans_complete", "last_activity_at", "prompt_id")
    assert got == [("alone", None, None, "unknown", False, None, None), ("named", "t3", "first", "s", False, 1, None), ("real", "t1", "b", "unknown", True, 9, "p"), ("t2", None, "a", "s", False, 4, None)]
    assert records.upserted(spark.createDataFrame([], BATCH)).count() == 0


def test_upsert_keeps_a_promoted_name_and_what_creation_fixed(spark):
    made = spark.createDataFrame(
        [
            ("t1", "t1", None, None, None, False, 1, 1),
            ("real", "t1", "a", "late", "dev", True, 2, 2),
            ("t1", "t1", "b", "later", "dev", None, 3, 3),
            ("t2", "t2", None, "web", "dev", None, 1, 4),
            ("one", "t2", None, None, None, None, 1, 5),
            ("two", "t2", None, None, None, None, 1, 6),
            ("t2", "t2", None, None, None, None, 9, 7),
            ("t3", "t3", None, None, "test", None, 1, 8),
        ],
        BATCH,
    )
    got = rows(records.upserted(made.repartition(4)), "call_id", "trace_id", "agent_id", "source", "environment", "spans_complete", "last_activity_at")
    assert got == [("real", "t1", "a", "unknown", "prod", True, 3), ("t3", "t3", None, "unknown", "test", False, 1), ("two", "t2", None, "web", "dev", False, 9)]


def test_replace_drops_calls_without_new_rows(spark):
    old = spark.createDataFrame([(1, "x"), (2, "y"), (None, "z")], "call long, v string")
    new = spark.createDataFrame([(2, "n", 0), (3, "stray", 0)], "call long, v string, more int")
    again = spark.createDataFrame([(1,), (2,), (2,), (None,)], "call long")
    assert rows(records.replaced(old, new, "call", again), "v") == [("n",), ("z",)]


def test_versions_count_every_update(spark):
    old = spark.createDataFrame([("a", "1", 4), ("b", "2", 1)], "agent string, body string, version long")
    new = spark.createDataFrame([("a", "3", 2), ("a", None, 9), ("c", "5", 1)], "agent string, body string, ord int")
    assert rows(records.bumped(old, new, "agent"), "agent", "body", "version") == [("a", None, 6), ("b", "2", 1), ("c", "5", 1)]


def test_first_rule_wins_even_when_it_captures_nothing(spark):
    paths = spark.createDataFrame([("a/7.wav",), ("a/.wav",), ("b/7.json",), (None,), ("",)], "path string")
    got = records.by_first_rule(paths, "path", [("audio", r"a/([0-9]*)\.wav"), ("any", r"([0-9a-z]+)")])
    assert rows(got, "path", "kind", "call_id") == [("a/7.wav", "audio", "7"), ("b/7.json", "any", "b")]


def test_counts_and_casts(spark):
    one = spark.createDataFrame([(0, 0, " 12 ", "4.2", "1__0", " Ü-A b ")], "a int, b int, x string, y string, z string, name string")
    c = F.col
    got = one.select(
        records.agreement(c("a"), c("b")), records.agreement(F.lit(1), F.lit(3)), records.agreement(F.lit(None).cast("int"), c("b")),
        records.tolerant_int(c("x")), records.tolerant_int(c("y")), records.tolerant_int(c("z")), records.slug(c("name")), records.slug(F.lit("--")),
    ).first()
    assert tuple(got) == (1.0, 0.3333, None, 12, None, None, "a-b", "org")


def test_params_need_a_key(spark):
    up = spark.createDataFrame([(1, {"id": " 5 ", "n": " a"}), (1, {"id": "  "}), (1, {"n": "b"}), (1, None)], "upload_id int, cells map<string,string>")
    assert [(r["key"], r["params"]["n"]) for r in records.params_rows(up, "id").collect()] == [("5", "a")]


JUDGED = "is_failure boolean, model_fault string, model_fault_detail string, hallucination boolean, hallucination_detail string, root_cause string, suggested_fix string, llm_corrections array<string>, guardrail_violation boolean, guardrail_violation_points array<string>"


def test_failure_block(spark):
    cells = ("d", True, "h", "r", "s", ["c"], None, ["p"])
    made = spark.createDataFrame([(True, " LLM", *cells), (None, "llm", *cells), (True, None, *cells), (True, "gpu", *cells)], JUDGED)
    got = [(r.is_failure, r.model_fault, r.model_fault_detail, r.hallucination_detail, r.root_cause, r.llm_corrections, r.guardrail_violation_points) for r in judged.consistent(made).collect()]
    assert got == [
        (True, "llm", "d", "h", "r", ["c"], []),
        (False, "none", None, None, None, [], []),
        (True, "none", None, "h", "r", [], []),
        (True, "other", "d", "h", "r", [], []),
    ]


def test_training_rows(spark):
    fix = "array<struct<turn_id:string,kind:string,observed:string,corrected:string,corrected_tool:string,corrected_args:string>>"
    calls = spark.createDataFrame(
        [
            ("a", 1, "llm", "yes", "S", [("t1", "response", " No way, sir ", "Sure", None, None), ("t1", "response", "x", "", "", None)]),
            ("b", 1, "llm", None, None, [("t0", "tool_call", None, None, "find", None)]),
            ("c", 1, "asr", "no", "S", [("t0", "response", "q", "r", None, None)]),
        ],
        f"call_id string, agent_id int, model_fault string, objective string, script string, corrections {fix}",
    )
    turns = spark.createDataFrame([("a", 0, "", "Hi"), ("a", 1, "Help", "No way"), ("a", 2, "Bye", None)], "call_id string, turn_index int, caller string, agent string")
    got = {r.call_id: json.loads(r.row) for r in judged.training_rows(calls, turns, "dpo", "openai").collect()}
    assert set(got) == {"a", "b"}
    assert [m["content"] for m in got["a"]["input"]["messages"]] == ["S", "Hi", "Help"]
    assert got["a"]["preferred_output"] == [{"role": "assistant", "content": "Sure"}] and got["a"]["meta"]["recoverable"] is False
    assert got["b"]["preferred_output"][0] == {"role": "assistant", "content": None, "tool_calls": [{"type": "function", "function": {"name": "find", "arguments": "{}"}}]}
    assert got["b"]["input"]["messages"] == [{"role": "system", "content": ""}] and got["b"]["meta"]["outcome"] == "uncertain"
