"""Registrations: a batch has the outcome of its rows taken one by one."""

import random

from turnwise.operators.ordered import ranked
from turnwise.plans import intake


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


CALL = "call_id string, status string, spans_complete boolean, media_ready boolean, channel_map string, sample_rate long, t0_offset_s double, last_activity_at long"
ARRIVAL = "call_id string, kind string, uri string, sha256 string, channel_map string, sample_rate long, t0_offset_s double, at long, ord long"


def test_artifacts(spark):
    make = spark.createDataFrame
    calls = make([("a", "awaiting_media", True, False, "old", 8000, None, 1), ("b", "awaiting_spans", False, None, None, None, 0.5, 1), ("c", "open", None, False, None, None, None, 1), ("d", "open", True, False, None, None, None, 1)], CALL)
    media = make([("a", "audio", "u0", "s0"), ("c", "audio", "u1", None)], "call_id string, kind string, uri string, sha256 string")
    arrivals = make(
        [
            ("a", "audio", "u2", "s0", "new", 1, 9.0, 50, 1),  # stands already
            ("a", "audio_agent", "late", "s1", "", 0, None, 8, 3),
            ("a", "audio_agent", "first", "s1", "kept", 16000, 0.0, 7, 2),
            ("b", "audio", "u3", None, None, None, None, 6, 4),
            ("b", "otlp", "u4", "s2", "not of a recording", 44100, 1.0, 9, 5),
            ("c", "audio", "u5", None, "x", 1, 1.0, 5, 6),  # no digest equals none
            ("d", "transcript", "u6", "s3", "x", 1, 1.0, 4, 7),
            ("z", "audio", "u7", "s4", "x", 1, 1.0, 3, 8),
            (None, "audio", "u8", "s5", "x", 1, 1.0, 3, 9),
        ],
        ARRIVAL,
    )
    after, stored = intake.registered(calls, media, arrivals)
    assert rows_of(after, "call_id") == [
        ("a", "ingested", True, True, "kept", 16000, 0.0, 7),
        ("b", "awaiting_spans", False, True, None, None, 0.5, 9),
        ("c", "open", None, False, None, None, None, 1),
        ("d", "open", True, False, None, None, None, 4),
    ]
    assert sorted(r.uri for r in stored.collect()) == ["first", "u0", "u1", "u3", "u4", "u6"]
    again, same = intake.registered(after, stored, arrivals)
    assert rows_of(again, "call_id") == rows_of(after, "call_id") and same.count() == stored.count()
    none, still = intake.registered(calls, media, arrivals.where("false"))
    assert rows_of(none, "call_id") == rows_of(calls, "call_id") and still.count() == 2


def test_prompts_transcripts_calls(spark):
    make = spark.createDataFrame
    prompts = make([("s1", "one")], "template_sha256 string, text string")
    got = intake.prompts_added(prompts, make([("s1", "other", 1), ("s2", "later", 3), ("s2", "first", 2), (None, "x", 4)], "template_sha256 string, text string, ord int"))
    assert rows_of(got, "template_sha256") == [("s1", "one", False), ("s2", "first", True)]

    fields = "call_id string, source string, format string, content string, uri string"
    stored = make([("a", "s", "f", "old", None), ("b", "s", "f", "kept", None)], fields)
    sent = make([("a", None, None, None, "u", 2), ("a", "x", "y", "gone", None, 1), ("c", "x", None, "", None, 3)], fields + ", ord int")
    assert rows_of(intake.transcripts_replaced(stored, sent), "call_id") == [("a", None, None, None, "u"), ("b", "s", "f", "kept", None), ("c", "x", None, "", None)]

    calls = make([("a", "g1", "live")], "external_call_id string, agent_id string, source string")
    wanted = make([("a", "g9", 5, 1), ("b", None, 7, 3), ("b", "g2", 8, 4), (None, "g3", 1, 0)], "external_call_id string, agent_id string, at long, ord int")
    assert rows_of(intake.ensured(calls, wanted), "external_call_id") == [("a", "g1", "live"), ("b", None, "backfill")]

    old = make([("a", 1), ("b", 2), ("c", 3)], "call_id string, n int")
    new = make([("a", 4, "material"), ("b", 5, "within_band")], "call_id string, n int, verdict string")
    assert rows_of(intake.discrepancies(old, new, make([("a",), ("b",)], "call_id string")), "call_id") == [("a", 4), ("c", 3)]


def one_by_one(wanted, taken):
    """Rows asking for a longer name first, then by ord: each takes the first free name."""
    from collections import defaultdict

    held, out = defaultdict(set), {}
    for org, slug in taken:
        held[org].add(slug)
    for org, base, ord_ in sorted(wanted, key=lambda w: (-len(w[1]), w[2])):
        n, name = 1, base
        while name in held[org]:
            n += 1
            name = f"{base}-{n}"
        held[org].add(name)
        out[ord_] = name
    return out


def test_free_slugs(spark):
    rng = random.Random(3)
    names = ["a", "a-2", "a-3", "a-2-2", "a-02", "a-1", "b-12", "b", "a-99999999999999999999"]
    wanted = [(rng.choice("xy"), rng.choice(names), i) for i in range(120)]
    taken = [(rng.choice("xy"), rng.choice([*names, *(f"a-{i}" for i in range(2, 40, 3))])) for _ in range(60)] + [(None, "a"), ("x", None)]
    make = spark.createDataFrame
    held = make(taken, "org string, slug string")
    got = intake.free_slugs(make([*wanted, (None, "a", 999)], "org string, name string, ord long"), held)
    assert {r.ord: r.slug for r in got.collect()} == one_by_one(wanted, taken)
    assert intake.free_slugs(make([], "org string, name string, ord long"), held).count() == 0
    assert [r.slug for r in intake.free_slugs(make([("x", "  ?! ", 1)], "org string, name string, ord long"), held.where("false")).collect()] == ["org"]


def test_ranked_spreads_a_hot_key(spark):
    rows = spark.range(5000).selectExpr("if(id % 10 < 8, 'hot', concat('k', id % 7)) as k", "(id * 7919) % 1000 as v", "id").repartition(7)
    got = ranked(rows, ["k"], ["v", "id"], "place").collect()
    want, seen = {}, {}
    for k, v, i in sorted((r.k, r.v, r.id) for r in got):
        seen[k] = want[i] = seen.get(k, 0) + 1
    assert {r.id: r.place for r in got} == want and len(want) == 5000
