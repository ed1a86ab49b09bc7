"""Pull ingest over real files, its log, recordings attached later, and word error rates by letters."""

import os
import tempfile

import pytest
from pyspark.sql import functions as F

from turnwise.functions import text
from turnwise.plans import pull, truth

RULES = [("audio", r"/([a-z0-9]+)/call\.wav$"), ("trace", r"/([a-z0-9]*)/trace\.json$")]


def put(folder, name, at):
    path = f"{folder}/{name}"
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(name)
    os.utime(path, (at, at))


def sweep(spark, folder, log, number, cutoff, bad=()):
    objects = pull.listing(spark, folder).withColumn("agent_id", F.lit("a"))
    rows = pull.due(pull.calls_found(objects, RULES), pull.outcomes(spark, log), F.timestamp_seconds(F.lit(cutoff)))
    got = {r.call_id: (r.why, len(r.objects)) for r in rows.collect()}
    pull.record(rows.withColumn("ok", ~F.col("call_id").isin(*bad) if bad else F.lit(True)), log, number)
    return got


def test_sweeps(spark):
    folder, log = tempfile.mkdtemp(prefix="spark-", dir="/tmp"), tempfile.mkdtemp(prefix="spark-", dir="/tmp") + "/log"
    for name, at in (("c1/call.wav", 100), ("c1/trace.json", 200), ("c2/call.wav", 300), ("c3/trace.json", 250), ("c4/call.wav", 900), ("c5/notes.txt", 10), ("trace.json", 10)):
        put(folder, name, at)
    assert "content" not in pull.listing(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert sweep(spark, folder, log, 1, 500, bad=("c3",)) == {"c1": ("new", 2), "c2": ("new", 1), "c3": ("new", 1)}
    assert sweep(spark, folder, log, 2, 500, bad=("c3",)) == {"c3": ("retry", 1)}
    # the same sweep again replaces what it logged
    assert sweep(spark, folder, log, 2, 500, bad=("c3",)) == {"c3": ("retry", 1)}
    put(folder, "c1/more/../call.wav", 600)
    assert sweep(spark, folder, log, 3, 700) == {"c1": ("new", 2), "c3": ("retry", 1)}
    assert sweep(spark, folder, log, 4, 700) == {}
    assert sweep(spark, folder, log, 5, 1000) == {"c4": ("new", 1)}


def test_tries_end_and_a_newer_object_begins_anew(spark):
    log = spark.createDataFrame([("a", "c", 10, False, n) for n in range(1, 6)] + [("a", "d", 5, False, 1), ("a", "d", 5, True, 2), ("a", "d", 5, False, 3)], "agent_id string, call_id string, latest long, ok boolean, sweep long")
    log = log.withColumn("latest", F.timestamp_seconds("latest"))
    assert [tuple(r) for r in pull.retries(log).collect()] == [("a", "d", 1)]
    found = spark.createDataFrame([("a", "c", 10), ("a", "d", 5), ("a", "e", None), ("b", "c", 1)], "agent_id string, call_id string, latest long").withColumn("latest", F.timestamp_seconds("latest"))
    cutoff = F.timestamp_seconds(F.lit(100))
    assert sorted((r.agent_id, r.call_id, r.why) for r in pull.due(found, log, cutoff).collect()) == [("a", "d", "retry"), ("b", "c", "new")]
    newer = found.where("call_id = 'c'").withColumn("latest", F.timestamp_seconds(F.lit(50)))
    assert sorted((r.agent_id, r.why) for r in pull.due(newer, log, cutoff).collect()) == [("a", "new"), ("b", "new")]
    assert pull.due(found.where("false"), log, cutoff).count() == 0


def test_recordings_are_attached_once(spark):
    stamp = F.timestamp_seconds("modified")
    rec = spark.createDataFrame([("a", c, k, f"{c}/{n}", m) for c, k, n, m in (("1", "audio", "b", 5), ("1", "audio", "a", 6), ("2", "audio", "x", 5), ("3", "audio", "x", 5), ("4", "audio", "x", 99), ("5", "audio", "x", 5), ("1", None, "y", 5), (None, "audio", "z", 5))], "agent_id string, call_id string, kind string, uri string, modified long").withColumn("modified", stamp)
    calls = spark.createDataFrame([("a", "1", True, False, "waiting"), ("a", "2", True, False, "waiting"), ("a", "3", False, True, "waiting"), ("a", "4", False, False, "waiting"), ("b", "5", True, False, "waiting")], "agent_id string, call_id string, spans_complete boolean, media_ready boolean, status string")
    gone, media = spark.createDataFrame([("2",)], "call_id string"), spark.createDataFrame([("3", "audio"), ("1", "peaks")], "call_id string, kind string")
    new = pull.attached(rec, calls, gone, media, F.timestamp_seconds(F.lit(50)))
    assert [tuple(r) for r in new.collect()] == [("1", "audio", "1/a")]
    assert {r.call_id: (r.media_ready, r.status) for r in pull.with_media(calls, new).collect()} == {"1": (True, "ingested"), "2": (False, "waiting"), "3": (True, "waiting"), "4": (False, "waiting"), "5": (False, "waiting")}


@pytest.mark.parametrize("letters", [text.LETTERS, 3])
def test_word_errors_by_letters(spark, monkeypatch, letters):
    monkeypatch.setattr(text, "LETTERS", letters)
    pairs = [("a b c", "a x c d"), ("", ""), (None, "x"), ("x", None), ("Über b", "ber b"), (" ".join(f"w{i % 700}" for i in range(900)), " ".join(f"w{i % 701}" for i in range(880)))]
    df = spark.createDataFrame(pairs, "r string, h string").coalesce(1)
    words = [(r.a, r.b) for r in df.select(text.tokens(F.col("r")).alias("a"), text.tokens(F.col("h")).alias("b")).collect()]
    assert [r.wer for r in text.with_wer(df, "r", "h").collect()] == [text.word_errors(a, b) / len(a) if a else float(bool(b)) for a, b in words]


def test_pairs_of_conversations(spark, sf):
    assert truth.wer_pairs(spark, sf).where("wer < 0 or wer is null").count() == 0
