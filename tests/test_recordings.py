"""Recordings by their frames against measures of whole waves in numpy."""

import io
import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from turnwise.functions import frames as fr
from turnwise.functions.audio import channels, coverage, speech
from turnwise.plans import recordings as rec

RATE = 8000


def wav(*sides, rate=RATE):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(sides))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.stack(sides, 1).astype("<i2").tobytes())
    return out.getvalue()


def tone(start, end, seconds=2.0, amp=20000, floor=0):
    n = int(seconds * RATE)
    x = np.where(np.arange(n) % 2 == 0, floor, -floor).astype(float)
    at = np.arange(int(start * RATE), int(end * RATE))
    x[at] = amp * np.sin(2 * np.pi * 220 * at / RATE)
    return x.astype(np.int64)


def gapped(x, *gaps):
    x = np.where(x == 0, 1, x)
    for a, b in gaps:
        x[a:b] = 0
    return x


CALLS = {
    "separated": wav(tone(0, 1, floor=60), tone(1, 2, floor=1)),
    "swapped": wav(tone(1, 2, floor=1), tone(0, 1, floor=60)),
    "mixed": wav(tone(0.2, 1.8), tone(0.2, 1.8) // 2),
    "inverted": wav(tone(0.2, 1.8), -tone(0.2, 1.8)),
    "half": wav(tone(0.2, 1.8), tone(0, 0)),
    "silent": wav(tone(0, 0), tone(0, 0)),
    "constant": wav(np.full(4000, 900), np.full(4000, 1000)),
    "one": wav(tone(0.2, 1.8)),
    "odd": wav(gapped(tone(0, 2)[:12_345], (0, 50), (100, 419), (500, 820), (1000, 1321), (5000, 9000), (12_000, 12_345))),
    "short": wav(tone(0, 1)[:100]),
    "empty": wav(np.zeros(0)),
    "three": wav(tone(0, 1), tone(1, 2), tone(0, 2)),
    "none": None,
    "noise": b"RIFF nothing",
}


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame([(k, None if v is None else bytearray(v), 1) for k, v in CALLS.items()], "call_id string, content binary, channel int").repartition(3).cache()


def test_layouts_and_the_agents_channel(files):
    got = {r.call_id: (r.layout, r.agent_channel) for r in rec.layout(fr.frames(files)).collect()}
    assert got == {
        "separated": ("separated", 1), "swapped": ("separated", 0), "mixed": ("mixed", None), "inverted": ("mixed", None), "half": ("mono", None), "silent": ("mono", None),
        "constant": ("separated", None), "one": ("mono", None), "odd": ("mono", None), "short": ("mono", None), "three": ("separated", None),
    }


def test_quality_of_runs_that_cross_frames(files):
    got = {(r.call_id, r.channel): r for r in rec.quality(fr.frames(files)).collect()}
    odd = got["odd", 0]
    assert (odd.dropout_count, odd.dropout_s) == (3, round((320 + 321 + 4000) / RATE, 4))
    for (call, c), r in got.items():
        x = channels(CALLS[call])[1][c].astype(float)
        assert r.coverage == coverage(x) and r.clipping_ratio == round(float((abs(x) >= 32768 * 10 ** (-0.1 / 20)).mean()), 6)
        peak, rms = abs(x).max(), np.sqrt((x**2).mean())
        assert (r.peak_dbfs, r.rms_dbfs) == ((round(20 * np.log10(peak / 32768), 2), round(20 * np.log10(rms / 32768), 2)) if peak else (None, None))
    assert got["silent", 1].dropout_count == 0 and "empty" not in {c for c, _ in got}


def test_runs_of_zeros_reach_spark_whole_and_only_if_long(spark):
    """Noise with a zero in three samples has thousands of runs; quality sums them without a row of their own."""
    x = np.arange(20_000) % 3 - 3 * (np.arange(20_000) % 3 == 2)
    for a, b in ((0, 400), (5000, 9000), (12_001, 12_320), (19_500, 20_000)):
        x[a:b] = 0
    rows = fr.frames(spark.createDataFrame([("a", bytearray(wav(x)))], "call_id string, content binary"))
    assert [(r.frame, r.start, r.end) for r in rows.select("frame", F.inline("zeros")).orderBy("start").collect()] == [(0, 0, 400), (31, 5000, 9001), (75, 12_000, 12_320), (121, 19_500, 20_000)]
    got = rec.quality(rows)
    row, plan = got.first(), got._jdf.queryExecution().executedPlan().toString()
    assert (row.dropout_count, row.dropout_s, row.coverage) == (2, round((4001 + 320) / RATE, 4), coverage(x))
    assert not any(x in plan for x in ("Window", "Generate", "Join"))


def test_peaks_are_filled_up_and_packed(spark, files):
    got = {(r.call_id, r.channel): bytes(r.peaks) for r in rec.peaks(files, 30).collect()}
    for (call, c), data in got.items():
        x = channels(CALLS[call])[1][c]
        x = np.append(x, np.zeros(-len(x) % (RATE // 30), np.int64)).reshape(-1, RATE // 30)
        assert data == np.stack([x.min(1), x.max(1)], 1).astype("<i2").tobytes()
    rows = spark.createDataFrame([([0, 1, -1, 32767, -32768, 255, 256],), ([],)], "v array<int>")
    assert [(bytes(r.p), r.u) for r in rows.select(fr.packed(F.col("v")).alias("p")).withColumn("u", fr.unpacked(F.col("p"))).collect()] == [
        (struct.pack("<7h", 0, 1, -1, 32767, -32768, 255, 256), [0, 1, -1, 32767, -32768, 255, 256]),
        (b"", []),
    ]


def test_floats_go_and_come_back(spark):
    rows = spark.createDataFrame([([0.5, -120.0, 3.25],), ([],), (None,)], "v array<double>")
    packed = rows.select(fr.packed_floats(F.col("v")).alias("p"))
    assert [None if r.p is None else bytes(r.p) for r in packed.collect()] == [struct.pack("<3f", 0.5, -120.0, 3.25), b"", None]
    assert [r.u for r in packed.select(fr.unpacked_floats(F.col("p")).alias("u")).collect()] == [[0.5, -120.0, 3.25], [], None]


def test_utterances_and_measures(spark, files):
    rows = fr.frames(files)
    got = {}
    for r in rec.utterances(rows).collect():
        got.setdefault((r.call_id, r.channel), []).append((round(r.start * 0.02, 4), round(r.end * 0.02, 4)))
    for call, raw in CALLS.items():
        if call not in ("none", "noise", "empty"):
            rate, data = channels(raw)
            for c, x in enumerate(data):
                assert sorted(got.get((call, c), [])) == speech(x, rate), call
    told = spark.createDataFrame([("swapped", 0, "caller"), ("swapped", 1, "agent")], "call_id string, channel int, speaker string")
    by = {r.call_id: r for r in rec.call_metrics(rows, dead_air_s=0.1).collect()}
    assert (by["separated"].talk_ratio_caller, by["separated"].talk_ratio_agent, by["separated"].overlap_ratio, by["separated"].turn_count_agent) == (0.5, 0.5, 0.0, 1)
    assert (by["swapped"].barge_in, by["mixed"].barge_in, by["mixed"].overlap_ratio, by["mixed"].dead_air_s) == (0, 0, 0.9, 0.2)
    assert (by["one"].barge_in, by["one"].turn_count_caller, by["one"].talk_ratio_agent) == (None, 1, None)
    assert by["silent"].turn_count_caller == 0 and by["silent"].talk_ratio_caller is None
    mapped = {r.call_id: r for r in rec.call_metrics(rows.where("call_id = 'swapped'"), told).collect()}["swapped"]
    assert mapped.turn_count_caller == 1 and mapped.turn_count_agent == 1 and mapped.dead_air_s == 0
    windows = spark.createDataFrame([("one", 0, 50)], "call_id string, start long, end long")
    assert {r.call_id: r.barge_in for r in rec.call_metrics(rows.where("call_id = 'one'"), agent_windows=windows).collect()} == {"one": 1}


def test_two_mono_files_become_one():
    rate, data = channels(fr.combined(wav(np.arange(5)), wav(np.arange(3), rate=16000)))
    assert rate == RATE and data.tolist() == [[0, 1, 2, 3, 4], [0, 1, 2, 0, 0]]


def test_synthesised_recordings_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    """A partition has a bounded number of recordings, however small their events are."""
    from turnwise.plans import recordings

    monkeypatch.setattr(recordings, "TOGETHER", 1, raising=False)
    spark.range(1000).selectExpr("id as event_id", "'view' as event_type").write.parquet(f"{tmp_path}/events.parquet")
    assert recordings.synthesised(spark, str(tmp_path)).rdd.getNumPartitions() == 5
