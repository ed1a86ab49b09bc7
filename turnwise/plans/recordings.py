"""What a recording tells by its frames: layout, the agent's channel, quality, peaks, utterances and the measures of a call.

Frames come from ``functions.frames``; all that follows are sums, windows and
interval plans per channel. A recording fits into a row, so a channel's frames
fit into a window. Defined cases: a file that is no 16-bit WAV has no rows; an
empty channel has no frames and so no measures; a channel of zeros has null
levels, which stand for minus infinity.
"""

from __future__ import annotations

import io
import wave

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.frames import DROPOUT_MS, FRAME_S, FULL_SCALE, dbfs, frames, packed
from ..functions.stats import half_even
from ..operators import intervals as iv
from ..session import materialize

#: fixed limits of the measures
MIXED, SILENT = 0.95, 0.02
FLOOR_DBFS, FLOOR_MARGIN = -120.0, 6.0
SPEECH_DBFS, HANGOVER_S, LEAST_S = -50.0, 0.20, 0.10
DEAD_AIR_S = 1.5
PEAKS_PER_S = 50
SPEAKERS = ("caller", "agent")


def layout(rows: DataFrame, key: str = "call_id") -> DataFrame:
    """key, layout (mono, separated or mixed) and agent_channel (null: not told apart) of each recording.

    One channel, two silent ones or one below ``SILENT`` of the other's level are
    mono; channels whose correlation is ``MIXED`` or more are one signal. The
    agent's channel is the one whose quiet frames are quieter by ``FLOOR_MARGIN``.
    """
    level = F.coalesce(dbfs(F.col("squares") / F.col("n")), F.lit(FLOOR_DBFS))
    whole = F.col("n") == (F.col("rate") * FRAME_S).cast("int")
    per = rows.where("channel < 2").groupBy(key, "channel").agg(
        F.max("channels").alias("channels"), F.sum("n").cast("double").alias("n"), F.sum("total").cast("double").alias("s"), F.sum("squares").cast("double").alias("q"),
        F.sum("products").cast("double").alias("p"), F.coalesce(F.percentile(F.when(whole, level), 0.1), F.lit(FLOOR_DBFS)).alias("floor"),
    )

    def of(c: int, name: str):
        return F.max(F.when(F.col("channel") == c, F.col(name)))

    both = per.groupBy(key).agg(F.max("channels").alias("channels"), F.max("n").alias("n"), F.max("p").alias("p"), *[of(c, x).alias(f"{x}{c}") for c in (0, 1) for x in ("s", "q", "floor")])
    mean = [F.col(f"s{c}") / F.col("n") for c in (0, 1)]
    spread = [F.col(f"q{c}") / F.col("n") - mean[c] * mean[c] for c in (0, 1)]
    r = F.when((F.col("n") < 2) | (spread[0] <= 0) | (spread[1] <= 0), 0.0).otherwise(F.abs(F.col("p") / F.col("n") - mean[0] * mean[1]) / F.sqrt(spread[0] * spread[1]))
    rms = [F.sqrt(F.col(f"q{c}") / F.col("n")) for c in (0, 1)]
    mono = (F.col("channels") < 2) | (F.greatest(*rms) == 0) | (F.least(*rms) < SILENT * F.greatest(*rms))
    apart = F.abs(F.col("floor0") - F.col("floor1")) >= FLOOR_MARGIN
    agent = F.when((F.col("channels") > 1) & apart, F.when(F.col("floor0") < F.col("floor1"), 0).otherwise(1))
    return both.select(key, F.when(mono, "mono").when(r >= MIXED, "mixed").otherwise("separated").alias("layout"), agent.cast("int").alias("agent_channel"))


def quality(rows: DataFrame, key: str = "call_id") -> DataFrame:
    """Peak and RMS level, coverage, share of clipped samples, and runs of zeros of ``DROPOUT_MS`` or more inside a channel's sound.

    Sums per channel alone. A run before the first sound starts at 0; one after
    the last sound is known by its length and taken off again.
    """
    loud = F.greatest(F.max(F.abs("hi")), F.max(F.abs("lo")))
    later = F.filter("zeros", lambda z: z.start > 0)
    per = rows.groupBy(key, "channel").agg(
        F.max("rate").alias("rate"), F.sum("n").alias("n"), F.sum("squares").alias("q"), loud.alias("peak"), F.sum("clipped").alias("clipped"), F.sum("silent").alias("_silent"),
        F.max("last").alias("last"), F.sum(F.size(later)).alias("runs"), F.sum(F.aggregate(later, F.lit(0).cast("long"), lambda a, z: a + z.end - z.start)).alias("samples"),
    )
    long = F.greatest(F.lit(1), (F.col("rate") * DROPOUT_MS / 1000).cast("int"))
    after = F.col("n") - 1 - F.col("last")
    after = F.when(after >= long, after).otherwise(0)
    return per.select(
        key,
        "channel",
        half_even((F.col("n") - F.col("_silent")) / F.col("n"), 4).alias("coverage"),
        half_even(F.when(F.col("peak") > 0, 20 * F.log10(F.col("peak") / FULL_SCALE)), 2).alias("peak_dbfs"),
        half_even(dbfs(F.col("q") / F.col("n")), 2).alias("rms_dbfs"),
        half_even(F.col("clipped") / F.col("n"), 6).alias("clipping_ratio"),
        (F.col("runs") - (after > 0).cast("int")).alias("dropout_count"),
        half_even((F.col("samples") - after) / F.col("rate"), 4).alias("dropout_s"),
    )


def peaks(files: DataFrame, per_second: int = PEAKS_PER_S, key: str = "call_id") -> DataFrame:
    """key, channel, peaks: (least, greatest) sample of each bucket as packed 16-bit numbers; a last bucket that is not full counts as filled up with zeros."""
    rows = frames(files, key, per_second=per_second)
    full = F.col("n") == F.greatest(F.lit(1), F.floor(F.col("rate") / per_second))
    pair = F.struct("frame", F.when(full, F.col("lo")).otherwise(F.least("lo", F.lit(0))).alias("lo"), F.when(full, F.col("hi")).otherwise(F.greatest("hi", F.lit(0))).alias("hi"))
    each = F.flatten(F.transform(F.sort_array(F.collect_list(pair)), lambda x: F.array(x.lo, x.hi)))
    return rows.groupBy(key, "channel").agg(packed(each).alias("peaks"))


def utterances(rows: DataFrame, key: str = "call_id") -> DataFrame:
    """key, channel, start, end in whole frames: sound over ``SPEECH_DBFS``, pauses up to the hangover bridged, short ones dropped.

    Sound whose last pause reaches the end of the recording lasts until there.
    """
    size = (F.col("rate") * FRAME_S).cast("int")
    whole = rows.where(F.col("n") == size).withColumn("_frames", F.max("frame").over(W.partitionBy(key, "channel")) + 1)
    hangover, least = round(HANGOVER_S / FRAME_S), round(LEAST_S / FRAME_S)
    order = W.partitionBy(key, "channel").orderBy("frame")
    loud = whole.where(dbfs(F.col("squares") / F.col("n")) > SPEECH_DBFS)
    new = F.when(F.col("frame") - F.lag("frame").over(order) <= hangover + 1, 0).otherwise(1)
    marked = loud.withColumn("_new", new).withColumn("_island", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    found = marked.groupBy(key, "channel", "_island").agg(F.min("frame").alias("start"), F.max("frame").alias("_last"), F.max("_frames").alias("_frames"))
    end = F.when(F.col("_frames") - 1 - F.col("_last") <= hangover, F.col("_frames")).otherwise(F.col("_last") + 1)
    return found.select(key, "channel", "start", end.alias("end")).where(F.col("end") - F.col("start") >= least)


def speakers(rows: DataFrame, told: DataFrame | None = None, key: str = "call_id") -> DataFrame:
    """key, channel, speaker: by an explicit map (key, channel, speaker), else by noise floors, else caller first."""
    agent = layout(rows, key).select(key, F.coalesce("agent_channel", F.lit(1)).alias("_agent"))
    known = rows.where("channel < 2").select(key, "channel").distinct().join(agent, key)
    guess = F.when(F.col("channel") == F.col("_agent"), SPEAKERS[1]).otherwise(SPEAKERS[0])
    if told is None:
        return known.select(key, "channel", guess.alias("speaker"))
    explicit = told.select(key, "channel", F.col("speaker").alias("_told"))
    mapped = told.select(key).distinct().withColumn("_mapped", F.lit(True))
    named = known.join(explicit, [key, "channel"], "left").join(mapped, key, "left")
    return named.select(key, "channel", F.when(F.col("_mapped"), F.col("_told")).otherwise(guess).alias("speaker")).where("speaker is not null")


def call_metrics(rows: DataFrame, told: DataFrame | None = None, agent_windows: DataFrame | None = None, dead_air_s: float = DEAD_AIR_S, key: str = "call_id") -> DataFrame:
    """One row per call with the measures of its sound; null where a measure has no ground.

    The agent's side comes from ``agent_windows`` (key, start, end in frames) where
    spans told them, else from its channel's utterances. Shares are of the time
    until the last sound of either side; dead air are gaps of ``dead_air_s`` or more.
    """
    who = materialize(speakers(rows, told, key), "speakers")
    said = materialize(utterances(rows, key).join(who, [key, "channel"]).select(key, "speaker", "start", "end"), "said")
    caller = said.where(F.col("speaker") == SPEAKERS[0]).select(key, "start", "end")
    agent = said.where(F.col("speaker") == SPEAKERS[1]).select(key, "start", "end") if agent_windows is None else agent_windows.select(key, "start", "end")
    agent, caller_union = materialize(iv.merged(agent, key), "agent"), iv.merged(caller, key)
    every = caller.unionByName(agent)
    span = every.groupBy(key).agg(F.max("end").alias("span"))
    bounds = span.select(key, F.lit(0).cast("long").alias("lo"), F.col("span").alias("hi"))
    least = round(dead_air_s / FRAME_S)
    dead = iv.gaps(iv.merged(every, key), bounds, key).where(F.col("end") - F.col("start") >= least)
    # an onset is inside the agent's time if the last window that starts before it still goes on
    points = caller.select(key, F.col("start").alias("t"), F.lit(None).cast("long").alias("end")).unionByName(agent.select(key, F.col("start").alias("t"), "end"))
    order = W.partitionBy(key).orderBy("t", F.col("end").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    inside = points.withColumn("_reach", F.last("end", ignorenulls=True).over(order)).where("end is null").groupBy(key).agg(F.count_if(F.col("t") < F.col("_reach")).alias("_barge"))
    covered = quality(rows, key).join(who, [key, "channel"]).groupBy(key).agg(F.min("coverage").alias("capture_coverage"))
    out = covered.join(span, key, "left")
    for name, part in (("_c", caller_union), ("_a", agent), ("_both", iv.intersected(caller_union, agent, key)), ("_dead", dead)):
        out = out.join(iv.length(part, key, name=name), key, "left")
    out = out.join(inside, key, "left")
    for name, part in (("turn_count_caller", caller), ("_n_agent", agent)):
        out = out.join(part.groupBy(key).agg(F.count("*").alias(name)), key, "left")
    ok, none = F.col("_n_agent") > 0, F.lit(0)

    def share(c: str):
        return half_even(F.coalesce(c, none) / F.col("span"), 4)

    return out.select(
        key,
        "capture_coverage",
        F.when(ok, F.coalesce("_barge", none)).alias("barge_in"),
        F.when(ok, half_even(F.coalesce("_dead", none) * FRAME_S, 4)).alias("dead_air_s"),
        share("_c").alias("talk_ratio_caller"),
        F.when(ok, share("_a")).alias("talk_ratio_agent"),
        F.when(ok, share("_both")).alias("overlap_ratio"),
        F.coalesce("turn_count_caller", none).alias("turn_count_caller"),
        F.when(ok, F.col("_n_agent")).alias("turn_count_agent"),
    )


CALL, RATE, PER_EVENT = 200, 8000, 320
TOGETHER = 100  # recordings of a partition, on average: a batch of them is decoded at once


def synthesised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """call_id, content: every 200 events are a recording of 40 ms each, whose samples their ids and kinds decide.

    Views are the caller's sound, clicks and purchases the agent's, an error cuts
    the caller's channel off. Of five recordings one is a downmix, one has an
    empty and one a missing second channel, and one has its channels swapped.
    """

    def wav(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("event_id")
        e, k, kind = rows["event_id"].to_numpy()[:, None], np.arange(PER_EVENT)[None], rows["event_type"].to_numpy()[:, None]
        x = np.where(kind == "view", ((k * 37 + e * 11) % 201 - 100) * 150, np.where(kind == "error", 0, (k * 7 + e) % 17 - 8)).ravel()
        y = np.where(np.isin(kind, ("click", "purchase")), ((k * 53 + e * 7) % 199 - 99) * np.where(kind == "click", 300, 328), (k * 5 + e) % 3 - 1).ravel()
        call = int(rows["call_id"].iloc[0])
        both = {0: (x, y), 1: (x, x), 2: (x, y * 0), 3: (y, x), 4: (x,)}[call % 5]
        out = io.BytesIO()
        with wave.open(out, "wb") as w:
            w.setnchannels(len(both))
            w.setsampwidth(2)
            w.setframerate(RATE)
            w.writeframes(np.stack(both, 1).astype("<i2").tobytes())
        return pd.DataFrame({"call_id": [call], "content": [out.getvalue()]})

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.floor(F.col("event_id") / CALL).alias("call_id"), "event_id", "event_type")
    # the events of a recording are small and its sound is not: by the size of events alone one task would get thousands of recordings
    rows = rows.repartition(max(1, rows.count() // (CALL * TOGETHER)), "call_id")
    return rows.groupBy("call_id").applyInPandas(wav, "call_id long, content binary")


def audio_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout(frames(synthesised(spark, sf_dir)))


def audio_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(frames(synthesised(spark, sf_dir)))


def audio_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return peaks(synthesised(spark, sf_dir), 30).select("call_id", "channel", F.lower(F.hex("peaks")).alias("peaks"))


def audio_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return call_metrics(materialize(frames(synthesised(spark, sf_dir)), "frames"), dead_air_s=0.4)


QUERIES = {"audio_layout": audio_layout, "audio_quality": audio_quality, "audio_peaks": audio_peaks, "audio_metrics_synth": audio_metrics}

_SAMPLES = """with recursive e as (select event_id // 200 as call_id, event_id as e, event_type as t, row_number() over (partition by event_id // 200 order by event_id) - 1 as slot from events),
raw as (select call_id, slot * 320 + k as i, case when t = 'view' then ((k * 37 + e * 11) % 201 - 100) * 150 when t = 'error' then 0 else (k * 7 + e) % 17 - 8 end as x,
case t when 'click' then ((k * 53 + e * 7) % 199 - 99) * 300 when 'purchase' then ((k * 53 + e * 7) % 199 - 99) * 328 else (k * 5 + e) % 3 - 1 end as y from e, (select unnest(range(320)) as k)),
s as (select call_id, i, case when call_id % 5 = 3 then y else x end as a, case call_id % 5 when 1 then x when 2 then 0 when 3 then x when 4 then null else y end as b from raw),
c as (select call_id, 0 as channel, i, a as v from s union all select call_id, 1, i, b from s where b is not null)"""
_FRAMES = """, f as (select call_id, channel, i // 160 as frame, count(*) as n, sum(v * v) as q from c group by all),
l as (select *, coalesce(case when q > 0 then 20 * log10(sqrt(q / n) / 32768) end, -120.0) as level from f)"""
_LAYOUT = """, g as (select call_id, channel, quantile_cont(level, 0.1) filter (n = 160) as floor from l group by all),
m as (select call_id, cast(count(*) as double) as n, cast(sum(a) as double) as s0, cast(sum(b) as double) as s1, cast(sum(a * a) as double) as q0, cast(sum(b * b) as double) as q1, cast(sum(a * b) as double) as p from s group by 1),
h as (select m.*, g0.floor as f0, g1.floor as f1, q0 / n - (s0 / n) * (s0 / n) as v0, q1 / n - (s1 / n) * (s1 / n) as v1 from m join g g0 on g0.call_id = m.call_id and g0.channel = 0 left join g g1 on g1.call_id = m.call_id and g1.channel = 1),
y as (select call_id, case when q1 is null or greatest(q0, q1) = 0 or least(sqrt(q0 / n), sqrt(q1 / n)) < 0.02 * greatest(sqrt(q0 / n), sqrt(q1 / n)) then 'mono'
when case when v0 <= 0 or v1 <= 0 then 0 else abs(p / n - (s0 / n) * (s1 / n)) / sqrt(v0 * v1) end >= 0.95 then 'mixed' else 'separated' end as layout,
cast(case when abs(f0 - f1) >= 6 then case when f0 < f1 then 0 else 1 end end as integer) as agent_channel from h)"""
_QUALITY = """, z as (select *, sum(cast(v <> 0 as integer)) over (partition by call_id, channel order by i) as island, max(case when v <> 0 then i end) over (partition by call_id, channel) as last from c),
r as (select call_id, channel, count(*) as n from z where v = 0 and island > 0 and i < last group by call_id, channel, island having count(*) >= 320),
d as (select call_id, channel, count(*) as dropout_count, sum(n) as samples from r group by all),
k as (select call_id, channel, cast(printf('%.4f', count(*) filter (v <> 0) / count(*)) as double) as coverage, cast(printf('%.2f', 20 * log10(nullif(max(abs(v)), 0) / 32768)) as double) as peak_dbfs,
cast(printf('%.2f', 20 * log10(sqrt(nullif(sum(v * v), 0) / count(*)) / 32768)) as double) as rms_dbfs, cast(printf('%.6f', count(*) filter (abs(v) >= 32768 * pow(10, -0.1 / 20)) / count(*)) as double) as clipping_ratio from c group by all)"""

ORACLE_SQL = {
    "audio_layout": f"{_SAMPLES}{_FRAMES}{_LAYOUT} select * from y",
    "audio_quality": f"{_SAMPLES}{_QUALITY} select k.*, coalesce(dropout_count, 0) as dropout_count, cast(printf('%.4f', coalesce(samples, 0) / 8000) as double) as dropout_s from k left join d using (call_id, channel)",
    "audio_peaks": f"""{_SAMPLES}, b as (select call_id, channel, i // 266 as bucket, count(*) as n, min(v) as lo, max(v) as hi from c group by all),
p as (select call_id, channel, bucket, case when n < 266 then least(lo, 0) else lo end as lo, case when n < 266 then greatest(hi, 0) else hi end as hi from b),
u as (select *, [(x + 65536) % 65536 for x in [lo, hi]] as w from p),
t as (select *, list_transform(w, lambda x: lower(printf('%02x%02x', cast(x % 256 as integer), cast(x // 256 as integer)))) as h from u)
select call_id, channel, string_agg(h[1] || h[2], '' order by bucket) as peaks from t group by all""",
    "audio_metrics_synth": f"""{_SAMPLES}{_FRAMES}{_LAYOUT}{_QUALITY},
o as (select call_id, channel, frame, case when frame - lag(frame) over (partition by call_id, channel order by frame) <= 11 then 0 else 1 end as new from l where n = 160 and level > -50),
i as (select *, sum(new) over (partition by call_id, channel order by frame) as island from o),
w as (select call_id, max(frame) + 1 as frames from f where n = 160 group by 1),
u as (select i.call_id, i.channel, min(frame) as s, case when any_value(frames) - 1 - max(frame) <= 10 then any_value(frames) else max(frame) + 1 end as t from i join w using (call_id) group by i.call_id, i.channel, island),
x as (select u.call_id, case when channel = coalesce(agent_channel, 1) then 'agent' else 'caller' end as who, s, t from u join y using (call_id) where t - s >= 5),
n as (select call_id, max(t) as span, count(*) filter (who = 'caller') as nc, count(*) filter (who = 'agent') as na, sum(t - s) filter (who = 'caller') as c, sum(t - s) filter (who = 'agent') as a from x group by 1),
pr as (select p.call_id, sum(greatest(least(p.t, q.t) - greatest(p.s, q.s), 0)) as shared, count(*) filter (q.s < p.s and p.s < q.t) as barge from x p join x q on p.call_id = q.call_id and p.who = 'caller' and q.who = 'agent' group by 1),
ev as (select call_id, s, t from x union all select call_id, span, span from n),
gp as (select call_id, s, coalesce(max(t) over (partition by call_id order by s, t rows between unbounded preceding and 1 preceding), 0) as reach from ev),
da as (select call_id, sum(s - reach) as dead from gp where s - reach >= 20 group by 1),
cv as (select call_id, min(coverage) as capture_coverage from k group by 1)
select cv.call_id, capture_coverage, case when na > 0 then coalesce(barge, 0) end as barge_in, case when na > 0 then cast(printf('%.4f', coalesce(dead, 0) * 0.02) as double) end as dead_air_s,
cast(printf('%.4f', coalesce(c, 0) / span) as double) as talk_ratio_caller, case when na > 0 then cast(printf('%.4f', a / span) as double) end as talk_ratio_agent, case when na > 0 then cast(printf('%.4f', coalesce(shared, 0) / span) as double) end as overlap_ratio,
coalesce(nc, 0) as turn_count_caller, case when na > 0 then na end as turn_count_agent from cv left join n using (call_id) left join pr using (call_id) left join da using (call_id)""",
}
