"""Small functions with known answers."""

import io
import wave

import numpy as np
from pyspark.sql import functions as F

from turnwise.functions import audio
from turnwise.operators import intervals as iv
from turnwise.plans import truth
from turnwise.plans.pricing import priced, price_rows
from turnwise.plans.security import run_sql
from turnwise.functions.text import wer


def test_wer(spark):
    rows = [("the cat sat", "the cat sit"), ("a b c", "a c"), ("", ""), ("", "x"), (None, "x y")]
    got = [r.w for r in spark.createDataFrame(rows, "a string, b string").select(wer(F.col("a"), F.col("b")).alias("w")).collect()]
    assert got == [1 / 3, 1 / 3, 0.0, 1.0, 1.0]


def test_truth(spark):
    turns = spark.createDataFrame([("c", 0, 1.0, 1.4, "the cat sat"), ("c", 1, 2.0, 2.05, None)], "call_id string, turn_index int, tts_first_audio_at double, audio_out_start_s double, transcript string")
    assert [(r.delta, r.verdict) for r in truth.first_audio(turns).orderBy("turn_index").collect()] == [(400.0, "material"), (50.0, "within_band")]
    heard = spark.createDataFrame([("c", "the cat sit")], "call_id string, said string")
    assert [(r.delta, r.verdict) for r in truth.transcripts(turns, heard).collect()] == [(0.3333, "material")]


def wav(*sides, rate=8000):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(len(sides))
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.stack(sides, 1).astype("<i2").tobytes())
    return out.getvalue()


def test_audio(spark):
    t = np.arange(8000 * 3) / 8000
    tone = np.where((t >= 0.5) & (t < 1.5), 8000 * np.sin(2 * np.pi * 220 * t), 0)
    files = spark.createDataFrame([("c", wav(tone, tone * 0)), ("bad", b"x")], "call_id string, content binary")
    got = {r.channel: r for r in audio.utterances(files).collect()}
    assert (got["caller"].t_start, got["caller"].t_end) == (0.5, 1.5) and got["agent"].t_start is None and got["agent"].coverage == 0.0


def test_interval_arrays(spark):
    one = spark.sql("select array(named_struct('start', 0D, 'end', 1D), named_struct('start', 1D, 'end', 2D), named_struct('start', 4D, 'end', 5D)) a, array(named_struct('start', 1.5D, 'end', 4.5D)) b")
    r = one.select(
        iv.array_total(iv.array_merged(F.col("a"))).alias("union"), iv.array_total(iv.array_intersected(F.col("a"), F.col("b"))).alias("both"), iv.array_total(iv.array_subtracted(iv.array_merged(F.col("a")), F.col("b"))).alias("left")
    ).first()
    assert (r.union, r.both, r.left) == (3.0, 1.0, 2.0)


def test_prices(spark):
    rows = [("model-a", None, None, 1_000_000.0, None, 250_000.0, None, None), (None, "ear-a", None, None, None, None, None, None), ("nobody", None, None, 5.0, 5.0, None, None, None)]
    usage = spark.createDataFrame(rows, "llm_model string, stt_model string, tts_model string, tokens_in double, tokens_out double, tokens_cached double, tts_chars double, stt_seconds double")
    got = {r.llm_model: r for r in priced(usage, price_rows(spark)).collect()}
    assert round(got["model-a"].cost_llm, 6) == 0.325 and got["model-a"].cost_stt is None
    assert got[None].cost_stt == 0.0 and got["nobody"].cost_total is None


def test_sql_over_views(spark):
    views = {"calls": spark.range(5).withColumnRenamed("id", "call_id")}
    out = run_sql(spark, views, "with x as (select call_id from calls) select count(*) as n from x")
    assert out == {"columns": ["n"], "rows": [[5]], "row_count": 1, "truncated": False}
    assert run_sql(spark, views, "select * from calls", cap=3)["truncated"]
    for bad in ("drop table calls", "select 1; select 2", "select * from other", "select nope from calls"):
        assert "error" in run_sql(spark, views, bad)


def test_sql_scope_holds_for_with_names(spark):
    spark.range(3).createOrReplaceTempView("mine")
    spark.sql("create table if not exists secret using parquet as select 42 as x")
    views = {"calls": spark.range(5).withColumnRenamed("id", "call_id")}
    hidden = "select * from (with secret as (select 1 as x) select * from secret) a, secret b"
    for bad in (hidden, "select * from secret", "select (select max(x) from secret) as x from calls", "select * from calls where call_id in (select x from secret)", "select * from mine"):
        assert "error" in run_sql(spark, views, bad), bad
    own = run_sql(spark, views, "with secret as (select 1 as x) select x from secret")
    assert own["rows"] == [[1]]
    inner = run_sql(spark, views, "select a.call_id from calls a join calls b on a.call_id = b.call_id where a.call_id in (select max(call_id) from calls)")
    assert inner["rows"] == [[4]]


def test_sql_writes_and_reaches_nothing(spark, tmp_path):
    views = {"calls": spark.range(5).withColumnRenamed("id", "call_id")}
    spark.range(3).write.parquet(str(tmp_path / "in"))
    spark.sql("create table if not exists secret using parquet as select 42 as x")
    for n, bad in enumerate(
        (
            "with x as (select 1 as a) insert overwrite directory '{}' using parquet select * from x",
            "with x as (select 1 as a) insert overwrite local directory '{}' using json select * from x",
            "with x as (select 1 as a) insert into secret select * from x",
            "with x as (select 1 as a) from x insert overwrite directory '{}' using json select *",
            "select reflect('java.lang.System', 'getProperty', 'user.home')",
            "select call_id from calls where java_method('java.lang.System', 'getProperty', 'user.home') is not null",
            "select (select max(try_reflect('java.lang.System', 'getProperty', 'user.home')) from calls) as x",
            "with y as (select reflect('java.lang.System', 'gc') as g) select * from y",
            "select call_id from calls order by reflect('java.lang.System', 'gc')",
            "select transform(array(1), x -> reflect('java.lang.System', 'gc')) from calls",
            "select system.builtin.reflect('java.lang.System', 'gc')",
            "select raise_error('x'), version(), input_file_name() from calls",
            "select * from parquet.`{}`".replace("{}", str(tmp_path / "in")),
            "select * from text.`/etc/passwd`",
            "select * from sql_keywords()",
            "select sum(a.call_id) filter (where exists (select reflect('java.lang.System', 'gc'))) from calls a",
        )
    ):
        out = run_sql(spark, views, bad.replace("{}", str(tmp_path / f"out-{n}")))
        assert "error" in out, bad
        assert not (tmp_path / f"out-{n}").exists()
    fine = """with a as (select call_id, row_number() over (order by call_id desc) as r, date_trunc('day', timestamp'2024-05-05 01:02:03') as d from calls), b as (select explode(array(1, 2)) as e)
        select count(*) as n, max(cast(d as string)) as d, sum(if(r > 2 and call_id in (select id from range(9)), 1, 0)) as m, max(length(upper('x'))) as l, percentile(e, 0.5) as p from a cross join b lateral view explode(array(e)) t as z"""
    assert run_sql(spark, views, fine, seconds=60.0) == {"columns": ["n", "d", "m", "l", "p"], "rows": [[10, "2024-05-05 00:00:00", 6, 1, 1.5]], "row_count": 1, "truncated": False}


def test_sql_ends_in_time(spark):
    out = run_sql(spark, {"calls": spark.range(10)}, "select count(*) as n from range(1000000000) a, range(1000000) b where a.id * b.id % 7 = 3", seconds=2.0)
    assert "error" in out
