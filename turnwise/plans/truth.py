"""Checks of reported values against the recording: first audio and transcript."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import half_even
from ..functions.text import with_wer

AUDIO_MS, MOST_WER = 150.0, 0.20


def first_audio(turns: DataFrame, band_ms: float = AUDIO_MS) -> DataFrame:
    """Measured minus reported onset of the agent's audio; material beyond the band."""
    delta = half_even((F.col("audio_out_start_s") - F.col("tts_first_audio_at")) * 1000, 1)
    return turns.where("audio_out_start_s is not null and tts_first_audio_at is not null").select(
        "call_id", "turn_index", F.lit("first_audio").alias("check"), delta.alias("delta"), F.when(F.abs(delta) > band_ms, "material").otherwise("within_band").alias("verdict")
    )


def transcripts(turns: DataFrame, words: DataFrame, most: float = MOST_WER) -> DataFrame:
    """Reported caller text of a call against recognised text (call_id, said); without one the check cannot be made."""
    said = turns.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn_index", "transcript"))), lambda x: x.transcript), " ").alias("reported"))
    both = said.join(words.select("call_id", F.col("said").alias("_said")), "call_id", "left")
    found = with_wer(both, "reported", "_said").withColumn("delta", F.when(F.col("_said").isNotNull(), half_even(F.col("wer"), 4)))
    verdict = F.when(F.col("delta").isNull(), "unverifiable").when(F.col("delta") > most, "material").otherwise("within_band")
    return found.select("call_id", F.lit(None).cast("int").alias("turn_index"), F.lit("transcript").alias("check"), "delta", verdict.alias("verdict"))


def material(checks: DataFrame) -> DataFrame:
    return checks.where("verdict = 'material'")


def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's text against the reply: two speakers' words stand in for a transcript and its recognition."""
    talk = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = talk.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("reported"))
    replied = talk.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("heard"))
    rows = with_wer(asked.join(replied, ["conv_id", "turn"]), "reported", "heard")
    return rows.select("conv_id", "turn", half_even(F.col("wer"), 4).alias("wer"))


QUERIES = {"wer_pairs": wer_pairs}
ORACLE_SQL: dict[str, str] = {}
