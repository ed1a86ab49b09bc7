"""Usage to cost by a price table; a side without a price is unknown, not free."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRICE_SCHEMA = "model string, in_per_1m double, out_per_1m double, cached_per_1m double, chars_per_1m double, per_minute double"
#: example rows; deployments pass their own
EXAMPLE = [
    ("model-a", 0.4, 1.6, 0.1, None, None),
    ("model-b", 2.5, 10.0, 1.25, None, None),
    ("voice-a", None, None, None, 15.0, None),
    ("ear-a", None, None, None, None, 0.0043),
]


def price_rows(spark: SparkSession, rows: Iterable[tuple] = EXAMPLE) -> DataFrame:
    return spark.createDataFrame(list(rows), PRICE_SCHEMA)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def priced(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """usage with cost_llm, cost_stt, cost_tts and cost_total.

    Cached input tokens have their own rate and are taken from the input tokens,
    not below zero. A priced side with missing usage costs 0; a side whose model
    has no price (or no name) is null; the total sums the known sides and is null
    without one. Prices are one row per model and broadcast by their size.
    """

    def side(name: str, *cols: str) -> DataFrame:
        return prices.select(F.col("model").alias(f"{name}_model"), F.lit(True).alias(f"_{name}"), *[F.col(c).alias(f"_{name}_{c}") for c in cols])

    rows = usage.join(side("llm", "in_per_1m", "out_per_1m", "cached_per_1m"), "llm_model", "left")
    rows = rows.join(side("stt", "per_minute"), "stt_model", "left").join(side("tts", "chars_per_1m"), "tts_model", "left")
    cached = or_zero(F.col("tokens_cached"))
    plain = F.greatest(or_zero(F.col("tokens_in")) - cached, F.lit(0.0))
    llm = (plain * F.col("_llm_in_per_1m") + or_zero(F.col("tokens_out")) * F.col("_llm_out_per_1m") + cached * F.coalesce("_llm_cached_per_1m", "_llm_in_per_1m")) / 1e6
    out = rows.withColumns(
        {
            "cost_llm": F.when(F.col("_llm"), llm),
            "cost_stt": F.when(F.col("_stt"), or_zero(F.col("stt_seconds")) / 60 * F.col("_stt_per_minute")),
            "cost_tts": F.when(F.col("_tts"), or_zero(F.col("tts_chars")) * F.col("_tts_chars_per_1m") / 1e6),
        }
    )
    known = F.coalesce("cost_llm", "cost_stt", "cost_tts").isNotNull()
    total = F.when(known, or_zero(F.col("cost_llm")) + or_zero(F.col("cost_stt")) + or_zero(F.col("cost_tts")))
    return out.withColumn("cost_total", total).drop(*[c for c in out.columns if c.startswith("_")])
