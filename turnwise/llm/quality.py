"""Quality rules with thresholds that adapt to each language and source.

Four ratios are measured per document. Their distribution per (language,
source), and that of the numbers of words and lines, is summarised by a mergeable
quantile sketch: counts in logarithmic buckets of relative width ``GAMMA``, so
partial sketches add up in any order and a quantile is off by at most
``GAMMA - 1`` of its value. Fences replace fixed cutoffs: the median plus or minus
``FENCE`` times the spread between it and the quartile on that side. What a spread
is at least comes from the group as well: the step in which a ratio moves in its
shorter documents, one symbol, one line or one window over the first quartile of
their words or lines. Where junk fills a quartile, the word length's spread counts
as twice that of its other side at most.

A group's quartiles are blended with its language's, and these with the corpus's,
as if ``PRIOR`` more documents of these were in the group, so small groups lean on
their language and no size switches the rule. Documents are joined with the
fences of their group and filtered.

DataFrame operations only. Defined cases: null text has no words and fails the
base rule; null language or source is a group of its own; repeated rows count
as often as they stand; very long texts are measured whole; extra columns of any
name are carried by ``filter_quality``; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

GAMMA = 1.02
FENCE = 6.0
PRIOR = 100.0  # documents that a group's parent counts for
ZERO_BUCKET = -(1 << 30)
SYMBOLS = "#*$%&|<>"
#: metric -> (what its step is a share of, units in a step), or None: no step, but a fence on both sides
METRICS = {"symbol_ratio": ("n_words", 1), "dup_line_ratio": ("_n_lines", 1), "repeat_ratio": ("n_words", 5), "word_length": None}
SKETCHED = (*METRICS, "n_words", "_n_lines")

SPLIT = "[\\x20\\x09-\\x0D]+"


def measured(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` with n_words and the base counts of each row's whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.length(F.regexp_replace(x, SPLIT, "")) > 0)
    first = docs.select(
        *keep,
        F.filter(F.split(text, SPLIT), lambda w: w != "").alias("_words"),
        F.length(F.regexp_replace(text, SPLIT, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
    )
    hashed = first.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").alias("_n_lines"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_h"),
    )
    windows = F.expr("transform(slice(_h, 1, size(_h) - 4), (x, i) -> xxhash64(x, _h[i + 1], _h[i + 2], _h[i + 3], _h[i + 4]))")
    windowed = hashed.withColumn("_w", F.when(F.col("n_words") >= 5, windows)).drop("_h")
    # most texts repeat no window: only the others are sorted
    repeated = F.size(F.array_distinct("_w")) < F.size("_w")
    placed = windowed.withColumn("_s", F.when(repeated, F.expr("sort_array(transform(_w, (x, i) -> struct(x as h, i as p)))"))).drop("_w")
    pairs = placed.withColumn("_next", F.expr("concat(slice(_s, 2, size(_s)), array(cast(null as struct<h:bigint,p:int>)))")).withColumn(
        "_last", F.expr("concat(array(cast(null as struct<h:bigint,p:int>)), slice(_s, 1, size(_s) - 1))")
    )
    marked = F.expr(
        """sort_array(transform(filter(zip_with(zip_with(_s, _next, (a, b) -> struct(a.h as h, a.p as p, coalesce(a.h = b.h, false) as d)), _last,
             (a, b) -> struct(a.p as p, a.d or coalesce(a.h = b.h, false) as d)), x -> x.d), x -> x.p))"""
    )
    covered = F.expr("aggregate(_p, struct(cast(-5 as int) as last, 0L as n), (a, p) -> struct(p as last, a.n + least(5, p - a.last) as n), a -> a.n)")
    return pairs.withColumn("_p", marked).select(
        *keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "_n_lines", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def with_ratios(df: DataFrame) -> DataFrame:
    n = F.greatest(F.col("n_words"), F.lit(1))
    return df.withColumns(
        {
            "symbol_ratio": F.col("n_symbols") / n,
            "dup_line_ratio": F.col("n_dup_lines") / F.greatest(F.col("_n_lines"), F.lit(1)),
            "repeat_ratio": F.col("n_repeat_words") / n,
            "word_length": F.col("word_chars") / n,
            "base_failed": base_failed(),
        }
    )


def sketches(df: DataFrame) -> DataFrame:
    """Bucket counts per (lang, source, metric); merging sketches is adding counts."""
    bucket = F.when(F.col("value") > 0, F.ceil(F.log("value") / math.log(GAMMA))).otherwise(ZERO_BUCKET).cast("int")
    there = [m for m in SKETCHED if m in df.columns]
    long = df.select("lang", "source", F.expr("stack({}, {}) as (metric, value)".format(len(there), ", ".join(f"'{m}', cast({m} as double)" for m in there))))
    return long.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("n"))


def merged(sketch: DataFrame, *by: str) -> DataFrame:
    return sketch.groupBy(*by, "metric", "bucket").agg(F.sum("n").alias("n"))


def quartiles(sketch: DataFrame, *by: str) -> DataFrame:
    """q1, q2, q3 and rows of each group's sketch, one row per group and metric."""
    group = W.partitionBy(*by, "metric")
    upto = group.orderBy("bucket").rowsBetween(W.unboundedPreceding, 0)
    value = F.when(F.col("bucket") == ZERO_BUCKET, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bucket")) / (GAMMA + 1))
    cum = sketch.withColumns({"_cum": F.sum("n").over(upto), "_rows": F.sum("n").over(group), "_value": value})
    return cum.groupBy(*by, "metric").agg(
        F.max("_rows").alias("rows"), *[F.min(F.when(F.col("_cum") >= q / 4 * F.col("_rows"), F.col("_value"))).alias(f"q{q}") for q in (1, 2, 3)]
    )


def blended(own: DataFrame, parent: DataFrame, *by: str) -> DataFrame:
    """own's quartiles with parent's (which has ``by``, a part of own's keys) mixed in as ``PRIOR`` documents."""
    named = parent.select(*[F.col(c).alias(f"_p_{c}") for c in (*by, "metric", "q1", "q2", "q3")])
    on = F.col("metric") == F.col("_p_metric")
    for c in by:
        on &= F.col(c).eqNullSafe(F.col(f"_p_{c}"))
    weight = F.col("rows") / (F.col("rows") + PRIOR)
    mixed = {q: weight * F.col(q) + (1 - weight) * F.col(f"_p_{q}") for q in ("q1", "q2", "q3")}
    return own.join(named, on).withColumns(mixed).drop(*named.columns)


def fences(sketch: DataFrame) -> DataFrame:
    """lo and hi of every metric for each (lang, source), side by side."""
    every = quartiles(merged(sketch))
    lang = blended(quartiles(merged(sketch, "lang"), "lang"), every)
    own = blended(quartiles(sketch, "lang", "source"), lang, "lang")
    q = {(m, k): F.max(F.when(F.col("metric") == m, F.col(k))).alias(f"{m}_{k}") for m in SKETCHED for k in ("q1", "q2", "q3")}
    wide = own.groupBy("lang", "source").agg(*q.values())
    cols = []
    for metric, step in METRICS.items():
        q1, q2, q3 = (F.col(f"{metric}_{k}") for k in ("q1", "q2", "q3"))
        if step is None:
            above, below = F.least(q3 - q2, 2 * (q2 - q1)), F.least(q2 - q1, 2 * (q3 - q2))
            cols += [(q2 + FENCE * above).alias(f"hi_{metric}"), (q2 - FENCE * below).alias(f"lo_{metric}")]
        else:
            of, units = step
            least = units / F.greatest(F.col(f"{of}_q1"), F.lit(1.0))
            cols.append((q2 + FENCE * F.greatest(q3 - q2, least)).alias(f"hi_{metric}"))
    return wide.select("lang", "source", *cols)


def verdict(df: DataFrame, fence: DataFrame) -> DataFrame:
    """df (lang, source, ratios, base_failed) with kept, by a join with its group's fences."""
    named = fence.withColumnsRenamed({"lang": "_f_lang", "source": "_f_source"})
    joined = df.join(named, F.col("lang").eqNullSafe(F.col("_f_lang")) & F.col("source").eqNullSafe(F.col("_f_source")), "left")
    fine = F.lit(True)
    for metric, step in METRICS.items():
        fine &= F.coalesce(F.col(metric) <= F.col(f"hi_{metric}"), F.lit(True))
        if step is None:
            fine &= F.coalesce(F.col(metric) >= F.col(f"lo_{metric}"), F.lit(True))
    return joined.withColumn("kept", ~F.col("base_failed") & fine).drop("_f_lang", "_f_source", *fence.columns[2:])


def score_quality(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts, ratios, base_failed and kept of every row."""
    rows = materialize(with_ratios(measured(docs, "doc_id", "lang", "source")), "quality")
    return verdict(rows, fences(sketches(rows.where("not base_failed"))))


def filter_quality(docs: DataFrame) -> DataFrame:
    """The rows that are kept, with all their columns. Measures once, joins the verdict back by row content."""
    key = F.xxhash64("doc_id", "text", "lang", "source")
    rows = docs.select("doc_id", "lang", "source", "text", key.alias("_key"))
    scored = materialize(with_ratios(measured(rows, "_key", "lang", "source")), "quality")
    kept = verdict(scored, fences(sketches(scored.where("not base_failed")))).where("kept").select("_key").distinct()
    whole = docs.select(F.struct("*").alias("_row"), key.alias("_key"))
    return whole.join(kept, "_key", "left_semi").select("_row.*")


def op4(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return score_quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
