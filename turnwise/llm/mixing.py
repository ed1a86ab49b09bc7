"""Mixing sources to target weights by iterative proportional fitting.

Documents are summed up to cells (source, language, topic) of token counts. The
cells' weights are raked to the target marginals in turn, source, language,
topic, again and again, until all three hold to ``TOLERANCE``. Targets that cannot
hold together (a source that has one language only, say) stop it once a pass no
longer brings them nearer, with a warning that says how far off they are. A
document is then sampled with its cell's probability: weight over tokens, scaled so that
the expected tokens are ``BUDGET`` of all; a cell whose share would exceed its
tokens is taken whole and the others are scaled on.

Targets default to the corpus's own token shares raised to a power below one,
which lifts small sources and languages. The draw is a hash of the row's content,
so a recomputed task draws alike, and equal rows stay or go together.

A cell table, however large, stays in Spark; hot sources are summed before the
shuffle, and the documents meet their cell's probability by a join that adaptive
execution broadcasts when it is small and splits when a cell is hot.

Defined cases: null source, language or topic is a category of its own; null or
empty text has no tokens and is never sampled; a category with no target is not
sampled; a column ``topic``, if there, is taken as it is, columns ``tokens`` and
``p`` of the input are carried and not read; very long texts count whole; equal
rows stay or go together; an empty table gives no rows.
"""

from __future__ import annotations

import warnings
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..session import drop_materialized, materialize

DIMS = ("source", "lang", "topic")
POWERS = {"source": 0.7, "lang": 0.7, "topic": 0.9}
BUDGET = 0.6
STALLED = 0.999  # a write's error over the one before, from which on passes bring nothing more
TOLERANCE = 1e-6
PER_WRITE = 3  # rakings between two writes
SPLIT = "[\\x20\\x09-\\x0D]+"


def tokens_of(text: Column) -> Column:
    """Words; the weight of a document."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")).cast("long")


def topic_of(text: Column) -> Column:
    """The form of a text, where a table brings no topic of its own."""
    n = F.greatest(F.length(text), F.lit(1))

    def share(signs: str) -> Column:
        return (F.length(text) - F.length(F.translate(text, signs, ""))) / n

    return (
        F.when(share("{}();=<>[]_") > 0.03, "code")
        .when(share("0123456789") > 0.05, "figures")
        .when(share("?!") > 0.01, "speech")
        .when(share("\n") > 0.01, "lists")
        .when(n > 2000, "long prose")
        .otherwise("prose")
    )


def with_topic(docs: DataFrame) -> DataFrame:
    return docs if "topic" in docs.columns else docs.withColumn("topic", topic_of(F.col("text")))


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def with_targets(cells: DataFrame, dim: str, power: float, target: Mapping[str, float] | None) -> DataFrame:
    """cells with t_<dim>: the target weight of the cell's category, of all tokens."""
    shares = cells.groupBy(dim).agg(F.sum("tokens").alias("_t"))
    if target is None:
        raw = shares.select(dim, F.pow(F.col("_t").cast("double"), F.lit(power)).alias("_w"))
    else:
        pairs = F.create_map(*[F.lit(x) for kv in target.items() for x in kv])
        raw = shares.select(dim, F.coalesce(F.try_element_at(pairs, F.col(dim)), F.lit(0.0)).alias("_w"))
    weight, tokens = raw.agg(F.sum("_w")).first()[0] or 1.0, cells.agg(F.sum("tokens")).first()[0] or 0
    scaled = raw.select(F.col(dim).alias("_d"), (F.col("_w") * F.lit(float(tokens) / weight)).alias(f"t_{dim}"))
    return cells.join(scaled, same(F.col(dim), F.col("_d"))).drop("_d")


def raked(cells: DataFrame) -> DataFrame:
    """One pass over the dimensions."""
    for dim in DIMS:
        held = F.sum("w").over(W.partitionBy(dim))
        cells = cells.withColumn("w", F.when(held > 0, F.col("w") * F.col(f"t_{dim}") / held).otherwise(0.0))
    return cells


def error_of(cells: DataFrame) -> float:
    """Greatest relative distance of a marginal from its target."""
    worst = 0.0
    for dim in DIMS[:-1]:  # the last one holds after a pass
        by = cells.groupBy(dim).agg(F.sum("w").alias("w"), F.max(f"t_{dim}").alias("t")).where("t > 0")
        worst = max(worst, by.agg(F.max(F.abs(F.col("w") / F.col("t") - 1))).first()[0] or 0.0)
    return worst


def fitted(cells: DataFrame) -> DataFrame:
    """cells (source, lang, topic, tokens) with w, raked to t_source, t_lang, t_topic."""
    now, error = materialize(cells.withColumn("w", F.col("tokens").cast("double")), "cells"), float("inf")
    while error >= TOLERANCE:
        nxt = now
        for _ in range(PER_WRITE):
            nxt = raked(nxt)
        nxt = materialize(nxt, "cells")
        drop_materialized(now)
        now, before, error = nxt, error, error_of(nxt)
        if error >= TOLERANCE and error > STALLED * before:
            warnings.warn(f"targets cannot be met together: a marginal stays {error:.2%} off", stacklevel=2)
            break
    return now


def probabilities(cells: DataFrame, budget: float = BUDGET) -> DataFrame:
    """cells with p: w / tokens scaled to the budget, 1 at most."""
    ratio = F.col("w") / F.col("tokens")
    scale = 0.0
    for _ in range(50):
        whole = ratio * scale >= 1
        row = cells.where("tokens > 0").agg(
            F.sum("tokens").alias("all"), F.sum(F.when(whole, F.col("tokens"))).alias("whole"), F.sum(F.when(~whole, F.col("w"))).alias("open")
        ).first()
        if not row["open"]:
            break
        new = (budget * row["all"] - (row["whole"] or 0)) / row["open"]
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return cells.withColumn("p", F.when(F.col("tokens") > 0, F.least(F.lit(1.0), ratio * F.lit(float(scale)))).otherwise(0.0))


def fit(docs: DataFrame, targets: Mapping[str, Mapping[str, float]] | None = None, budget: float = BUDGET) -> DataFrame:
    """(source, lang, topic, tokens, docs, w, p) per cell, from rows of source, lang, topic, tokens."""
    cells = materialize(docs.groupBy(*DIMS).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "cells")
    goal = cells
    for dim in DIMS:
        goal = with_targets(goal, dim, POWERS[dim], (targets or {}).get(dim))
    return materialize(probabilities(fitted(goal), budget).select(*DIMS, "tokens", "docs", "w", "p"), "mix")


def draw() -> Column:
    """Even in [0, 1), by the row's content."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(5), "doc_id", "text"), 11) / float(1 << 53)


def join_mix(rows: DataFrame, mix: DataFrame) -> DataFrame:
    named = mix.select(*[F.col(d).alias(f"_m_{d}") for d in DIMS], "p")
    on = F.lit(True)
    for d in DIMS:
        on &= same(F.col(d), F.col(f"_m_{d}"))
    return rows.join(named, on).drop(*[f"_m_{d}" for d in DIMS])


def sampled(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, lang, topic, tokens, p and kept of every row."""
    wide = with_topic(docs).select("doc_id", *DIMS, tokens_of(F.col("text")).alias("tokens"), draw().alias("_draw"))
    rows = materialize(wide, "weights")
    return join_mix(rows, fit(rows, **options)).withColumn("kept", (F.col("_draw") < F.col("p")) & (F.col("tokens") > 0)).drop("_draw")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The sampled rows of docs, with all their columns."""
    topic = F.col("topic") if "topic" in docs.columns else topic_of(F.col("text"))
    mix = fit(docs.select("source", "lang", topic.alias("topic"), tokens_of(F.col("text")).alias("tokens")), **options)
    # texts without a word are of cells with others, so they are dropped by themselves
    spoken = F.coalesce(F.col("text"), F.lit("")).rlike("[^\\x20\\x09-\\x0D]")
    whole = docs.where(spoken).select(F.struct("*").alias("_row"), "source", "lang", topic.alias("topic"), draw().alias("_draw"))
    return join_mix(whole, mix).where("_draw < p").select("_row.*")


def op5(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return sampled(docs).select("doc_id", "source", "lang", "topic", "tokens", F.round("p", 9).alias("p"), "kept")
