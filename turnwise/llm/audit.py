"""Filter interaction audit over every order of a set of filters.

Which filter removes a document depends on what ran before it. The audit walks
the trie of all orders depth first: a state is the set of filters applied so
far, its survivors are a persisted DataFrame, and its edges are the filters that
may come next. Orders that applied the same filters meet in one state, which is
visited once, so k! orders cost 2 ** k states. One aggregate over a state's
survivors counts, per part, what each edge removes, and it is written before the
walk goes on; at most k + 1 states are persisted at a time, and a lost executor's
share is read again from the written table of flags.

Filters are boolean Columns over the rows, measured once; what remains are rows
of a part, the flags and the labels. A filter fails where its Column is true, a
null fails nothing.

Defined cases: null text is empty; a null part is the empty string; a null
doc_id has no smaller one and is no smaller one, and has no label; rows that
share a doc_id are documents of their own, and copies of one another only to
larger doc_ids; a doc_id with several labels has the highest; other columns are
not read; very long texts are measured whole; an empty table gives no rows.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from itertools import permutations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .tables import read

SPLIT = "[\\x20\\x09-\\x0D]+"
MOST = 6  # filters: 64 states, 720 orders


def text_filters(text: Column) -> dict[str, Column]:
    """Few words, repeated words, capitals, symbols."""
    words = F.filter(F.split(text, SPLIT), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return {
        "A": n < 200,
        "B": 100 * distinct < 50 * n,
        "C": 100 * F.length(F.regexp_replace(text, "[^A-Z]+", "")) > 3 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }


def copies(docs: DataFrame, key: str, doc_id: str) -> DataFrame:
    """docs with ``copied``: some row of the same key has a smaller doc_id."""
    first = docs.groupBy(key).agg(F.min(doc_id).alias("_least"))
    return docs.join(first, key).withColumn("copied", F.coalesce(F.col("_least") < F.col(doc_id), F.lit(False))).drop("_least")


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with good and toxic, from the labels of their doc_id."""
    each = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("_of"))
    each = each.agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    told = docs.join(each, F.col("doc_id") == F.col("_of"), "left")
    return told.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")}).drop("_of")


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, good, toxic and whether each of the filters A to E fails, for every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    part = F.coalesce(F.col("lang"), F.lit("")).alias("part")
    # the filters see the text once and leave it behind
    measured = docs.select("doc_id", part, F.unhex(F.sha2(text, 256)).alias("_key"), *[f.alias(name) for name, f in text_filters(text).items()])
    slim = materialize(measured, "measured")
    return labelled(copies(slim, "_key", "doc_id").withColumnRenamed("copied", "E"), labels).select("part", "good", "toxic", *"ABCDE")


def states(rows: DataFrame, names: str, walk: Callable[[int], None] = lambda state: None) -> DataFrame:
    """part, state (bits of the filters applied), kept, and of each filter not applied yet what it removes next: removed_X, good_X, toxic_X.

    ``walk`` is told each state as it is visited.
    """
    found: dict[int, DataFrame] = {}

    def visit(survivors: DataFrame, state: int) -> None:
        walk(state)
        left = [k for k in range(len(names)) if not state >> k & 1]
        counts = [F.count("*").alias("kept")]
        for k, name in enumerate(names):
            gone = F.col(name) if k in left else F.lit(False)
            counts += [F.count_if(gone & also).alias(f"{what}_{name}") for what, also in (("removed", F.lit(True)), ("good", F.col("good")), ("toxic", F.col("toxic")))]
        found[state] = materialize(survivors.groupBy("part").agg(*counts).withColumn("state", F.lit(state)), f"state-{state}")
        for k in left:
            if state | 1 << k not in found:
                kept = survivors.where(~F.col(names[k])).persist(StorageLevel.MEMORY_AND_DISK)
                visit(kept, state | 1 << k)
                kept.unpersist()

    visit(rows, 0)
    out = None
    for one in found.values():
        out = one if out is None else out.unionByName(one)
    return out


def orders(names: str) -> Column:
    """filter_order, step, filter, before, after of all orders: k! * k structs, as a literal."""
    rows = []
    for order in permutations(range(len(names))):
        state = 0
        for step, k in enumerate(order):
            rows.append({"filter_order": "".join(names[j] for j in order), "step": step + 1, "filter": names[k], "before": state, "after": state | 1 << k})
            state |= 1 << k
    return F.from_json(F.lit(json.dumps(rows)), "array<struct<filter_order:string,step:int,filter:string,before:int,after:int>>")


def audit(rows: DataFrame, names: str) -> DataFrame:
    """One row per part, order and step. ``rows``: part, good, toxic and a boolean column per one-letter name."""
    if not 0 < len(names) <= MOST:
        raise ValueError(f"1 to {MOST} filters, as every order of them is a row")
    rows = materialize(rows.select("part", "good", "toxic", *[F.coalesce(n, F.lit(False)).alias(n) for n in names]), "flags")
    failed = [F.count_if(F.col(n)).alias(f"all_{n}") for n in names]
    only = [F.count_if(F.col(n) & ~F.greatest(*[F.col(m) for m in names if m != n], F.lit(False), F.lit(False))).alias(f"only_{n}") for n in names]
    parts = materialize(rows.groupBy("part").agg(*failed, *only), "parts")
    walked = states(rows, names)

    def tall(df: DataFrame, keys: list[str], *what: str) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(n).alias("filter"), *[F.col(f"{w}_{n}").alias(w) for w in what]) for n in names]))
        return df.select(*keys, each.alias("_e")).select(*keys, "_e.*")

    edges = tall(walked, ["part", "state"], "removed", "good", "toxic").withColumnRenamed("state", "before")
    kept = walked.select("part", F.col("state").alias("after"), "kept")
    # a state without survivors in a part has no row there
    every = parts.select("part", F.inline(orders(names)))
    steps = every.join(edges, ["part", "before", "filter"], "left").join(kept, ["part", "after"], "left").join(tall(parts, ["part"], "all", "only"), ["part", "filter"])
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    steps = materialize(
        steps.select(
            "part",
            "filter_order",
            "step",
            "filter",
            count("kept").alias("kept"),
            count("removed").alias("removed"),
            (F.col("all") - count("removed")).alias("redundant"),
            F.col("only").alias("unique_fails"),
            count("good").alias("good_lost"),
            count("toxic").alias("toxic_lost"),
        ),
        "steps",
    )
    shapley = steps.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return steps.join(shapley, ["part", "filter"]).drop("filter")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(flags(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")), "ABCDE")
