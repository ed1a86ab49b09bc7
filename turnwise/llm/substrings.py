"""Substring dedup by seed and extend.

A repeat is a run of at least ``SPAN`` words whose every window of ``SPAN``
words also starts earlier: in a document with a smaller doc_id, or earlier in
the same one. Seeds are winnowed anchors: of the ``SPAN - ANCHOR + 1`` runs of
``ANCHOR`` words inside a window, those with the least hash. Equal windows choose
equal anchors, so a window can repeat only if its anchor occurs twice. Documents
meet on anchors; around every anchor that occurs twice or more the match is
extended both ways over all windows that chose it. These runs of windows meet on
two independent 64-bit hashes of the words they span: equal runs keep their
first occurrence. Where runs of one anchor differ, they are compared window by
window. The union of all that stood earlier are the maximal repeats, which are cut.

One shuffle carries the texts, keyed by row content, and serves the extension,
the comparison and the cutting. Anchors and runs shuffle as plain numbers, and
equal ones of a document collapse before. Anchors are counted by partial sums. A
run that many documents share is compared in one task, as a row of a few
numbers per document, streamed through a window that spills.

Defined cases: null text has no words and hashes like an empty one; rows with
one doc_id and different texts are ordered by the hash of their content; rows
that are equal in doc_id and text are one document that stands several times,
each with the same result; null doc_id comes first; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .words import Words, as_long, chunks, mix, split_words, windows

SPAN = 20
ANCHOR = 8
_SEEDS = (0x243F6A8885A308D3, 0x13198A2E03707344)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values."""
    have, out = 1, x
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    return out if have == width else np.minimum(out[: len(out) - (width - have)], out[width - have :])


def seeds(h: np.ndarray, span: int, anchor: int) -> np.ndarray:
    """The anchor of each window of ``span`` words, given the words' hashes."""
    if len(h) < span:
        return np.zeros(0, np.uint64)
    return sliding_min(windows(h, anchor, _BASES[0]), span - anchor + 1)


def chosen(h: np.ndarray, span: int, anchor: int) -> np.ndarray:
    """Anchors at every place that some window chose; equal anchors stand once per place."""
    least = seeds(h, span, anchor)
    if not len(least):
        return least
    grams, width = windows(h, anchor, _BASES[0]), span - anchor + 1
    pad = np.zeros(width - 1, np.uint64)
    best = ~sliding_min(~np.concatenate([pad, least, pad]), width)  # greatest least value of the windows over each place
    return grams[grams == best]


def row_hashes(batch: pa.RecordBatch, seed: int) -> tuple[Words, np.ndarray]:
    words = split_words(batch.column(batch.schema.get_field_index("text")))
    return words, words.hashes(seed)


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("doc_id", "text").alias("k"))


def anchors(rows: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(anchor, k, n): how often each anchor stands in a document, once per slice of text."""
    schema = pa.schema([("anchor", pa.int64()), ("k", pa.int64()), ("n", pa.int32())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                words, h = row_hashes(part, _SEEDS[0])
                keys = part.column(part.schema.get_field_index("k")).to_numpy()
                found = [chosen(h[a:b], span, anchor) for a, b in zip(words.first[:-1], words.first[1:], strict=True)]
                which = np.repeat(keys, [len(x) for x in found])
                value = np.concatenate(found) if found else np.zeros(0, np.uint64)
                order = np.lexsort((which, value))
                value, which = value[order], which[order]
                new = np.ones(len(value), bool)
                new[1:] = (value[1:] != value[:-1]) | (which[1:] != which[:-1])
                at = np.nonzero(new)[0]
                n = np.diff(np.append(at, len(value))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(as_long(value[at])), pa.array(which[at]), pa.array(n)], schema=schema)

    return rows.mapInArrow(run, "anchor long, k long, n int")


def repeated(found: DataFrame) -> DataFrame:
    """(k, seeds): the anchors of each document that occur twice or more anywhere."""
    often = found.groupBy("anchor").agg(F.sum("n").alias("all")).where("all > 1").select("anchor")
    return found.join(often, "anchor").groupBy("k").agg(F.collect_set("anchor").alias("seeds"))


_PLACED = "seed long, h1 long, h2 long, doc_id long, k long, at int, n int, again boolean"


def placed(rows: DataFrame, wanted: str, find) -> DataFrame:
    """(seed, h1, h2, doc_id, k, at, n, again): hashed runs of n windows that begin at a word, from text and ``wanted``.

    ``find(wanted, h, g)`` gives (seed, h1, h2, at, n) of a row from its words'
    two hashes; equal runs have equal seeds. Of equal runs in one document only
    the first is open, the others start ``again``. A row's output depends on the
    row alone, so a task that is run anew says the same.
    """
    names = [c.split()[0] for c in _PLACED.split(", ")]

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                ids, keys, want = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "k", wanted))
                words, h = row_hashes(part, _SEEDS[0])
                g = words.hashes(_SEEDS[1])
                found = [find(want[r], h[a:b], g[a:b]) for r, (a, b) in enumerate(zip(words.first[:-1], words.first[1:], strict=True))]
                row = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
                seed, h1, h2, at, n = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((at, h2, h1, row))
                r, a, b = row[order], h1[order], h2[order]
                again = np.zeros(len(h1), bool)
                again[order[1:]] = (r[1:] == r[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
                take = pa.array(row)
                arrays = [as_long(seed), as_long(h1), as_long(h2), ids.take(take), keys.take(take), at.astype(np.int32), n.astype(np.int32), again]
                yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in arrays], names=names)

    return rows.select("doc_id", "text", "k", wanted).mapInArrow(run, _PLACED)


def extended(seeded: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """The runs of windows that chose one repeated anchor at one place, each by the words it spans."""

    def find(wanted, h, g):
        own = np.sort(np.asarray(wanted.values.to_numpy(), np.int64))
        least = as_long(seeds(h, span, anchor))
        if not len(least):
            return (np.zeros(0, np.uint64),) * 3 + (np.zeros(0, np.int32),) * 2
        place = np.nonzero(own[np.minimum(np.searchsorted(own, least), len(own) - 1)] == least)[0]
        new = np.ones(len(place), bool)
        # an equal anchor that enters on the right is another place, so a run has no window twice
        enters = as_long(windows(h, anchor, _BASES[0]))[place + span - anchor] == least[place]
        new[1:] = (np.diff(place) > 1) | (least[place[1:]] != least[place[:-1]]) | enters[1:]
        first = np.nonzero(new)[0]
        n = np.diff(np.append(first, len(place)))
        within = (np.arange(len(place)) - np.repeat(first, n)).astype(np.uint64) * np.uint64(_BASES[0])
        out = []
        for x, base in ((h, _BASES[1]), (g, _BASES[2])):
            each = windows(x, span, base)[place]
            out.append(mix(np.add.reduceat(mix(each + within), first)) if len(first) else each)
        return (least[place[first]].view(np.uint64), *out, place[first], n)

    return placed(seeded, "seeds", find)


def opened(led: DataFrame, span: int = SPAN) -> DataFrame:
    """The single windows of the runs in ``runs``."""

    def find(wanted, h, g):
        at = np.concatenate([np.arange(w["at"], w["at"] + w["n"]) for w in wanted.as_py()])
        one = windows(h, span, _BASES[1])[at]
        return one, one, windows(g, span, _BASES[2])[at], at, np.ones(len(at), np.int32)

    return placed(led, "runs", find)


def sorted_out(found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, at, n) of the runs that stand earlier too, and of the first ones whose seed has other runs beside.

    One shuffle by seed. A run alone with its seed, however often it stands, has
    no window in common with any other run.
    """
    place = F.struct("doc_id", "k", "at")
    open_ = found.where("not again").repartition("seed")
    first = open_.withColumn("later", place != F.min(place).over(W.partitionBy("seed", "h1", "h2")))
    later = first.where("later").select("k", "at", "n").unionByName(found.where("again").select("k", "at", "n"))
    beside = first.withColumn("kinds", F.count_if(~F.col("later")).over(W.partitionBy("seed")))
    return later, beside.where("not later and kinds > 1").select("k", "at", "n")


def repeats(rows: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    """(k, runs): where windows start that also start earlier.

    Whole runs first: one that stands earlier too goes as it is. Where a seed has
    runs that differ somewhere, the windows of these are compared one by one.
    """
    seeded = rows.join(repeated(anchors(rows, span, anchor)).hint("shuffle_hash"), "k")
    later, lead = sorted_out(extended(seeded, span, anchor))
    led = rows.join(lead.groupBy("k").agg(F.collect_list(F.struct("at", "n")).alias("runs")).hint("shuffle_hash"), "k")
    again, _ = sorted_out(opened(led, span))
    return later.unionByName(again).groupBy("k").agg(F.collect_list(F.struct("at", "n")).alias("runs"))


def covered(n: int, runs: list[dict], span: int) -> np.ndarray:
    """Which of n words lie in a window of the runs."""
    edge = np.zeros(n + 1, np.int32)
    for run in runs:
        edge[run["at"]] += 1
        edge[run["at"] + run["n"] - 1 + span] -= 1
    return np.cumsum(edge[:-1]) > 0


def cut(marked: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed, kept (the words left, joined by one space) from text and runs."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.large_string())])

    def run(batches):
        for batch in batches:
            for part in chunks(batch):
                ids, texts, runs = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "text", "runs"))
                n, gone, kept = [], [], []
                for text, gone_runs in zip(texts, runs, strict=True):
                    words = (text.as_py() or "").encode().split()
                    n.append(len(words))
                    if gone_runs.is_valid:
                        out = covered(len(words), gone_runs.as_py(), span)
                        words = [w for w, x in zip(words, out, strict=True) if not x]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode())
                yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.large_string())], schema=schema)

    return marked.select("doc_id", "text", "runs").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string")


def dedup_substrings(docs: DataFrame, span: int = SPAN, anchor: int = ANCHOR) -> DataFrame:
    rows = keyed(docs)
    return cut(rows.join(repeats(rows, span, anchor).hint("shuffle_hash"), "k", "left"), span)


def op10(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], span: int = SPAN) -> dict[int, tuple[int, int, str]]:
    """The definition on a small list with unique ids, for tests."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - span + 1):
            w = tuple(words[i : i + span])
            if w in seen:
                gone[i : i + span] = [True] * span
            seen.add(w)
        kept = b" ".join(w for w, x in zip(words, gone, strict=True) if not x)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out
