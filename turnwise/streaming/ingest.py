"""Exactly-once assembly of calls from fragments that come late, twice, out of order and before their call has a name.

Fragments are keyed by trace, so children that come before the root are with it
when it names the call. State per trace: a summary, and each (batch, seq) that
was counted, which lives ``keep_s`` and makes a redelivered fragment count for
nothing, in whatever micro-batch it comes. A call is analysed when its root and
media are there, or when its root is and nothing new came for ``grace_s``. A new
fragment after that is due for another analysis once it is quiet again. A call
that nothing new came for in ``keep_s`` leaves the state.

Results are written per micro-batch into a folder that its number names, and a
repeated micro-batch writes the folder anew, so a stream that stops anywhere and
starts again from its checkpoint leaves every result once. ``analyses`` reads
them, ``latest`` keeps the last analysis of each call, and ``assembled`` gives
the same rows from a batch of all fragments.

Defined cases: a fragment without a trace is keyed by its call, one with neither
goes; a fragment without a batch has no identity and always counts; a null flag
is false; a span list may be empty. An older call_id gives way to a newer one of
the same trace and is never taken back by fragments that name none.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GRACE_S = 60.0
KEEP_S = 7 * 86400.0
FRAGMENT = "trace_id string, call_id string, batch_id string, seq int, n_spans long, is_root boolean, is_media boolean, ord long"
RESULT = "trace_id string, call_id string, version int, why string, fragments long, spans long"


def keyed(fragments: DataFrame) -> DataFrame:
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("is_root", "is_media")}
    named = fragments.withColumns({"key": F.coalesce("trace_id", "call_id"), "n_spans": F.coalesce("n_spans", F.lit(0)).cast("long"), **flags})
    return named.where("key is not null").select("key", "call_id", "batch_id", "seq", "n_spans", "is_root", "is_media", "ord")


class Assembly(StatefulProcessor):
    """One row per analysis of a call."""

    def __init__(self, grace_s: float, keep_s: float):
        self.grace_ms, self.keep_ms = int(grace_s * 1000), int(keep_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "name string, named_at long, root boolean, media boolean, version int, open boolean, fragments long, spans long, due long, gone long")
        self.seen = handle.getMapState("seen", "batch_id string, seq int", "n int", self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentProcessingTimeInMs()
        state = self.call.get() if self.call.exists() else (None, None, False, False, 0, False, 0, 0, 0, 0)
        name, named_at, root, media, version, open_, fragments, spans, due, gone = state
        fresh = False
        for part in rows:
            for r in part.itertuples(index=False):
                known = r.batch_id is not None and not pd.isna(r.batch_id)
                identity = (r.batch_id, int(r.seq) if known and not pd.isna(r.seq) else -1)
                if known and self.seen.containsKey(identity):
                    continue
                if known:
                    self.seen.updateValue(identity, (1,))
                fresh, root, media = True, root or bool(r.is_root), media or bool(r.is_media)
                fragments, spans = fragments + 1, spans + int(r.n_spans)
                at = -1 if pd.isna(r.ord) else int(r.ord)
                if r.call_id is not None and r.call_id != key[0] and (named_at is None or at >= named_at):
                    name, named_at = r.call_id, at
        if not fresh:
            return
        open_ = True
        ready = root and media and version == 0
        if ready:
            version, open_ = version + 1, False
            yield self.row(key, name, version, "media", fragments, spans)
        due, gone = (now + self.grace_ms if root and open_ else 0), now + self.keep_ms
        self.set_timers(due, gone)
        self.call.update((name, named_at, root, media, version, open_, fragments, spans, due, gone))

    def set_timers(self, due: int, gone: int) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        for at in {due, gone} - {0}:
            self.handle.registerTimer(at)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.call.exists():
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        name, named_at, root, media, version, open_, fragments, spans, due, gone = self.call.get()
        if due and due <= now and open_:
            version, open_, due = version + 1, False, 0
            yield self.row(key, name, version, "quiet" if version == 1 else "late", fragments, spans)
            self.call.update((name, named_at, root, media, version, open_, fragments, spans, due, gone))
        if gone <= now:
            self.call.clear()
            self.seen.clear()

    def close(self) -> None:
        pass

    @staticmethod
    def row(key, name, version: int, why: str, fragments: int, spans: int) -> pd.DataFrame:
        return pd.DataFrame({"trace_id": [key[0]], "call_id": [name or key[0]], "version": [version], "why": [why], "fragments": [fragments], "spans": [spans]})


def analysed(fragments: DataFrame, tombstones: DataFrame | None = None, grace_s: float = GRACE_S, keep_s: float = KEEP_S) -> DataFrame:
    """A stream of analyses; calls that were erased, by their own name or their trace's, give none."""
    out = keyed(fragments).groupBy("key").transformWithStateInPandas(statefulProcessor=Assembly(grace_s, keep_s), outputStructType=RESULT, outputMode="Update", timeMode="ProcessingTime")
    if tombstones is None:
        return out
    erased = tombstones.select(F.col("call_id").alias("_e")).distinct()
    return out.join(erased, (F.col("call_id") == F.col("_e")) | (F.col("trace_id") == F.col("_e")), "left_anti")


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that leaves a micro-batch's rows once, however often it runs."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def analyses(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{RESULT}, batch long").option("basePath", path).parquet(path)


def latest(results: DataFrame) -> DataFrame:
    last = results.groupBy("trace_id").agg(F.max(F.struct("version", "call_id", "fragments", "spans")).alias("_l"))
    return last.select("trace_id", "_l.call_id", "_l.fragments", "_l.spans")


def assembled(fragments: DataFrame) -> DataFrame:
    """trace_id, call_id, fragments, spans of every call whose root came, from a batch of all fragments.

    Redelivered fragments are dropped before the calls are added up, so a call of
    many fragments is added up in parts.
    """
    rows = keyed(fragments)
    told = rows.where("batch_id is not null").groupBy("key", "batch_id", F.coalesce("seq", F.lit(-1)).alias("seq"))
    first = told.agg(F.min_by(F.struct("call_id", "n_spans", "is_root", "ord"), F.coalesce("ord", F.lit(-1))).alias("r")).select("key", "r.*")
    each = first.unionByName(rows.where("batch_id is null").select("key", "call_id", "n_spans", "is_root", "ord"))
    named = F.when(F.col("call_id") != F.col("key"), F.struct(F.coalesce("ord", F.lit(-1)).alias("ord"), F.col("call_id").alias("name")))
    calls = each.groupBy(F.col("key").alias("trace_id")).agg(F.max(named).alias("_n"), F.count("*").alias("fragments"), F.sum("n_spans").alias("spans"), F.max("is_root").alias("_root"))
    return calls.where("_root").select("trace_id", F.coalesce("_n.name", "trace_id").alias("call_id"), "fragments", "spans")


def settled(done: Callable[[], bool], seconds: float = 60.0) -> bool:
    """Wait until done; False when that takes too long."""
    end = time.time() + seconds
    while time.time() < end:
        if done():
            return True
        time.sleep(0.5)
    return False
