"""Live assembly of calls from span fragments, and the batch jobs around it.

Fragments of a call arrive late, twice and out of order. The stream keeps a
summary per call: a call is ready when its root has come and its media is there,
or when the root has come and nothing arrived for ``GRACE_S``. Spans themselves
are not state; they land in a table once each, and a ready call is a key into it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

GRACE_S = 60
FRAGMENT = "call_id string, batch_id string, seq int, span_id string, is_root boolean, is_media boolean, received_at timestamp"
READY = "call_id string, why string, fragments long, spans long"


class CallProcessor(StatefulProcessor):
    """Emits each call once: (call_id, why, fragments, spans)."""

    def __init__(self, grace_s: float = GRACE_S):
        self.grace_ms = int(grace_s * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.call = handle.getValueState("call", "root boolean, media boolean, done boolean, fragments long, spans long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        root, media, done, fragments, spans = self.call.get() if self.call.exists() else (False, False, False, 0, 0)
        for part in rows:
            root |= bool(part["is_root"].any())
            media |= bool(part["is_media"].any())
            fragments += part[["batch_id", "seq"]].drop_duplicates().shape[0]
            spans += int(part["span_id"].notna().sum())
        for old in self.handle.listTimers():
            self.handle.deleteTimer(old)
        ready = root and media and not done
        if root and not ready and not done:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.grace_ms)
        self.call.update((root, media, done or ready, fragments, spans))
        if ready:
            yield self.row(key, "media", fragments, spans)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        root, media, done, fragments, spans = self.call.get()
        if root and not done:
            self.call.update((root, media, True, fragments, spans))
            yield self.row(key, "quiet", fragments, spans)

    def close(self) -> None:
        pass

    @staticmethod
    def row(key, why: str, fragments: int, spans: int) -> pd.DataFrame:
        return pd.DataFrame({"call_id": [key[0]], "why": [why], "fragments": [fragments], "spans": [spans]})


def once(fragments: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Fragments without redelivered ones of (call, batch, seq, span)."""
    return fragments.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["call_id", "batch_id", "seq", "span_id"])


def ready_calls(fragments: DataFrame, tombstones: DataFrame | None = None, grace_s: float = GRACE_S) -> DataFrame:
    """A stream of calls that are ready, erased ones left out."""
    live = fragments if tombstones is None else fragments.join(tombstones.select("call_id"), "call_id", "left_anti")
    return live.groupBy("call_id").transformWithStateInPandas(
        statefulProcessor=CallProcessor(grace_s), outputStructType=READY, outputMode="Update", timeMode="ProcessingTime"
    )


def changed_objects(listing: DataFrame, since: str | None, cutoff: str) -> DataFrame:
    """Calls to read anew from stored objects (call_id, uri, modified), oldest first.

    All objects of a call go together once the latest has settled; ``since`` is
    the last watermark. A late object brings its whole call back.
    """
    calls = listing.groupBy("call_id").agg(F.max("modified").alias("latest"), F.sort_array(F.collect_set("uri")).alias("uris"))
    due = calls.where(F.col("latest") <= F.lit(cutoff).cast("timestamp"))
    due = due if since is None else due.where(F.col("latest") > F.lit(since).cast("timestamp"))
    return due.orderBy("latest", "call_id")


def board_stream(facts: DataFrame, width: str = "6 hours", delay: str = "1 hour") -> DataFrame:
    """Calls, failures and cost per tumbling window, final once the watermark has passed."""
    return (
        facts.withWatermark("ts", delay)
        .groupBy(F.window("ts", width))
        .agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("failures"), F.sum("value").alias("cost"))
        .select(F.col("window.start").alias("bucket"), "calls", "failures", F.round("cost", 4).alias("cost"))
    )


def split_bad(batch: DataFrame, good: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of a micro-batch that decoding did not bring back: the dead letters."""
    return batch.join(good.select(*keys), keys, "left_anti")
