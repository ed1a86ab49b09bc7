"""Recordings as rows of frames, whose sums add up to any measure of a channel.

A frame of a channel carries its samples' count, sum, sum of squares and of
products with the other channel, least and greatest sample, clipped samples and
zeros, and the channel's runs of zeros of ``DROPOUT_MS`` or more that start in
it, whole. All are whole numbers, so measures of a recording do not depend on
how its frames were added up. What follows is Spark's work.
"""

from __future__ import annotations

import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .audio import channels

FULL_SCALE = 32768
CLIP_DBFS = -0.1
DROPOUT_MS = 40.0
FRAME_S = 0.02
FRAME = """channels int, rate int, channel int, frame long, n int, total long, squares long, products long, lo int, hi int, clipped int,
    silent int, zeros array<struct<start:long,end:long>>, first long, last long"""
_ZEROS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_KINDS = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), _ZEROS, pa.int64(), pa.int64()]


def runs(mask: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of a mask that are ``least`` or longer."""
    edge = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    long = ends - starts >= least
    return starts[long], ends[long]


def framed(data: np.ndarray, size: int, least: int) -> Iterator[list[list]]:
    """Per channel the columns of FRAME from channel on, with runs of ``least`` zeros or more; the last frame may be shorter."""
    n = data.shape[1]
    first = np.arange(0, n, size)
    if not len(first):
        return
    clip = FULL_SCALE * 10.0 ** (CLIP_DBFS / 20)
    for c, raw in enumerate(data):
        x, other = raw.astype(np.int64), data[1 - c if c < 2 <= len(data) else c].astype(np.int64)
        starts, ends = runs(x == 0, least)
        of, spoken = starts // size, np.nonzero(x)[0]
        ends_of = [[] for _ in first]
        for k, a, b in zip(of.tolist(), starts.tolist(), ends.tolist(), strict=True):
            ends_of[k].append({"start": a, "end": b})
        lowest = np.full(len(first), n)
        highest = np.full(len(first), -1)
        np.minimum.at(lowest, spoken // size, spoken)
        np.maximum.at(highest, spoken // size, spoken)
        sums = [np.add.reduceat(v, first).tolist() for v in (x, x * x, x * other)]
        none = [None if h < 0 else h for h in highest.tolist()]
        yield [
            [c] * len(first), list(range(len(first))), np.diff(np.append(first, n)).tolist(), *sums, np.minimum.reduceat(x, first).tolist(),
            np.maximum.reduceat(x, first).tolist(), *[np.add.reduceat(v.astype(np.int64), first).tolist() for v in (np.abs(x) >= clip, x == 0)], ends_of,
            [None if h is None else low for low, h in zip(lowest.tolist(), none, strict=True)], none,
        ]


def frames(files: DataFrame, key: str = "call_id", seconds: float = FRAME_S, per_second: int | None = None) -> DataFrame:
    """key and FRAME of the WAV in ``content``; ``per_second`` frames instead of frames of ``seconds``.

    A file that is no 16-bit WAV gives no rows, nor does an empty one. A file is
    decoded whole, in one row's memory; its rows leave channel by channel.
    """
    kind = files.schema[key].dataType.simpleString()
    schema = files.select(key).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names = [key, "channels", "rate", "channel", "frame", "n", "total", "squares", "products", "lo", "hi", "clipped", "silent", "zeros", "first", "last"]
        kinds = [to_arrow_type(schema[0].dataType), *_KINDS]
        for batch in batches:
            for call, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rate, data = channels(raw or b"")
                except (ValueError, EOFError, wave.Error):
                    continue
                size = max(1, rate // per_second if per_second else int(rate * seconds))
                for columns in framed(data, size, max(1, int(rate * DROPOUT_MS / 1000))):
                    n = len(columns[0])
                    whole = [[call] * n, [len(data)] * n, [rate] * n, *columns]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(whole, kinds, strict=True)], names=names)

    return files.select(key, "content").mapInArrow(run, f"{key} {kind}, {FRAME}")


def combined(caller: bytes, agent: bytes) -> bytes:
    """Two mono recordings as one of two channels, the shorter filled up with zeros, at the caller's rate."""
    import io

    (rate, left), (_, right) = channels(caller), channels(agent)
    n = max(left.shape[1], right.shape[1])
    both = np.zeros((n, 2), "<i2")
    both[: left.shape[1], 0], both[: right.shape[1], 1] = left[0], right[0]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(both.tobytes())
    return out.getvalue()


def dbfs(mean_square: Column) -> Column:
    """Level of a mean square of samples; silence is null."""
    return F.when(mean_square > 0, 20 * F.log10(F.sqrt(mean_square) / FULL_SCALE))


def packed(values: Column) -> Column:
    """Whole numbers of 16 bits as little-endian bytes, in order."""

    def two(x: Column) -> Column:
        low = F.pmod(x.cast("int"), F.lit(65536))
        return F.concat(F.lpad(F.hex(low % 256), 2, "0"), F.lpad(F.hex(F.floor(low / 256)), 2, "0"))

    return F.unhex(F.array_join(F.transform(values, two), ""))


def unpacked(data: Column) -> Column:
    """The numbers that ``packed`` wrote."""
    text = F.hex(data)

    def number(i: Column) -> Column:
        low, high = (F.conv(F.substring(text, i * 4 + at, F.lit(2)), 16, 10).cast("int") for at in (1, 3))
        value = high * 256 + low
        return F.when(value >= 32768, value - 65536).otherwise(value)

    n = F.floor(F.length(text) / 4).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), number)).otherwise(F.array().cast("array<int>"))


def packed_floats(values: Column) -> Column:
    """Doubles as little-endian 32-bit floats, in batches."""

    @F.pandas_udf("binary")
    def pack(rows):
        return rows.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())

    return pack(values)


def unpacked_floats(data: Column) -> Column:
    @F.pandas_udf("array<float>")
    def unpack(rows):
        return rows.map(lambda v: None if v is None else np.frombuffer(v, "<f4").tolist())

    return unpack(data)
