"""Signal measures of recordings: one WAV per row, decoded and measured in Arrow batches."""

from __future__ import annotations

import io
import wave
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Measure:
    """Fixed values of the measures: levels in dBFS, times in seconds."""

    threshold_dbfs: float = -50.0
    hangover_s: float = 0.20
    least_s: float = 0.10
    frame_s: float = 0.02
    floor_dbfs: float = -120.0


def channels(raw: bytes) -> tuple[int, np.ndarray]:
    """(rate, one row per channel) of 16-bit PCM."""
    with wave.open(io.BytesIO(raw)) as w:
        if w.getsampwidth() != 2:
            raise ValueError("only 16-bit PCM is read")
        data = np.frombuffer(w.readframes(w.getnframes()), "<i2")
        return w.getframerate(), data.reshape(-1, w.getnchannels()).T


def energy(x: np.ndarray, rate: int, m: Measure = Measure()) -> np.ndarray:
    """Level of each whole frame; silence has the floor."""
    size = max(1, int(rate * m.frame_s))
    frames = x[: len(x) // size * size].reshape(-1, size).astype(np.float64)
    rms = np.sqrt((frames**2).mean(1)) / 32768
    with np.errstate(divide="ignore"):
        return np.maximum(20 * np.log10(rms), m.floor_dbfs)


def speech(x: np.ndarray, rate: int, m: Measure = Measure()) -> list[tuple[float, float]]:
    """Intervals over the threshold; gaps up to the hangover are bridged, one that reaches the end too, short ones dropped."""
    levels = energy(x, rate, m)
    loud = np.nonzero(levels > m.threshold_dbfs)[0]
    if not len(loud):
        return []
    hangover = round(m.hangover_s / m.frame_s)
    breaks = np.nonzero(np.diff(loud) > hangover + 1)[0]
    first, last = loud[np.append(0, breaks + 1)], loud[np.append(breaks, len(loud) - 1)]
    if len(levels) - 1 - last[-1] <= hangover:
        last[-1] = len(levels) - 1
    found = [(round(float(a * m.frame_s), 4), round(float((b + 1) * m.frame_s), 4)) for a, b in zip(first, last, strict=True)]
    return [(a, b) for a, b in found if b - a >= m.least_s]


def coverage(x: np.ndarray) -> float:
    return round(float((x != 0).mean()), 4) if len(x) else 0.0


def utterances(files: DataFrame, speakers: tuple[str, ...] = ("caller", "agent"), m: Measure = Measure()) -> DataFrame:
    """(call_id, channel, t_start, t_end, coverage) of call_id and content; a channel without speech is one row of nulls.

    Files that are no 16-bit WAV give no rows.
    """

    def run(batches):
        for batch in batches:
            out = []
            for call, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    rate, data = channels(raw or b"")
                except (ValueError, EOFError, wave.Error):
                    continue
                for name, x in zip(speakers, data, strict=False):
                    out += [(call, name, a, b, coverage(x)) for a, b in speech(x, rate, m) or [(None, None)]]
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = (pa.string(), pa.string(), pa.float64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["call_id", "channel", "t_start", "t_end", "coverage"])

    return files.select("call_id", "content").mapInArrow(run, "call_id string, channel string, t_start double, t_end double, coverage double")
