"""Array signals: Fourier and autocorrelation work in numpy on Arrow batches, the rest in array functions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import METERS
from pulsegrid.operators.hypotheses import TATUMS

#: The least concentration of onsets, the least fit of a window's best grid.
CONCENTRATION, FIT = 1.5, 0.7129778875046098


def hann(n: int) -> np.ndarray:
    """The periodic window, its sum 1."""
    w = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    return w / w.sum()


def autocorrelation(x: np.ndarray) -> np.ndarray:
    """Normalised circular autocorrelation of rows, lags 0 to n/2; rows of zeros stay zeros."""
    f = np.fft.rfft(x, axis=1)
    a = np.fft.irfft(f * f.conj(), n=x.shape[1], axis=1)[:, : x.shape[1] // 2 + 1]
    return np.divide(a, a[:, :1], out=np.zeros_like(a), where=a[:, :1] > 0)


def rows_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(length, numbers of rows) and their values as a matrix, for each length of array in a column; rows that are null or hold nulls stay out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    ends = np.asarray(column.offsets, np.int64)
    flat = column.values
    bad = np.asarray(column.is_null())
    if flat.null_count:
        holes = np.concatenate([[0], np.cumsum(np.asarray(flat.is_null()))])
        bad = bad | (holes[ends[1:]] > holes[ends[:-1]])
    values = np.asarray(flat.fill_null(0.0), np.float64)
    size = np.where(bad, -1, np.diff(ends))
    for n in np.unique(size[size > 0]):
        own = np.flatnonzero(size == n)
        yield own, values[ends[own][:, None] + np.arange(n)]


def circular_autocorrelation(frames: DataFrame, key: str, x: str) -> DataFrame:
    """(key, acf) for rows of float arrays. Null and empty arrays and ones with nulls give null."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [None] * batch.num_rows
            for own, values in rows_of(batch.column(1)):
                for i, a in zip(own.tolist(), autocorrelation(values), strict=True):
                    out[i] = a
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], [key, "acf"])

    return frames.select(F.col(key).cast("long").alias(key), F.col(x).cast("array<double>").alias(x)).mapInArrow(each, f"{key} long, acf array<double>")


def circular_peaks(x: Column) -> Column:
    """Places, from 0, above both neighbours; the ends are neighbours."""
    n = F.size(x)
    at = lambda i: F.element_at(x, F.pmod(i, n) + 1)
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: (at(i - 1) < at(i)) & (at(i) > at(i + 1)))


def smoothed(x: Column, half: int, raise_: float = 1.5) -> Column:
    """x less a circular weighted mean around each place, times raise_; nothing below zero."""
    size = 2 * half + 1
    w = [0.5 - 0.5 * math.cos(2 * math.pi * (i + 1) / (size + 1)) for i in range(size)]
    total = sum(w)
    n = F.size(x)
    mean = lambda i: sum((F.element_at(x, F.pmod(i + k - half, n) + 1) * (w[k] / total) for k in range(size)), F.lit(0.0))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.greatest(F.lit(0.0), F.element_at(x, i + 1) - mean(i) * raise_))


def novelty(now: Column, before: Column) -> Column:
    """The sum of rises of log2(1 + 100 sqrt(p)) between two power spectra."""
    level = lambda p: F.log2(F.sqrt(F.greatest(p, F.lit(0.0))) * 100 + 1)
    return F.aggregate(F.zip_with(now, before, lambda a, b: F.greatest(F.lit(0.0), level(a) - level(b))), F.lit(0.0), lambda s, v: s + v)


def onset_gate(count: Column, weights: Column) -> Column:
    """Whether onsets are rejected: none, not as many as counted, not finite, or too concentrated in a few."""
    odd = F.exists(weights, lambda w: w.isNull() | F.isnan(w) | (F.abs(w) == float("inf")))
    up = F.filter(weights, lambda w: w > 0)
    s = F.aggregate(up, F.lit(0.0), lambda a, w: a + w)
    q = F.aggregate(up, F.lit(0.0), lambda a, w: a + w * w)
    return F.coalesce((F.size(weights) == 0) | (count != F.size(weights)) | odd | (q <= 0) | (s * s / F.nullif(q, F.lit(0.0)) < CONCENTRATION), F.lit(True))


def fft_size(sample_rate: Column) -> Column:
    """The power of two nearest to 2048 samples at 44.1 kHz, in 2^7 to 2^15."""
    return F.pow(F.lit(2.0), F.least(F.lit(15), F.greatest(F.lit(7), F.lit(11) + F.round(F.log2(sample_rate / 44_100.0)).cast("int")))).cast("int")


def frame_count(samples: Column, sample_rate: Column) -> Column:
    """The power of two of frames whose hop is nearest to 10 ms."""
    return F.pow(F.lit(2.0), F.round(F.log2(samples / (sample_rate * 0.01)))).cast("int")


def circular_frames(x: np.ndarray, size: int, count: int) -> np.ndarray:
    """`count` frames of `size` samples at equal hops; the first ends where the first hop does, and what is before the start is the end."""
    hop = len(x) / count
    ends = np.floor(hop * np.arange(1, count + 1) + 0.5).astype(np.int64)
    return x[(ends[:, None] - size + np.arange(size)) % len(x)]


def onset_curve(x: np.ndarray, sample_rate: float) -> tuple[np.ndarray, float]:
    """(curve, frames a second): rises of the compressed spectrum from frame to frame, less a raised mean around each; the last frame goes on
    to the first. The curve is empty where the window is too short for a power of two of frames."""
    if not sample_rate > 0 or len(x) < 1:
        return np.zeros(0), 0.0
    size = 1 << int(np.clip(11 + np.floor(np.log2(sample_rate / 44_100) + 0.5), 7, 15))
    count = 1 << max(0, int(np.floor(np.log2(max(1.0, len(x) / (sample_rate * 0.01))) + 0.5)))
    if count < 2 or len(x) < size:
        return np.zeros(0), 0.0
    power = np.abs(np.fft.rfft(circular_frames(np.asarray(x, np.float64), size, count) * hann(size), axis=1))
    level = np.log2(1 + 100 * power)
    rise = np.maximum(level - np.roll(level, 1, axis=0), 0).sum(axis=1)
    rate = count * sample_rate / len(x)
    half = max(1, int(np.floor(0.2 * rate / 4 + 0.5)))
    span = 2 * half + 1
    w = 0.5 - 0.5 * np.cos(2 * np.pi * (np.arange(span) + 1) / (span + 1))
    mean = sum(np.roll(rise, half - k) * w[k] for k in range(span)) / w.sum()
    return np.maximum(rise - 1.5 * mean, 0), rate


def onset_lag(x: np.ndarray, tatums: int) -> int:
    """How far a train of equal pulses can be moved before what it hits falls for the first time."""
    at = np.floor(np.arange(tatums) * (len(x) / tatums) + 0.5).astype(np.int64)
    padded = np.concatenate([x, np.zeros(len(x) + 1)])
    hit = padded[at[None, :] + np.arange(len(x))[:, None]].sum(axis=1)
    falls = np.flatnonzero(hit[1:] < np.maximum.accumulate(hit)[:-1])
    return int(falls[0]) if len(falls) else len(x) - 1


def grid_error(places: np.ndarray, weights: np.ndarray, size: int, tatums: int, lag: int) -> float:
    """Twice the weighted mean distance to the nearest line of a grid of so many tatums that begins at lag, over its step."""
    phase = (places - lag) / (size / tatums)
    return float((2 * np.abs(phase - np.floor(phase + 0.5)) * weights).sum() / weights.sum())


def self_similarity(acf: np.ndarray, size: int, lag: float) -> float:
    """The mean of the autocorrelation at the peaks that are reached uphill from each multiple of a lag."""
    half = len(acf)
    found = []
    for k in range(1, int(half / lag) + 2):
        j = int(k * lag + 0.5)
        if j >= half:
            break
        for _ in range(size):
            before, after = (min(i % size, size - i % size) for i in (j - 1, j + 1))
            if acf[before] <= acf[j] >= acf[after]:
                break
            j = before if acf[before] > acf[after] else after
        found.append(acf[j])
    return float(np.mean(found)) if found else 0.0


def divisions(duration_s: float) -> dict[int, list[tuple[float, float, int]]]:
    """Tatum counts of a window with the (rate, tatums in a beat, beats in a bar) that complete bars of 1 to 4 seconds allow."""
    found: dict[int, list[tuple[float, float, int]]] = {}
    for bars in range(max(1, math.floor(duration_s / 4 + 0.5)), math.floor(duration_s + 0.5) + 1):
        for per_bar in range(2, 5):
            beats = bars * per_bar
            rate = beats * 60 / duration_s
            for a, b in TATUMS:
                tatums = beats * a / b
                if 50 <= rate <= 200 and tatums == int(tatums) and 100 < tatums * 60 / duration_s < 700:
                    found.setdefault(int(tatums), []).append((rate, a / b, per_bar))
    return found


def _meter(per_beat: float, per_bar: int) -> tuple[str, float, float, float]:
    name = {2: "6/8" if per_beat == 3 else "2/2", 3: "3/4", 4: "4/4"}[per_bar]
    return next(m for m in METERS if m[0] == name)


def window_fit(curve: np.ndarray, rate: float, duration_s: float) -> tuple[str, int, float, float, str, float]:
    """(reason, tatums, error, rate, meter, meter score) of one onset curve: the first thing that is missing, or the grid that fits best.

    Of grids with equal errors the one with fewer tatums counts. Of its meters, those in 4/4 go first; then likelihood times self-similarity.
    """
    none = (0, 1.0, 0.0, "", 0.0)
    if len(curve) < 8:
        return "insufficient_odf", *none
    places = np.flatnonzero((curve > np.roll(curve, 1)) & (curve > np.roll(curve, -1)))
    w = np.maximum(curve[places], 0)
    if len(places) < 3:
        return "insufficient_onsets", *none
    if not (w**2).sum() or w.sum() ** 2 / (w**2).sum() < CONCENTRATION:
        return "single_event", *none
    possible = divisions(duration_s) if duration_s > 0 else {}
    if not possible:
        return "no_loop_hypotheses", *none
    error, tatums = min((grid_error(places, w, len(curve), t, onset_lag(curve, t)), t) for t in possible)
    if not np.isfinite(error):
        return "ambiguous_tatum_fit", *none
    acf = autocorrelation(curve[None, :])[0]
    scored = []
    for bpm, per_beat, per_bar in possible[tatums]:
        name, mean, spread, prior = _meter(per_beat, per_bar)
        likely = math.exp(-0.5 * ((bpm - mean) / spread) ** 2) * prior
        scored.append((name == "4/4", likely * self_similarity(acf, len(curve), rate * 60 / bpm), -bpm, name))
    _, score, bpm, name = max(scored)
    return ("fit" if min(1.0, max(0.0, 1 - error)) >= FIT else "below_threshold"), tatums, error, -bpm, name, score


FITTED = "reason string, num_tatums int, error double, rate double, meter string, meter_score double"


def _fitted(frames: DataFrame, key: str, x: str, fit: Callable[[np.ndarray], tuple]) -> DataFrame:
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.string(), pa.int32(), pa.float64(), pa.float64(), pa.string(), pa.float64())
        for batch in batches:
            out: list[tuple] = [("invalid_input", 0, 1.0, 0.0, "", 0.0)] * batch.num_rows
            for own, values in rows_of(batch.column(1)):
                for i, row in zip(own.tolist(), values, strict=True):
                    if np.isfinite(row).all():
                        out[i] = fit(row)
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]], [key, *[f.split()[0] for f in FITTED.split(", ")]])

    return frames.select(F.col(key).cast("long").alias(key), F.col(x).cast("array<double>").alias(x)).mapInArrow(each, f"{key} long, {FITTED}")


def evaluate_curves(frames: DataFrame, key: str, x: str, duration_s: float) -> DataFrame:
    """(key, reason, num_tatums, error, rate, meter, meter_score) of each window's onset curve; a broken row says so and fails no task."""
    return _fitted(frames, key, x, lambda row: window_fit(row, len(row) / duration_s, duration_s))


def evaluate_windows(samples: DataFrame, key: str, x: str, sample_rate: float) -> DataFrame:
    """The same of each window's samples, from which the onset curve is made; under 1,024 samples a window is invalid."""

    def fit(row: np.ndarray) -> tuple:
        if len(row) < 1024:
            return "invalid_input", 0, 1.0, 0.0, "", 0.0
        curve, rate = onset_curve(row, sample_rate)
        return window_fit(curve, rate, len(row) / sample_rate)

    return _fitted(samples, key, x, fit)
