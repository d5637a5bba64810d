"""Scans of a grid of rates by vectors of phase sums: a row for each (track, section, centre) and task, never one for each onset and grid point.

A task adds up, for each scan, the sums of all grid points as numpy vectors; the vectors of several tasks are added where scans meet, and
the best point comes out. So what is shuffled is bounded by the scans, however many onsets a track has.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import series

#: Onsets whose angles are held at once.
BLOCK = 2048
_SUMS = ("c1", "s1", "c2", "s2")
PARTIAL = "track long, section long, centre double, n long, span double, " + ", ".join(f"{c} array<double>" for c in _SUMS)
FOUND = "track long, section long, centre double, rate double, score double, n long, border boolean"


class Grid:
    """Rates half to each side of a centre in steps, from a floor on."""

    def __init__(self, half: float, step: float, unit_s: float, floor: float = 30.0):
        self.half, self.step, self.unit_s, self.floor = half, step, unit_s, floor
        self.points = int(round(2 * half / step)) + 1

    def rates(self, centre: float) -> np.ndarray:
        return np.round(centre - self.half + np.arange(self.points) * self.step, 6)

    def sums(self, t: np.ndarray, centre: float) -> np.ndarray:
        """Four vectors, of cosines and sines of the phases and of twice the phases; a rate that isn't one adds nothing."""
        rates = self.rates(centre)
        turn = np.where(rates >= self.floor, rates / self.unit_s, 0.0) * (2 * math.pi)
        out = np.zeros((4, self.points))
        for at in range(0, len(t), BLOCK):
            a = np.outer(t[at : at + BLOCK], turn)
            out += [np.cos(a).sum(axis=0), np.sin(a).sum(axis=0), np.cos(2 * a).sum(axis=0), np.sin(2 * a).sum(axis=0)]
        return out

    def best(self, sums: np.ndarray, n: int, span: float, centre: float) -> tuple[float, float, bool] | None:
        """(rate, score, at the border) of the best point, the lower of equal ones; None where no rate reaches the floor."""
        rates = self.rates(centre)
        fit = np.flatnonzero(rates >= self.floor)
        if not len(fit):
            return None
        strength = np.hypot(sums[0::2], sums[1::2])[:, fit] / n
        density = np.minimum(4.0, n / np.maximum(span * rates[fit] / self.unit_s, 1.0))
        score = np.round(strength[0] * 0.5 + strength[1] * 0.35 + np.minimum(density, 1.0) * 0.15, 9)
        i = int(score.argmax())
        return float(rates[fit[i]]), float(score[i]), bool(fit[i] in (0, self.points - 1))


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray]]:
    """((track, section, centre), rows) of a batch in any order."""
    keys = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
    order = np.lexsort(keys[::-1])
    change = np.flatnonzero(np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)) + 1
    for rows in np.split(order, change):
        yield tuple(k[rows[0]].item() for k in keys), rows


def scanned(onsets: DataFrame, centres: DataFrame, grid: Grid, least: int = 1) -> DataFrame:
    """(track, section, centre, rate, score, n, border): the best rate of each scan of `least` onsets or more.

    onsets: track, section, t, span (seconds that the section's onsets cover); centres: track, centre, one or more for a track. border: the best
    rate is the grid's first or last, so what is beyond might be better.
    """
    rows = onsets.join(centres, "track").select(F.col("track").cast("long").alias("track"), F.col("section").cast("long").alias("section"), F.col("centre").cast("double").alias("centre"), F.col("t").cast("double").alias("t"), F.col("span").cast("double").alias("span")).where("t IS NOT NULL AND centre IS NOT NULL")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def out() -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.float64(), *[pa.list_(pa.float64())] * 4]
            made = [(*k, n, span, *(v.tolist() for v in sums)) for k, (n, span, sums) in held.items()]
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], [x.split()[0] for x in PARTIAL.split(", ")])

        for batch in batches:
            if not batch.num_rows:
                continue
            t, span = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4))
            for key, some in _groups(batch):
                n, widest, sums = held.get(key, (0, 0.0, 0.0))
                held[key] = [n + len(some), max(widest, float(np.nanmax(span[some], initial=0.0))), sums + grid.sums(t[some], key[2])]
            if len(held) * grid.points > 1 << 19:
                yield out()
                held.clear()
        if held:
            yield out()

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None

        def row() -> list[tuple]:
            best = grid.best(state[2], state[0], state[1], key[2]) if state and state[0] >= least else None
            return [(*key, best[0], best[1], state[0], best[2])] if best else []

        for batch in batches:
            made = []
            for track, section, centre, n, span, *vectors in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (track, section, centre) != key:
                    made += row() if state else []
                    key, state = (track, section, centre), [0, 0.0, 0.0]
                state = [state[0] + n, max(state[1], span), state[2] + np.array(vectors)]
            yield table_of(made)
        if state:
            yield table_of(row())

    def table_of(made: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_()]
        return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], kind) for i, kind in enumerate(kinds)], [x.split()[0] for x in FOUND.split(", ")])

    by = ["track", "section", "centre"]
    return rows.mapInArrow(add, PARTIAL).repartition(*by).sortWithinPartitions(*by).mapInArrow(finish, FOUND)


def coarse_to_fine(onsets: DataFrame, centres: DataFrame, coarse: Grid, fine: Grid, least: int = 1) -> DataFrame:
    """(track, section, rate, score, coarse_rate, coarse_score, border): a second grid around each track's coarse winner.

    The fine grids' centres are what the coarse one found in the track's sections, so only points near these are ever summed. border: the fine
    winner is the fine grid's end.
    """
    first = scanned(onsets, centres, coarse, least)
    top = first.groupBy("track", "section").agg(F.max(F.struct("score", (-F.col("rate")).alias("r"))).alias("b")).select("track", "section", (-F.col("b.r")).alias("coarse_rate"), F.col("b.score").alias("coarse_score"))
    # a scan's centre belongs to its section: the winners of sections that found the same rate share a scan, each with its own onsets
    second = scanned(onsets, top.select("track", F.col("coarse_rate").alias("centre")).distinct(), fine, least)
    return top.join(second.withColumnRenamed("centre", "coarse_rate"), ["track", "section", "coarse_rate"]).select("track", "section", "rate", "score", "coarse_rate", "coarse_score", "border")


def consensus(found: DataFrame, best: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(track, sections, median, q25, q75, iqr, least, most, near_best, cluster, cluster_share): what the sections' best rates agree on.

    found: scanned() by section; best: (track, rate) of the whole track. near_best: the share of sections within tolerance of it; cluster: the
    largest group of rates that keep together, with its share.
    """
    values = found.select("track", F.col("rate").alias("x"))
    spread = series.quantiles(values, "track", "x").drop("stability")
    near = series.near_share(values, best.select("track", F.col("rate").alias("centre")), tolerance).select("track", F.col("near_1").alias("near_best"))
    largest = series.clusters(values, tolerance, 1).select("track", F.col("centre").alias("cluster"), F.col("n").alias("members"))
    out = spread.join(near, "track").join(largest, "track")
    return out.select("track", F.col("n").alias("sections"), "median", "q25", "q75", "iqr", "least", "most", "near_best", "cluster", (F.col("members") / F.col("n")).alias("cluster_share"))
