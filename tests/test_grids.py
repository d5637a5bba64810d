"""Scans by vectors against one onset and grid point after another."""

import math

import numpy as np
import pytest

from pulsegrid.operators import grids


def plain(times, centre, grid, least=1):
    span, best = max(times) - min(times), None
    if len(times) < least:
        return None
    for k in range(grid.points):
        rate = round(centre - grid.half + k * grid.step, 6)
        if rate < grid.floor:
            continue
        a = [2 * math.pi * t * rate / grid.unit_s for t in times]
        vs, axial = (math.hypot(sum(math.cos(m * x) for x in a), sum(math.sin(m * x) for x in a)) / len(a) for m in (1, 2))
        score = round(0.5 * vs + 0.35 * axial + 0.15 * min(1, len(a) / max(1, span * rate / grid.unit_s)), 9)
        if best is None or score > best[1]:
            best = (rate, score)
    return best


@pytest.fixture(scope="module")
def onsets(spark):
    rng = np.random.default_rng(2)
    rows = {}
    for track in range(6):
        for section in range(4):
            beat = 60 / (100 + 7 * track)
            n = [3, 30, 200, 3000][section] if track < 2 else int(rng.integers(3, 60))
            rows[track, section] = np.sort(rng.integers(0, 400, n) * beat + rng.normal(0, 0.01, n)).tolist()
    flat = [(t, s, x, max(v) - min(v)) for (t, s), v in rows.items() for x in v]
    return rows, spark.createDataFrame(flat, "track long, section int, t double, span double").repartition(7)


def test_scans(spark, onsets):
    rows, df = onsets
    grid = grids.Grid(3.0, 0.25, 60.0)
    centres = spark.createDataFrame([(t, 100.0 + 7 * t + d) for t in range(6) for d in (0.1, 5.0)], "track long, centre double")
    got = {(r["track"], r["section"], r["centre"]): (r["rate"], r["score"]) for r in grids.scanned(df, centres, grid, 4).collect()}
    want = {(t, s, 100.0 + 7 * t + d): plain(v, 100.0 + 7 * t + d, grid, 4) for (t, s), v in rows.items() for d in (0.1, 5.0)}
    assert got.keys() == {k for k, v in want.items() if v}
    for k, (rate, score) in got.items():
        assert rate == want[k][0] and abs(score - want[k][1]) < 1e-8


def test_coarse_to_fine_against_the_whole_fine_grid(spark, onsets):
    rows, df = onsets
    centres = spark.createDataFrame([(t, 100.4 + 7 * t) for t in range(6)], "track long, centre double")
    got = grids.coarse_to_fine(df, centres, grids.Grid(3.0, 0.25, 60.0), grids.Grid(0.5, 0.01, 60.0), 20).collect()
    assert {(r["track"], r["section"]) for r in got} == {k for k, v in rows.items() if len(v) >= 20}
    for r in got:
        full = plain(rows[r["track"], r["section"]], r["coarse_rate"], grids.Grid(0.5, 0.01, 60.0))
        assert r["rate"] == full[0] and r["score"] >= r["coarse_score"] - 1e-9
        assert r["border"] == (abs(abs(r["rate"] - r["coarse_rate"]) - 0.5) < 1e-9)


def test_consensus(spark):
    found = spark.createDataFrame([(1, r) for r in (100.0, 100.2, 100.4, 103.0)] + [(2, 90.0)], "track long, rate double")
    best = spark.createDataFrame([(1, 100.1), (2, 95.0)], "track long, rate double")
    got = {r["track"]: r for r in grids.consensus(found, best).collect()}
    assert (got[1]["sections"], got[1]["near_best"], got[1]["cluster_share"]) == (4, 0.75, 0.75) and abs(got[1]["cluster"] - 100.2) < 1e-9 and abs(got[1]["median"] - 100.3) < 1e-9
    assert (got[2]["near_best"], got[2]["cluster"], got[2]["iqr"]) == (0.0, 90.0, 0.0)


def test_odd_rows(spark):
    none = spark.createDataFrame([(1, 0, None, 1.0)], "track long, section long, t double, span double")
    centre = spark.createDataFrame([(1, 100.0)], "track long, centre double")
    grid = grids.Grid(1.0, 0.5, 60.0)
    assert grids.scanned(none, centre, grid).count() == 0
    one = spark.createDataFrame([(1, 0, 5.0, None), (1, 0, 5.0, None)], none.schema)
    assert [(r["rate"], r["n"]) for r in grids.scanned(one, centre, grid).collect()] == [(99.0, 2)]
    assert grids.scanned(one, centre, grids.Grid(1.0, 0.5, 60.0, floor=200.0)).count() == 0
