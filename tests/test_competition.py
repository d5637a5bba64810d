"""The tournament of relations against one option after another, and what its winner releases."""

import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions.relations import RELATIONS
from pulsegrid.operators import competition

FAMILIES = [  # track, rank, rate, score, support, candidates
    (1, 1, 180.0, 5.0, 9, 9), (2, 1, 120.0, 5.0, 9, 9), (2, 2, 90.0, 4.0, 6, 2), (3, 1, 200.0, 2.0, 5, 9), (4, 1, 100.0, 0.0, 5, 5), (5, 1, 100.0, 3.0, 5, 5), (6, 1, 60.0, 3.0, 8, 8), (6, 2, 61.0, 3.0, 8, 1), (6, 3, 90.0, 1.0, 1, 1), (6, 4, 120.0, 0.5, 1, 0),
]
SHARES = [(1, 10.0, 10.0), (2, 10.0, 10.0), (3, 10.0, 5.0), (4, 10.0, 5.0), (5, 10.0, 0.0), (6, 10.0, 9.0)]
ROUTES = [(1, 130.0, 140.0), (2, 80.0, 140.0), (3, 145.0, 155.0), (4, 80.0, 140.0), (5, 80.0, 140.0), (6, 40.0, 220.0)]


def plain(track):
    own = sorted(f[1:] for f in FAMILIES if f[0] == track)
    windows, won = next(s[1:] for s in SHARES if s[0] == track)
    low, high = next(r[1:] for r in ROUTES if r[0] == track)
    top, runner = own[0][2], own[1][2] if len(own) > 1 else 0.0
    if top <= 0 or won <= 0:
        return []
    unit = lambda x: min(1.0, max(0.0, x))
    quality = 0.4 * unit(own[0][3] / windows) + 0.35 * unit(math.log1p(top / runner if runner else top) / math.log1p(8)) + 0.25 * unit(1 - runner / top)
    out = []
    for rank, rate, score, support, _ in own:
        for name, a, b in RELATIONS:
            x = rate * (a / b)
            if low <= x <= high and 40 <= x <= 220:
                gap = abs(x - (low + high) / 2)
                out.append((-round(42 * score / top + 30 * support / won + 20 * quality + 13 * competition.PRIOR[name] + 7 * max(0, 1 - min(1, gap / (max(1, high - low) / 2))) - 1.75 * (rank - 1), 9), rank, round(gap, 9), x, name))
    return sorted(out)


@pytest.fixture(scope="module")
def won(spark):
    ranked = spark.createDataFrame(FAMILIES, "track long, family_rank int, rate double, score_sum double, support long, candidate_support long")
    found = competition.options(ranked, spark.createDataFrame(SHARES, "track long, windows double, won double"), spark.createDataFrame(ROUTES, "track long, low double, high double"))
    return found, competition.winners(found)


def test_winners(won):
    got = {r["track"]: r for r in won[1].collect()}
    assert set(got) == {t for t in range(1, 7) if plain(t)} == {1, 2, 3, 6}
    for track, r in got.items():
        best = plain(track)
        assert (r["options"], r["family_rank"], r["relation"]) == (len(best), best[0][1], best[0][4]) and abs(r["rate"] - best[0][3]) < 1e-9 and abs(r["score"] + best[0][0]) < 1e-8
        assert abs(r["runner_up_ratio"] - (best[1][0] / best[0][0] if len(best) > 1 else 0)) < 1e-8
    assert {t: r["clear"] for t, r in got.items()} == {1: True, 2: False, 3: False, 6: False}


def test_release(spark, won):
    no = {h: False for h in ("hold_sparse", "hold_material", "hold_family", "hold_centre", "hold_exact")}
    rows = [(1, True, 180.0, no), (1, True, 160.0, no), (1, False, 180.0, no), (1, True, 180.0, no | {"hold_exact": True}), (2, True, 180.0, no), (9, True, 180.0, no)]
    names = ["hold_sparse", "hold_material", "hold_family", "hold_centre", "hold_exact"]
    held = spark.createDataFrame([(i, t, a, x, *[h[n] for n in names]) for i, (t, a, x, h) in enumerate(rows)], "i int, track long, hold_alias boolean, ex_rate double, " + ", ".join(f"{n} boolean" for n in names))
    assert [r["release"] for r in competition.released(held, won[1]).orderBy("i").collect()] == [135.0, None, None, None, None, None]


def test_nothing_to_compete(spark, won):
    assert competition.winners(won[0].where("false")).count() == 0
    assert won[0].where(F.col("track") == 4).count() == 0
