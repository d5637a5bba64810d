"""Releases after the policy, each with what lets it pass by."""

import pytest

from pulsegrid.operators import releases

DECIDED = "track long, reason string, action string, kind string, candidate_rate double, current_rate double, final_rate double, would_write boolean, written_as string, confidence double"
HELD = ("family_conflict_hold", "hold", "review_hold", 120.0, 150.0, 0.0, False, "review_hold", 0.0)
WRITTEN = ("override_veto", "keep", "keep_current", 100.0, 100.0, 100.0, True, "current", None)
ROUTE = (100.0, 20.0, True, False)
# rate, coarse, local, score_sum, score_ratio, family_rank, top5, segments, total, board_rate
BAR = {"rate": 112.0, "coarse": 112.0, "local": 0.30, "score_sum": 2.0, "score_ratio": 0.9, "family_rank": 1, "top5": 20, "segments": 20, "total": 20, "board_rate": 150.0}
TOP = "track long, rate double, coarse double, local double, score_sum double, score_ratio double, family_rank int, top5 int, segments int, total int, board_rate double"


def bars(*changes):
    return [tuple((BAR | c).values()) for c in changes]


CASES = {  # decided, route, bars: reason and rate
    "rational": (HELD, ROUTE, bars({}), ("exact_rational_release", 112.0)), "centre": (HELD, ROUTE, bars({"rate": 100.5, "board_rate": 140.0}), ("exact_centre_release", 100.5)),
    "rational_first": (HELD, ROUTE, bars({"local": 0.29}, {"rate": 100.5, "board_rate": 140.0}), ("exact_rational_release", 112.0)), "stronger": (HELD, ROUTE, bars({}, {"rate": 112.5, "local": 0.31}), ("exact_rational_release", 112.5)),
    "weak": (HELD, ROUTE, bars({"local": 0.17}), None), "far": (HELD, ROUTE, bars({"rate": 125.0, "board_rate": 187.5}), None), "few_windows": (HELD, ROUTE, bars({"segments": 19}), None), "never_first_five": (HELD, ROUTE, bars({"top5": 0}), None),
    "low_ratio": (HELD, ROUTE, bars({"score_ratio": 0.4}), None), "not_the_best": (HELD, ROUTE, bars({"local": 0.28}, {"rate": 160.0, "local": 0.30}), None), "generic": (HELD, (100.0, 20.0, True, True), bars({}), None), "written": (WRITTEN, ROUTE, bars({}), None), "no_bars": (HELD, ROUTE, [], None),
}


@pytest.fixture(scope="module")
def settled(spark):
    names = list(CASES)
    decided = spark.createDataFrame([(i, *CASES[n][0]) for i, n in enumerate(names)], DECIDED)
    context = spark.createDataFrame([(i, *CASES[n][1]) for i, n in enumerate(names)], "track long, centre double, spread double, matched boolean, generic boolean")
    top = spark.createDataFrame([(i, *b) for i, n in enumerate(names) for b in CASES[n][2]], TOP)
    return {names[r["track"]]: r for r in releases.exact_top(decided, context, top).collect()}


@pytest.mark.parametrize("name", CASES)
def test_exact_top(settled, name):
    row, want = settled[name], CASES[name][3]
    if want:
        assert (row["reason"], row["final_rate"], row["would_write"], row["action"]) == (*want, True, "override") and 50 <= row["confidence"] <= 99
    else:
        assert tuple(row)[1:] == CASES[name][0]


def test_cross_view(spark):
    fast = {"rate": 160.0, "local": 0.3, "support": 0.9, "cont": 0.3, "cont_section": 0.9}
    tracks = [
        (WRITTEN, [fast], bars({"coarse": 161.0}), 160.0), (WRITTEN, [fast], bars({"coarse": 161.5}), None), (WRITTEN, [fast | {"rate": 170.0}], bars({"coarse": 170.0}), None), (WRITTEN, [fast | {"support": 0.7}], bars({"coarse": 160.0}), None), (HELD, [fast], bars({"coarse": 160.0}), None),
        (WRITTEN, [fast, fast | {"rate": 161.0}], bars({"coarse": 160.5}), 161.0), (WRITTEN, [fast, fast | {"rate": 164.0}], bars({"coarse": 160.0}, {"coarse": 164.0, "score_sum": 3.0}), 164.0), (WRITTEN, [fast], bars({"coarse": 160.0, "score_ratio": 0.7}), None), (WRITTEN, [], bars({}), None),
    ]
    decided = spark.createDataFrame([(i, *t[0]) for i, t in enumerate(tracks)], DECIDED)
    board = spark.createDataFrame([(i, *k.values()) for i, t in enumerate(tracks) for k in t[1]], "track long, k_rate double, k_local double, k_support double, k_cont double, k_cont_section double")
    got = {r["track"]: r for r in releases.cross_view(decided, board, spark.createDataFrame([(i, *b) for i, t in enumerate(tracks) for b in t[2]], TOP)).collect()}
    for i, t in enumerate(tracks):
        assert (got[i]["reason"] == "cross_view_release") == (t[3] is not None), i
        assert tuple(got[i])[1:] == t[0] if t[3] is None else got[i]["final_rate"] == t[3], i
