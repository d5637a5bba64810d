"""Boards are dealt out by track once, while rows are narrow, to as many tasks as the table's rows ask for."""

import re

import pytest

from pulsegrid.plans import registry
from pulsegrid.sources import inputs
from pulsegrid.sources.staged import staged

ONCE = ["board_raw", "board_collapse", "board_winner", "full_board", "lane_classify", "route_independent", "confidence", "nearest_target", "harmonic_partner", "policy_decision", "witness_semi_join", "review_candidates"]


def exchanges(df):
    """The ways in which a plan shuffles, one entry for each exchange that is run."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"(?<!Reused)Exchange (\w+\([^)]*\))", plan)


@pytest.mark.parametrize("name", ONCE)
def test_one_shuffle(name, spark, sf_dir):
    assert len(exchanges(registry.QUERIES[name](spark, sf_dir))) == 1


def test_tasks_grow_with_the_rows(spark, sf_dir):
    n = inputs.table(spark, sf_dir, "lineitem").count()
    assert inputs.tasks(spark, sf_dir) == spark.sparkContext.defaultParallelism
    assert inputs.tasks(spark, sf_dir, share=100) == -(-n // 100) > 8


def test_steps_of_a_staged_table_need_no_shuffle(spark):
    rows = spark.range(1000).selectExpr("id % 50 AS track", "id AS x")
    kept = staged(rows.repartition(4, "track"), "kept-by-track", "track", 4)
    found = kept.groupBy("track").sum("x")
    assert exchanges(found) == [] and sorted(found.collect()) == sorted(rows.groupBy("track").sum("x").collect())


def test_evidence_is_shuffled_while_narrow(spark, sf_dir):
    assert len(exchanges(registry.QUERIES["board_evidence"](spark, sf_dir))) == 3


def test_a_lane_comes_with_the_board(spark, sf_dir):
    assert len(exchanges(registry.QUERIES["conservative_select"](spark, sf_dir))) == 1


def test_partners_are_made_in_one_pass(spark, sf_dir):
    plan = registry.QUERIES["harmonic_partner"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    windows, sorts = (re.findall(rf"\b{x} \[", plan) for x in ("Window", "Sort"))
    assert len(windows) == 2 and len(sorts) == 1


def test_tasks_hold_few_lines():
    assert inputs.SHARE <= 25_000


def test_partners_of_any_board(spark):
    """Partners are those of brute force where ratios stand at the very error, and rates of a fine step meet in a twentieth."""
    from pulsegrid.operators.board import PARTNER_ERROR, PARTNERS, release_features

    rates = [60.0, 61.0, 80.0, 81.25, 89.0, 91.75, 117.75, 120.0, 122.0, 180.0, 183.25, 220.0]
    rows = [(1, r, round(0.1 + (i * 7 % 12) / 13, 9), 0.2, 0.5) for i, r in enumerate(rates)] + [(2, 40.0, -0.1, 0.0, 0.5)]
    board = spark.createDataFrame(rows, "track long, rate double, base double, local double, support double")
    got = {(r["track"], r["rate"]): r["family"] for r in release_features(board, 130.0, 45.0).collect()}
    top = max(b for t, _, b, *_ in rows if t == 1)
    for t, rate, *_ in rows:
        near = [b / top * (1 - e / PARTNER_ERROR) for u, o, b, *_ in rows if u == t and o > rate for e in [min(abs(o / rate - q) / q for q in PARTNERS)] if e < PARTNER_ERROR]
        assert got[t, rate] == pytest.approx(max([0.0, *near]), abs=1e-12)
    fine = spark.createDataFrame([(1, 60.0, 0.5, 0.2, 0.5), (1, 60.01, 0.6, 0.2, 0.5)], board.schema)
    assert [r["rate"] for r in release_features(fine, 130.0, 45.0, step=0.01).collect()] == [60.01]
