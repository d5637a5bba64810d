"""Queries against their SQL on small tables where the order of a sum, a tie of rounding or a sign once made them differ."""

from datetime import datetime, timedelta

import duckdb
import pandas as pd
import pytest

from pulsegrid.plans import registry


def differences(spark, folder, name, **tables):
    """Rows that Spark and SQL don't share, over tables given as lists of dicts."""
    con = duckdb.connect()
    for table, rows in tables.items():
        pd.DataFrame(rows).to_parquet(folder / f"{table}.parquet", coerce_timestamps="us", index=False)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = registry.QUERIES[name](spark, str(folder))
    want = con.execute(registry.ORACLE[name])
    names = [c[0] for c in want.description]
    rows = lambda found: sorted(map(repr, found))
    a, b = rows(tuple(r[c] for c in names) for r in got.collect()), rows(want.fetchall())
    return [x for x in a if x not in b], [x for x in b if x not in a]


def events(*values):
    return [{"event_id": i, "user_id": 1, "event_type": "view", "ts": datetime(2024, 1, 1) + timedelta(seconds=i), "value": v, "props": '{"k": 1}'} for i, v in enumerate(values)]


CUSTOMERS = [{"c_custkey": i, "c_acctbal": x} for i, x in enumerate((-0.3, 0.3, -0.5, 2.5, -12.5, 7.0))]
ORDERS = [{"o_custkey": i, "o_totalprice": x, "o_orderstatus": "O"} for i, x in enumerate((189980.0, 181980.0, 180020.0, 1234.5, 20.0, 5.0, 9.0))]


def test_run_mode_is_rounded_once(spark, tmp_path):
    assert differences(spark, tmp_path, "run_mode", events=events(0.0, 0.0000009999998)) == ([], [])


def test_run_mode_of_equal_values_keeps_runs_whole(spark, tmp_path):
    """Each value stands 60 times; a run holds all of them, in whatever order they come."""
    values = [0.5, 1.25, 7.0, 7.75, 8.5, 9.25, 20.0]
    assert differences(spark, tmp_path, "run_mode", events=events(*values * 60)) == ([], [])
    assert registry.QUERIES["run_mode"](spark, str(tmp_path)).collect() == [(1, 8.125, 240)]


@pytest.mark.parametrize("low, high", [(12.27, 12.28), (18.5, 18.55), (37.26, 37.29)])
def test_spread_confidence_at_a_tie_of_the_median(spark, tmp_path, low, high):
    assert differences(spark, tmp_path, "spread_confidence", events=events(low, high, low - 30, high + 30)) == ([], [])


@pytest.mark.parametrize("name", ["tag_delta", "write_then_resolve"])
def test_tags_of_negative_zeros_and_of_tracks_without_one(spark, tmp_path, name):
    assert differences(spark, tmp_path, name, customer=CUSTOMERS, orders=ORDERS) == ([], [])


def test_rounded_makes_no_decimal(spark):
    import math

    from pyspark.sql import functions as F

    from pulsegrid.functions.scalars import rounded

    values = [0.5, -0.5, 0.49999999999999994, 2.5, -2.5, 1e300, -1e300, 2.0**52 + 1, float("inf"), 0.0, -0.0, -0.2, None, float("nan")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(rounded(F.col("x"), 0)).collect()]
    assert got[:-1] == [1.0, -1.0, 0.0, 3.0, -3.0, 1e300, -1e300, 2.0**52 + 1, float("inf"), 0.0, 0.0, 0.0, None] and math.isnan(got[-1])
    assert math.copysign(1.0, got[11]) == 1.0
