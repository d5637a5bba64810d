import math

import pytest
from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.operators import dsp, routing


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("args", "want"),
    [((0, 0, 0, 0.0, 0), 1000), ((12, 12, 5, 1.0, 650), 1000), ((12, 0, 0, 0.6, 0), 0), ((1, 0, 1, 1.0, 0), 850), ((10, 4, 2, 0.9, 0), 570), ((10, 6, 2, 0.7, 700), 700), ((10, 0, 500, 1.0, 0), 850),
     ((10, 9, 1, 1.0, 0), 985), ((10, 1, 2, math.nan, 0), 100), ((10, 1, 2, math.inf, 0), 100), ((10, 3, 2, -100.0, 0), 300), ((10, 0, 1, 0.0, 999), 985)],
)
def test_progress(spark, args, want):
    assert one(spark, scalars.progress_permille(*map(F.lit, args))) == want


@pytest.mark.parametrize(
    ("args", "want"),
    [((0, 0, 0, False), "onset evidence"), ((1, 1, 0, True), "onset evidence"), ((30, 0, 0, False), "no scored segments"), ((400, 15, 0, False), "empty board"), ((400, 15, 3, True), "withheld by policy"),
     ((0, 0, 3, True), "withheld by policy"), ((400, 15, 3, False), "no admissible candidate")],
)
def test_hold_message(spark, args, want):
    assert one(spark, scalars.hold_message(*map(F.lit, args))) == want


@pytest.mark.parametrize(
    ("count", "weights", "rejected"),
    [(4, [1.0, 1, 1, 1], False), (5, [1.0] * 5, False), (4, [1.0, 1, 1, 1.001], False), (4, [1.0, 1, 0, 0], False), (4, [1.0, 0, 0, 0], True), (4, [20.0, 0.01, 0.01, 0.01], True), (4, [0.0] * 4, True),
     (4, [-1.0, -2, -1, -2], True), (3, [1.0, math.nan, 1], True), (3, [1.0, math.inf, 1], True), (0, [1.0] * 3, True), (2, [1.0] * 3, True), (0, [], True)],
)
def test_onset_gate(spark, count, weights, rejected):
    df = spark.createDataFrame([(count, [float(w) for w in weights])], "n int, w array<double>")
    assert df.select(dsp.onset_gate(F.col("n"), F.col("w"))).first()[0] is rejected


@pytest.mark.parametrize(("text", "want"), [("120 ", 120.0), (".5", 0.5), ("1e3", 1000.0), ("-3", -3.0), ("120d", None), ("nan", None), ("0x10", None), ("12 3", None), ("", None), ("120,5", None)])
def test_number(spark, text, want):
    assert one(spark, scalars.number(F.lit(text))) == want


def test_small_functions(spark):
    assert one(spark, scalars.decimal_comma(F.lit("120,50"))) == 120.5
    assert one(spark, scalars.safe_ratio(F.lit(1.0), F.lit(0.0))) == math.inf
    assert one(spark, scalars.safe_ratio(F.lit(0.0), F.lit(0.0))) == 1.0
    assert one(spark, scalars.clock(F.lit(3661.9))) == "1:01:01"
    assert one(spark, scalars.clock(F.lit(1e9))) == "99:59:59"
    assert one(spark, scalars.ratio_class(F.lit(60.0), F.lit(120.0))) == "exact 1/2"
    assert one(spark, scalars.ratio_class(F.lit(62.0), F.lit(120.0))) == "near 1/2"
    assert one(spark, scalars.ratio_class(F.lit(107.0), F.lit(120.0))) == "other"
    assert one(spark, dsp.fft_size(F.lit(44_100.0))) == 2048
    assert one(spark, scalars.positive(F.lit(math.nan))) is False


@pytest.mark.parametrize(
    ("line", "want"),
    [("a = center 120, spread 10", (110.0, 130.0)), ("a = 128", (113.0, 143.0)), ("a = 90,140,x", (90.0, 140.0)), ("a = center: 150", (135.0, 165.0)), ("a = center 12, spread 20", None), ("a = 10, 5", None), ("a", None),
     ("a = center 100, spread 0", None), ("a = center 100, spread 10, 3", None), ("= 120", None)],
)
def test_rule_values(spark, line, want):
    row = routing.parse(routing.lines(spark, [line])).first()
    assert ((row["low"], row["high"]) if row["valid"] else None) == want
