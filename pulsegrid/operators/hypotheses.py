"""Bars that may fill a window: complete ones, ones with beats left over, and what meter they have."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import meter, meter_likelihood

#: Tatums in a beat, as numerator and denominator.
TATUMS = [(1, 1), (2, 1), (3, 1), (4, 1), (6, 1), (1, 2), (1, 3), (1, 4), (1, 6)]
#: Seconds of a bar, beats of a bar, beats a minute, tatums a minute (both ends excluded).
BAR_S, BEATS, BPM, TATUM_RATE = (1.0, 4.0), (2, 4), (50.0, 200.0), (100.0, 700.0)


def bars(windows: DataFrame) -> DataFrame:
    """(duration_s, bars, beats_per_bar, tatum_num, tatum_den, num_tatums, bpm): whole bars that fill the distinct durations of windows."""
    d = F.col("duration_s")
    rows = windows.select(d.cast("double").alias("duration_s")).distinct().where("duration_s > 0")
    least, most = F.greatest(F.round(d / BAR_S[1]).cast("int"), F.lit(1)), F.round(d / BAR_S[0]).cast("int")
    rows = rows.where(most >= least).select("duration_s", F.explode(F.sequence(least, most)).alias("bars"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(BEATS[0]), F.lit(BEATS[1]))).alias("beats_per_bar"))
    rows = rows.select("*", F.inline(F.array(*[F.struct(F.lit(a).alias("tatum_num"), F.lit(b).alias("tatum_den")) for a, b in TATUMS])))
    beats = F.col("bars") * F.col("beats_per_bar")
    rows = rows.withColumn("bpm", beats * 60.0 / d).where(((beats * F.col("tatum_num")) % F.col("tatum_den") == 0) & F.col("bpm").between(*BPM))
    rows = rows.withColumn("num_tatums", (beats * F.col("tatum_num") / F.col("tatum_den")).cast("int"))
    rate = F.col("num_tatums") * 60.0 / d
    return rows.where((rate > TATUM_RATE[0]) & (rate < TATUM_RATE[1])).select("duration_s", "bars", "beats_per_bar", "tatum_num", "tatum_den", "num_tatums", "bpm")


def partial_bars(windows: DataFrame) -> DataFrame:
    """(duration_s, total_beats, beats_per_bar, whole_bars, trailing_beats, bpm): beats of which some stand behind the last whole bar."""
    d = F.col("duration_s")
    rows = windows.select(d.cast("double").alias("duration_s")).distinct().where("duration_s > 0")
    least, most = F.greatest(F.ceil(d * BPM[0] / 60).cast("int"), F.lit(1)), F.floor(d * BPM[1] / 60).cast("int")
    rows = rows.where(most >= least).select("duration_s", F.explode(F.sequence(least, most)).alias("total_beats"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(BEATS[0]), F.lit(BEATS[1]))).alias("beats_per_bar"))
    rows = rows.withColumn("bpm", F.col("total_beats") * 60.0 / d).withColumn("trailing_beats", F.col("total_beats") % F.col("beats_per_bar"))
    bar = F.col("beats_per_bar") * 60.0 / F.col("bpm")
    return rows.where((F.col("trailing_beats") > 0) & bar.between(*BAR_S)).select("duration_s", "total_beats", "beats_per_bar", F.floor(F.col("total_beats") / F.col("beats_per_bar")).cast("int").alias("whole_bars"), "trailing_beats", "bpm")


def scored(hypotheses: DataFrame) -> DataFrame:
    """Adds meter and likelihood."""
    name = meter(F.col("beats_per_bar"), F.when(F.col("tatum_den") == 1, F.col("tatum_num")).otherwise(0))
    return hypotheses.withColumn("meter", name).withColumn("likelihood", meter_likelihood(F.col("meter"), F.col("bpm")))


def preferred(rows: DataFrame) -> DataFrame:
    """One hypothesis for each duration: of 4/4 where there is any, the most likely; ties by tatums, then bars."""
    order = [F.desc(F.col("meter") == "4/4"), F.desc(F.round("likelihood", 9)), "num_tatums", "bars", "tatum_num", "tatum_den"]
    return rows.withColumn("r", F.row_number().over(Window.partitionBy("duration_s").orderBy(*order))).where("r = 1").drop("r")


def top_with_winner(rows: DataFrame, k: int) -> DataFrame:
    """(duration_s, bpm, likelihood, winner, rank): the k best distinct rates of each duration; the winner is among them, last if it isn't else."""
    win = preferred(rows).select("duration_s", F.col("bpm").alias("w"))
    one = rows.groupBy("duration_s", F.round("bpm", 3).alias("bpm")).agg(F.max(F.round("likelihood", 9)).alias("likelihood")).join(win, "duration_s")
    one = one.withColumn("winner", F.abs(F.col("bpm") - F.col("w")) <= 0.001)
    order = Window.partitionBy("duration_s").orderBy(F.desc("likelihood"), F.desc("winner"), "bpm")
    r = one.withColumn("r", F.row_number().over(order))
    at = F.max(F.when(F.col("winner"), F.col("r"))).over(Window.partitionBy("duration_s"))
    kept = r.withColumn("at", at).where((F.col("r") < k) | ((F.col("r") == k) & (F.col("at") <= k)) | F.col("winner"))
    return kept.select("duration_s", "bpm", "likelihood", "winner", F.least("r", F.lit(k)).alias("rank"))
