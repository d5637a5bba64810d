"""Onset series: windows and their coverage, frame differences, peaks, intervals, phases and rate scans."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import positive, rounded
from pulsegrid.operators import folds

#: Windows as a share of the chosen rate with their least width, and the weights of what is measured in them.
SPREAD = {"tight": (0.008, 0.6), "wide": (0.020, 1.2), "mad": (0.06, 1.6)}
SPREAD_WEIGHTS = {"wide": 0.50, "tight": 0.35, "quality": 0.15}


def window_plan(tracks: DataFrame, seconds: float = 20.0, passes: int = 50, low: float = 20.0, high: float = 80.0, decode_margin: float = 1.0, end_margin: float = 0.5) -> DataFrame:
    """(track, segment_index, start_s, duration_s, error) for tracks (track, length_s); an unknown length gets one window at 0."""
    n = F.col("length_s")
    known = positive(n)
    size = F.when(known, F.when(n > decode_margin, F.least(F.lit(seconds), n, n - decode_margin)).otherwise(F.least(F.lit(seconds), n))).otherwise(F.lit(seconds))
    count = F.when(known, F.lit(passes)).otherwise(F.lit(1))
    bad = F.lit(seconds <= 0 or passes <= 0)
    rows = tracks.select("track", n.alias("length_s"), size.alias("duration_s"), count.alias("passes"), F.explode(F.when(bad, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), count - 1))).alias("segment_index"))
    at = F.when(F.col("passes") > 1, F.col("segment_index") / F.nullif(F.col("passes") - 1, F.lit(0))).otherwise(F.lit(0.5))
    pct = F.least(F.lit(low) + at * (high - low), F.lit(high - 1e-9))
    start = F.greatest(F.lit(0.0), F.least(F.col("length_s") * pct / 100, F.col("length_s") - F.col("duration_s") - end_margin))
    return rows.select("track", "segment_index", F.when(positive(F.col("length_s")), start).otherwise(0.0).alias("start_s"), "duration_s", F.when(bad, "invalid_window").alias("error"))


def window_coverage(plan: DataFrame) -> DataFrame:
    """(track, passes, distinct_starts, processed_s, unique_s, redundancy): how much of a track its windows read, and how often."""
    end = F.col("start_s") + F.col("duration_s")
    before = F.max(end).over(Window.partitionBy("track").orderBy("start_s", "segment_index").rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0.0), end - F.greatest(F.col("start_s"), F.coalesce(before, F.col("start_s"))))
    out = plan.withColumn("new", new).groupBy("track").agg(F.count("*").alias("passes"), F.count_distinct(F.round("start_s", 6)).alias("distinct_starts"), F.sum("duration_s").alias("processed_s"), F.sum("new").alias("unique_s"))
    return out.withColumn("redundancy", F.col("processed_s") / F.nullif(F.col("unique_s"), F.lit(0.0)))


def segment_join(peaks: DataFrame, windows: DataFrame, cell: float) -> DataFrame:
    """(track, segment_index, t) for peaks (track, t) that stand in a window [start_s, start_s + duration_s).

    An equi-join on cells of the time axis: a window stands in each cell it touches, a peak in one, so no pair is tried twice.
    """
    end = F.col("start_s") + F.col("duration_s")
    touched = F.explode(F.sequence(F.floor(F.col("start_s") / cell), F.floor(end / cell))).alias("cell")
    w = windows.select("track", "segment_index", "start_s", end.alias("end_s"), touched)
    p = peaks.select("track", "t", F.floor(F.col("t") / cell).alias("cell"))
    return p.join(w, ["track", "cell"]).where((F.col("t") >= F.col("start_s")) & (F.col("t") < F.col("end_s"))).select("track", "segment_index", "t")


def frame_flux(frames: DataFrame) -> DataFrame:
    """(track, frame, energy, flux): rises of log energy from one frame (track, frame, energy) to the next; 0 at the first."""
    x = F.log(F.col("energy") + 1.0)
    before = F.lag(x).over(Window.partitionBy("track").orderBy("frame"))
    return frames.select("track", "frame", "energy", F.coalesce(F.greatest(F.lit(0.0), x - before), F.lit(0.0)).alias("flux"))


def flux_peaks(flux: DataFrame, k_sigma: float = 0.35, share: float = 0.12) -> DataFrame:
    """(track, frame, flux): local maxima, ends excluded, not under the threshold of the track's positive flux."""
    w, o = Window.partitionBy("track"), Window.partitionBy("track").orderBy("frame")
    up = F.when(F.col("flux") > 0, F.col("flux"))
    limit = F.greatest(F.avg(up).over(w) + F.stddev_pop(up).over(w) * k_sigma, F.max(up).over(w) * share)
    rows = flux.select("track", "frame", "flux", F.round(limit, 9).alias("limit"), F.lag("flux").over(o).alias("a"), F.lead("flux").over(o).alias("b"))
    return rows.where((F.round("flux", 9) >= F.col("limit")) & (F.col("flux") >= F.col("a")) & (F.col("flux") >= F.col("b"))).select("track", "frame", "flux")


def intervals(onsets: DataFrame) -> DataFrame:
    """(track, us, gap_s) between an onset (track, us) and the one before it."""
    return onsets.withColumn("gap_s", (F.col("us") - F.lag("us").over(Window.partitionBy("track").orderBy("us"))) / 1e6).where("gap_s is not null")


def median_rate(gaps: DataFrame, unit_s: float, low: float, high: float) -> DataFrame:
    """(track, n, rate): from the median of the gaps that a rate inside the rail has."""
    kept = gaps.where(F.col("gap_s").between(unit_s / high, unit_s / low))
    return kept.groupBy("track").agg(F.count("*").alias("n"), (F.lit(unit_s) / F.percentile("gap_s", 0.5)).alias("rate"))


def longest_run(values: DataFrame, tolerance: float) -> DataFrame:
    """(track, mode, run): the mean of the longest run of sorted values (track, x) of which each is within tolerance of the one before."""
    o = Window.partitionBy("track").orderBy("x")
    new = F.when(F.col("x") - F.lag("x").over(o) <= tolerance, 0).otherwise(1)
    runs = values.withColumn("new", new).withColumn("island", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    sizes = runs.groupBy("track", "island").agg(F.count("*").alias("run"), F.avg("x").alias("mode"))
    best = F.max(F.struct("run", (-rounded(F.col("mode"), 9)).alias("m"), "mode")).alias("b")
    return sizes.groupBy("track").agg(best).select("track", "b.mode", "b.run")


def phase_sums(t: Column, period: Column) -> list[Column]:
    a = t * (2 * math.pi) / period
    return [F.count("*").alias("n"), F.sum(F.cos(a)).alias("c1"), F.sum(F.sin(a)).alias("s1"), F.sum(F.cos(a * 2)).alias("c2"), F.sum(F.sin(a * 2)).alias("s2")]


def phase_strength(rows: DataFrame, by: list[str], period: str, span: str) -> DataFrame:
    """by, n, vs, axial, density: how far events (t, period, span seconds) keep one phase, or two opposite ones, and how many come in a period.

    Sums are combined before they are shuffled, so a grid of rates costs a row for each of its points and no more.
    """
    sums = rows.groupBy(*by).agg(*phase_sums(F.col("t"), F.col(period)), F.max(F.col(span) / F.col(period)).alias("expected"))
    strength = lambda c, s: F.sqrt(F.col(c) * F.col(c) + F.col(s) * F.col(s)) / F.col("n")
    return sums.select(*by, "n", strength("c1", "s1").alias("vs"), strength("c2", "s2").alias("axial"), F.least(F.lit(4.0), F.col("n") / F.greatest(F.col("expected"), F.lit(1.0))).alias("density"))


def scan(onsets: DataFrame, rates: DataFrame, half: float, step: float, unit_s: float, floor: float = 30.0) -> DataFrame:
    """(track, centre, rate, score): all grid points within half of a centre, for onsets (track, t, span) and rates (track, centre)."""
    points = int(round(2 * half / step))
    grid = F.explode(F.transform(F.sequence(F.lit(0), F.lit(points)), lambda k: F.round(F.col("centre") - half + k * step, 6))).alias("rate")
    rows = onsets.join(rates, "track").select("track", "t", "span", "centre", grid).where(F.col("rate") >= floor).withColumn("period", F.lit(unit_s) / F.col("rate"))
    found = phase_strength(rows, ["track", "centre", "rate"], "period", "span")
    return found.select("track", "centre", "rate", F.round(F.col("vs") * 0.5 + F.col("axial") * 0.35 + F.least(F.col("density"), F.lit(1.0)) * 0.15, 9).alias("score"))


def best_of_scan(scanned: DataFrame) -> DataFrame:
    """(track, centre, rate, score): the best point of each scan, the lower rate on ties."""
    best = F.max(F.struct("score", (-F.col("rate")).alias("r"))).alias("b")
    return scanned.groupBy("track", "centre").agg(best).select("track", "centre", (-F.col("b.r")).alias("rate"), F.col("b.score").alias("score"))


def recurrence(onsets: DataFrame, rates: DataFrame, unit_s: float) -> DataFrame:
    """(track, score): the share of onsets after which, one, two or four periods on, another stands, weighted 1, 1/2 and 1/4.

    onsets: (track, t); rates: (track, rate). Within the tolerance of the target, the nearest is found by an equi-join on cells of twice that width.
    """
    rows = onsets.join(rates, "track").select("track", "t", (F.lit(unit_s) / F.col("rate")).alias("p"))
    tol = F.greatest(F.col("p") * 0.01, F.lit(0.006))
    cell = lambda x: F.floor(x / (tol * 2))
    ask = rows.select("track", "t", "p", tol.alias("tol"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("k"))
    ask = ask.withColumn("target", F.col("t") + F.col("p") * F.col("k")).withColumn("base", F.floor(F.col("target") / (F.col("tol") * 2)))
    ask = ask.withColumn("cell", F.explode(F.array(F.col("base") - 1, F.col("base"), F.col("base") + 1)))
    there = rows.select("track", F.col("t").alias("u"), cell(F.col("t")).alias("cell")).distinct()
    hit = ask.join(there, ["track", "cell"]).where(F.abs(F.col("u") - F.col("target")) <= F.col("tol")).select("track", "t", "k").distinct()
    hits = hit.groupBy("track").agg(F.sum(F.lit(1.0) / F.col("k")).alias("h"))
    return rows.groupBy("track").agg(F.count("*").alias("n")).join(hits, "track", "left").select("track", (F.coalesce("h", F.lit(0.0)) / (F.col("n") * 1.75)).alias("score"))


def theil_sen(taps: DataFrame, last: int = 30) -> DataFrame:
    """(track, taps, period_s, mad_s): the median slope over all pairs of the last taps (track, t), and the median distance from that line.

    The last taps of a track are found before the shuffle too, so no track is gathered whole; pairs are those of at most `last` rows.
    """
    newest = taps.withColumn("r", F.row_number().over(Window.partitionBy("track").orderBy(F.desc("t")))).where(F.col("r") <= last)
    rows = newest.select("track", "t", (-F.col("r")).alias("i"))
    later = rows.select("track", F.col("t").alias("u"), F.col("i").alias("j"))
    slopes = rows.join(later, "track").where("i < j").groupBy("track").agg(F.percentile((F.col("u") - F.col("t")) / (F.col("j") - F.col("i")), 0.5).alias("period_s"))
    at = rows.join(slopes, "track").withColumn("c", F.col("t") - F.col("period_s") * F.col("i"))
    line = at.groupBy("track").agg(F.percentile("c", 0.5).alias("b"))
    return at.join(line, "track").groupBy("track").agg(F.count("*").alias("taps"), F.first("period_s").alias("period_s"), F.percentile(F.abs(F.col("c") - F.col("b")), 0.5).alias("mad_s"))


def quantiles(rows: DataFrame, by: str, x: str) -> DataFrame:
    """by, n, q25, median, q75, iqr, least, most, stability."""
    out = rows.groupBy(by).agg(F.count("*").alias("n"), *[F.percentile(x, q).alias(n) for n, q in (("q25", 0.25), ("median", 0.5), ("q75", 0.75))], F.min(x).alias("least"), F.max(x).alias("most"), F.avg(x).alias("m"), F.stddev_pop(x).alias("d"))
    return out.select(by, "n", "q25", "median", "q75", (F.col("q75") - F.col("q25")).alias("iqr"), "least", "most", (F.col("m") / F.nullif(F.col("m") + F.col("d"), F.lit(0.0))).alias("stability"))


def histogram_p95(values: DataFrame, bounds: list[float]) -> DataFrame:
    """(n, p95): the upper bound of the first bin up to which 95 % of all values (x) stand; the last bin has no bound and counts as infinite.

    One count for each bin is all that is ordered.
    """
    bin_ = F.lit(len(bounds))
    for k in reversed(range(len(bounds))):
        bin_ = F.when(F.col("x") <= bounds[k], k).otherwise(bin_)
    counts = values.groupBy(bin_.alias("bin")).agg(F.count("*").alias("c"))
    tops = F.element_at(F.array(*[F.lit(b) for b in bounds], F.lit(float("inf"))), F.col("bin") + 1)
    upto = F.sum("c").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    rows = counts.groupBy("bin").agg(F.sum("c").alias("c")).withColumn("upto", upto).withColumn("n", F.sum("c").over(Window.partitionBy()))
    return rows.where(F.col("upto") >= F.ceil(F.col("n") * 0.95)).groupBy("n").agg(F.min(tops).alias("p95"))


def spaced(peaks: DataFrame, spacing: float) -> DataFrame:
    """(track, t, weight): of peaks closer than spacing to the last one accepted, the stronger stays; its place moves along."""
    rows = peaks.select("track", F.col("t").cast("double").alias("t"), F.col("weight").cast("double").alias("weight"))
    return folds.folded(rows, ["track"], ["t"], lambda: folds.Spaced(spacing), "t double, weight double")


def clusters(values: DataFrame, tolerance: float = 0.5, keep: int = 3) -> DataFrame:
    """(track, centre, n): sorted values (track, x) join the first cluster whose running mean is within tolerance; the largest stay."""
    rows = values.select("track", F.col("x").cast("double").alias("x"))
    return folds.folded(rows, ["track"], ["x"], lambda: folds.Clusters(tolerance, keep), "centre double, n long, place int").drop("place")


def unburst(onsets: DataFrame, near: int, window: int, share: float = 0.62, follow: float = 0.90) -> DataFrame:
    """(track, place, weight): onsets (track, place, weight) that reach `share` of the strongest within `near` of them and don't follow a kept
    one within `window` with less than `follow` of its weight."""
    around = Window.partitionBy("track").orderBy("place").rangeBetween(-near, near)
    top = F.max("weight").over(around)
    kept = onsets.withColumn("top", top).where(~((F.col("top") > 0) & (F.col("weight") + 1e-12 < F.col("top") * share))).select("track", "place", "weight")
    return folds.folded(kept, ["track"], ["place"], lambda: folds.Bursts(window, follow), "place long, weight double")


def spread_out(onsets: DataFrame, spacing: int, offset: int = 0) -> DataFrame:
    """(track, place): onsets at least `spacing` behind the last one taken, moved by `offset`."""
    return folds.folded(onsets.select("track", "place"), ["track"], ["place"], lambda: folds.Spread(spacing, offset), "place long")


def near_share(values: DataFrame, centres: DataFrame, *tolerances: float) -> DataFrame:
    """(track, n, near_1, ...): the share of a track's values (track, x) within each tolerance of its centre (track, centre)."""
    d = F.abs(F.col("x") - F.col("centre"))
    shares = [F.avg(F.when(d <= t, 1.0).otherwise(0.0)).alias(f"near_{i}") for i, t in enumerate(tolerances, 1)]
    return values.join(centres, "track").groupBy("track").agg(F.count("*").alias("n"), *shares)


def spread_confidence(values: DataFrame, chosen: DataFrame, trust_at: float = 50.0) -> DataFrame:
    """(track, n, confidence) of a chosen rate by how its track's values (track, x) spread around it; chosen: track, rate.

    Shares near it, in a tight and a wide window, and the mean distance count by fixed weights; few values are trusted less.
    """
    c, d = F.col("rate"), F.abs(F.col("x") - F.col("rate"))
    joined = values.join(chosen.where(positive(c)), "track")
    share = lambda width: F.avg(F.when(d <= width, 1.0).otherwise(0.0))
    rows = joined.groupBy("track", "rate").agg(F.count("*").alias("n"), share(F.greatest(c * SPREAD["tight"][0], F.lit(SPREAD["tight"][1]))).alias("tight"), share(F.greatest(c * SPREAD["wide"][0], F.lit(SPREAD["wide"][1]))).alias("wide"), F.avg(d).alias("mad"))
    quality = 1.0 - F.least(F.lit(1.0), F.col("mad") / F.greatest(c * SPREAD["mad"][0], F.lit(SPREAD["mad"][1])))
    raw = F.col("wide") * SPREAD_WEIGHTS["wide"] + F.col("tight") * SPREAD_WEIGHTS["tight"] + quality * SPREAD_WEIGHTS["quality"]
    trust = F.least(F.lit(1.0), F.col("n") / max(4.0, trust_at) * 0.25 + 0.75)
    score = F.pow(F.least(F.lit(1.0), F.greatest(F.lit(0.0), raw * trust)), F.lit(0.45)) * 100
    score = F.when((score < 5) & (F.col("wide") > 0), 5.0).otherwise(score)
    return rows.select("track", "n", F.when(F.col("n") == 1, 55.0).otherwise(F.least(F.lit(100.0), score)).alias("confidence"))


def hops(samples: DataFrame, hop: int) -> DataFrame:
    """(track, hop, energy, high): mean square and mean squared first difference, as log1p, of each whole hop of (track, sample, x).

    The difference starts anew in each hop; a last hop that isn't full is left out.
    """
    w = Window.partitionBy("track", "hop").orderBy("sample")
    rows = samples.withColumn("hop", F.floor(F.col("sample") / hop)).withColumn("d", F.col("x") - F.lag("x").over(w))
    sums = rows.groupBy("track", "hop").agg(F.count("*").alias("n"), F.avg(F.col("x") * F.col("x")).alias("e"), F.avg(F.col("d") * F.col("d")).alias("h"))
    return sums.where(F.col("n") == hop).select("track", "hop", F.log1p("e").alias("energy"), F.log1p("h").alias("high"))


def low_energy(samples: DataFrame, alpha: float) -> DataFrame:
    """(track, rms, low_rms, ratio) of arrays (track, x): the root mean square, that of a one-pole low-pass of it, and their ratio, 0 to 4."""
    x = F.col("x")
    low = F.aggregate(x, F.struct(F.lit(0.0).alias("y"), F.lit(0.0).alias("s")), lambda a, v: F.struct((a["y"] + (v - a["y"]) * alpha).alias("y"), (a["s"] + (a["y"] + (v - a["y"]) * alpha) * (a["y"] + (v - a["y"]) * alpha)).alias("s")))
    total = F.aggregate(x, F.lit(0.0), lambda a, v: a + v * v)
    rows = samples.where(F.size("x") > 0).select("track", F.sqrt(total / F.size("x")).alias("rms"), F.sqrt(low["s"] / F.size("x")).alias("low_rms"))
    return rows.withColumn("ratio", F.when(F.col("rms") > 0, F.least(F.lit(4.0), F.greatest(F.lit(0.0), F.col("low_rms") / F.nullif("rms", F.lit(0.0))))).otherwise(0.0))


def phase_offset(peaks: DataFrame, period: Column) -> DataFrame:
    """(track, period, offset): the weighted circular mean of where peaks (track, place, weight) stand in a period; 0 without weight."""
    angle = F.pmod(F.col("place").cast("double"), period) / period * (2 * math.pi)
    w = F.greatest(F.col("weight"), F.lit(0.0))
    sums = peaks.groupBy("track", period.alias("period")).agg(F.sum(w * F.sin(angle)).alias("s"), F.sum(w * F.cos(angle)).alias("c"), F.sum(w).alias("w"))
    mean = F.atan2("s", "c")
    turn = F.when(mean < 0, mean + 2 * math.pi).otherwise(mean) / (2 * math.pi)
    return sums.select("track", "period", F.when(F.col("w") > 0, turn * F.col("period")).otherwise(0.0).alias("offset"))


def separated(points: DataFrame, keep: int = 3, apart: float = 0.20) -> DataFrame:
    """(track, rate, score, place): the best points (track, rate, score) of a scan, in the scan's order of rates, that stand apart."""
    good = points.where(positive(F.col("rate"))).select("track", "rate", "score")
    return folds.folded(good, ["track"], ["rate"], lambda: folds.Separated(keep, apart), "rate double, score double, place int")


def best_three(points: DataFrame) -> DataFrame:
    """(track, rate, score, place): the three best points of each track; each task keeps three of a track before it passes them on."""
    w = Window.partitionBy("track").orderBy(F.desc("score"), "rate")
    return points.select("track", "rate", "score").withColumn("place", F.row_number().over(w)).where("place <= 3")
