"""Queries over onset series."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import rounded
from pulsegrid.operators import grids, series
from pulsegrid.sources import inputs
from pulsegrid.sources.inputs import ONSETS, SPANS, UNIT_S

SCALE = 15_000_000_000.0
#: Seconds in a section.
SECTION_S = UNIT_S / 6
BOUNDS = [60.0, 600.0, 1800.0, 3600.0, 7200.0, 14_400.0, 28_800.0, 43_200.0, 86_400.0, 172_800.0, 345_600.0]


def _round(df, p=6):  # noqa: ANN001, ANN202
    return df.withColumns({c: F.round(c, p) for c, t in df.dtypes if t == "double"})


def _plan(spark, d):  # noqa: ANN001, ANN202
    return series.window_plan(inputs.spans(spark, d))


def _timed(spark, d):  # noqa: ANN001, ANN202
    """Onsets in seconds with the time that their track's cover."""
    on = inputs.onsets(spark, d).select("track", "us", (F.col("us") / 1e6).alias("t"))
    span = on.groupBy("track").agg(((F.max("us") - F.min("us")) / 1e6).alias("span"))
    return on.join(span, "track").select("track", "t", "span")


def _rates(spark, d):  # noqa: ANN001, ANN202
    on = inputs.onsets(spark, d)
    return series.median_rate(series.intervals(on), UNIT_S, 20.0, 2000.0).select("track", F.round("rate", 2).alias("rate"))


def window_plan(spark, d):  # noqa: ANN001, ANN201
    return _round(_plan(spark, d).drop("error"))


def window_coverage(spark, d):  # noqa: ANN001, ANN201
    return _round(series.window_coverage(_plan(spark, d)), 5)


def onset_segment_join(spark, d):  # noqa: ANN001, ANN201
    peaks = inputs.onsets(spark, d)
    peaks = peaks.join(peaks.groupBy("track").agg(F.min("us").alias("u0")), "track").select("track", ((F.col("us") - F.col("u0")) / SCALE).alias("t"))
    hit = series.segment_join(peaks, _plan(spark, d), 20.0)
    return _round(hit.groupBy("track", "segment_index").agg(F.count("*").alias("peaks"), F.sum("t").alias("sum_t")).where("peaks >= 4"), 5)


def _frames(spark, d):  # noqa: ANN001, ANN202
    return inputs.onsets(spark, d).select("track", F.floor(F.col("us") / 86_400_000_000).alias("frame"), "value").groupBy("track", "frame").agg(F.avg(F.col("value") * F.col("value")).alias("energy"))


def energy_flux(spark, d):  # noqa: ANN001, ANN201
    return _round(series.frame_flux(_frames(spark, d)))


def flux_peaks(spark, d):  # noqa: ANN001, ANN201
    return _round(series.flux_peaks(series.frame_flux(_frames(spark, d))))


def ioi_median_rate(spark, d):  # noqa: ANN001, ANN201
    return _round(series.median_rate(series.intervals(inputs.onsets(spark, d)), UNIT_S, 20.0, 2000.0))


def run_mode(spark, d):  # noqa: ANN001, ANN201
    found = series.longest_run(inputs.onsets(spark, d).select("track", F.col("value").alias("x")), 1.0)
    return found.withColumn("mode", rounded(F.col("mode"), 6))


def onset_union(spark, d):  # noqa: ANN001, ANN201
    on = inputs.onsets(spark, d)
    both = on.where("value > 20").select("track", "us").union(on.where("kind in ('click', 'purchase')").select("track", "us")).distinct()
    return both.groupBy("track").agg(F.count("*").alias("n"), F.min("us").alias("first_us"), F.max("us").alias("last_us"))


def phase_vector_strength(spark, d):  # noqa: ANN001, ANN201
    rows = _timed(spark, d).join(_rates(spark, d), "track").withColumn("period", F.lit(UNIT_S) / F.col("rate"))
    return _round(series.phase_strength(rows, ["track"], "period", "span"), 5)


def rate_scan(spark, d):  # noqa: ANN001, ANN201
    found = series.scan(_timed(spark, d), _rates(spark, d).withColumnRenamed("rate", "centre"), 6.0, 0.25, UNIT_S)
    return _round(found, 5).groupBy("track", "centre").agg(F.count("*").alias("points"), F.max("score").alias("best_score"), F.min("score").alias("least_score"))


def _sections(spark, d):  # noqa: ANN001, ANN202
    """Onsets of a track's five-day sections, with the seconds that each section's cover."""
    rows = _timed(spark, d).select("track", F.floor(F.col("t") / SECTION_S).alias("section"), "t")
    part = Window.partitionBy("track", "section")
    return rows.withColumn("span", F.max("t").over(part) - F.min("t").over(part))


def _centres(spark, d):  # noqa: ANN001, ANN202
    return _rates(spark, d).select("track", F.col("rate").alias("centre"))


def local_exact(spark, d):  # noqa: ANN001, ANN201
    found = grids.scanned(_timed(spark, d).withColumn("section", F.lit(0)), _centres(spark, d), grids.Grid(0.75, 0.01, UNIT_S))
    return found.select("track", "centre", "rate", F.round("score", 5).alias("score"))


def segment_consensus(spark, d):  # noqa: ANN001, ANN201
    grid = grids.Grid(6.0, 0.25, UNIT_S)
    whole = grids.scanned(_timed(spark, d).withColumn("section", F.lit(0)), _centres(spark, d), grid)
    return _round(grids.consensus(grids.scanned(_sections(spark, d), _centres(spark, d), grid, 4), whole, 0.5), 5)


def coarse_to_fine(spark, d):  # noqa: ANN001, ANN201
    found = grids.coarse_to_fine(_timed(spark, d).withColumn("section", F.lit(0)), _centres(spark, d), grids.Grid(6.0, 0.25, UNIT_S), grids.Grid(0.5, 0.01, UNIT_S))
    return found.select("track", "rate", F.round("score", 5).alias("score"), "coarse_rate", F.round("coarse_score", 5).alias("coarse_score"), "border")


def interval_recurrence(spark, d):  # noqa: ANN001, ANN201
    return _round(series.recurrence(_timed(spark, d), _rates(spark, d), UNIT_S))


def theil_sen_interval(spark, d):  # noqa: ANN001, ANN201
    return _round(series.theil_sen(_timed(spark, d).select("track", "t")), 4)


def segment_quantiles(spark, d):  # noqa: ANN001, ANN201
    return _round(series.quantiles(inputs.onsets(spark, d), "track", "value"), 5)


def histogram_p95(spark, d):  # noqa: ANN001, ANN201
    return series.histogram_p95(series.intervals(inputs.onsets(spark, d)).select(F.col("gap_s").alias("x")), BOUNDS)


def peak_spacing(spark, d):  # noqa: ANN001, ANN201
    return series.spaced(inputs.onsets(spark, d).select("track", (F.col("us") / 1e6).alias("t"), F.col("value").alias("weight")), 43_200.0)


def cluster_fold(spark, d):  # noqa: ANN001, ANN201
    return _round(series.clusters(inputs.onsets(spark, d).select("track", F.col("value").alias("x"))))


def tap_sessions(spark, d):  # noqa: ANN001, ANN201
    gaps = inputs.onsets(spark, d).select("track", "us")
    from pyspark.sql import Window

    o = Window.partitionBy("track").orderBy("us")
    new = F.when(F.col("us") - F.lag("us").over(o) < 18_000_000_000, 0).otherwise(1)
    marked = gaps.withColumn("new", new).withColumn("session", F.sum("new").over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("track", "session").agg(F.min("us").alias("start_us"), F.count("*").alias("taps")).drop("session")


PLAN = f"""sp AS ({SPANS}), z AS (SELECT track, length_s, CASE WHEN length_s > 0 THEN CASE WHEN length_s > 1 THEN least(20.0::DOUBLE, length_s, length_s - 1) ELSE least(20.0::DOUBLE, length_s) END ELSE 20.0::DOUBLE END AS duration_s,
  CASE WHEN length_s > 0 THEN 50 ELSE 1 END AS passes FROM sp),
pl AS (SELECT track, i::INT AS segment_index, CASE WHEN length_s > 0 THEN greatest(0, least(length_s * least(20 + (CASE WHEN passes > 1 THEN i / (passes - 1)::DOUBLE ELSE 0.5::DOUBLE END) * 60, 80 - 1e-9::DOUBLE) / 100, length_s - duration_s - 0.5::DOUBLE)) ELSE 0 END AS start_s, duration_s
  FROM z, LATERAL (SELECT unnest(range(0, passes)) AS i))"""
_GAPS = f"SELECT * FROM (SELECT track, us, (us - lag(us) OVER (PARTITION BY track ORDER BY us)) / 1e6::DOUBLE AS gap_s FROM ({ONSETS})) WHERE gap_s IS NOT NULL"
_RATE = f"rt AS (SELECT track, count(*) AS n, {UNIT_S}::DOUBLE / quantile_cont(gap_s, 0.5) AS rate FROM ({_GAPS}) WHERE gap_s BETWEEN {UNIT_S}::DOUBLE / 2000 AND {UNIT_S}::DOUBLE / 20 GROUP BY track)"
_TIMED = f"tm AS (SELECT track, us / 1e6::DOUBLE AS t, (max(us) OVER (PARTITION BY track) - min(us) OVER (PARTITION BY track)) / 1e6::DOUBLE AS span FROM ({ONSETS}))"
_FRAMES = f"fr AS (SELECT track, floor(us / 86400000000)::BIGINT AS frame, avg(value * value) AS energy FROM ({ONSETS}) GROUP BY 1, 2), fx AS (SELECT track, frame, energy, coalesce(greatest(0, ln(energy + 1) - lag(ln(energy + 1)) OVER (PARTITION BY track ORDER BY frame)), 0) AS flux FROM fr)"


def _scan_of(out: str, rows: str, centres: str, by: str, half: float, step: float) -> str:
    """The scores of all grid points: rows (by, t, span) around the centres (by or track, centre)."""
    a = f"(t * (2 * pi()) / ({UNIT_S}::DOUBLE / rate))"
    return f"""{out}_g AS (SELECT r.*, centre, round(centre - {half} + k * {step}::DOUBLE, 6) AS rate FROM {rows} AS r JOIN {centres} AS c ON r.track = c.track, (SELECT unnest(range(0, {round(2 * half / step) + 1})) AS k)),
{out}_p AS (SELECT {by}, centre, rate, count(*) AS n, sum(cos({a})) AS c1, sum(sin({a})) AS s1, sum(cos(2 * {a})) AS c2, sum(sin(2 * {a})) AS s2, max(span / ({UNIT_S}::DOUBLE / rate)) AS expected FROM {out}_g WHERE rate >= 30 GROUP BY ALL),
{out} AS (SELECT {by}, centre, rate, n, round(0.5::DOUBLE * sqrt(c1 * c1 + s1 * s1) / n + 0.35::DOUBLE * sqrt(c2 * c2 + s2 * s2) / n + 0.15::DOUBLE * least(1, least(4, n / greatest(expected, 1))), 9) AS score FROM {out}_p)"""


def _scan(half: float, step: float) -> str:
    return f"ce AS (SELECT track, round(rate, 2) AS centre FROM rt), {_scan_of('sc', 'tm', 'ce', 'track', half, step)}"


_BEST = lambda rows, by: f"(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, rate) AS place FROM {rows}) WHERE place = 1)"


_CASES = " ".join(f"WHEN gap_s <= {b} THEN {k}" for k, b in enumerate(BOUNDS))
def fold_sql(rows: str, order: str, first: str, step: str) -> str:
    """A fold as a recursive query over a track's numbered rows; first: the state at the first row, step: the state after another."""
    return f"""src AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY {order}) AS n FROM ({rows})), go AS (SELECT track, 1::BIGINT AS n, {first} FROM src WHERE n = 1 UNION ALL
SELECT go.track, src.n, {step} FROM go JOIN src ON go.track = src.track AND src.n = go.n + 1)"""


_SPACED = fold_sql(f"SELECT track, us / 1e6::DOUBLE AS x, value AS w FROM ({ONSETS})", "x, w", "x AS t, w AS weight, 1 AS g", "CASE WHEN x - t >= 43200 OR w > weight THEN x ELSE t END, CASE WHEN x - t >= 43200 OR w > weight THEN w ELSE weight END, g + (x - t >= 43200)::INT")
_CLUSTERS = fold_sql(f"SELECT track, value AS x FROM ({ONSETS})", "x", "x AS c, 1::BIGINT AS k, 1 AS g", "CASE WHEN abs(x - c) <= 0.5 THEN (c * k + x) / (k + 1) ELSE x END, CASE WHEN abs(x - c) <= 0.5 THEN k + 1 ELSE 1 END, g + (abs(x - c) > 0.5)::INT")
_SECTIONS = f"sec AS (SELECT track, section, t, max(t) OVER (PARTITION BY track, section) - min(t) OVER (PARTITION BY track, section) AS span FROM (SELECT track, floor(t / {SECTION_S})::BIGINT AS section, t FROM tm))"
_AGREED = f"""{_RATE}, {_TIMED}, {_scan(6.0, 0.25)}, {_SECTIONS}, {_scan_of('ss', 'sec', 'ce', 'track, section', 6.0, 0.25)}, win AS (SELECT track, section, rate AS x FROM {_BEST('ss', 'track, section')} WHERE n >= 4), whole AS (SELECT track, rate AS c FROM {_BEST('sc', 'track')})"""
_GROUPS = fold_sql("SELECT track, x FROM win", "x", "x AS c, 1::BIGINT AS k, 1 AS g", "CASE WHEN abs(x - c) <= 0.5 THEN (c * k + x) / (k + 1) ELSE x END, CASE WHEN abs(x - c) <= 0.5 THEN k + 1 ELSE 1 END, g + (abs(x - c) > 0.5)::INT")
QUERIES = {
    f.__name__: f
    for f in (
        window_plan, window_coverage, onset_segment_join, energy_flux, flux_peaks, ioi_median_rate, run_mode, onset_union, phase_vector_strength, rate_scan, local_exact, segment_consensus, coarse_to_fine, interval_recurrence,
        theil_sen_interval, segment_quantiles, histogram_p95, peak_spacing, cluster_fold, tap_sessions,
    )
}
ORACLE = {
    "peak_spacing": f"WITH RECURSIVE {_SPACED} SELECT track, t, weight FROM (SELECT *, row_number() OVER (PARTITION BY track, g ORDER BY n DESC) AS last FROM go) WHERE last = 1",
    "cluster_fold": f"WITH RECURSIVE {_CLUSTERS} SELECT track, round(c, 6) AS centre, k AS n FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY k DESC, c) AS place FROM (SELECT *, row_number() OVER (PARTITION BY track, g ORDER BY n DESC) AS last FROM go) WHERE last = 1) WHERE place <= 3",
    "window_plan": f"WITH {PLAN} SELECT track, segment_index, round(start_s, 6) AS start_s, round(duration_s, 6) AS duration_s FROM pl",
    "window_coverage": f"""WITH {PLAN}, b AS (SELECT *, max(start_s + duration_s) OVER (PARTITION BY track ORDER BY start_s, segment_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM pl),
      s AS (SELECT track, count(*) AS passes, count(DISTINCT round(start_s, 6)) AS distinct_starts, sum(duration_s) AS processed_s, sum(greatest(0, start_s + duration_s - greatest(start_s, coalesce(before, start_s)))) AS unique_s FROM b GROUP BY track)
      SELECT track, passes, distinct_starts, round(processed_s, 5) AS processed_s, round(unique_s, 5) AS unique_s, round(processed_s / nullif(unique_s, 0), 5) AS redundancy FROM s""",
    "onset_segment_join": f"""WITH {PLAN}, p AS (SELECT track, (us - min(us) OVER (PARTITION BY track)) / {SCALE}::DOUBLE AS t FROM ({ONSETS}))
      SELECT track, segment_index, count(*) AS peaks, round(sum(t), 5) AS sum_t FROM p JOIN pl USING (track) WHERE t >= start_s AND t < start_s + duration_s GROUP BY ALL HAVING count(*) >= 4""",
    "energy_flux": f"WITH {_FRAMES} SELECT track, frame, round(energy, 6) AS energy, round(flux, 6) AS flux FROM fx",
    "flux_peaks": f"""WITH {_FRAMES}, l AS (SELECT track, frame, flux, round(greatest(avg(CASE WHEN flux > 0 THEN flux END) OVER w + 0.35::DOUBLE * stddev_pop(CASE WHEN flux > 0 THEN flux END) OVER w, 0.12::DOUBLE * max(CASE WHEN flux > 0 THEN flux END) OVER w), 9) AS lim,
      lag(flux) OVER o AS a, lead(flux) OVER o AS b FROM fx WINDOW w AS (PARTITION BY track), o AS (PARTITION BY track ORDER BY frame)) SELECT track, frame, round(flux, 6) AS flux FROM l WHERE round(flux, 9) >= lim AND flux >= a AND flux >= b""",
    "ioi_median_rate": f"WITH {_RATE} SELECT track, n, round(rate, 6) AS rate FROM rt",
    "run_mode": f"""WITH i AS (SELECT track, value AS x, sum(new) OVER (PARTITION BY track ORDER BY value ROWS UNBOUNDED PRECEDING) AS island FROM (SELECT *, CASE WHEN value - lag(value) OVER (PARTITION BY track ORDER BY value) <= 1.0 THEN 0 ELSE 1 END AS new FROM ({ONSETS}))),
      s AS (SELECT track, island, count(*) AS run, avg(x) AS mode FROM i GROUP BY 1, 2) SELECT track, round(mode, 6) AS mode, run FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY run DESC, round(mode, 9)) AS n FROM s) WHERE n = 1""",
    "onset_union": f"SELECT track, count(*) AS n, min(us) AS first_us, max(us) AS last_us FROM (SELECT DISTINCT track, us FROM ({ONSETS}) WHERE value > 20 OR kind IN ('click', 'purchase')) GROUP BY track",
    "phase_vector_strength": f"""WITH {_RATE}, {_TIMED}, q AS (SELECT track, count(*) AS n, sum(cos(t * (2 * pi()) / p)) AS c1, sum(sin(t * (2 * pi()) / p)) AS s1, sum(cos(2 * (t * (2 * pi()) / p))) AS c2, sum(sin(2 * (t * (2 * pi()) / p))) AS s2, max(span / p) AS e
      FROM tm JOIN (SELECT track, {UNIT_S}::DOUBLE / round(rate, 2) AS p FROM rt) USING (track) GROUP BY track)
      SELECT track, n, round(sqrt(c1 * c1 + s1 * s1) / n, 5) AS vs, round(sqrt(c2 * c2 + s2 * s2) / n, 5) AS axial, round(least(4, n / greatest(e, 1)), 5) AS density FROM q""",
    "rate_scan": f"WITH {_RATE}, {_TIMED}, {_scan(6.0, 0.25)} SELECT track, centre, count(*) AS points, max(round(score, 5)) AS best_score, min(round(score, 5)) AS least_score FROM sc GROUP BY 1, 2",
    "local_exact": f"WITH {_RATE}, {_TIMED}, {_scan(0.75, 0.01)} SELECT track, centre, rate, round(score, 5) AS score FROM {_BEST('sc', 'track, centre')}",
    "segment_consensus": f"""WITH RECURSIVE {_AGREED}, {_GROUPS}, cl AS (SELECT track, c AS cluster, k FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY k DESC, c) AS place FROM (SELECT *, row_number() OVER (PARTITION BY track, g ORDER BY n DESC) AS last FROM go) WHERE last = 1) WHERE place = 1),
      q AS (SELECT track, count(*) AS sections, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.75) AS q75, min(x) AS least, max(x) AS most FROM win GROUP BY track), ns AS (SELECT track, avg(CASE WHEN abs(x - whole.c) <= 0.5 THEN 1::DOUBLE ELSE 0 END) AS near_best FROM win JOIN whole USING (track) GROUP BY track)
      SELECT track, sections, round(median, 5) AS median, round(q25, 5) AS q25, round(q75, 5) AS q75, round(q75 - q25, 5) AS iqr, round(least, 5) AS least, round(most, 5) AS most, round(near_best, 5) AS near_best, round(cluster, 5) AS cluster, round(k / sections, 5) AS cluster_share FROM q JOIN ns USING (track) JOIN cl USING (track)""",
    "coarse_to_fine": f"""WITH {_RATE}, {_TIMED}, {_scan(6.0, 0.25)}, co AS (SELECT track, rate AS centre, score AS coarse_score FROM {_BEST('sc', 'track')}), {_scan_of('fi', 'tm', 'co', 'track', 0.5, 0.01)}
      SELECT f.track, f.rate, round(f.score, 5) AS score, co.centre AS coarse_rate, round(coarse_score, 5) AS coarse_score, abs(abs(f.rate - co.centre) - 0.5) < 1e-7 AS border FROM {_BEST('fi', 'track')} AS f JOIN co USING (track)""",
    "interval_recurrence": f"""WITH {_RATE}, {_TIMED}, r AS (SELECT tm.track, t, {UNIT_S}::DOUBLE / round(rate, 2) AS p FROM tm JOIN rt USING (track)), k AS (SELECT unnest([1, 2, 4]) AS k),
      h AS (SELECT track, sum(1.0::DOUBLE / k) AS h FROM r a, k WHERE EXISTS (SELECT 1 FROM r b WHERE b.track = a.track AND abs(b.t - (a.t + a.p * k)) <= greatest(a.p * 0.01::DOUBLE, 0.006::DOUBLE)) GROUP BY track)
      SELECT track, round(coalesce(h, 0) / (n * 1.75::DOUBLE), 6) AS score FROM (SELECT track, count(*) AS n FROM r GROUP BY track) LEFT JOIN h USING (track)""",
    "theil_sen_interval": f"""WITH r AS (SELECT track, us / 1e6::DOUBLE AS t, -n AS i FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY us DESC) AS n FROM ({ONSETS})) WHERE n <= 30),
      s AS (SELECT a.track, quantile_cont((b.t - a.t) / (b.i - a.i), 0.5) AS p FROM r a JOIN r b ON a.track = b.track AND a.i < b.i GROUP BY a.track),
      c AS (SELECT track, p, t - p * i AS c FROM r JOIN s USING (track)), b AS (SELECT track, quantile_cont(c, 0.5) AS b FROM c GROUP BY track)
      SELECT track, count(*) AS taps, round(any_value(p), 4) AS period_s, round(quantile_cont(abs(c - b), 0.5), 4) AS mad_s FROM c JOIN b USING (track) GROUP BY track""",
    "segment_quantiles": f"""SELECT track, count(*) AS n, round(quantile_cont(value, 0.25), 5) AS q25, round(quantile_cont(value, 0.5), 5) AS median, round(quantile_cont(value, 0.75), 5) AS q75, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 5) AS iqr,
      min(value) AS least, max(value) AS most, round(avg(value) / nullif(avg(value) + stddev_pop(value), 0), 5) AS stability FROM ({ONSETS}) GROUP BY track""",
    "histogram_p95": f"""WITH b AS (SELECT CASE {_CASES} ELSE {len(BOUNDS)} END AS bin, count(*) AS c FROM ({_GAPS}) GROUP BY 1), u AS (SELECT bin, sum(c) OVER (ORDER BY bin) AS upto, sum(c) OVER () AS n FROM b)
      SELECT n::BIGINT AS n, min(([{', '.join(f"'{b}'" for b in BOUNDS)}, 'inf'])[bin + 1]::DOUBLE) AS p95 FROM u WHERE upto >= ceil(n * 0.95::DOUBLE) GROUP BY n""",
    "tap_sessions": f"""WITH m AS (SELECT track, us, sum(new) OVER (PARTITION BY track ORDER BY us ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY track ORDER BY us) < 18000000000 THEN 0 ELSE 1 END AS new FROM ({ONSETS})))
      SELECT track, min(us) AS start_us, count(*) AS taps FROM m GROUP BY track, s""",
}
