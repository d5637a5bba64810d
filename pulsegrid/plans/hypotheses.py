"""Queries over bar hypotheses; part sizes are the lengths of windows, in seconds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions.scalars import METERS
from pulsegrid.operators import hypotheses
from pulsegrid.operators.hypotheses import TATUMS
from pulsegrid.sources import inputs


def _windows(spark, d):  # noqa: ANN001, ANN202
    return inputs.table(spark, d, "part").select(F.col("p_size").cast("double").alias("duration_s"))


def bar_hypotheses(spark, d):  # noqa: ANN001, ANN201
    return hypotheses.bars(_windows(spark, d)).withColumn("bpm", F.round("bpm", 6))


def partial_bar_hypotheses(spark, d):  # noqa: ANN001, ANN201
    return hypotheses.partial_bars(_windows(spark, d)).withColumn("bpm", F.round("bpm", 6))


def meter_likelihood(spark, d):  # noqa: ANN001, ANN201
    out = hypotheses.scored(hypotheses.bars(_windows(spark, d)))
    return out.groupBy("duration_s", "meter").agg(F.count("*").alias("n"), F.round(F.max("likelihood"), 6).alias("best"))


def preferred_meter(spark, d):  # noqa: ANN001, ANN201
    out = hypotheses.preferred(hypotheses.scored(hypotheses.bars(_windows(spark, d))))
    return out.select("duration_s", "meter", "num_tatums", "bars", F.round("bpm", 6).alias("bpm"), F.round("likelihood", 6).alias("likelihood"))


def topk_with_winner(spark, d):  # noqa: ANN001, ANN201
    out = hypotheses.top_with_winner(hypotheses.scored(hypotheses.bars(_windows(spark, d))), 5)
    return out.withColumn("likelihood", F.round("likelihood", 6))


_T = ", ".join(f"({a}, {b})" for a, b in TATUMS)
_D = "d AS (SELECT DISTINCT p_size::DOUBLE AS duration_s FROM part WHERE p_size > 0)"
_BARS = f"""{_D}, h0 AS (SELECT duration_s, bars::INT AS bars, bpb::INT AS beats_per_bar, tn::INT AS tatum_num, td::INT AS tatum_den, bars * bpb * 60.0::DOUBLE / duration_s AS bpm, bars * bpb * tn AS up FROM d,
  LATERAL (SELECT unnest(range(greatest(round(duration_s / 4)::INT, 1), round(duration_s)::INT + 1)) AS bars), (SELECT unnest([2, 3, 4]) AS bpb), (VALUES {_T}) t(tn, td)),
h AS (SELECT duration_s, bars, beats_per_bar, tatum_num, tatum_den, (up // tatum_den)::INT AS num_tatums, bpm FROM h0 WHERE up % tatum_den = 0 AND bpm BETWEEN 50 AND 200 AND (up // tatum_den) * 60.0::DOUBLE / duration_s > 100 AND (up // tatum_den) * 60.0::DOUBLE / duration_s < 700)"""
_LIK = " ".join(f"WHEN '{m}' THEN {p}::DOUBLE * exp(-0.5::DOUBLE * pow((bpm - {a}) / {s}::DOUBLE, 2))" for m, a, s, p in METERS)
_SCORED = f"""{_BARS}, m AS (SELECT *, CASE beats_per_bar WHEN 2 THEN CASE WHEN tatum_num = 3 AND tatum_den = 1 THEN '6/8' ELSE '2/2' END WHEN 3 THEN '3/4' ELSE '4/4' END AS meter FROM h), s AS (SELECT *, CASE meter {_LIK} END AS likelihood FROM m),
w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY duration_s ORDER BY (meter = '4/4') DESC, round(likelihood, 9) DESC, num_tatums, bars, tatum_num, tatum_den) AS r FROM s) WHERE r = 1)"""
QUERIES = {f.__name__: f for f in (bar_hypotheses, partial_bar_hypotheses, meter_likelihood, preferred_meter, topk_with_winner)}
ORACLE = {
    "bar_hypotheses": f"WITH {_BARS} SELECT duration_s, bars, beats_per_bar, tatum_num, tatum_den, num_tatums, round(bpm, 6) AS bpm FROM h",
    "partial_bar_hypotheses": f"""WITH {_D}, b AS (SELECT duration_s, n::INT AS total_beats, bpb::INT AS beats_per_bar, n * 60.0::DOUBLE / duration_s AS bpm FROM d, LATERAL (SELECT unnest(range(greatest(ceil(duration_s * 50 / 60)::INT, 1), floor(duration_s * 200 / 60)::INT + 1)) AS n), (SELECT unnest([2, 3, 4]) AS bpb))
      SELECT duration_s, total_beats, beats_per_bar, (total_beats // beats_per_bar)::INT AS whole_bars, (total_beats % beats_per_bar)::INT AS trailing_beats, round(bpm, 6) AS bpm FROM b WHERE total_beats % beats_per_bar > 0 AND beats_per_bar * 60.0::DOUBLE / bpm BETWEEN 1 AND 4""",
    "meter_likelihood": f"WITH {_SCORED} SELECT duration_s, meter, count(*) AS n, round(max(likelihood), 6) AS best FROM s GROUP BY 1, 2",
    "preferred_meter": f"WITH {_SCORED} SELECT duration_s, meter, num_tatums, bars, round(bpm, 6) AS bpm, round(likelihood, 6) AS likelihood FROM w",
    "topk_with_winner": f"""WITH {_SCORED}, o AS (SELECT s.duration_s, round(s.bpm, 3) AS bpm, max(round(s.likelihood, 9)) AS likelihood, abs(round(s.bpm, 3) - any_value(w.bpm)) <= 0.001 AS winner FROM s JOIN w ON s.duration_s = w.duration_s GROUP BY 1, 2),
      r AS (SELECT *, row_number() OVER (PARTITION BY duration_s ORDER BY likelihood DESC, winner DESC, bpm) AS r FROM o), a AS (SELECT *, max(CASE WHEN winner THEN r END) OVER (PARTITION BY duration_s) AS place FROM r)
      SELECT duration_s, bpm, round(likelihood, 6) AS likelihood, winner, least(r, 5)::INT AS rank FROM a WHERE r < 5 OR (r = 5 AND place <= 5) OR winner""",
}
