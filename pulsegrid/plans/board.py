"""Queries over candidate boards, selection, policy and review."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import relations, scalars
from pulsegrid.operators import board
from pulsegrid.sources import inputs
from pulsegrid.sources.inputs import CANDIDATES

B = relations.bit
TARGETS = [108.0, 120.0, 132.0, 135.0, 136.0, 144.0]


def _round(df, **places):  # noqa: ANN001, ANN202
    return df.withColumns({c: F.round(c, p) for c, p in places.items()})


def _rounded(df, **places):  # noqa: ANN001, ANN202
    """As SQL rounds, and compiled to a few operations, where F.round makes a decimal of each number."""
    return df.withColumns({c: scalars.rounded(F.col(c), p) for c, p in places.items()})


def _raw(spark, d):  # noqa: ANN001, ANN202
    return board.raw_board(inputs.candidates(spark, d))


def _collapsed(spark, d):  # noqa: ANN001, ANN202
    return board.collapse(_raw(spark, d))


def _full(spark, d):  # noqa: ANN001, ANN202
    return board.full_board(_collapsed(spark, d))


def board_raw(spark, d):  # noqa: ANN001, ANN201
    return _round(_raw(spark, d).drop("segments", "windows"), score_sum=6, quant_sum=6)


def board_collapse(spark, d):  # noqa: ANN001, ANN201
    return _round(_collapsed(spark, d), support=6, winner_support=6, score_sum=6, quant=6)


def board_winner(spark, d):  # noqa: ANN001, ANN201
    out = board.winners(board.evidence(_collapsed(spark, d)), "evidence")
    return _round(out.select("track", "rate", "bits", "support", "evidence", "runner_up", "margin"), support=6, evidence=9, runner_up=9, margin=9)


def full_board(spark, d):  # noqa: ANN001, ANN201
    return _rounded(_full(spark, d).select("track", "rate", "bits", "base", "rank"), base=9)


def lane_classify(spark, d):  # noqa: ANN001, ANN201
    return _round(board.lanes(_raw(spark, d)), best=6, high_direct=6, low=6, mid=6, high=6)


def conservative_select(spark, d):  # noqa: ANN001, ANN201
    return _rounded(board.conservative(_raw(spark, d)), support=6, winner_support=6, score=9)


def route_independent(spark, d):  # noqa: ANN001, ANN201
    best = board.best_first(board.route_independent(_collapsed(spark, d)), "measured").where("rank = 1")
    return _round(best.select("track", "rate", "support", "measured"), support=6, measured=9)


def alias_bucket_support(spark, d):  # noqa: ANN001, ANN201
    return _round(board.bucket_support(inputs.candidates(spark, d), TARGETS), support=6, winner_support=6)


def harmonic_partner(spark, d):  # noqa: ANN001, ANN201
    return _rounded(board.release_features(_full(spark, d), 130.0, 45.0), base=6, local=6, family=5, proximity=6)


def nearest_target(spark, d):  # noqa: ANN001, ANN201
    return _round(board.nearest(_full(spark, d), F.lit(128.0)), distance=6)


def _decided(spark, d):  # noqa: ANN001, ANN202
    return board.policy(board.with_current(board.full_board(board.route_independent(_collapsed(spark, d)))))


def policy_decision(spark, d):  # noqa: ANN001, ANN201
    return _round(_decided(spark, d).drop("rates"), margin=9)


def witness_semi_join(spark, d):  # noqa: ANN001, ANN201
    return board.witness_guard(_decided(spark, d)).select("track", "reason", "output_rate", "would_write", "witnessed")


def review_candidates(spark, d):  # noqa: ANN001, ANN201
    best = board.best_first(board.route_independent(_collapsed(spark, d)), "measured").withColumnRenamed("rank", "selected")
    full = board.full_board(best)
    measured = F.struct(F.col("base").alias("evidence"), "support", F.col("rank").cast("int").alias("rank"), F.lit("full_board").alias("source"))
    primary = F.struct(F.col("measured").alias("evidence"), "support", F.lit(None).cast("int").alias("rank"), F.lit("primary_selector").alias("source"))
    both = full.select("track", "rate", F.explode(F.when(F.col("selected") == 1, F.array(measured, primary)).otherwise(F.array(measured))).alias("m"))
    return _round(board.review_candidates(both.select("track", "rate", "m.*")), evidence=9, support=6)


def confidence(spark, d):  # noqa: ANN001, ANN201
    best = board.best_first(board.route_independent(_collapsed(spark, d)), "measured").where("rank = 1")
    c = scalars.confidence(F.col("support"), F.col("best_score"), F.col("quant"), F.lit(0.0), F.col("winner_support"))
    return best.select("track", "rate", F.round(c, 5).alias("confidence"))


RAW = f"""c AS ({CANDIDATES}),
raw AS (SELECT track, round(rate * ratio / 0.25) * 0.25 AS rate, bit, count(DISTINCT segment) AS segment_hits, count(DISTINCT CASE WHEN winner THEN segment END) AS winner_hits,
  count(*) AS rows, count(*) FILTER (WHERE winner) AS winner_rows, sum(score) AS score_sum, sum(quant) AS quant_sum, max(score) AS best_score, max(quant) AS best_quant
  FROM c, {relations.sql_values()} WHERE rate * ratio BETWEEN 40 AND 220 GROUP BY ALL),
total AS (SELECT track, count(DISTINCT segment) AS total FROM c GROUP BY track),
sup AS (SELECT raw.*, segment_hits / total::DOUBLE AS support, winner_hits / total::DOUBLE AS winner_support FROM raw JOIN total USING (track)),
col AS (SELECT track, rate, bit_or(bit)::BIGINT AS bits, max(support) AS support, max(winner_support) AS winner_support, sum(least(score_sum, 2.0::DOUBLE)) AS score_sum, max(best_score) AS best_score,
  max(quant_sum / rows) AS quant, sum(rows)::BIGINT AS rows FROM sup GROUP BY track, rate)"""
FULL = f"""{RAW}, fb0 AS (SELECT *, best_score AS local, round(0.5::DOUBLE * coalesce(best_score / nullif(max(best_score) OVER w, 0), 0) + coalesce(quant / nullif(max(quant) OVER w, 0), 0)
  + 0.5::DOUBLE * coalesce(ln(score_sum + 1) / nullif(max(ln(score_sum + 1)) OVER w, 0), 0)
  - CASE WHEN bits & {B('equivalent')} <> 0 THEN -0.05::DOUBLE WHEN bits & {relations.mask('one_third', 'quarter', 'triple')} <> 0 THEN 0.18::DOUBLE WHEN bits & {relations.mask('half', 'double_time')} <> 0 THEN 0.1::DOUBLE ELSE 0.04::DOUBLE END, 9) AS base
  FROM col WINDOW w AS (PARTITION BY track)),
fb AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY base DESC, support DESC, winner_support DESC, local DESC, rate) AS rank FROM fb0)"""
EVID = f"""{RAW}, ev AS (SELECT *, round(support * 4 + winner_support + best_score * 10 + ln(score_sum + 1) * 1.5::DOUBLE + CASE WHEN bits & {B('equivalent')} <> 0 THEN 0.7::DOUBLE ELSE 0 END, 9) AS evidence FROM col),
er AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY evidence DESC, support DESC, winner_support DESC, rate) AS rank FROM ev)"""
LANES = f"""{RAW}, st AS (SELECT track, max(support) AS best, coalesce(max(support) FILTER (WHERE bit = {B('equivalent')} AND rate >= 150), 0) AS high_direct, coalesce(max(support) FILTER (WHERE rate <= 90), 0) AS low,
  coalesce(max(support) FILTER (WHERE rate > 90 AND rate < 145), 0) AS mid, coalesce(max(support) FILTER (WHERE rate >= 145), 0) AS high FROM sup GROUP BY track),
lanes AS (SELECT *, CASE WHEN high_direct >= 0.55 AND high >= mid * 0.85::DOUBLE THEN 'high_pulse' WHEN best >= 0.85 AND abs(low - mid) <= 0.12 THEN 'harmonic_conflict' ELSE 'general' END AS lane FROM st)"""
_EXT = relations.mask(*relations.EXTREME)
_NEAR = relations.mask("two_thirds", "three_halves", "three_quarters", "four_thirds")
_MEASURED = """ms AS (SELECT *, round(support * 0.34::DOUBLE + winner_support * 0.24::DOUBLE + best_score * 0.14::DOUBLE + quant * 0.13::DOUBLE
  + 0.02::DOUBLE * coalesce(score_sum / nullif(max(score_sum) OVER (PARTITION BY track), 0), 0), 9) AS measured FROM col),
mr AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY measured DESC, support DESC, winner_support DESC, rate) AS rank FROM ms)"""
_RATIO = lambda v, r: f"(CASE WHEN {r} > 0 THEN {v} / {r} WHEN {v} > 0 THEN 'Infinity'::DOUBLE ELSE 1 END)"
DECIDED = f"""{FULL}, {_MEASURED},
cur AS (SELECT fb.track, fb.rate AS c_rate, fb.local AS c_local, fb.support AS c_support, fb.base AS c_base, fb.bits AS c_bits FROM fb JOIN mr ON fb.track = mr.track AND fb.rate = mr.rate WHERE mr.rank = 1),
two AS (SELECT track, max(CASE WHEN rank = 1 THEN base END) - coalesce(max(CASE WHEN rank = 2 THEN base END), 0) AS margin FROM
  (SELECT *, row_number() OVER (PARTITION BY track ORDER BY base DESC, support DESC, winner_support DESC, rate) AS rank FROM fb0) GROUP BY track),
win AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY base DESC, support DESC, winner_support DESC, rate) AS r FROM fb0) WHERE r = 1),
con AS (SELECT track, rate AS conflict_rate FROM (SELECT fb.track, fb.rate, row_number() OVER (PARTITION BY fb.track ORDER BY round(abs(c_rate - 130) - abs(fb.rate - 130), 9) DESC, round({_RATIO('fb.local', 'c_local')}, 9) DESC,
  round({_RATIO('fb.base', 'c_base')}, 9) DESC, fb.support DESC, fb.rate) AS n FROM fb JOIN cur USING (track) WHERE c_rate >= 80 AND abs(c_rate - 130) >= 15 AND abs(fb.rate - c_rate) >= 15 AND fb.support >= 0.6
  AND {_RATIO('fb.local', 'c_local')} >= 0.7 AND {_RATIO('fb.base', 'c_base')} >= 0.8 AND abs(c_rate - 130) - abs(fb.rate - 130) >= 10) WHERE n = 1),
gate AS (SELECT track, win.rate AS winner_rate, margin, c_rate AS current_rate, conflict_rate, CASE WHEN c_rate < 40 AND support >= 0.8 AND local >= 0.25 THEN 'out_of_rail_release'
  WHEN win.rate / c_rate BETWEEN 1.3::DOUBLE AND 1.35::DOUBLE AND bits & {B('equivalent')} <> 0 AND bits & {B('three_quarters')} <> 0 AND support >= 0.8 AND local >= 0.28 AND margin >= 0.35 AND ({_RATIO('local', 'c_local')} >= 1.5 OR {_RATIO('support', 'c_support')} >= 1.2) THEN 'four_thirds_release'
  WHEN abs(win.rate - c_rate) > 1 AND bits & {B('equivalent')} <> 0 AND support >= 0.9 AND local >= 0.35 AND margin >= 0.35 AND ({_RATIO('local', 'c_local')} >= 1.2 OR {_RATIO('support', 'c_support')} >= 1.2) THEN 'dominant_direct_release'
  WHEN abs(win.rate - c_rate) > 15 AND bits & {B('equivalent')} <> 0 AND support >= 0.9 AND local >= 0.25 AND margin >= 0.2 AND abs(greatest(win.rate, c_rate) / least(win.rate, c_rate) - 1.5::DOUBLE) <= 0.03 THEN CASE WHEN win.rate > c_rate THEN 'dominant_family_release' ELSE 'three_halves_conflict_hold' END
  WHEN margin BETWEEN 0 AND 0.1 AND c_support <= 0.15 AND support >= 0.5 AND abs(win.rate - c_rate) >= 15 AND {_RATIO('local', 'c_local')} >= 1.2 AND {_RATIO('support', 'c_support')} >= 3 AND bits & {B('two_thirds')} <> 0 AND bits & {B('three_halves')} <> 0 AND c_bits & {B('equivalent')} <> 0
    AND c_bits & {relations.mask('three_quarters', 'four_thirds')} <> 0 THEN 'broad_conflict_hold'
  WHEN conflict_rate IS NOT NULL THEN 'family_conflict_hold'
  WHEN abs(win.rate - c_rate) BETWEEN 0.05 AND 3.0 AND support >= 0.4 AND {_RATIO('local', 'c_local')} >= 1.2 AND {_RATIO('support', 'c_support')} >= 0.45 THEN 'micro_upgrade' ELSE 'keep_current' END AS reason
  FROM win JOIN two USING (track) JOIN cur USING (track) LEFT JOIN con USING (track)),
dec AS (SELECT *, CASE WHEN reason LIKE '%hold' THEN 0 WHEN reason = 'keep_current' THEN current_rate ELSE winner_rate END AS output_rate, reason NOT LIKE '%hold' AS would_write FROM gate)"""

QUERIES = {f.__name__: f for f in (board_raw, board_collapse, board_winner, full_board, lane_classify, conservative_select, route_independent, alias_bucket_support, harmonic_partner, nearest_target, policy_decision, witness_semi_join, review_candidates, confidence)}
ORACLE = {
    "board_raw": f"WITH {RAW} SELECT track, rate, bit, segment_hits, winner_hits, rows, winner_rows, round(score_sum, 6) AS score_sum, round(quant_sum, 6) AS quant_sum, best_score, best_quant FROM raw",
    "board_collapse": f"WITH {RAW} SELECT track, rate, bits, round(support, 6) AS support, round(winner_support, 6) AS winner_support, round(score_sum, 6) AS score_sum, best_score, round(quant, 6) AS quant, rows FROM col",
    "board_winner": f"""WITH {EVID} SELECT track, max(CASE WHEN rank = 1 THEN rate END) AS rate, max(CASE WHEN rank = 1 THEN bits END) AS bits, round(max(CASE WHEN rank = 1 THEN support END), 6) AS support,
      round(max(CASE WHEN rank = 1 THEN evidence END), 9) AS evidence, round(coalesce(max(CASE WHEN rank = 2 THEN evidence END), 0), 9) AS runner_up,
      round(max(CASE WHEN rank = 1 THEN evidence END) - coalesce(max(CASE WHEN rank = 2 THEN evidence END), 0), 9) AS margin FROM er GROUP BY track""",
    "full_board": f"WITH {FULL} SELECT track, rate, bits, round(base, 9) AS base, rank::INT AS rank FROM fb",
    "lane_classify": f"WITH {LANES} SELECT track, round(best, 6) AS best, round(high_direct, 6) AS high_direct, round(low, 6) AS low, round(mid, 6) AS mid, round(high, 6) AS high, lane FROM lanes",
    "conservative_select": f"""WITH {LANES}, sc AS (SELECT sup.*, lane, (CASE WHEN bit & {_EXT} <> 0 THEN 0 ELSE 2 END) + (CASE WHEN support >= 0.15 THEN 1 ELSE 0 END) AS pool, round(support * 9 + winner_support * 2 + ln(score_sum + 1) * 0.8::DOUBLE + best_score * 2.5::DOUBLE
      + quant_sum / rows * 0.4::DOUBLE + CASE WHEN bit = {B('equivalent')} THEN 0.8::DOUBLE WHEN bit & {_NEAR} <> 0 THEN -0.2::DOUBLE WHEN bit & {_EXT} <> 0 THEN -3.5::DOUBLE ELSE -1 END
      - abs(rate - 130) * CASE WHEN lane = 'general' THEN 0.06::DOUBLE ELSE 0.035::DOUBLE END + CASE WHEN lane = 'high_pulse' THEN (CASE WHEN rate >= 150 THEN 5 ELSE 0 END) + (CASE WHEN bit = {B('equivalent')} THEN 2 ELSE 0 END) - (CASE WHEN rate < 130 THEN 4 ELSE 0 END) ELSE 0 END
      - CASE WHEN bit & {_EXT} <> 0 THEN 4 ELSE 0 END - CASE WHEN support < 0.15 THEN 3 ELSE 0 END, 9) AS score FROM sup JOIN lanes USING (track))
      SELECT track, lane, rate, bit, round(support, 6) AS support, round(winner_support, 6) AS winner_support, round(score, 9) AS score FROM
      (SELECT *, row_number() OVER (PARTITION BY track ORDER BY pool DESC, score DESC, support DESC, winner_support DESC, score_sum DESC, rate, bit) AS n FROM sc) WHERE n = 1""",
    "route_independent": f"WITH {RAW}, {_MEASURED} SELECT track, rate, round(support, 6) AS support, round(measured, 9) AS measured FROM mr WHERE rank = 1",
    "alias_bucket_support": f"""WITH {RAW}, x AS (SELECT track, segment, winner, round(rate * ratio / 0.25) * 0.25 AS target FROM c, {relations.sql_values()} WHERE rate * ratio BETWEEN 40 AND 220)
      SELECT track, target, round(count(DISTINCT segment) / any_value(total)::DOUBLE, 6) AS support, round(count(DISTINCT CASE WHEN winner THEN segment END) / any_value(total)::DOUBLE, 6) AS winner_support
      FROM x JOIN total USING (track) WHERE target IN (108, 120, 132, 135, 136, 144) GROUP BY track, target""",
    "harmonic_partner": f"""WITH {FULL}, u0 AS (SELECT *, row_number() OVER (PARTITION BY track, floor(rate * 20 + 0.5) ORDER BY base DESC, local DESC, support DESC, rate) AS n FROM fb),
      u AS (SELECT track, rate, base / (CASE WHEN max(base) OVER w > 0 THEN max(base) OVER w ELSE 1 END) AS base, local / (CASE WHEN max(local) OVER w > 0 THEN max(local) OVER w ELSE 1 END) AS local FROM u0 WHERE n = 1 WINDOW w AS (PARTITION BY track)),
      f AS (SELECT a.track, a.rate, max(b.base * (1 - abs(b.rate / a.rate - q) / q / 0.018::DOUBLE)) AS family FROM u a JOIN u b ON a.track = b.track AND b.rate > a.rate, (VALUES (4 / 3::DOUBLE), (1.5::DOUBLE), (2::DOUBLE), (3::DOUBLE), (4::DOUBLE)) r(q)
      WHERE abs(b.rate / a.rate - q) / q < 0.018::DOUBLE GROUP BY a.track, a.rate)
      SELECT track, rate, round(base, 6) AS base, round(local, 6) AS local, round(greatest(coalesce(family, 0), 0), 5) AS family, round(exp(-0.5::DOUBLE * pow((rate - 130) / 45, 2)), 6) AS proximity FROM u LEFT JOIN f USING (track, rate)""",
    "nearest_target": f"WITH {FULL} SELECT track, 128.0::DOUBLE AS target, rate, round(abs(rate - 128), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(abs(rate - 128), 9), base DESC, rate) AS n FROM fb) WHERE n = 1",
    "policy_decision": f"WITH {DECIDED} SELECT track, winner_rate, round(margin, 9) AS margin, current_rate, conflict_rate, reason, output_rate, would_write FROM dec",
    "witness_semi_join": f"""WITH {DECIDED}, w AS (SELECT dec.*, EXISTS (SELECT 1 FROM fb WHERE fb.track = dec.track AND abs(fb.rate - dec.output_rate) <= 0.001) AND output_rate BETWEEN 40 AND 220 AS witnessed FROM dec)
      SELECT track, CASE WHEN would_write AND NOT witnessed THEN 'unmeasured_output_hold' ELSE reason END AS reason, CASE WHEN would_write AND NOT witnessed THEN 0 ELSE output_rate END AS output_rate, would_write AND witnessed AS would_write, witnessed FROM w""",
    "review_candidates": f"""WITH {FULL}, {_MEASURED}, m AS (SELECT track, rate, base AS evidence, support, rank, 'full_board' AS source FROM fb UNION ALL SELECT track, rate, measured, support, NULL, 'primary_selector' FROM mr WHERE rank = 1),
      o AS (SELECT track, round(rate, 3) AS rate, max(evidence) AS evidence, max(support) AS support, min(rank) AS rank, array_to_string(list_sort(list_distinct(list(source))), '|') AS sources FROM m GROUP BY 1, 2),
      p AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY (rank IS NULL), evidence DESC, support DESC, rate) AS place FROM o)
      SELECT track, rate, round(evidence, 9) AS evidence, round(support, 6) AS support, sources, coalesce(rank, place)::INT AS rank, CASE WHEN place = 1 THEN 'Final' WHEN place <= 3 THEN 'Alt' || (place - 1) ELSE '' END AS role FROM p""",
    "confidence": f"""WITH {RAW}, {_MEASURED} SELECT track, rate, round(least(99, greatest(0, 30 + 50 * least(1, greatest(0, support)) + 8 * least(1, greatest(0, best_score / 0.45::DOUBLE)) + 6 * least(1, greatest(0, quant / 0.4::DOUBLE))
      + CASE WHEN winner_support >= 0.5 THEN 4 ELSE 0 END)), 5) AS confidence FROM mr WHERE rank = 1""",
}
