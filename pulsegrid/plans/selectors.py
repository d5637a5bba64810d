"""Queries over the candidate selectors; the merged board is that of the evidence query."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import relations
from pulsegrid.operators import families, selectors
from pulsegrid.operators.selectors import CLUSTER, HARMONIC, SOFT, lane_score, sql_score
from pulsegrid.plans.board import _raw as raw
from pulsegrid.plans.board import LANES
from pulsegrid.plans.families import _PULSE, _merged
from pulsegrid.sources import inputs

M = relations.mask


def _board(spark, d):  # noqa: ANN001, ANN202
    return families.collapse_merged(_merged(spark, d))


def selector_scores(spark, d):  # noqa: ANN001, ANN201
    return selectors.scored(_board(spark, d), raw(spark, d)).select("track", "rate", "lane", *[(F.col(c) + 0.0).alias(c) for c in ("cluster", "harmonic", "soft", "proof")])


def soft_centre(spark, d):  # noqa: ANN001, ANN201
    return selectors.soft_centre(selectors.measured(_board(spark, d)), 128.0, 30.0)


def slow_rescue(spark, d):  # noqa: ANN001, ANN201
    li = inputs.table(spark, d, "lineitem")
    c = li.select((F.col("l_orderkey") % 500).alias("track"), (F.col("l_linenumber") * 0.5 + 94).alias("rate"), F.round(F.col("l_discount") * 30, 4).alias("ratio"), (F.col("l_quantity") / 50).alias("support"), (F.col("l_tax") * 12).alias("stability"), F.col("l_extendedprice").alias("score"))
    won = li.groupBy((F.col("l_orderkey") % 500).alias("track")).agg((F.min("l_quantity") + 80.0).alias("won"))
    return selectors.slow_rescue(c, won)


_MERGED = f"""{LANES}, {_PULSE}, m AS (SELECT track, rate, bit, support, winner_support, rows, score_sum, quant_sum, best_score, 0 AS pulse, 0 AS section, 0 AS continuous FROM sup UNION ALL SELECT track, rate, bit, 0, 0, 0, 0, 0, 0, pulse, section, 0 FROM pu
  UNION ALL SELECT l_orderkey, floor(l_quantity) * 2 + 60, {relations.bit('equivalent')}, least(greatest(l_discount * 8, 0), 1), 0, 1, l_discount * 8, 0, l_discount * 8, 0, 0, l_discount * 8 FROM lineitem WHERE l_linenumber = 3),
mg AS (SELECT track, rate, bit, max(support) AS support, max(winner_support) AS winner_support, max(best_score) AS best_score, max(pulse) AS pulse, max(section) AS section, max(continuous) AS continuous, sum(rows) AS rows, sum(score_sum) AS score_sum FROM m GROUP BY 1, 2, 3),
mb AS (SELECT track, rate, bit_or(bit)::BIGINT AS bits, max(support) AS support, max(winner_support) AS winner_support, max(best_score) AS best_score, max(pulse) AS pulse, max(section) AS section, max(continuous) AS continuous, sum(least(score_sum, 2)) AS score_sum FROM mg GROUP BY 1, 2),
ms AS (SELECT mb.*, lane, round(support * 4 + winner_support + best_score * 10 + pulse * 4 + section * 4 + ln(score_sum + 1) * 1.5::DOUBLE + CASE WHEN bits & {relations.bit('equivalent')} <> 0 THEN 0.7::DOUBLE ELSE 0 END, 9) AS evidence,
  round({lane_score(CLUSTER, 130.0)}, 9) AS cluster, round({sql_score(HARMONIC, 130.0)}, 9) AS harmonic, round({sql_score(SOFT, 130.0)}, 9) AS soft, round(best_score + section * 0.12::DOUBLE, 9) AS proof FROM mb JOIN lanes USING (track))"""
QUERIES = {f.__name__: f for f in (selector_scores, soft_centre, slow_rescue)}
ORACLE = {
    "selector_scores": f"WITH {_MERGED} SELECT track, rate, lane, cluster + 0.0::DOUBLE AS cluster, harmonic + 0.0::DOUBLE AS harmonic, soft + 0.0::DOUBLE AS soft, proof + 0.0::DOUBLE AS proof FROM ms",
    "soft_centre": f"""WITH {_MERGED}, e AS (SELECT *, round(support * 0.34::DOUBLE + winner_support * 0.24::DOUBLE + best_score * 0.14::DOUBLE + pulse * 0.13::DOUBLE + section * 0.1::DOUBLE + continuous * 0.03::DOUBLE + 0.02::DOUBLE * coalesce(least(1, greatest(0, score_sum / nullif(max(score_sum) OVER (PARTITION BY track), 0))), 0), 9) AS measured FROM mb),
      x AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY measured DESC, support DESC, winner_support DESC, section DESC, best_score DESC, round(score_sum, 9) DESC, rate) AS a,
        row_number() OVER (PARTITION BY track ORDER BY round(measured + 0.08::DOUBLE * exp(-0.5::DOUBLE * pow((rate - 128) / 15, 2)), 9) DESC, support DESC, winner_support DESC, section DESC, best_score DESC, round(score_sum, 9) DESC, rate) AS b FROM e WHERE rate BETWEEN 40 AND 220),
      g AS (SELECT track, max(CASE WHEN a = 1 THEN rate END) AS m, max(CASE WHEN b = 1 THEN rate END) AS s, max(CASE WHEN a = 1 THEN measured END) - coalesce(max(CASE WHEN a = 2 THEN measured END), 0) AS margin, bool_or(a = 1 AND rate >= 155 AND support >= 0.7 AND winner_support >= 0.55 AND bits & {M('equivalent', 'double_time', 'four_thirds')} <> 0) AS immune FROM x GROUP BY track)
      SELECT track, CASE WHEN margin > 0.25 OR immune THEN m ELSE s END AS rate, m AS measured_rate, round(margin, 9) AS margin, NOT (margin > 0.25 OR immune) AND s <> m AS moved FROM g""",
    "slow_rescue": """WITH c AS (SELECT l_orderkey % 500 AS track, l_linenumber * 0.5::DOUBLE + 94 AS rate, round(l_discount * 30, 4) AS ratio, l_quantity / 50 AS support, l_tax * 12 AS stability, l_extendedprice AS score FROM lineitem), w AS (SELECT l_orderkey % 500 AS track, min(l_quantity) + 80 AS won FROM lineitem GROUP BY 1)
      SELECT track, rate FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY ratio DESC, support DESC, stability DESC, score DESC, abs(rate - 99), rate) AS n FROM c JOIN w USING (track) WHERE won <= 90 AND rate BETWEEN 95 AND 102 AND abs(rate - won) >= 10 AND ratio >= 1.5 AND support >= 0.8 AND stability >= 0.7) WHERE n = 1""",
}
