"""Queries over families of rates, partial bars and merged evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import relations
from pulsegrid.operators import board, families
from pulsegrid.plans.board import FULL, RAW
from pulsegrid.plans.board import _full as full
from pulsegrid.plans.board import _raw as raw
from pulsegrid.sources import inputs
from pulsegrid.sources.inputs import CANDIDATES

REFERENCE = 120.0


def _windows(spark, d):  # noqa: ANN001, ANN202
    return inputs.candidates(spark, d).groupBy("track").agg(F.count_distinct("segment").alias("total"))


def _octaves(spark, d):  # noqa: ANN001, ANN202
    return inputs.candidates(spark, d).withColumn("rate", F.round(families.octave_of(F.col("rate"), F.lit(REFERENCE)), 9))


def _partial_rows(spark, d):  # noqa: ANN001, ANN202
    rate = F.floor(F.col("l_quantity") / 10) * 7.0 + 90.0
    return inputs.table(spark, d, "lineitem").select(
        (F.col("l_orderkey") % 1000).alias("track"), F.col("l_linenumber").alias("segment"), rate.alias("rate"), F.col("l_discount").alias("score"), F.col("l_tax").alias("quant"), (F.col("l_tax") * 2).alias("meter"), (F.col("l_suppkey") % 12).cast("int").alias("rank")
    )


def family_cluster(spark, d):  # noqa: ANN001, ANN201
    return _round(families.families(inputs.candidates(spark, d).where("score > 0")))


def _round(df):  # noqa: ANN001, ANN202
    return df.withColumns({c: F.round(c, 6) for c, k in df.dtypes if k == "double"})


def family_octave_class(spark, d):  # noqa: ANN001, ANN201
    ranked = families.families(_octaves(spark, d).where("score > 0"), tasks=inputs.tasks(spark, d))
    return _round(families.family_class(ranked, _windows(spark, d), REFERENCE))


def alias_resolution(spark, d):  # noqa: ANN001, ANN201
    ranked = families.families(inputs.candidates(spark, d).where("score > 0"))
    return _round(families.resolve_alias(ranked, _windows(spark, d), 100.0, 140.0))


def partial_bar_aggregate(spark, d):  # noqa: ANN001, ANN201
    return _round(families.partial_bars(_partial_rows(spark, d), 4))


def cross_view_band_join(spark, d):  # noqa: ANN001, ANN201
    rows = _partial_rows(spark, d)
    total = rows.groupBy("track").agg(F.count_distinct("segment").alias("total"))
    return _round(families.cross_view(full(spark, d), families.partial_bars(rows), total))


def _pulse(spark, d):  # noqa: ANN001, ANN202
    rows = inputs.table(spark, d, "lineitem").where("l_linenumber <= 2").select(F.col("l_orderkey").alias("track"), "l_quantity", "l_discount", "l_tax")
    p = relations.expanded(inputs.by_track(rows, spark, d), F.col("l_quantity") * 3.0 + 40.0)
    value = families.pulse_score(F.col("l_discount") * 5, F.col("l_tax") * 5, F.col("l_discount") * 20, F.col("l_tax") * 10, F.lit(0.5))
    return p.select("track", (F.floor(F.col("x.rate") / 0.25 + 0.5) * 0.25).alias("rate"), F.col("x.bit").alias("bit"), value.alias("pulse"), (F.col("l_tax") * 10).alias("section"))


def _continuous(spark, d):  # noqa: ANN001, ANN202
    rows = inputs.table(spark, d, "lineitem").where("l_linenumber = 3")
    rows = rows.select(F.col("l_orderkey").alias("track"), (F.floor(F.col("l_quantity")) * 2.0 + 60.0).alias("rate"), F.lit(relations.bit("equivalent")).cast("long").alias("bit"), (F.col("l_discount") * 8).alias("score"))
    return inputs.by_track(rows, spark, d)


def _merged(spark, d):  # noqa: ANN001, ANN202
    return families.with_evidence(board.with_support(raw(spark, d)), _pulse(spark, d), _continuous(spark, d))


def board_evidence(spark, d):  # noqa: ANN001, ANN201
    return _round(families.collapse_merged(_merged(spark, d)))


def alias_pulse(spark, d):  # noqa: ANN001, ANN201
    return _round(_pulse(spark, d).groupBy("track", "rate", "bit").agg(F.max("pulse").alias("pulse"), F.max("section").alias("section")))


_BEST = "list_min(list_transform(f, lambda z: abs(z.rate - x)))"
_NEW = "{'rate': x, 's': score, 'best': score, 'support': 1, 'cand': winner::INT, 'best_rate': x}"
_F0 = "{'rate': 0::DOUBLE, 's': 0::DOUBLE, 'best': 0::DOUBLE, 'support': 0, 'cand': 0, 'best_rate': 0::DOUBLE}"


def fold_sql(rows: str) -> str:
    """Families by a recursive query: a step for each row of a track, the families so far as a list."""
    return f"""src AS (SELECT track, rate AS x, score, winner, row_number() OVER (PARTITION BY track ORDER BY segment, rate, score, winner) AS n FROM ({rows}) WHERE score > 0),
go AS (SELECT track, 0::BIGINT AS n, [{_F0}][:0] AS f FROM (SELECT DISTINCT track FROM src) UNION ALL
  SELECT go.track, src.n, CASE WHEN len(f) = 0 OR {_BEST} > 2 THEN list_append(f, {_NEW}) ELSE
    list_transform(f, lambda z, i: CASE WHEN i = list_position(list_transform(f, lambda y: abs(y.rate - x)), {_BEST}) THEN
      {{'rate': (z.rate * z.s + x * score) / (z.s + score), 's': z.s + score, 'best': greatest(z.best, score), 'support': z.support + 1, 'cand': z.cand + winner::INT, 'best_rate': CASE WHEN score > z.best THEN x ELSE z.best_rate END}} ELSE z END) END
  FROM go JOIN src ON go.track = src.track AND src.n = go.n + 1),
fam0 AS (SELECT track, unnest(f) AS z FROM (SELECT *, max(n) OVER (PARTITION BY track) AS last FROM go) WHERE n = last),
fam AS (SELECT * FROM (SELECT track, row_number() OVER (PARTITION BY track ORDER BY round(z.s, 9) DESC, z.support DESC, z.best DESC, z.rate) AS family_rank, z.rate AS rate, z.s AS score_sum, z.best AS best_score, z.support::BIGINT AS support,
  z.cand::BIGINT AS candidate_support, z.best_rate AS best_rate FROM fam0) WHERE family_rank <= 4)"""


_TOTAL = "tot AS (SELECT track, count(DISTINCT segment) AS total FROM c GROUP BY track)"
_OCT = f"SELECT track, segment, round(rate * pow(2, -round(log2(rate / {REFERENCE}::DOUBLE))), 9) AS rate, score, winner FROM c"
_PAIR = "one AS (SELECT fam.*, total, (SELECT max(score_sum) FROM fam g WHERE g.track = fam.track AND g.family_rank = 2) AS second FROM fam JOIN tot USING (track) WHERE family_rank = 1)"
_PART = """pr AS (SELECT l_orderkey % 1000 AS track, l_linenumber AS segment, round(floor(l_quantity / 10) * 7 + 90, 3)::DOUBLE AS rate, l_discount AS score, l_tax AS quant, l_tax * 2 AS meter, (l_suppkey % 12)::INT AS rank FROM lineitem),
pb0 AS (SELECT track, rate, sum(score) AS score_sum, avg(quant) AS quant, avg(meter) AS meter, count(*) AS rows, count(*) FILTER (WHERE rank = 1) AS rank1_hits, count(*) FILTER (WHERE rank <= 5) AS top5_hits, count(DISTINCT segment) AS segments FROM pr GROUP BY 1, 2),
pb1 AS (SELECT *, row_number() OVER w AS place, count(*) OVER (PARTITION BY track) AS families, CASE WHEN first(score_sum) OVER w > 0 THEN score_sum / first(score_sum) OVER w ELSE 0 END AS ratio_to_top FROM pb0 WINDOW w AS (PARTITION BY track ORDER BY round(score_sum, 9) DESC, rate)),
pb AS (SELECT *, coalesce(max(CASE WHEN place = 2 THEN ratio_to_top END) OVER (PARTITION BY track), 0) AS runner_up_ratio FROM pb1)"""
_PULSE = f"""pu AS (SELECT l_orderkey AS track, round((l_quantity * 3 + 40) * ratio / 0.25) * 0.25 AS rate, bit, 0.4::DOUBLE * (l_discount * 5) + 0.25::DOUBLE * (l_tax * 5) + 0.15::DOUBLE * least(l_discount * 20, 1) + 0.1::DOUBLE * (l_tax * 10) + 0.05::DOUBLE AS pulse, l_tax * 10 AS section
  FROM lineitem, {relations.sql_values()} WHERE l_linenumber <= 2 AND (l_quantity * 3 + 40) * ratio BETWEEN 40 AND 220)"""

QUERIES = {f.__name__: f for f in (family_cluster, family_octave_class, alias_resolution, partial_bar_aggregate, cross_view_band_join, board_evidence, alias_pulse)}
ORACLE = {
    "family_cluster": f"WITH RECURSIVE c AS ({CANDIDATES}), {fold_sql('SELECT * FROM c')} SELECT track, round(rate, 6) AS rate, round(score_sum, 6) AS score_sum, round(best_score, 6) AS best_score, support, candidate_support, round(best_rate, 6) AS best_rate, family_rank::INT AS family_rank FROM fam",
    "family_octave_class": f"""WITH RECURSIVE c AS ({CANDIDATES}), {fold_sql(_OCT)}, {_TOTAL}, {_PAIR} SELECT track, round(rate, 6) AS rate, CASE WHEN support / total < 0.35 OR coalesce(second > 0 AND score_sum < second * 1.25::DOUBLE, false) THEN 'ambiguous'
      WHEN abs(rate - 120) <= 2 THEN 'supports_current' WHEN abs(rate * 2 - 120) <= 2 THEN 'supports_half' WHEN abs(rate * 0.5::DOUBLE - 120) <= 2 THEN 'supports_double' ELSE 'supports_alternative' END AS family_class FROM one""",
    "alias_resolution": f"""WITH RECURSIVE c AS ({CANDIDATES}), {fold_sql('SELECT * FROM c')}, {_TOTAL}, {_PAIR}, ins AS (SELECT one.track, relation, bit, one.rate * ratio AS r FROM one, {relations.sql_values()} WHERE one.rate * ratio BETWEEN 100 AND 140),
      agg AS (SELECT track, count(*) AS n, first(relation ORDER BY round(abs(r - 120), 9), bit) AS rel, first(r ORDER BY round(abs(r - 120), 9), bit) AS near FROM ins GROUP BY track)
      SELECT track, round(rate, 6) AS input_rate, coalesce(n, 0)::INT AS options, rel AS centre_relation, round(near, 6) AS centre_rate, CASE WHEN n = 1 THEN round(near, 6) END AS rate, CASE WHEN n IS NULL THEN 'no_alias' WHEN n > 1 THEN 'ambiguous_alias'
      WHEN support / total >= 0.25 OR score_sum / nullif(coalesce(second, 0), 0) >= 1.25 OR (coalesce(second, 0) > 0 AND second / score_sum <= 0.8) THEN 'unique_alias' ELSE 'weak_evidence' END AS reason FROM one LEFT JOIN agg USING (track)""",
    "partial_bar_aggregate": f"WITH {_PART} SELECT track, rate, round(score_sum, 6) AS score_sum, round(quant, 6) AS quant, round(meter, 6) AS meter, rows, rank1_hits, top5_hits, segments, place::INT AS place, families, round(ratio_to_top, 6) AS ratio_to_top, round(runner_up_ratio, 6) AS runner_up_ratio FROM pb WHERE place <= 4",
    "cross_view_band_join": f"""WITH {FULL}, {_PART}, tt AS (SELECT track, count(DISTINCT segment) AS total FROM pr GROUP BY track), m AS (SELECT fb.track, fb.rate, pb.rate AS partial_rate, round(abs(fb.rate - pb.rate), 9) AS bridge, row_number() OVER (PARTITION BY fb.track ORDER BY base DESC, fb.support DESC, round(pb.score_sum, 9) DESC,
      round(abs(fb.rate - pb.rate), 9), fb.rate, pb.rate) AS n FROM fb JOIN pb USING (track) JOIN tt USING (track) WHERE abs(fb.rate - pb.rate) <= 1.25 AND place <= 16 AND ratio_to_top >= 0.8 AND top5_hits / total >= 0.25 AND segments / total >= 0.9)
      SELECT track, rate, partial_rate, round(bridge, 6) AS bridge FROM m WHERE n = 1""",
    "board_evidence": f"""WITH {RAW}, {_PULSE}, m AS (SELECT track, rate, bit, support, winner_support, rows, score_sum, quant_sum, best_score, 0 AS pulse, 0 AS section, 0 AS continuous FROM sup UNION ALL SELECT track, rate, bit, 0, 0, 0, 0, 0, 0, pulse, section, 0 FROM pu
      UNION ALL SELECT l_orderkey, floor(l_quantity) * 2 + 60, {relations.bit('equivalent')}, least(greatest(l_discount * 8, 0), 1), 0, 1, l_discount * 8, 0, l_discount * 8, 0, 0, l_discount * 8 FROM lineitem WHERE l_linenumber = 3),
      g AS (SELECT track, rate, bit, max(support) AS support, max(winner_support) AS winner_support, max(best_score) AS best_score, max(pulse) AS pulse, max(section) AS section, max(continuous) AS continuous, sum(rows) AS rows, sum(score_sum) AS score_sum, sum(quant_sum) AS quant_sum FROM m GROUP BY 1, 2, 3)
      SELECT track, rate, bit_or(bit)::BIGINT AS bits, round(max(support), 6) AS support, round(max(winner_support), 6) AS winner_support, round(max(best_score), 6) AS best_score, round(max(pulse), 6) AS pulse, round(max(section), 6) AS section, round(max(continuous), 6) AS continuous,
      round(sum(least(score_sum, 2)), 6) AS score_sum, round(max(CASE WHEN rows > 0 THEN quant_sum / rows ELSE 0 END), 6) AS quant, sum(rows)::BIGINT AS rows FROM g GROUP BY 1, 2""",
    "alias_pulse": f"WITH {_PULSE} SELECT track, rate, bit, round(max(pulse), 6) AS pulse, round(max(section), 6) AS section FROM pu GROUP BY 1, 2, 3",
}
