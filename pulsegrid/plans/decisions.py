"""The whole decision of a track: merged board, primary selection with its holds, policy, what is written."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from pulsegrid.functions import relations
from pulsegrid.functions.scalars import rounded
from pulsegrid.operators import board, competition, families, gates, primary, releases
from pulsegrid.plans.families import _PULSE, _pulse, fold_sql
from pulsegrid.sources import inputs
from pulsegrid.sources.inputs import CANDIDATES
from pulsegrid.sources.staged import staged

_D = relations.bit("equivalent")
#: What an exact scan found near a winner; it stands within three quarters of it.
EXACT_RATE, EXACT_LOCAL = "rate + ((track * 7 + CAST(rate * 4 AS BIGINT)) % 151 - 75) / CAST(100 AS DOUBLE)", "best_score"
#: One text for both engines: routes, continuous measurements and partial bars of an order's lines.
ROUTES = f"""SELECT track, CASE WHEN kind = 2 THEN middle - 15 WHEN kind = 3 THEN middle - 45 ELSE CAST(40 AS DOUBLE) END AS low, CASE WHEN kind = 2 THEN middle + 15 WHEN kind = 3 THEN middle + 45 ELSE CAST(220 AS DOUBLE) END AS high, kind <> 0 AS matched, kind = 1 AS generic,
  priority = '1-URGENT' AND kind < 2 AS slow_words, priority = '5-LOW' AND customer % 7 = 0 AS bare_words, 1000 + (track % 97) * CAST(100 AS DOUBLE) AS peaks
  FROM (SELECT o_orderkey AS track, o_custkey % 4 AS kind, 80 + (o_custkey % 12) * CAST(10 AS DOUBLE) AS middle, o_custkey AS customer, o_orderpriority AS priority FROM {{orders}}) AS o"""
CONTINUOUS = f"SELECT l_orderkey AS track, floor(l_quantity) * CAST(2 AS DOUBLE) + 60 AS rate, CAST({_D} AS BIGINT) AS bit, l_discount * 4 AS cont, least(l_tax * 14, CAST(1 AS DOUBLE)) AS cont_section, l_discount * 10 + 1 AS cont_ratio, l_tax * 12 AS cont_stab FROM {{lineitem}} WHERE l_linenumber BETWEEN 3 AND 5"
PARTIAL = "SELECT l_orderkey AS track, l_linenumber AS segment, floor(l_quantity / 10) * CAST(7 AS DOUBLE) + 90 AS rate, l_discount AS score, CAST(l_suppkey % 4 AS INT) AS rank FROM {lineitem}"
_PARTS = """SELECT track, max(CASE WHEN place = 1 THEN rate END) AS part_coarse, max(CASE WHEN place = 1 THEN score_sum END) AS part_score, max(CASE WHEN place = 1 THEN best END) AS part_local, max(CASE WHEN place = 1 THEN hit1 END) AS part_rank1, max(CASE WHEN place = 1 THEN hit5 END) AS part_top5, max(CASE WHEN place = 1 THEN segs END) AS part_segments, max(CASE WHEN place = 2 THEN rate END) AS part_runner,
  coalesce(max(CASE WHEN place = 2 THEN score_sum END) / nullif(max(CASE WHEN place = 1 THEN score_sum END), 0), 0) AS part_runner_ratio FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY round(score_sum, 9) DESC, rate) AS place FROM
  (SELECT track, rate, sum(score) AS score_sum, max(score) AS best, CAST(count(CASE WHEN rank = 1 THEN 1 END) AS DOUBLE) AS hit1, CAST(count(CASE WHEN rank <= 5 THEN 1 END) AS DOUBLE) AS hit5, CAST(count(DISTINCT segment) AS DOUBLE) AS segs FROM {partial} GROUP BY track, rate) AS q1) AS q2 WHERE place <= 2 GROUP BY track"""
#: A track's best partial bars as the releases after the policy ask for them; a bar's exact rate stands near it.
_TOPS = f"""SELECT q2.track AS track, q2.rate + CAST(q2.track % 3 AS DOUBLE) * 0.25 AS rate, q2.rate AS coarse, least(best * 4, CAST(1 AS DOUBLE)) AS local, score_sum, coalesce(score_sum / nullif(most, 0), 0) AS score_ratio, place AS family_rank, hit5 AS top5, segs AS segments, total, current_rate AS board_rate
  FROM (SELECT *, max(score_sum) OVER (PARTITION BY track) AS most, max(segs) OVER (PARTITION BY track) AS total, row_number() OVER (PARTITION BY track ORDER BY round(score_sum, 9) DESC, rate) AS place FROM
  (SELECT track, rate, sum(score) AS score_sum, max(score) AS best, count(CASE WHEN rank <= 5 THEN 1 END) AS hit5, count(DISTINCT segment) AS segs FROM {{partial}} GROUP BY track, rate) AS q1) AS q2 JOIN {{decided}} AS d ON q2.track = d.track WHERE place <= {releases.KEPT}"""
_TOP = """SELECT track, max(CASE WHEN family_rank = 1 THEN rate END) AS fam_rate, max(CASE WHEN family_rank = 1 THEN score_sum END) AS fam_score, coalesce(max(CASE WHEN family_rank = 2 THEN score_sum END), 0) AS fam_runner, max(CASE WHEN family_rank = 1 THEN support END) AS fam_support,
  max(CASE WHEN family_rank = 1 THEN candidate_support END) AS fam_candidates, count(CASE WHEN abs(rate / nullif(top, 0) - CAST(1.5 AS DOUBLE)) <= 0.03 THEN 1 END) > 0 AS fam_halves FROM (SELECT *, max(CASE WHEN family_rank = 1 THEN rate END) OVER (PARTITION BY track) AS top FROM {families}) AS q GROUP BY track"""
_SHARES = "SELECT track, CAST(count(DISTINCT segment) AS DOUBLE) AS shares_total, CAST(count(DISTINCT CASE WHEN winner THEN segment END) AS DOUBLE) AS shares_won FROM {rows} GROUP BY track"
_FAMILIES = "SELECT t.track, fam_rate, fam_score, fam_runner, fam_support / nullif(shares_total, 0) AS fam_consensus, coalesce(fam_candidates / nullif(shares_won, 0), 0) AS fam_winners, shares_won / nullif(shares_total, 0) AS fam_share, fam_halves FROM {top} AS t JOIN {shares} AS s ON t.track = s.track"
_ROUTED = f"SELECT r.*, coalesce(fam_rate, 0) AS fam_rate, coalesce(fam_score, 0) AS fam_score, coalesce(fam_runner, 0) AS fam_runner, coalesce(fam_consensus, 0) AS fam_consensus, coalesce(fam_winners, 0) AS fam_winners, coalesce(fam_share, 0) AS fam_share, coalesce(fam_halves, FALSE) AS fam_halves FROM {{routes}} AS r LEFT JOIN {{families}} AS f ON r.track = f.track"
#: The full board: base, as each value stands to the track's largest, less what relations cost; then the board's order.
_COST = f"CASE WHEN (bits & {_D}) <> 0 THEN CAST(-0.05 AS DOUBLE) WHEN (bits & {relations.mask('one_third', 'quarter', 'triple')}) <> 0 THEN CAST(0.18 AS DOUBLE) WHEN (bits & {relations.mask('half', 'double_time')}) <> 0 THEN CAST(0.10 AS DOUBLE) ELSE CAST(0.04 AS DOUBLE) END"
_PART = lambda x: f"coalesce({x} / nullif(max({x}) OVER (PARTITION BY track), 0), 0)"
_LOG = "ln(greatest(score_sum, 0) + 1)"
_BASE = f"{_PART('best_score')} * CAST(0.5 AS DOUBLE) + {_PART('cont')} + {_PART(_LOG)} * CAST(0.5 AS DOUBLE) - {_COST}"
FULL = f"SELECT *, row_number() OVER (PARTITION BY track ORDER BY base DESC, support DESC, winner_support DESC, best_score DESC, rate) AS place FROM (SELECT *, round({_BASE}, 9) AS base FROM {{board}}) AS q"
KNOWN = {"rate": "rate", "cluster": "rate", "place": "place", "bits": "bits", "support": "support", "winner": "winner_support", "local": "best_score", "base": "base", "pulse": "pulse", "pulse_section": "section", "cont": "cont", "cont_section": "cont_section", "cont_ratio": "cont_ratio", "cont_stab": "cont_stab", "evidence": "evidence"}
MEASURED = f"SELECT b.track, {', '.join(f'b.{v} AS k_{k}' for k, v in KNOWN.items())}, coalesce(f.family, 0) AS k_family FROM {{full}} AS b LEFT JOIN {{partners}} AS f ON b.track = f.track AND b.rate = f.rate"
_ZERO, _NO = "CAST(0 AS DOUBLE)", "FALSE"
CONTEXT = {
    "cur_rate": "rate", "cur_local": "best_score", "cur_support": "support", "hold_soft": "hold_centre OR hold_alias", "slow_lane": "lane = 'low_pulse'", "spread": "(high - low) * CAST(0.5 AS DOUBLE)", "fam_ok": "fam_rate > 0", "cur_cont": "cont", "cur_cont_ratio": "cont_ratio", "cur_cont_section": "cont_section", "low_support": "slow",
    "part_ok": "part_coarse IS NOT NULL", "part_exact": "part_coarse + CAST(s.track % 3 AS DOUBLE) * 0.25", "part_total": "windows", **{f"probe_{c}": _ZERO for c in ("context", "rate", "current", "local", "ratio", "candidates", "peaks", "inner", "span")}, "probe_ok": _NO,
}
DECIDED_BY = f"SELECT s.track, {', '.join(f'{CONTEXT.get(k, k)} AS {k}' for k in gates.CONTEXT)} FROM {{selected}} AS s LEFT JOIN {{parts}} AS p ON s.track = p.track"


def _raw(spark, d):  # noqa: ANN001, ANN202
    found = inputs.by_track(spark.sql(CONTINUOUS, lineitem=inputs.table(spark, d, "lineitem")), spark, d)
    return primary.raw_evidence(inputs.candidates(spark, d), _pulse(spark, d), found)


def _partial(spark, d):  # noqa: ANN001, ANN202
    return inputs.by_track(spark.sql(PARTIAL, lineitem=inputs.table(spark, d, "lineitem")), spark, d)


def _routes(spark, d):  # noqa: ANN001, ANN202
    rows = inputs.candidates(spark, d)
    top = spark.sql(_TOP, families=families.families(rows.where("score > 0"), tasks=inputs.tasks(spark, d)))
    found = spark.sql(_FAMILIES, top=top, shares=spark.sql(_SHARES, rows=rows))
    return spark.sql(_ROUTED, routes=inputs.by_track(spark.sql(ROUTES, orders=inputs.table(spark, d, "orders")), spark, d), families=found)


def _selected(board_, routes, tasks):  # noqa: ANN001, ANN202
    return primary.select(board_, routes, EXACT_RATE, EXACT_LOCAL, tasks)


def _candidates(spark, d):  # noqa: ANN001, ANN202
    """The board, routes, written once in buckets by track, and how many."""
    n = inputs.tasks(spark, d)
    routes = staged(_routes(spark, d), "routes", "track", n)
    return primary.candidates(_raw(spark, d), routes), routes, n


def primary_select(spark, d):  # noqa: ANN001, ANN201
    return _selected(*_candidates(spark, d)).select("track", "lane", "selector", "rate", "bits", "held", "reason")


def _full(board_):  # noqa: ANN001, ANN202
    """The candidates of board_ as the policy knows them, by FULL: track and KNOWN as k_name."""
    order = [F.desc("base"), F.desc("support"), F.desc("winner_support"), F.desc("best_score"), F.asc("rate")]
    rows = board_.withColumns({"base": F.expr(_BASE), "evidence": F.expr(primary.EVIDENCE_SCORE)}).withColumns({c: rounded(F.col(c), 9) for c in ("base", "evidence")})
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy(*order)))
    return rows.select("track", *[F.col(v).alias(f"k_{k}") for k, v in KNOWN.items()])


def _measured(board_, selected):  # noqa: ANN001, ANN202
    """_full() with k_family. Only a hold for exactness asks for harmonic partners, so other tracks pass as they are; a partner's strength meets
    its rate in a sum by track and rate, which the partitions by track serve (a join by both would shuffle the board)."""
    held = selected.where("hold_exact").select("track").hint("shuffle_hash")
    others = _full(board_.join(held, "track", "left_anti")).withColumn("k_family", F.lit(0.0))
    asked = _full(board_.join(held, "track", "left_semi"))
    partners = board.release_features(asked.select("track", F.col("k_rate").alias("rate"), F.col("k_base").alias("base"), F.col("k_local").alias("local"), F.col("k_support").alias("support")), 130.0, 45.0)
    found = partners.select("track", F.col("rate").alias("k_rate"), rounded(F.col("family"), 9).alias("k_family"))
    rest = [c for c in asked.columns if c not in ("track", "k_rate")]
    both = asked.withColumn("k_family", F.lit(0.0)).unionByName(found, allowMissingColumns=True)
    return others.unionByName(both.groupBy("track", "k_rate").agg(*[F.max(c).alias(c) for c in (*rest, "k_family")]).select(others.columns))


def _chain(spark, d):  # noqa: ANN001, ANN202
    """(decisions, measured candidates, context) of all tracks."""
    board_, routes, n = _candidates(spark, d)
    board_ = staged(board_, "board", "track", n)
    selected = staged(_selected(board_, routes, n), "selected", "track", n)
    measured = staged(_measured(board_, selected), "measured", "track", n)
    parts = spark.sql(_PARTS, partial=_partial(spark, d))
    more = routes.select("track", "fam_winners", "fam_share", "fam_halves")
    context = staged(spark.sql(DECIDED_BY, selected=selected.join(more.hint("shuffle_hash"), "track"), parts=parts.hint("shuffle_hash")), "context", "track", n)
    return gates.decide(measured, context, tasks=n), measured, context


def decision_chain(spark, d):  # noqa: ANN001, ANN201
    return _chain(spark, d)[0]


def decision_released(spark, d):  # noqa: ANN001, ANN201
    decided, measured, context = _chain(spark, d)
    n = inputs.tasks(spark, d)
    decided, context = staged(decided, "decided", "track", n), context.select("track", "centre", "spread", "matched", "generic")
    top = staged(spark.sql(_TOPS, partial=_partial(spark, d), decided=decided), "partial-bars", "track", n)
    return releases.cross_view(releases.exact_top(decided, context, top), measured, top)


def gate_counts(spark, d):  # noqa: ANN001, ANN201
    return decision_chain(spark, d).groupBy("reason", "written_as").agg(F.count("*").alias("tracks"))


def alias_competition(spark, d):  # noqa: ANN001, ANN201
    rows = inputs.candidates(spark, d)
    shares = spark.sql(_SHARES, rows=rows).select("track", F.col("shares_total").alias("windows"), F.col("shares_won").alias("won"))
    routes = inputs.by_track(spark.sql(ROUTES, orders=inputs.table(spark, d, "orders")), spark, d)
    found = competition.options(families.families(rows.where("score > 0"), tasks=inputs.tasks(spark, d)), shares, routes)
    return competition.winners(found).withColumns({c: F.round(c, 4) for c in ("family_rate", "rate", "score", "runner_up_ratio")})


_PRIOR = "CASE relation " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in competition.PRIOR.items()) + " END"
_OPTIONS = f"""c AS ({CANDIDATES}), {fold_sql('SELECT * FROM c')}, sh AS ({_SHARES.replace('{rows}', 'c')}), ro AS ({ROUTES.replace('{orders}', 'orders')}),
f1 AS (SELECT track, max(CASE WHEN family_rank = 1 THEN score_sum END) AS top, coalesce(max(CASE WHEN family_rank = 2 THEN score_sum END), 0) AS runner, max(CASE WHEN family_rank = 1 THEN support END) AS consensus, max(CASE WHEN family_rank = 1 THEN candidate_support END) AS first_support FROM fam GROUP BY track),
op AS (SELECT fam.track, family_rank, fam.rate AS family_rate, relation, fam.rate * ratio AS rate, round(abs(fam.rate * ratio - (low + high) * 0.5::DOUBLE), 9) AS distance, shares_won / shares_total AS share, first_support / shares_won AS support_1,
  round(score_sum / top * 42 + support / shares_won * 30 + (0.4::DOUBLE * least(1, greatest(0, consensus / shares_total)) + 0.35::DOUBLE * least(1, greatest(0, ln(1 + CASE WHEN runner > 0 THEN top / runner ELSE top END) / ln(9))) + 0.25::DOUBLE * least(1, greatest(0, 1 - runner / top))) * 20
  + {_PRIOR} * 13 + greatest(0, 1 - least(1, abs(fam.rate * ratio - (low + high) * 0.5::DOUBLE) / (greatest(1, high - low) * 0.5::DOUBLE))) * 7 - (family_rank - 1) * 1.75::DOUBLE, 9) AS score
  FROM fam JOIN f1 USING (track) JOIN sh USING (track) JOIN ro USING (track), {relations.sql_values()} WHERE top > 0 AND shares_won > 0 AND score_sum > 0 AND fam.rate * ratio BETWEEN greatest(low, 40) AND least(high, 220)),
ow AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS next, count(*) OVER (PARTITION BY track) AS options FROM op WINDOW w AS (PARTITION BY track ORDER BY score DESC, family_rank, distance, rate))"""
_B = primary.Primary(spark=False)
_G = gates.Engine(spark=False)
RAW = f"""c AS ({CANDIDATES}), {_PULSE}, cn AS ({CONTINUOUS.replace('{lineitem}', 'lineitem')}), x AS (SELECT track, round(rate * ratio / 0.25) * 0.25 AS rate, bit, segment, winner, score, quant FROM c, {relations.sql_values()} WHERE rate * ratio BETWEEN 40 AND 220),
mm AS (SELECT track, rate, bit, segment, CASE WHEN winner THEN segment END AS won, 1 AS rows, score AS score_sum, quant AS quant_sum, score AS best_score, 0::DOUBLE AS least_support, 0::DOUBLE AS pulse, 0::DOUBLE AS section, 0::DOUBLE AS cont, 0::DOUBLE AS cont_section, 0::DOUBLE AS cont_ratio, 0::DOUBLE AS cont_stab FROM x
  UNION ALL SELECT track, rate, bit, NULL, NULL, 0, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, pulse, section, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE, 0::DOUBLE FROM pu UNION ALL SELECT track, rate, bit, NULL, NULL, 1, cont, 0::DOUBLE, cont, least(greatest(cont, 0), 1), 0::DOUBLE, 0::DOUBLE, cont, cont_section, cont_ratio, cont_stab FROM cn),
tw AS (SELECT track, count(DISTINCT segment)::DOUBLE AS windows FROM x GROUP BY track),
raw AS (SELECT track, any_value(coalesce(windows, 0)) AS windows, rate, bit, greatest(coalesce(count(DISTINCT segment) / nullif(any_value(windows), 0), 0), max(least_support)) AS support, coalesce(count(DISTINCT won) / nullif(any_value(windows), 0), 0) AS winner_support, sum(rows) AS rows, sum(score_sum) AS score_sum, sum(quant_sum) AS quant_sum, max(best_score) AS best_score,
  {', '.join(f'max({c}) AS {c}' for c in primary.EVIDENCE)} FROM mm LEFT JOIN tw USING (track) GROUP BY track, rate, bit)"""
ROUTED = f"{fold_sql('SELECT * FROM c')}, ro AS ({ROUTES.replace('{orders}', 'orders')}), tp AS ({_TOP.replace('{families}', 'fam')}), sh AS ({_SHARES.replace('{rows}', 'c')}), fs AS ({_FAMILIES.replace('{top}', 'tp').replace('{shares}', 'sh')}), rt AS ({_ROUTED.replace('{routes}', 'ro').replace('{families}', 'fs')})"
SELECTED = f"{RAW}, {ROUTED}, cb AS MATERIALIZED ({_B.candidates('raw', 'rt')}), se0 AS MATERIALIZED ({_B.selected('cb')}), se AS MATERIALIZED ({_B.held('se0', EXACT_RATE, EXACT_LOCAL)})"
_PARTNERS = """ak AS (SELECT track, rate, base / (CASE WHEN max(base) OVER w > 0 THEN max(base) OVER w ELSE 1 END) AS base FROM fu WHERE track IN (SELECT track FROM se WHERE hold_exact) WINDOW w AS (PARTITION BY track)),
pn AS (SELECT a.track, a.rate, round(greatest(max(b.base * (1 - abs(b.rate / a.rate - q) / q / 0.018::DOUBLE)), 0), 9) AS family FROM ak a JOIN ak b ON a.track = b.track AND b.rate > a.rate, (VALUES (4 / 3::DOUBLE), (1.5::DOUBLE), (2::DOUBLE), (3::DOUBLE), (4::DOUBLE)) r(q) WHERE abs(b.rate / a.rate - q) / q < 0.018::DOUBLE GROUP BY a.track, a.rate)"""
CHAIN = f"""{SELECTED}, fu AS MATERIALIZED ({FULL.replace('{board}', 'cb')}), {_PARTNERS}, me AS MATERIALIZED ({MEASURED.replace('{full}', 'fu').replace('{partners}', 'pn')}), pt AS ({_PARTS.replace('{partial}', f'({PARTIAL.replace("{lineitem}", "lineitem")}) AS pl')}),
sx AS (SELECT se.*, fam_winners, fam_share, fam_halves FROM se JOIN rt USING (track)), cx AS MATERIALIZED ({DECIDED_BY.replace('{selected}', 'sx').replace('{parts}', 'pt')}), fa AS MATERIALIZED ({_G.facts('me', 'cx')}), ch AS MATERIALIZED ({_G.chosen('me', 'fa')}), de AS MATERIALIZED ({_G.decided('ch')}), fi AS ({_G.final('de')})"""

_T, _X = releases.TOP, releases.CROSS
_ERR = "least(" + ", ".join(f"abs(greatest(rate, board_rate) / nullif(least(rate, board_rate), 0) / {q} - 1)" for q in ("(4 / 3::DOUBLE)", "1.5::DOUBLE", "2::DOUBLE")) + ")"
_SURE = "round(least(99, greatest(50, support * 45 + local * 20 + 45)), 6)"
RELEASED = f"""{CHAIN}, fz AS MATERIALIZED (SELECT * FROM fi), tz AS (SELECT * FROM ({_TOPS.replace('{partial}', f'({PARTIAL.replace("{lineitem}", "lineitem")}) AS pl').replace('{decided}', 'fz')})),
e0 AS (SELECT tz.*, max(local) OVER (PARTITION BY tz.track) AS best_local, abs(tz.rate - centre) / spread AS z FROM tz JOIN fz USING (track) JOIN cx ON cx.track = tz.track WHERE fz.reason = 'family_conflict_hold' AND cx.matched AND NOT cx.generic AND centre > 0 AND spread > 0 AND tz.rate > 0 AND total > 0),
e1 AS (SELECT *, segments / total AS support, {_ERR} <= {_T['relation']} AND z <= {_T['rational_z']} AS rational FROM e0 WHERE top5 >= 1 AND segments / total >= 1 AND local >= {_T['local']} AND score_ratio >= {_T['ratio']} AND local / nullif(best_local, 0) >= {_T['to_max']}),
e2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY rational DESC, local DESC, score_ratio DESC, family_rank, rate) AS n FROM e1 WHERE rational OR z <= {_T['centre_z']}) WHERE n = 1),
d1 AS (SELECT fz.track, CASE WHEN e2.rate IS NULL THEN reason WHEN rational THEN 'exact_rational_release' ELSE 'exact_centre_release' END AS reason, coalesce(e2.rate, final_rate) AS final_rate, would_write OR e2.rate IS NOT NULL AS would_write, e2.rate AS new_rate, {_SURE} AS sure, action, kind, candidate_rate, current_rate, written_as, confidence FROM fz LEFT JOIN e2 USING (track)),
d2 AS (SELECT track, reason, CASE WHEN new_rate IS NULL THEN action ELSE 'override' END AS action, CASE WHEN new_rate IS NULL THEN kind ELSE 'override' END AS kind, coalesce(new_rate, candidate_rate) AS candidate_rate, current_rate, final_rate, would_write, CASE WHEN new_rate IS NULL THEN written_as ELSE 'override' END AS written_as, CASE WHEN new_rate IS NULL THEN confidence ELSE sure END AS confidence FROM d1),
v AS (SELECT * FROM (SELECT d2.track, k_rate, k_support AS support, k_local AS local, row_number() OVER (PARTITION BY d2.track ORDER BY round(score_sum, 9) DESC, round(abs(k_rate - coarse), 9), k_rate DESC, coarse DESC) AS n FROM d2 JOIN me USING (track) JOIN tz USING (track) WHERE would_write AND final_rate > 0 AND k_rate / final_rate BETWEEN {_X['family'][0]}::DOUBLE AND {_X['family'][1]}::DOUBLE
  AND k_local >= {_X['local']} AND k_support >= {_X['support']} AND k_cont >= {_X['cont']} AND k_cont_section >= {_X['cont_section']} AND score_ratio >= {_X['ratio']} AND top5 / total >= {_X['top5']} AND segments / total >= {_X['segments']} AND round(abs(k_rate - coarse), 9) <= {_X['bridge']}) WHERE n = 1)"""
QUERIES = {f.__name__: f for f in (primary_select, decision_chain, decision_released, gate_counts, alias_competition)}
ORACLE = {
    "primary_select": f"WITH RECURSIVE {SELECTED} SELECT track, lane, selector, rate, bits, held, reason FROM se",
    "decision_chain": f"WITH RECURSIVE {CHAIN} SELECT * FROM fi",
    "decision_released": f"""WITH RECURSIVE {RELEASED} SELECT track, CASE WHEN k_rate IS NULL THEN reason ELSE 'cross_view_release' END AS reason, CASE WHEN k_rate IS NULL THEN action ELSE 'override' END AS action, CASE WHEN k_rate IS NULL THEN kind ELSE 'override' END AS kind, coalesce(k_rate, candidate_rate) AS candidate_rate, current_rate,
      coalesce(k_rate, final_rate) AS final_rate, would_write, CASE WHEN k_rate IS NULL THEN written_as ELSE 'override' END AS written_as, CASE WHEN k_rate IS NULL THEN confidence ELSE {_SURE} END AS confidence FROM d2 LEFT JOIN v USING (track)""",
    "alias_competition": f"""WITH RECURSIVE {_OPTIONS} SELECT track, options, family_rank::INT AS family_rank, round(family_rate, 4) AS family_rate, relation, round(rate, 4) AS rate, round(score, 4) AS score, round(round(coalesce(next / score, 0), 9), 4) AS runner_up_ratio,
      family_rank = 1 AND relation = 'three_quarters' AND share >= 0.65 AND support_1 >= 0.85 AND coalesce(next / score, 0) <= 0.45 AND rate BETWEEN 40 AND 220 AS clear FROM ow WHERE place = 1""",
    "gate_counts": f"WITH RECURSIVE {CHAIN} SELECT reason, written_as, count(*) AS tracks FROM fi GROUP BY ALL",
}
