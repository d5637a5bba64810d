"""Candidate selectors from fixed tables: a score is a weighted sum of named features, a rule a list of bounds, one row by track wins.

A selector is a table of (feature, weight); the features of a candidate are in FEATURES, as Spark columns and as SQL. All selectors of a
track are evaluated in one aggregation by track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import relations
from pulsegrid.functions.relations import bit, has, mask
from pulsegrid.operators.board import evidence, lanes

NEAR = ("two_thirds", "three_quarters", "three_halves", "four_thirds")
PRODUCTION = ("equivalent", "half", "double_time", *NEAR)

_EVERY = relations.mask(*PRODUCTION)
#: Named features of a candidate; {c} is the centre of its route. One text serves both engines.
FEATURES = {
    "support": "support", "winner": "winner_support", "best": "best_score", "pulse": "pulse", "section": "section", "log_sum": "ln(greatest(score_sum, 0) + 1)",
    "direct": f"CASE WHEN bits & {bit('equivalent')} <> 0 THEN 1 ELSE 0 END", "near": f"CASE WHEN bits & {mask(*NEAR)} <> 0 THEN 1 ELSE 0 END",
    "relations": f"least(3, bit_count(bits & {_EVERY}))", "distance": "abs(rate - {c})", "far_above": "CASE WHEN rate > {c} + 20 THEN 1 ELSE 0 END",
    "from_68": "abs(rate - 68)", "in_48_86": "CASE WHEN rate BETWEEN 48 AND 86 THEN 1 ELSE 0 END", "over_115": "CASE WHEN rate > 115 THEN 1 ELSE 0 END",
    "slow_relation": f"CASE WHEN bits & {mask('one_third', 'two_thirds', 'three_quarters')} <> 0 THEN 1 ELSE 0 END",
    "direct_150": f"CASE WHEN rate >= 150 AND bits & {bit('equivalent')} <> 0 THEN 1 ELSE 0 END", "other_145": f"CASE WHEN rate >= 145 AND NOT (rate >= 150 AND bits & {bit('equivalent')} <> 0) THEN 1 ELSE 0 END",
    "under_118": "CASE WHEN rate < 118 THEN 1 ELSE 0 END", "weak": "CASE WHEN support < 0.12 THEN 1 ELSE 0 END",
}
CLUSTER = {"support": 8.0, "winner": 1.5, "log_sum": 1.5, "best": 3.0, "relations": 0.7, "direct": 1.2, "distance": -0.040}
LANES = {
    "low_pulse": {"from_68": -0.065, "in_48_86": 2.5, "over_115": -7.0, "slow_relation": 0.8},
    "high_pulse": {"direct_150": 4.0, "other_145": 1.0, "under_118": -4.0},
    "harmonic_conflict": {"distance": -0.10, "direct": 0.8},
    "sparse": {"weak": -2.0, "distance": -0.05},
}
#: Weights of the harmonic selector (C7) and of the selector around 144 (C8).
HARMONIC = {"support": 5.0, "winner": 0.8, "best": 14.0, "pulse": 8.0, "section": 5.0, "log_sum": 0.4, "distance": -0.035, "direct": 0.4, "near": 0.4, "far_above": -1.2}
SOFT = {"support": 5.5, "winner": 1.0, "best": 15.0, "pulse": 5.0, "section": 6.0, "log_sum": 0.7, "direct": 0.5, "near": 0.2, "distance": -0.025}
#: Where the pool around 144 stands, what is 144, the gain that a switch needs, and what a section counts as evidence (C8).
SOFT_POOL, AT_144, SWITCH, SECTION = (126.0, 141.5), (143.0, 145.0), 1.20, 0.12
#: Bounds of the rescue of a slow winner near 98 (C6), of 120 to 128 and of two thirds (C9); (feature, least, most).
SLOW_RESCUE = {"most": 90.0, "rate": (95.0, 102.0), "apart": 10.0, "ratio": 1.50, "support": 0.80, "stability": 0.70}
FAST_RESCUE = {"from": (118.0, 122.0), "to": (126.0, 130.5), "support": 0.60, "best": 0.18, "section": 0.55, "gain": 1.25}
LOWER_RESCUE = {"least": 84.0, "ratio": (0.64, 0.69), "support": 0.85, "winner": 0.25, "best": 0.08, "gain": 0.55, "section_below": 0.60}
#: The bonus of a centre (C13), its least spread, the margin that it can't turn and a fast winner that it can't.
CENTRE = {"bonus": 0.08, "spread": 12.0, "margin": 0.25, "rate": 155.0, "support": 0.70, "winner_support": 0.55}
#: Weights of the measured evidence with all of its parts (C12).
MEASURED = {"support": 0.34, "winner": 0.24, "best": 0.14, "pulse": 0.13, "section": 0.10, "continuous": 0.03, "share": 0.02}


def sql_score(weights: dict[str, float], centre: float) -> str:
    """The weighted sum as SQL that both engines read."""
    d = lambda v: f"CAST({v} AS DOUBLE)"
    return " + ".join(f"{d(w)} * {d('(' + FEATURES[f].format(c=centre) + ')')}" for f, w in weights.items())


def lane_score(weights: dict[str, float], centre: float) -> str:
    """The weighted sum with what the candidate's lane adds."""
    extra = " ".join(f"WHEN lane = '{k}' THEN {sql_score(v, centre)}" for k, v in LANES.items())
    return f"{sql_score(weights, centre)} + CASE {extra} ELSE CAST(0 AS DOUBLE) END"


def scored(candidates: DataFrame, raw: DataFrame, centre: float = 130.0) -> DataFrame:
    """candidates of the merged board with their lane, the scores of the selectors and their evidence, ties rounded away."""
    rows = evidence(candidates).join(lanes(raw).select("track", "lane"), "track")
    made = {"cluster": lane_score(CLUSTER, centre), "harmonic": sql_score(HARMONIC, centre), "soft": sql_score(SOFT, centre)}
    rows = rows.withColumns({k: F.round(F.expr(v), 9) for k, v in made.items()})
    return rows.withColumn("proof", F.round(F.col("best_score") + F.col("section") * SECTION, 9))


def slow_rescue(candidates: DataFrame, winners: DataFrame, centre: float = 99.0) -> DataFrame:
    """(track, rate): for a slow winner (track, rate as won) the candidate near 98 that continuous evidence (ratio, support, stability) bears out."""
    b = SLOW_RESCUE
    fit = (F.col("won") <= b["most"]) & F.col("rate").between(*b["rate"]) & (F.abs(F.col("rate") - F.col("won")) >= b["apart"]) & (F.col("ratio") >= b["ratio"]) & (F.col("support") >= b["support"]) & (F.col("stability") >= b["stability"])
    order = F.struct("ratio", "support", "stability", F.col("score"), (-F.abs(F.col("rate") - centre)).alias("d"), (-F.col("rate")).alias("r"))
    return candidates.join(winners, "track").where(fit).groupBy("track").agg(F.max_by("rate", order).alias("rate"))


def measured(candidates: DataFrame) -> DataFrame:
    """Adds measured: the evidence that no routing bears on, with pulse, sections and continuous evidence in full."""
    top = F.max("score_sum").over(Window.partitionBy("track"))
    share = F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score_sum") / F.nullif(top, F.lit(0.0)))), F.lit(0.0))
    m = MEASURED
    parts = F.col("support") * m["support"] + F.col("winner_support") * m["winner"] + F.col("best_score") * m["best"] + F.col("pulse") * m["pulse"] + F.col("section") * m["section"] + F.col("continuous") * m["continuous"] + share * m["share"]
    return candidates.withColumn("measured", F.round(parts, 9))


def soft_centre(candidates: DataFrame, centre: float, width: float) -> DataFrame:
    """(track, rate, measured_rate, margin, moved): the best measured candidate once the nearness to a soft centre counts a little.

    A winner that leads by more than the margin, or a fast and well supported one, isn't moved. candidates: measured().
    """
    b = CENTRE
    z = (F.col("rate") - centre) / max(b["spread"], width / 2)
    soft = F.round(F.col("measured") + F.exp(z * z * -0.5) * b["bonus"], 9)
    ties = lambda s: F.struct(s.alias("s"), F.col("support"), F.col("winner_support"), F.col("section"), F.col("best_score"), F.round("score_sum", 9).alias("q"), (-F.col("rate")).alias("r"))
    own = F.struct("rate", "support", "winner_support", "bits", "measured")
    two = F.slice(F.sort_array(F.collect_list("measured"), asc=False), 1, 2)  # a number for each rate of a track, 721 at most
    out = candidates.where(F.col("rate").between(*relations.RAIL)).groupBy("track").agg(F.max_by(own, ties(F.col("measured"))).alias("m"), F.max_by("rate", ties(soft)).alias("soft"), two.alias("two"))
    margin = F.element_at("two", 1) - F.coalesce(F.get("two", F.lit(1)), F.lit(0.0))
    immune = (F.col("m.rate") >= b["rate"]) & (F.col("m.support") >= b["support"]) & (F.col("m.winner_support") >= b["winner_support"]) & has(F.col("m.bits"), "equivalent", "double_time", "four_thirds")
    keep = (margin > b["margin"]) | immune
    return out.select("track", F.when(keep, F.col("m.rate")).otherwise(F.col("soft")).alias("rate"), F.col("m.rate").alias("measured_rate"), F.round(margin, 9).alias("margin"), (~keep & (F.col("soft") != F.col("m.rate"))).alias("moved"))
