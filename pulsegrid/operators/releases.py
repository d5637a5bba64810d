"""Releases after the policy: partial bars that settle a held conflict of families, or bear out a faster candidate than the one written."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP = {"top5": 1, "segments": 1.0, "local": 0.175, "ratio": 0.50, "to_max": 0.95, "relation": 0.020, "rational_z": 1.0, "centre_z": 0.05}
CROSS = {"family": (1.55, 1.65), "local": 0.20, "support": 0.80, "cont": 0.20, "cont_section": 0.80, "ratio": 0.80, "top5": 0.25, "segments": 0.90, "bridge": 1.25}
#: Rates of partial bars that a track brings at most, as partial_bars() keeps them.
KEPT = 16


def _relation_error(a: Column, b: Column) -> Column:
    """How far two rates are from four thirds, three halves or twice each other, relative to it."""
    ratio = F.greatest(a, b) / F.nullif(F.least(a, b), F.lit(0.0))
    return F.least(*[F.abs(ratio / r - 1) for r in (4 / 3, 1.5, 2.0)])


def exact_top(decided: DataFrame, context: DataFrame, top: DataFrame) -> DataFrame:
    """decided with the conflicts that a partial bar settles, its rate written: one that stands in a simple relation to the board's, else one at the centre.

    decided: decide(); context: track, centre, spread, matched, generic; top: track, rate (exact), local, score_ratio, family_rank, top5, segments, total,
    board_rate, KEPT rows for a track at most. Only tracks held for a conflict of families, on a specific route, are looked at.
    """
    t = TOP
    open_ = decided.where("reason = 'family_conflict_hold'").select("track").join(context.where("matched AND NOT generic AND centre > 0 AND spread > 0").select("track", "centre", "spread"), "track")
    rows = top.join(open_, "track").where("rate > 0 AND total > 0")
    most = rows.groupBy("track").agg(F.max("local").alias("most"))
    fit = (F.col("top5") >= t["top5"]) & (F.col("segments") / F.col("total") >= t["segments"]) & (F.col("local") >= t["local"]) & (F.col("score_ratio") >= t["ratio"]) & (F.col("local") / F.nullif("most", F.lit(0.0)) >= t["to_max"])
    z = F.abs(F.col("rate") - F.col("centre")) / F.col("spread")
    order = F.struct("local", "score_ratio", (-F.col("family_rank")).alias("r"), (-F.col("rate")).alias("x"))
    picked = F.struct("rate", (F.col("segments") / F.col("total")).alias("support"), "local")
    rational = fit & (_relation_error(F.col("rate"), F.col("board_rate")) <= t["relation"]) & (z <= t["rational_z"])
    best = rows.join(most, "track").groupBy("track").agg(F.max_by(picked, F.when(rational, order)).alias("rational"), F.max_by(picked, F.when(fit & (z <= t["centre_z"]), order)).alias("centred"))
    name = F.when(F.col("rational").isNotNull(), "exact_rational_release").otherwise("exact_centre_release")
    found = best.select("track", F.coalesce("rational", "centred").alias("p"), name.alias("new_reason")).where("p IS NOT NULL")
    return _replaced(decided, found)


def cross_view(decided: DataFrame, board: DataFrame, top: DataFrame) -> DataFrame:
    """decided with the written rates that a candidate of the board eight fifths as fast replaces, where a partial bar stands near that.

    board: track and k_ fields as decide() has them; top: as for exact_top(), with coarse, score_sum. Of several the one with the partial bar of the greatest
    sum, then the nearer, then the faster.
    """
    c = CROSS
    written = decided.where("would_write AND final_rate > 0").select("track", "final_rate")
    fast = board.select("track", "k_rate", "k_local", "k_support", "k_cont", "k_cont_section").join(written, "track")
    fast = fast.where((F.col("k_rate") / F.col("final_rate")).between(*c["family"]) & (F.col("k_local") >= c["local"]) & (F.col("k_support") >= c["support"]) & (F.col("k_cont") >= c["cont"]) & (F.col("k_cont_section") >= c["cont_section"]))
    near = top.where((F.col("score_ratio") >= c["ratio"]) & (F.col("top5") / F.col("total") >= c["top5"]) & (F.col("segments") / F.col("total") >= c["segments"])).select("track", "coarse", "score_sum")
    gap = F.round(F.abs(F.col("k_rate") - F.col("coarse")), 9)
    met = fast.join(near, "track").where(gap <= c["bridge"])
    best = met.groupBy("track").agg(F.max_by(F.struct(F.col("k_rate").alias("rate"), F.col("k_support").alias("support"), F.col("k_local").alias("local")), F.struct(F.round("score_sum", 9).alias("s"), (-gap).alias("g"), "k_rate", "coarse")).alias("p"))
    return _replaced(decided, best.select("track", "p", F.lit("cross_view_release").alias("new_reason")))


def _replaced(decided: DataFrame, found: DataFrame) -> DataFrame:
    """decided with the rate, reason and confidence of what was found for a track; the rest as it was."""
    j = decided.join(found, "track", "left")
    hit = F.col("p").isNotNull()
    sure = F.round(F.least(F.lit(99.0), F.greatest(F.lit(50.0), F.col("p.support") * 45 + F.col("p.local") * 20 + 45)), 6)
    new = {"reason": F.col("new_reason"), "action": F.lit("override"), "kind": F.lit("override"), "candidate_rate": F.col("p.rate"), "final_rate": F.col("p.rate"), "would_write": F.lit(True), "written_as": F.lit("override"), "confidence": sure}
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in decided.columns])
