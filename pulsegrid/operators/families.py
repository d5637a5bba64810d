"""Families of rates: greedy clusters, their ranks and classes, partial bars gathered over windows, and what bears them out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import relations
from pulsegrid.functions.scalars import clamp, positive
from pulsegrid.operators import folds
from pulsegrid.operators.board import _bit

#: The weights of the evidence that a pulse has a rate.
PULSE_WEIGHTS = {"phase": 0.40, "axial": 0.25, "density": 0.15, "support": 0.10, "stability": 0.10}
#: What makes the evidence behind a resolved alias strong.
STRONG = {"consensus": 0.25, "dominance": 1.25, "runner_up": 0.80}
#: What a partial bar needs to bear out a candidate of the full board, and how far apart they may be.
CROSS_VIEW = {"score_ratio": 0.80, "top5_support": 0.25, "segment_support": 0.90, "bridge": 1.25}


def octave_of(rate: Column, reference: Column) -> Column:
    """The rate moved by octaves into half an octave around the reference."""
    return rate * F.pow(F.lit(2.0), -F.round(F.log2(rate / reference)))


def families(rows: DataFrame, tolerance: float = 2.0, keep: int = 4, tasks: int = 0) -> DataFrame:
    """(track, family_rank, rate, score_sum, best_score, support, candidate_support, best_rate) from (track, segment, rate, score, winner).

    A row joins the nearest family within tolerance; the order of windows, then of rates, is the fold's. Ranked by score sum, support and
    best score, then the lower rate. tasks: rows come dealt out by track to so many tasks, and families go back to as many.
    """
    out = folds.folded(rows.select("track", "segment", "rate", "score", "winner"), ["track"], ["segment", "rate"], lambda: folds.Families(tolerance), "rate double, score_sum double, best_score double, support long, candidate_support long, best_rate double", dealt=tasks > 0)
    out = out.repartition(tasks, "track") if tasks else out
    order = [F.desc(F.round("score_sum", 9)), F.desc("support"), F.desc("best_score"), F.asc("rate")]
    ranked = out.withColumn("family_rank", F.row_number().over(Window.partitionBy("track").orderBy(*order)))
    return ranked.where(F.col("family_rank") <= keep)


def family_class(ranked: DataFrame, windows: DataFrame, reference: float) -> DataFrame:
    """(track, rate, family_class): what a track's first family says of a reference rate. windows: track, total.

    A family that few windows support, or that hardly leads, says nothing.
    """
    first = ranked.where("family_rank = 1").select("track", "rate", "score_sum", "support")
    second = ranked.where("family_rank = 2").select("track", F.col("score_sum").alias("second"))
    j = first.join(second, "track", "left").join(windows, "track")
    near = lambda x: F.abs(F.col("rate") * x - reference) <= 2.0
    weak = (F.col("support") / F.col("total") < 0.35) | F.coalesce((F.col("second") > 0) & (F.col("score_sum") < F.col("second") * 1.25), F.lit(False))
    named = F.when(weak, "ambiguous").when(near(1.0), "supports_current").when(near(2.0), "supports_half").when(near(0.5), "supports_double").otherwise("supports_alternative")
    return j.select("track", "rate", named.alias("family_class"))


def resolve_alias(ranked: DataFrame, windows: DataFrame, low: float, high: float) -> DataFrame:
    """(track, input_rate, options, centre_relation, centre_rate, rate, reason): the one relation that brings a track's first family into a
    rail. Several are ambiguous; one alone also needs strong evidence. windows: track, total."""
    first = ranked.where("family_rank = 1").select("track", F.col("rate").alias("input_rate"), "score_sum", "support")
    second = ranked.where("family_rank = 2").select("track", F.col("score_sum").alias("second"))
    inside = relations.expand(F.col("input_rate"), low, high)
    j = first.join(second, "track", "left").join(windows, "track").withColumn("inside", inside).withColumn("second", F.coalesce("second", F.lit(0.0)))
    centre = (low + high) / 2
    near = F.array_min(F.transform("inside", lambda x: F.struct(F.round(F.abs(x["rate"] - centre), 9).alias("d"), x["bit"].alias("bit"), x["relation"].alias("relation"), x["rate"].alias("rate"))))
    share = F.col("second") / F.nullif("score_sum", F.lit(0.0))
    strong = (F.col("score_sum") > 0) & ((F.col("support") / F.col("total") >= STRONG["consensus"]) | F.coalesce(F.col("score_sum") / F.nullif("second", F.lit(0.0)) >= STRONG["dominance"], F.lit(False)) | F.coalesce((share > 0) & (share <= STRONG["runner_up"]), F.lit(False)))
    n = F.size("inside")
    reason = F.when(n == 0, "no_alias").when(n > 1, "ambiguous_alias").when(~strong, "weak_evidence").otherwise("unique_alias")
    out = j.select("track", "input_rate", n.alias("options"), near.alias("near"), F.when(n == 1, F.element_at("inside", 1)["rate"]).alias("rate"), reason.alias("reason"))
    return out.select("track", "input_rate", "options", F.col("near.relation").alias("centre_relation"), F.col("near.rate").alias("centre_rate"), "rate", "reason")


def partial_bars(rows: DataFrame, keep: int = 16) -> DataFrame:
    """The `keep` best rates of a track's partial bars, from (track, segment, rate, score, quant, meter, rank).

    Rates are equal to a thousandth. One row each: sums of score, means of quant and meter, how often first and among the first five, windows,
    the score against the best, and the runner-up's against the winner's.
    """
    sums = rows.where(positive(F.col("rate"))).groupBy("track", F.round("rate", 3).alias("rate")).agg(
        F.sum("score").alias("score_sum"), F.avg("quant").alias("quant"), F.avg("meter").alias("meter"), F.count("*").alias("rows"),
        F.count_if(F.col("rank") == 1).alias("rank1_hits"), F.count_if(F.col("rank") <= 5).alias("top5_hits"), F.bit_count(F.bit_or(_bit(F.col("segment")))).cast("long").alias("segments"),
    )
    w = Window.partitionBy("track").orderBy(F.desc(F.round("score_sum", 9)), "rate")
    out = sums.withColumn("place", F.row_number().over(w)).withColumn("families", F.count("*").over(Window.partitionBy("track")))
    top = F.first("score_sum").over(w)
    out = out.withColumn("ratio_to_top", F.when(top > 0, F.col("score_sum") / F.nullif(top, F.lit(0.0))).otherwise(0.0))
    second = F.max(F.when(F.col("place") == 2, F.col("ratio_to_top"))).over(Window.partitionBy("track"))
    return out.withColumn("runner_up_ratio", F.coalesce(second, F.lit(0.0))).where(F.col("place") <= keep)


def cross_view(board: DataFrame, partial: DataFrame, windows: DataFrame) -> DataFrame:
    """(track, rate, partial_rate, bridge): candidates of the full board (track, rate, base, support) that a partial bar near them bears out.

    A join by track, of which the board keeps its partitions: a track has 721 rates and partial_bars() gives 16 at most. Of a track, the strongest: by base, support, then the partial bar's score and the smaller gap.
    """
    b = CROSS_VIEW["bridge"]
    good = partial.join(windows, "track").where((F.col("ratio_to_top") >= CROSS_VIEW["score_ratio"]) & (F.col("top5_hits") / F.col("total") >= CROSS_VIEW["top5_support"]) & (F.col("segments") / F.col("total") >= CROSS_VIEW["segment_support"]))
    near = good.select("track", F.col("rate").alias("partial_rate"), "score_sum")
    gap = F.round(F.abs(F.col("rate") - F.col("partial_rate")), 9)
    met = board.select("track", "rate", "base", "support").join(near, "track").where(gap <= b)
    best = F.max_by(F.struct("rate", "partial_rate", gap.alias("bridge")), F.struct("base", "support", F.round("score_sum", 9).alias("s"), (-gap).alias("g"), (-F.col("rate")).alias("r"), (-F.col("partial_rate")).alias("p")))
    return met.groupBy("track").agg(best.alias("m")).select("track", "m.rate", "m.partial_rate", "m.bridge")


def pulse_score(phase: Column, axial: Column, density: Column, support: Column, stability: Column) -> Column:
    """The evidence that a pulse has a rate, from how its onsets' phases gather and in how many sections."""
    w = PULSE_WEIGHTS
    return phase * w["phase"] + axial * w["axial"] + F.least(density, F.lit(1.0)) * w["density"] + support * w["support"] + stability * w["stability"]


def with_evidence(raw: DataFrame, pulse: DataFrame, continuous: DataFrame) -> DataFrame:
    """Merges evidence into a raw board: the greatest pulse and section values of each candidate, and a row for each continuous measurement.

    raw: raw_board with support. pulse: track, rate, bit, pulse, section (a row for each family and relation; the greatest counts).
    continuous: track, rate, bit, score: it adds a row, its score to sum and maximum, and gives the candidate at least its score as support.
    A candidate that only evidence has is a candidate too.
    """
    zero = F.lit(0.0)
    keys = ["track", "rate", "bit"]
    base = raw.select(*keys, "support", "winner_support", "rows", "score_sum", "quant_sum", "best_score", zero.alias("pulse"), zero.alias("section"), zero.alias("continuous"))
    p = pulse.select(*keys, zero.alias("support"), zero.alias("winner_support"), F.lit(0).cast("long").alias("rows"), zero.alias("score_sum"), zero.alias("quant_sum"), zero.alias("best_score"), "pulse", "section", zero.alias("continuous"))
    s = F.col("score")
    c = continuous.select(*keys, clamp(s, 0.0, 1.0).alias("support"), zero.alias("winner_support"), F.lit(1).cast("long").alias("rows"), s.alias("score_sum"), zero.alias("quant_sum"), s.alias("best_score"), zero.alias("pulse"), zero.alias("section"), s.alias("continuous"))
    merged = base.unionByName(p).unionByName(c).groupBy(*keys)
    return merged.agg(*[F.max(x).alias(x) for x in ("support", "winner_support", "best_score", "pulse", "section", "continuous")], *[F.sum(x).alias(x) for x in ("rows", "score_sum", "quant_sum")])


def collapse_merged(merged: DataFrame) -> DataFrame:
    """The merged board by rate alone: relations as bits, the greatest of each value, and each relation's score sum counted to 2 at most."""
    most = ("support", "winner_support", "best_score", "pulse", "section", "continuous")
    quant = F.max(F.when(F.col("rows") > 0, F.col("quant_sum") / F.nullif("rows", F.lit(0))).otherwise(0.0)).alias("quant")
    return merged.groupBy("track", "rate").agg(F.bit_or("bit").alias("bits"), *[F.max(x).alias(x) for x in most], F.sum(F.least("score_sum", F.lit(2.0))).alias("score_sum"), quant, F.sum("rows").alias("rows"))


__all__ = ["collapse_merged", "cross_view", "families", "family_class", "octave_of", "partial_bars", "pulse_score", "resolve_alias", "with_evidence"]
