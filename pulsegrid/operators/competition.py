"""A tournament of the ranked families' relations inside a route, its winner's lead, and what a clear winner releases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import relations
from pulsegrid.functions.scalars import clamp

#: What a relation is worth before anything is measured, and the weights of an option (C15).
PRIOR = {"equivalent": 1.00, "half": 0.92, "double_time": 0.88, "two_thirds": 0.78, "three_halves": 0.76, "three_quarters": 0.70, "four_thirds": 0.70, "one_third": 0.45, "quarter": 0.35, "triple": 0.34, "quadruple": 0.25}
WEIGHTS = {"score": 42.0, "support": 30.0, "quality": 20.0, "prior": 13.0, "centre": 7.0, "rank": -1.75}
QUALITY = {"consensus": 0.40, "dominance": 0.35, "lead": 0.25}
#: When the winner releases a held track: least share of windows with a candidate, least support, most that the runner-up may have, least held rate.
RELEASE = {"share": 0.65, "support": 0.85, "runner_up": 0.45, "rate": 168.0}


def options(ranked: DataFrame, shares: DataFrame, routes: DataFrame) -> DataFrame:
    """(track, family_rank, family_rate, relation, rate, score, distance, share, support): the relations of a track's families that lie inside its route.

    ranked: families(); shares: track, windows, won (windows, and those with a candidate); routes: track, low, high. A track has four families and eleven
    relations at most. Tracks without a usable route, a scored first family or a window with a candidate have no option.
    """
    one = lambda rank, c: F.max(F.when(F.col("family_rank") == rank, F.col(c)))
    first = ranked.groupBy("track").agg(one(1, "score_sum").alias("top"), F.coalesce(one(2, "score_sum"), F.lit(0.0)).alias("runner"), one(1, "support").alias("consensus"), one(1, "candidate_support").alias("first_support"))
    j = ranked.join(first, "track").join(shares, "track").join(routes.where("low > 0 AND high > low").select("track", "low", "high"), "track").where("top > 0 AND won > 0 AND rate > 0 AND score_sum > 0")
    dominance = F.when(F.col("runner") > 0, F.col("top") / F.nullif("runner", F.lit(0.0))).otherwise(F.col("top"))
    q = QUALITY
    quality = clamp(F.col("consensus") / F.col("windows"), 0.0, 1.0) * q["consensus"] + clamp(F.log1p(dominance) / F.log1p(F.lit(8.0)), 0.0, 1.0) * q["dominance"] + clamp(1 - F.col("runner") / F.col("top"), 0.0, 1.0) * q["lead"]
    j = j.withColumn("quality", quality).withColumn("x", F.explode(relations.expand(F.col("rate")))).where("x.rate BETWEEN low AND high")
    prior = F.lit(0.35)
    for name, worth in PRIOR.items():
        prior = F.when(F.col("x.relation") == name, worth).otherwise(prior)
    distance = F.abs(F.col("x.rate") - (F.col("low") + F.col("high")) * 0.5)
    centre = F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), distance / (F.greatest(F.lit(1.0), F.col("high") - F.col("low")) * 0.5)))
    w = WEIGHTS
    score = F.col("score_sum") / F.col("top") * w["score"] + F.col("support") / F.col("won") * w["support"] + F.col("quality") * w["quality"] + prior * w["prior"] + centre * w["centre"] + (F.col("family_rank") - 1) * w["rank"]
    return j.select("track", "family_rank", F.col("rate").alias("family_rate"), F.col("x.relation").alias("relation"), F.col("x.rate").alias("rate"), F.round(score, 9).alias("score"), F.round(distance, 9).alias("distance"), (F.col("won") / F.col("windows")).alias("share"), (F.col("first_support") / F.col("won")).alias("support"))


def winners(found: DataFrame) -> DataFrame:
    """(track, options, family_rank, family_rate, relation, rate, score, runner_up_ratio, clear): one row for each track with an option.

    Of equal scores the better rank, then the nearer to the route's middle, then the lower rate. clear: the winner is three quarters of the first family, and by its
    share, support and lead would release a held track.
    """
    order = Window.partitionBy("track").orderBy(F.desc("score"), "family_rank", "distance", "rate")
    ranked = found.withColumn("place", F.row_number().over(order)).withColumn("next", F.lead("score").over(order)).withColumn("options", F.count("*").over(Window.partitionBy("track")))
    ratio = F.when((F.col("score") > 0) & F.col("next").isNotNull(), F.col("next") / F.nullif("score", F.lit(0.0))).otherwise(0.0)
    r = RELEASE
    clear = (F.col("family_rank") == 1) & (F.col("relation") == "three_quarters") & (F.col("share") >= r["share"]) & (F.col("support") >= r["support"]) & (ratio <= r["runner_up"]) & F.col("rate").between(*relations.RAIL)
    return ranked.where("place = 1").select("track", "options", "family_rank", "family_rate", "relation", "rate", "score", F.round(ratio, 9).alias("runner_up_ratio"), clear.alias("clear"))


def released(held: DataFrame, won: DataFrame) -> DataFrame:
    """held (track, hold_alias and the other holds, ex_rate, ...) with release: the rate that a clear winner lets a track have that is held for its relation alone, else null."""
    others = ("hold_sparse", "hold_material", "hold_family", "hold_centre", "hold_exact")
    alone = F.col("hold_alias") & (F.col("ex_rate") >= RELEASE["rate"])
    for other in others:
        alone = alone & ~F.col(other)
    j = held.join(won.where("clear").select("track", F.col("rate").alias("won_rate")), "track", "left")
    return j.withColumn("release", F.when(alone, F.col("won_rate"))).drop("won_rate")
