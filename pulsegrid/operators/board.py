"""Candidate boards: rows of windows gathered by rate and relation, collapsed, scored and ranked.

Rows are summed by (track, rate) before they are expanded to the eleven relations, so that what is expanded is bounded by the distinct rates
of a track, however many rows one track has. Windows of a track count as bits of one number, 63 at most. Rows that come dealt out by track
(`inputs.by_track`) are never shuffled again: sums, boards, ranks and decisions go by track.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions import relations
from pulsegrid.functions.relations import has
from pulsegrid.functions.scalars import clamp, rounded, safe_ratio

#: Rates are clustered in steps of a quarter.
STEP = 0.25


def _bit(segment: Column) -> Column:
    """The bit of a window; a number outside 0 to 62 is an error, as its bit would be another window's."""
    s = segment.cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.when(s.between(0, 62), s).otherwise(F.raise_error(F.lit("windows are numbered from 0 to 62")).cast("int")))


def raw_board(rows: DataFrame, step: float = STEP) -> DataFrame:
    """(track, rate, bit, segments, segment_hits, winner_hits, rows, winner_rows, score_sum, quant_sum, best_score, best_quant, windows).

    windows: how many of the track's windows have a candidate at all, counted before rows are expanded.
    """
    won = F.when(F.col("winner"), _bit(F.col("segment"))).otherwise(F.lit(0).cast("long"))
    first = rows.groupBy("track", "rate").agg(
        F.bit_or(_bit(F.col("segment"))).alias("s"), F.bit_or(won).alias("w"), F.count("*").alias("rows"), F.count_if("winner").alias("winner_rows"),
        F.sum("score").alias("score_sum"), F.sum("quant").alias("quant_sum"), F.max("score").alias("best_score"), F.max("quant").alias("best_quant"),
    )
    sums = ["rows", "winner_rows", "score_sum", "quant_sum"]
    total = F.bit_count(F.bit_or(F.when(relations.in_reach(F.col("rate")), F.col("s"))).over(Window.partitionBy("track")))
    spread = relations.expanded(first.withColumn("windows", total), F.col("rate"))
    spread = spread.withColumn("rate", F.floor(F.col("x.rate") / step + 0.5) * step).withColumn("bit", F.col("x.bit"))
    board = spread.groupBy("track", "rate", "bit").agg(
        F.bit_or("s").alias("s"), F.bit_or("w").alias("w"), *[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in ("best_score", "best_quant", "windows")]
    )
    return board.select("track", "rate", "bit", F.col("s").alias("segments"), F.bit_count("s").cast("long").alias("segment_hits"), F.bit_count("w").cast("long").alias("winner_hits"), *sums, "best_score", "best_quant", "windows")


def with_support(raw: DataFrame) -> DataFrame:
    """raw_board with support and winner_support, the share of the track's windows."""
    return raw.withColumn("support", F.col("segment_hits") / F.col("windows")).withColumn("winner_support", F.col("winner_hits") / F.col("windows"))


def collapse(raw: DataFrame) -> DataFrame:
    """(track, rate, bits, support, winner_support, score_sum, best_score, quant, rows): all relations that lead to a rate."""
    return with_support(raw).groupBy("track", "rate").agg(
        F.bit_or("bit").alias("bits"), F.max("support").alias("support"), F.max("winner_support").alias("winner_support"), F.sum(F.least("score_sum", F.lit(2.0))).alias("score_sum"),
        F.max("best_score").alias("best_score"), F.max(F.col("quant_sum") / F.col("rows")).alias("quant"), F.sum("rows").alias("rows"),
    )


def evidence(c: DataFrame) -> DataFrame:
    """Adds evidence, the score of a collapsed candidate, rounded so that ties are ties on any machine; pulse and section count where c has them."""
    direct = F.when(has(F.col("bits"), "equivalent"), 0.7).otherwise(0.0)
    score = F.col("support") * 4.0 + F.col("winner_support") + F.col("best_score") * 10.0 + F.log(F.greatest("score_sum", F.lit(0.0)) + 1.0) * 1.5 + direct
    for merged in ("pulse", "section"):
        score = score + F.col(merged) * 4.0 if merged in c.columns else score
    return c.withColumn("evidence", F.round(score, 9))


def best_first(scored: DataFrame, score: str) -> DataFrame:
    """Adds rank; ties by support, winner support and the lower rate."""
    order = [F.desc(score), F.desc("support"), F.desc("winner_support"), F.asc("rate")]
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(*order)))


def winners(scored: DataFrame, score: str) -> DataFrame:
    """One row for each track: the winner, the runner-up's score and the margin."""
    ranked = best_first(scored, score).where("rank <= 2")
    out = ranked.groupBy("track").agg(
        *[F.max(F.when(F.col("rank") == 1, F.col(c))).alias(c) for c in scored.columns if c != "track"], F.coalesce(F.max(F.when(F.col("rank") == 2, F.col(score))), F.lit(0.0)).alias("runner_up")
    )
    return out.withColumn("margin", F.col(score) - F.col("runner_up"))


def _lane(best: Column, high_direct: Column, low: Column, mid: Column, high: Column, centre: float, top: float) -> Column:
    lane = F.when(F.lit(centre <= 95 or top <= 110), "low_pulse").when((high_direct >= 0.55) & (high >= mid * 0.85), "high_pulse")
    return lane.when((best >= 0.85) & (F.abs(low - mid) <= 0.12), "harmonic_conflict").otherwise("general")


def _lane_supports() -> dict[str, Column]:
    """The largest supports that decide a lane, to be taken over a track's rows of with_support()."""
    s, rate = F.col("support"), F.col("rate")
    at = {"high_direct": (F.col("bit") == relations.bit("equivalent")) & (rate >= 150), "low": rate <= 90, "mid": (rate > 90) & (rate < 145), "high": rate >= 145}
    return {"best": s} | {name: F.when(where, s) for name, where in at.items()}


def lanes(raw: DataFrame, centre: float = 130.0, top: float = 220.0) -> DataFrame:
    """(track, lane and the supports that decide it)."""
    most = {n: F.max(x) if n == "best" else F.coalesce(F.max(x), F.lit(0.0)) for n, x in _lane_supports().items()}
    stats = with_support(raw).groupBy("track").agg(*[x.alias(n) for n, x in most.items()])
    return stats.withColumn("lane", _lane(*[F.col(n) for n in most], centre, top))


def conservative(raw: DataFrame, centre: float = 130.0, top: float = 220.0) -> DataFrame:
    """The best raw candidate of each track by the conservative score. Production relations and a support of 0.15 count first,
    whatever is there else.

    The board is made and sorted by track once: a track's lane goes to its rows through a window, and the best of the sorted rows is a running
    maximum, which holds one row.
    """
    w = Window.partitionBy("track")
    most = {n: F.max(x).over(w) if n == "best" else F.coalesce(F.max(x).over(w), F.lit(0.0)) for n, x in _lane_supports().items()}
    rows = with_support(raw).select("track", "rate", "bit", "support", "winner_support", "score_sum", "best_score", (F.col("quant_sum") / F.col("rows")).alias("quant"))
    rows = rows.withColumns(most).withColumn("lane", _lane(*[F.col(n) for n in most], centre, top)).drop(*most)
    bit = F.col("bit")
    extreme, near = has(bit, *relations.EXTREME), has(bit, "two_thirds", "three_halves", "three_quarters", "four_thirds")
    score = F.col("support") * 9.0 + F.col("winner_support") * 2.0 + F.log(F.greatest("score_sum", F.lit(0.0)) + 1.0) * 0.8 + F.col("best_score") * 2.5 + F.col("quant") * 0.4
    score = score + F.when(bit == relations.bit("equivalent"), 0.8).when(near, -0.2).when(extreme, -3.5).otherwise(-1.0)
    score = score - F.abs(F.col("rate") - centre) * F.when(F.col("lane") == "general", 0.060).otherwise(0.035)
    high = F.when(F.col("rate") >= 150, 5.0).otherwise(0.0) + F.when(bit == relations.bit("equivalent"), 2.0).otherwise(0.0) - F.when(F.col("rate") < 130, 4.0).otherwise(0.0)
    score = score + F.when(F.col("lane") == "high_pulse", high).otherwise(0.0) - F.when(extreme, 4.0).otherwise(0.0) - F.when(F.col("support") < 0.15, 3.0).otherwise(0.0)
    pool = (~extreme).cast("int") * 2 + (F.col("support") >= 0.15).cast("int")
    order = F.struct(pool.alias("pool"), rounded(score, 9).alias("score"), "support", "winner_support", "score_sum", (-F.col("rate")).alias("rate"), (-bit).alias("bit"))
    best = rows.select("track", "lane", order.alias("o")).groupBy("track").agg(F.max("lane").alias("lane"), F.max("o").alias("o"))
    return best.select("track", "lane", (-F.col("o.rate")).alias("rate"), (-F.col("o.bit")).alias("bit"), "o.support", "o.winner_support", "o.score")


def route_independent(c: DataFrame) -> DataFrame:
    """Adds measured, the evidence that no routing bears on: shares of support, winners, score and its sum against the track's largest."""
    largest = F.max("score_sum").over(Window.partitionBy("track"))
    part = F.when(largest > 0, clamp(F.col("score_sum") / F.nullif(largest, F.lit(0.0)), 0.0, 1.0)).otherwise(0.0)
    return c.withColumn("measured", F.round(F.col("support") * 0.34 + F.col("winner_support") * 0.24 + F.col("best_score") * 0.14 + F.col("quant") * 0.13 + part * 0.02, 9))


def full_board(c: DataFrame) -> DataFrame:
    """Adds local, base and rank: what is measured at a rate against the track's largest, less what its relations cost."""
    w = Window.partitionBy("track")
    logs = F.log(F.greatest("score_sum", F.lit(0.0)) + 1.0)
    part = lambda x: F.coalesce(clamp(x / F.nullif(F.max(x).over(w), F.lit(0.0)), 0.0, 1.0), F.lit(0.0))
    bits = F.col("bits")
    cost = F.when(has(bits, "equivalent"), -0.05).when(has(bits, "one_third", "quarter", "triple"), 0.18).when(has(bits, "half", "double_time"), 0.10).otherwise(0.04)
    local = F.col("best_score")
    base = part(local) * 0.5 + part(F.col("quant")) + part(logs) * 0.5 - cost
    scored = c.withColumn("local", local).withColumn("base", base).withColumn("base", rounded(F.col("base"), 9))
    order = [F.desc("base"), F.desc("support"), F.desc("winner_support"), F.desc("local"), F.asc("rate")]
    return scored.withColumn("rank", F.row_number().over(w.orderBy(*order)))


#: Ratios of harmonic partners, and the error up to which a rate is one.
PARTNERS, PARTNER_ERROR = (4 / 3, 1.5, 2.0, 3.0, 4.0), 0.018


def release_features(board: DataFrame, centre: float, spread: float, step: float = STEP) -> DataFrame:
    """(track, rate, base, local, family, proximity): the best candidate in each twentieth, and the strongest harmonic partner above it.

    board: a row for each track and rate, with a base (full_board() leaves none null), in steps of `step`; only steps of a twentieth or less can bring two rates into one twentieth. Inside
    the rail a track has 721 rates in steps of a quarter: each meets those of its own track, and as all of this goes by track, the board's
    partitions serve for it. Pairs are made from lists of numbers and tested by bounds, a little wider than the error, before a ratio is taken.
    """
    unique = board
    if step <= 0.05:
        order = [F.desc("base"), F.desc("local"), F.desc("support"), F.asc("rate")]
        place = F.row_number().over(Window.partitionBy("track", F.floor(F.col("rate") * 20 + 0.5)).orderBy(*order))
        unique = board.withColumn("n", place).where("n = 1")
    w = Window.partitionBy("track")
    # one pass over a track: its largest values, and lists of an entry for each rate, 721 at most
    unique = unique.select("track", "rate", "base", "local")
    known = unique.withColumns({"top_base": F.max("base").over(w), "top_local": F.max("local").over(w), "rates": F.collect_list("rate").over(w), "bases": F.collect_list("base").over(w)})
    top = lambda c: F.when(F.col(f"top_{c}") > 0, F.col(f"top_{c}")).otherwise(1.0)
    known = known.select("track", "rate", (F.col("base") / top("base")).alias("base"), (F.col("local") / top("local")).alias("local"), top("base").alias("top"), "bases", "rates")
    rows = known.select("track", "rate", "base", "local", "top", "bases", F.posexplode("rates").alias("i", "other"))
    rate, other = F.col("rate"), F.col("other")
    close = F.lit(False)
    for r in PARTNERS:
        close = close | other.between(rate * (r * (1 - PARTNER_ERROR * 1.01)), rate * (r * (1 + PARTNER_ERROR * 1.01)))
    # a rate's own entry keeps the row where it has no partner
    rows = rows.where((other == rate) | ((other > rate) & close))
    error = F.least(*[F.abs(other / rate - r) / r for r in PARTNERS])
    near = F.when((error < PARTNER_ERROR) & (other > rate), F.get("bases", F.col("i")) / F.col("top") * (1 - error / PARTNER_ERROR))
    out = rows.select("track", "rate", "base", "local", near.alias("near")).groupBy("track", "rate").agg(F.max("base").alias("base"), F.max("local").alias("local"), F.max("near").alias("family"))
    z = (rate - centre) / max(spread, 1.0)
    return out.select("track", "rate", "base", "local", F.greatest(F.coalesce("family", F.lit(0.0)), F.lit(0.0)).alias("family"), F.exp(z * z * -0.5).alias("proximity"))


def bucket_support(rows: DataFrame, targets: list[float], step: float = STEP) -> DataFrame:
    """(track, target, support, winner_support): the share of windows of which a row, by any relation, stands at the target."""
    total = rows.groupBy("track").agg(F.bit_count(F.bit_or(_bit(F.col("segment")))).alias("total"))
    at = F.explode(F.array_distinct(F.transform(relations.expand(F.col("rate")), lambda x: F.round(x["rate"] / step) * step))).alias("target")
    found = rows.select("track", "segment", "winner", at).where(F.col("target").isin(targets))
    hits = found.groupBy("track", "target").agg(F.bit_count(F.bit_or(_bit(F.col("segment")))).alias("s"), F.bit_count(F.bit_or(F.when(F.col("winner"), _bit(F.col("segment"))).otherwise(F.lit(0).cast("long")))).alias("w"))
    return hits.join(total, "track").select("track", "target", (F.col("s") / F.col("total")).alias("support"), (F.col("w") / F.col("total")).alias("winner_support"))


def nearest(board: DataFrame, target: Column) -> DataFrame:
    """(track, target, rate, distance): the candidate nearest to the target; of two, the one with the better base, then the lower rate."""
    d = F.round(F.abs(F.col("rate") - target), 9)
    best = F.min(F.struct(d.alias("distance"), (-F.col("base")).alias("b"), F.col("rate").alias("rate"), target.alias("target"))).alias("m")
    return board.groupBy("track").agg(best).select("track", "m.target", "m.rate", "m.distance")


GATES = {
    "out_of_rail": {"support": 0.80, "local": 0.25},
    "four_thirds": {"ratio": (1.30, 1.35), "support": 0.80, "local": 0.28, "margin": 0.35, "local_ratio": 1.50, "support_ratio": 1.20},
    "dominant": {"delta": 1.0, "support": 0.90, "local": 0.35, "margin": 0.35, "ratio": 1.20},
    "dominant_family": {"delta": 15.0, "support": 0.90, "local": 0.25, "margin": 0.20, "three_halves": 0.03},
    "broad": {"margin": 0.10, "current_support": 0.15, "support": 0.50, "delta": 15.0, "local_ratio": 1.20, "support_ratio": 3.0},
    "conflict": {"current": 80.0, "away": 15.0, "apart": 15.0, "support": 0.60, "local_ratio": 0.70, "base_ratio": 0.80, "gain": 10.0},
    "micro": {"delta": (0.05, 3.0), "support": 0.40, "local_ratio": 1.20, "support_ratio": 0.45},
}


def with_current(board: DataFrame, score: str = "measured") -> DataFrame:
    """board with what the best candidate by a score has, as current_rate, current_local, current_support, current_base and current_bits."""
    w = Window.partitionBy("track")
    first = F.row_number().over(w.orderBy(F.desc(score), F.desc("support"), F.desc("winner_support"), F.asc("rate"))) == 1
    marked = board.withColumn("first", first)
    return marked.withColumns({f"current_{c}": F.max(F.when(F.col("first"), F.col(c))).over(w) for c in ("rate", "local", "support", "base", "bits")}).drop("first")


def policy(rows: DataFrame, centre: float = 130.0) -> DataFrame:
    """One decision for each track by ordered gates, of which the first that holds counts.

    rows: full_board with_current. One aggregation by track finds the winner by base, its margin and the strongest conflict, and the
    board's own partitions serve for it. Gates: a witness where the current rate is out of the rail; four thirds of a slow current rate;
    a dominant direct measurement, or one of three halves that lies far off; a broad conflict; a family conflict nearer to the centre; a
    small upgrade; else the current rate. rates: what the track's board measured, 721 rates at most.
    """
    g = GATES
    away = F.abs(F.col("current_rate") - centre)
    gain = away - F.abs(F.col("rate") - centre)
    local_ratio, base_ratio = safe_ratio(F.col("local"), F.col("current_local")), safe_ratio(F.col("base"), F.col("current_base"))
    c = g["conflict"]
    fights = (
        (F.col("current_rate") >= c["current"]) & (away >= c["away"]) & (F.abs(F.col("rate") - F.col("current_rate")) >= c["apart"]) & (F.col("support") >= c["support"])
        & (local_ratio >= c["local_ratio"]) & (base_ratio >= c["base_ratio"]) & (gain >= c["gain"])
    )
    strength = F.struct(F.round(gain, 9).alias("g"), F.round(local_ratio, 9).alias("l"), F.round(base_ratio, 9).alias("b"), "support", (-F.col("rate")).alias("r"))
    current = [f"current_{x}" for x in ("rate", "local", "support", "base", "bits")]
    place = F.row_number().over(Window.partitionBy("track").orderBy(F.desc("base"), F.desc("support"), F.desc("winner_support"), F.asc("rate")))
    one = lambda x: F.max(F.when(F.col("place") == 1, F.col(x))).alias(x)
    j = rows.withColumn("place", place).groupBy("track", *current).agg(
        *[one(x) for x in ("rate", "bits", "support", "local")], (F.max(F.when(F.col("place") == 1, F.col("base"))) - F.coalesce(F.max(F.when(F.col("place") == 2, F.col("base"))), F.lit(0.0))).alias("margin"),
        F.max_by("rate", F.when(fights, strength)).alias("conflict_rate"), F.collect_list("rate").alias("rates"),
    )
    delta = F.abs(F.col("rate") - F.col("current_rate"))
    l, s = safe_ratio(F.col("local"), F.col("current_local")), safe_ratio(F.col("support"), F.col("current_support"))
    direct = has(F.col("bits"), "equivalent")
    at = lambda k: (F.col("support") >= g[k]["support"]) & (F.col("local") >= g[k]["local"])
    led = lambda k: at(k) & (F.col("margin") >= g[k]["margin"])
    ratio = F.col("rate") / F.nullif("current_rate", F.lit(0.0))
    four, dom, fam, broad, micro = (g[k] for k in ("four_thirds", "dominant", "dominant_family", "broad", "micro"))
    halves = F.abs(F.greatest("rate", "current_rate") / F.nullif(F.least("rate", "current_rate"), F.lit(0.0)) - 1.5) <= fam["three_halves"]
    gates = [
        ("out_of_rail_release", (F.col("current_rate") < relations.RAIL[0]) & at("out_of_rail"), F.col("rate"), True),
        ("four_thirds_release", ratio.between(*four["ratio"]) & direct & has(F.col("bits"), "three_quarters") & led("four_thirds") & ((l >= four["local_ratio"]) | (s >= four["support_ratio"])), F.col("rate"), True),
        ("dominant_direct_release", (delta > dom["delta"]) & direct & led("dominant") & ((l >= dom["ratio"]) | (s >= dom["ratio"])), F.col("rate"), True),
        ("dominant_family_release", (delta > fam["delta"]) & direct & led("dominant_family") & halves & (F.col("rate") > F.col("current_rate")), F.col("rate"), True),
        ("three_halves_conflict_hold", (delta > fam["delta"]) & direct & led("dominant_family") & halves, F.lit(0.0), False),
        (
            "broad_conflict_hold", F.col("margin").between(0.0, broad["margin"]) & (F.col("current_support") <= broad["current_support"]) & (F.col("support") >= broad["support"]) & (delta >= broad["delta"]) & (l >= broad["local_ratio"])
            & (s >= broad["support_ratio"]) & has(F.col("bits"), "two_thirds") & has(F.col("bits"), "three_halves") & has(F.col("current_bits"), "equivalent") & has(F.col("current_bits"), "three_quarters", "four_thirds"), F.lit(0.0), False,
        ),
        ("family_conflict_hold", F.col("conflict_rate").isNotNull(), F.lit(0.0), False),
        ("micro_upgrade", delta.between(*micro["delta"]) & (F.col("support") >= micro["support"]) & (l >= micro["local_ratio"]) & (s >= micro["support_ratio"]), F.col("rate"), True),
    ]
    chosen = F.struct(F.lit("keep_current").alias("reason"), F.col("current_rate").alias("output_rate"), F.lit(True).alias("would_write"))
    for reason, holds, rate, write in reversed(gates):
        chosen = F.when(holds, F.struct(F.lit(reason).alias("reason"), rate.alias("output_rate"), F.lit(write).alias("would_write"))).otherwise(chosen)
    return j.withColumn("d", chosen).select("track", F.col("rate").alias("winner_rate"), "margin", "current_rate", "conflict_rate", "d.reason", "d.output_rate", "d.would_write", "rates")


def witness_guard(decisions: DataFrame) -> DataFrame:
    """Decisions that would write a rate nobody measured, to a thousandth, become holds. decisions: policy()."""
    seen = F.exists("rates", lambda m: F.abs(m - F.col("output_rate")) <= 0.001) & F.col("output_rate").between(*relations.RAIL)
    out = decisions.withColumn("witnessed", F.coalesce(seen, F.lit(False)))
    held = F.col("would_write") & ~F.col("witnessed")
    return out.withColumn("reason", F.when(held, "unmeasured_output_hold").otherwise(F.col("reason"))).withColumn("output_rate", F.when(held, 0.0).otherwise(F.col("output_rate"))).withColumn("would_write", F.col("would_write") & F.col("witnessed"))


def review_candidates(measured: DataFrame) -> DataFrame:
    """(track, rate, evidence, support, sources, rank, role) from (track, rate, evidence, support, rank or null, source): equal rates, to a
    thousandth, become one with the best of each value and all their sources."""
    one = measured.groupBy("track", F.round("rate", 3).alias("rate")).agg(
        F.max("evidence").alias("evidence"), F.max("support").alias("support"), F.min("rank").alias("rank"), F.array_join(F.array_sort(F.collect_set("source")), "|").alias("sources")
    )
    order = [F.col("rank").isNull().asc(), F.desc("evidence"), F.desc("support"), F.asc("rate")]
    place = F.row_number().over(Window.partitionBy("track").orderBy(*order))
    role = F.when(place == 1, "Final").when(place <= 3, F.concat(F.lit("Alt"), (place - 1).cast("string"))).otherwise("")
    return one.select("track", "rate", "evidence", "support", "sources", F.coalesce("rank", place).cast("int").alias("rank"), role.alias("role"))
