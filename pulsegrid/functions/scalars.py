"""Guards, parsers, formats and scores of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as a number in text: no hex, no suffix, no NaN.
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
#: The meters with the mean and spread of their rates and their prior.
METERS = [("4/4", 115.0, 25.0, 0.45), ("2/2", 115.0, 25.0, 0.1), ("3/4", 140.0, 25.0, 0.2), ("6/8", 64.0, 15.0, 0.25)]


def positive(x: Column) -> Column:
    """Finite and above zero; false for null and NaN."""
    x = x.cast("double")
    return F.coalesce((x > 0) & (x < float("inf")) & ~F.isnan(x), F.lit(False))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def number(text: Column) -> Column:
    """The double that a text spells, else null."""
    x = F.when(text.rlike(NUMBER), F.expr("try_cast(null as double)")).otherwise(F.lit(None).cast("double"))
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double")).otherwise(x)


def decimal_comma(text: Column) -> Column:
    """Like number, for texts with a decimal comma as well."""
    return number(F.replace(text, F.lit(","), F.lit(".")))


def safe_ratio(value: Column, reference: Column) -> Column:
    """value / reference; without a positive reference infinity for a positive value and 1 for others."""
    return F.when(reference > 0, value / F.nullif(reference, F.lit(0.0))).when(value > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))


def format_rate(x: Column, places: int) -> Column:
    """Fixed places, half away from zero."""
    return F.format_string(f"%.{places}f", F.round(x, places))


def rounded(x: Column, places: int) -> Column:
    """Half away from zero of the value times a power of ten, as DuckDB rounds; F.round takes the shortest decimal, which differs at ties.

    No decimal is made of a number, as F.round does. From 2 to the 52nd on a double is whole; NaN and infinity stay. Zero has no sign.
    """
    v = x * 10.0**places
    size = F.abs(v)
    below = F.floor(size).cast("double")
    whole = below + F.when(size - below >= 0.5, 1.0).otherwise(0.0)
    return F.when(size < 2.0**52, F.when(v < 0, -whole).otherwise(whole)).otherwise(v) / 10.0**places + 0.0


def meter(beats_per_bar: Column, tatums_per_beat: Column) -> Column:
    return F.when(beats_per_bar == 2, F.when(tatums_per_beat == 3, "6/8").otherwise("2/2")).when(beats_per_bar == 3, "3/4").otherwise("4/4")


def meter_likelihood(name: Column, rate: Column) -> Column:
    out = F.lit(0.0)
    for m, mean, spread, prior in METERS:
        z = (rate - mean) / spread
        out = F.when(name == m, F.exp(z * z * -0.5) * prior).otherwise(out)
    return out


def ratio_class(rate: Column, reference: Column) -> Column:
    """The nearest of nine ratios: exact to 0.75 %, near to 4 %, else other."""
    named = [("1/4", 0.25), ("1/3", 1 / 3), ("1/2", 0.5), ("2/3", 2 / 3), ("1/1", 1.0), ("3/2", 1.5), ("2/1", 2.0), ("3/1", 3.0), ("4/1", 4.0)]
    errors = F.array(*[F.struct(F.abs(rate / reference / r - 1).alias("e"), F.lit(n).alias("n")) for n, r in named])
    least = F.array_min(errors)
    return F.when(least["e"] <= 0.0075, F.concat(F.lit("exact "), least["n"])).when(least["e"] <= 0.04, F.concat(F.lit("near "), least["n"])).otherwise("other")


def hold_message(peaks: Column, scored: Column, candidates: Column, hold: Column) -> Column:
    """Why nothing is written, by the first stage that has nothing."""
    return (
        F.when(hold & (candidates > 0), "withheld by policy")
        .when((candidates > 0), "no admissible candidate")
        .when((peaks > 1) & (scored > 0), "empty board")
        .when((peaks > 1), "no scored segments")
        .otherwise("onset evidence")
    )


def progress_permille(total: Column, done: Column, slots: Column, decoded: Column, previous: Column) -> Column:
    """How much of a batch is done, in thousandths, never less than before; decoding alone counts 85 % of the slots in work."""
    part = F.when(F.isnan(decoded) | (F.abs(decoded) == float("inf")), F.lit(0.0)).otherwise(clamp(decoded, 0.0, 1.0))
    finished = done / F.nullif(total, F.lit(0))
    ahead = F.least(part, (done + F.least(slots, total - done) * 0.85) / F.nullif(total, F.lit(0)))
    now = clamp(F.greatest(finished, ahead), 0.0, 0.985)
    whole = (total <= 0) | (done >= total)
    return F.when(whole, F.lit(1000)).otherwise(F.greatest(F.least(previous, F.lit(985)), F.round(now * 1000).cast("int"))).cast("int")


def confidence(support: Column, score: Column, pulse: Column, continuous: Column, winner_support: Column) -> Column:
    """30 and what the evidence adds, up to 99."""
    c = clamp(support, 0.0, 1.0) * 50 + clamp(score / 0.45, 0.0, 1.0) * 8 + clamp(pulse / 0.40, 0.0, 1.0) * 6 + clamp(continuous / 0.35, 0.0, 1.0) * 6 + 30
    return clamp(c + F.when(winner_support >= 0.5, 4.0).otherwise(0.0), 0.0, 99.0)


def clock(seconds: Column) -> Column:
    """h:mm:ss, at most 99:59:59."""
    s = F.least(F.greatest(F.floor(seconds), F.lit(0)), F.lit(359_999)).cast("int")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


#: Ratios of two rates that agree, with the errors at which they agree fully and not at all; ratios of cross rhythms.
HARMONIC, AGREE, APART = (1.0, 2.0, 0.5, 1.5, 0.75, 4 / 3, 2 / 3), 0.005, 0.03
CROSS, CROSS_TOLERANCE = (0.75, 4 / 3, 1.5, 2 / 3), 0.025


def harmonic_agreement(a: Column, b: Column) -> Column:
    """1 where two rates stand in a simple ratio, 0 where they are 3 % off any, in between a straight line; 0 unless both are positive."""
    error = F.array_min(F.array(*[F.abs(a / F.nullif(b, F.lit(0.0)) - r) / r for r in HARMONIC]))
    return F.when((a > 0) & (b > 0), clamp(1.0 - (error - AGREE) / (APART - AGREE), 0.0, 1.0)).otherwise(0.0)


def cross_rhythm(a: Column, b: Column) -> Column:
    """Whether two rates stand as three to four or two to three."""
    ratio = a / F.nullif(b, F.lit(0.0))
    near = [F.abs(ratio - r) <= CROSS_TOLERANCE for r in CROSS]
    return F.coalesce(positive(a) & positive(b) & (near[0] | near[1] | near[2] | near[3]), F.lit(False))


def rate_tolerance(rate: Column) -> Column:
    """What counts as the same rate: 0.8 %, 0.6 at least."""
    return F.greatest(rate * 0.008, F.lit(0.6))


def gaussian(distance: Column, most: float = 8.0) -> Column:
    """exp(-d * d / 2) of a distance in spreads; 1 at or below 0, 0 from `most` on."""
    return F.when(distance <= 0, 1.0).when(distance >= most, 0.0).otherwise(F.exp(distance * distance * -0.5))


def hop_quantised(rate: Column, sample_rate: int, hop: int) -> Column:
    """(hops, rate, error): the nearest rate whose period is a whole number of hops; null unless the rate is positive."""
    hops = F.greatest(F.round(F.lit(60.0 * sample_rate) / (rate * hop)), F.lit(1.0))
    near = F.lit(60.0 * sample_rate) / (hops * hop)
    return F.when(positive(rate), F.struct(hops.cast("long").alias("hops"), near.alias("rate"), (rate - near).alias("error")))


def circular_distance(phase: Column) -> Column:
    """How far a phase, in turns, is from the next whole turn."""
    wrapped = phase - F.floor(phase)
    return F.least(wrapped, 1 - wrapped)
