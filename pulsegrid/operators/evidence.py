"""Evidence logs: parsed into events, gathered by track, checked, and compared between runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import decimal_comma

LINE = r"^[^:]*: \[([^\]]*)\] (\S+) (.*)$"


class Violation(ValueError):
    """A log that can't be trusted."""


def field(payload: Column, name: str) -> Column:
    """The value of name=value, ended by a space or the end; a comma ends it only where a space follows. Null where there is none."""
    x = F.regexp_extract(payload, rf"(?:^|[ ,]){name}=([^ ]*?)(?:,? |,?$)", 1)
    return F.when(x != "", x)


def events(lines: DataFrame) -> DataFrame:
    """(label, event, payload) of the lines that are events."""
    part = lambda i: F.regexp_extract("line", LINE, i)
    return lines.where(F.col("line").rlike(LINE)).select(part(1).alias("label"), part(2).alias("event"), part(3).alias("payload"))


def parsed(found: DataFrame) -> DataFrame:
    p = F.col("payload")
    return found.select("label", "event", field(p, "id").cast("long").alias("id"), decimal_comma(field(p, "value")).alias("value"), field(p, "k").cast("int").alias("k"), field(p, "reason").alias("reason"))


def tracks(found: DataFrame, kinds: list[str]) -> DataFrame:
    """(label, first_id, n and, for each kind of event, its count and greatest value): lines of tracks may stand in any order."""
    one = [c for k in kinds for c in (F.count_if(F.col("event") == k).alias(f"n_{k}"), F.max(F.when(F.col("event") == k, F.col("value"))).alias(f"max_{k}"))]
    return found.groupBy("label").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), *one)


def violations(found: DataFrame, known: list[str]) -> DataFrame:
    """(label, violation, n): ids that come twice, unknown events, numbers that don't parse."""
    twice = found.groupBy("label", "id").agg(F.count("*").alias("c")).where("c > 1").groupBy("label").agg(F.count("*").alias("n")).select("label", F.lit("duplicate_id").alias("violation"), "n")
    bad = F.when(~F.col("event").isin(*known), "unknown_event").when(F.col("value").isNull() | F.col("id").isNull(), "bad_number")
    return found.withColumn("violation", bad).where("violation is not null").groupBy("label", "violation").agg(F.count("*").alias("n")).unionByName(twice)


def checked(found: DataFrame, known: list[str]) -> DataFrame:
    """found, or Violation raised where anything is wrong with it."""
    first = violations(found, known).limit(1).collect()
    if first:
        raise Violation(f"{first[0]['violation']} in {first[0]['label']}")
    return found


def labels_of(keys: DataFrame) -> DataFrame:
    """(label, key, keys): labels that several keys share are ambiguous and have no key."""
    return keys.groupBy("label").agg(F.count_distinct("key").alias("keys"), F.min("key").alias("k")).select("label", F.when(F.col("keys") == 1, F.col("k")).alias("key"), "keys")


def identity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(common, only_a, only_b): how the keys of two runs meet."""
    j = a.select(key, F.lit(1).alias("a")).join(b.select(key, F.lit(1).alias("b")), key, "full")
    return j.agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("common"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"))


def transitions(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(from_state, to_state, n, changed, mean_delta) of two runs (key, state, rate)."""
    j = a.select(key, F.col("state").alias("from_state"), F.col("rate").alias("x")).join(b.select(key, F.col("state").alias("to_state"), F.col("rate").alias("y")), key)
    return j.groupBy("from_state", "to_state").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("x") - F.col("y")) > 0.001).alias("changed"), F.avg(F.col("y") - F.col("x")).alias("mean_delta"))


def multiset_overlap(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, rows_a, rows_b, shared, equal): rows of two runs as multisets. Equal rows are counted before they meet."""
    count = lambda d, n: d.groupBy(key, *columns).agg(F.count("*").alias(n))
    j = count(a, "x").join(count(b, "y"), [key, *columns], "full").select(key, F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))
    out = j.groupBy(key).agg(F.sum("x").alias("rows_a"), F.sum("y").alias("rows_b"), F.sum(F.least("x", "y")).alias("shared"))
    return out.withColumn("equal", (F.col("rows_a") == F.col("shared")) & (F.col("rows_b") == F.col("shared")))


def ordinals(keys: DataFrame, key: str, buckets: int = 64) -> DataFrame:
    """(key, name): T0001, T0002, ... by a numeric key.

    Keys are numbered within buckets between fixed bounds, the quantiles of the keys, which only they decide: no task orders
    them all, and no partition needs to be the same twice. Bounds and the buckets' sizes are `buckets` numbers each.
    """
    one = keys.select(key).where(F.col(key).isNotNull()).distinct()
    bounds = sorted(set(one.agg(F.percentile_approx(key, [i / buckets for i in range(1, buckets)])).first()[0] or []))
    bucket = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col(key))) if bounds else F.lit(0)
    rows = one.withColumn("bucket", bucket)
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("n"))
    before = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("before"))  # `buckets` rows
    placed = rows.join(F.broadcast(before), "bucket").withColumn("n", F.row_number().over(Window.partitionBy("bucket").orderBy(key)) + F.col("before"))
    return placed.select(key, F.format_string("T%04d", "n").alias("name"))


def stage_class(board_rows: Column, source: Column, state: Column) -> Column:
    """How far a track came: no policy record, an impossible one, nothing measured, measured but held or without a board, or written."""
    return (
        F.when(source.isNull(), "UNKNOWN_POLICY").when(~source.isin(0, 1), "INCONSISTENT").when((board_rows == 0) & (source == 0), "NO_MEASURED_SOURCE")
        .when(board_rows == 0, "SOURCE_WITHOUT_POLICY_BOARD").when(state == "HOLD", "MEASURED_BUT_HOLD").otherwise("MEASURED_AND_OUTPUT")
    )


def short_stage(stage: Column) -> Column:
    """The five classes that are told apart between builds."""
    return F.when(stage == "SOURCE_WITHOUT_POLICY_BOARD", "SOURCE_WITHOUT_BOARD").when(stage == "MEASURED_BUT_HOLD", "MEASURED_HELD").when(stage == "MEASURED_AND_OUTPUT", "MEASURED_OUTPUT").otherwise(stage)


def trace_coverage(segments: DataFrame) -> DataFrame:
    """(track, reasons, seen, declared, coverage) of segment records (track, segment, reason, declared): all windows declared, some, or none."""
    own = segments.groupBy("track", "reason").agg(F.count("*").alias("n"), F.min("declared").alias("declared"))
    out = own.groupBy("track").agg(F.array_sort(F.collect_list(F.struct("reason", "n"))).alias("r"), F.sum("n").alias("seen"), F.min("declared").alias("declared"))
    text = F.array_join(F.transform("r", lambda x: F.concat(x["reason"], F.lit("="), x["n"].cast("string"))), " ")
    coverage = F.when(F.col("seen") == 0, "NO_TRACE").when(F.col("seen") == F.col("declared"), "COMPLETE").otherwise("PARTIAL")
    return out.select("track", text.alias("reasons"), "seen", "declared", coverage.alias("coverage"))


def sweep(a: DataFrame, b: DataFrame) -> DataFrame:
    """(dimension, error) of two runs' settings (track, seconds, passes, low, high): what changed between them.

    A run with mixed settings, two changed factors, other tracks or another range of offsets is an error; one row.
    """
    def of(run: DataFrame, n: str) -> DataFrame:
        kinds = F.count_distinct("seconds", "passes")
        return run.agg(F.min("seconds").alias(f"s{n}"), F.min("passes").alias(f"p{n}"), kinds.alias(f"k{n}"))

    same = F.col("x.low").eqNullSafe(F.col("y.low")) & F.col("x.high").eqNullSafe(F.col("y.high"))
    met = a.alias("x").join(b.alias("y"), "track", "full")
    keys = met.agg(F.count_if(F.col("x.seconds").isNull() | F.col("y.seconds").isNull()).alias("apart"), F.count_if(~same).alias("offsets"))
    j = of(a, "a").join(of(b, "b"), F.lit(True)).join(keys, F.lit(True))  # one row each
    error = F.when(F.col("apart") > 0, "track_identity").when((F.col("ka") > 1) | (F.col("kb") > 1), "mixed_settings").when((F.col("sa") != F.col("sb")) & (F.col("pa") != F.col("pb")), "confounded").when(F.col("offsets") > 0, "offset_policy")
    dimension = F.when(F.col("sa") != F.col("sb"), "window_seconds").when(F.col("pa") != F.col("pb"), "passes").otherwise("repeat")
    return j.select(F.when(error.isNull(), dimension).alias("dimension"), error.alias("error"))


def score_categories(reference: DataFrame, observed: DataFrame) -> DataFrame:
    """(ordinal, category, relative_error): observed (ordinal, bpm, held) against reference (ordinal, reference)."""
    j = reference.join(observed, "ordinal")
    r, o = F.col("reference"), F.col("bpm")
    error = F.abs(o - r) / F.nullif(r, F.lit(0.0))
    ratio = o / F.nullif(r, F.lit(0.0))
    silent = F.when(F.col("held") | (o <= 0), "correct_abstention").otherwise("false_positive")
    heard = F.when(F.col("held") | (o <= 0), "abstained").when(error <= 0.02, "within_two_percent").when((F.abs(ratio - 0.5) <= 0.04) | (F.abs(ratio - 2) <= 0.04), "half_double_alias").otherwise("other")
    return j.select("ordinal", F.when(r.isNull(), silent).otherwise(heard).alias("category"), error.alias("relative_error"))


def reconciled(review: DataFrame, analysed: DataFrame, held: DataFrame, key: str, locked: bool = False) -> DataFrame:
    """The new review list: without what was analysed, with what is held; a locked list only gains."""
    kept = review.select(key).distinct() if locked else review.select(key).distinct().join(analysed.select(key).distinct(), key, "left_anti")
    return kept.union(held.select(key)).distinct()
