"""Evidence logs of whole runs: provenance makes tracks, every other line attaches to one, what can't be trusted is a violation.

Lines of tracks may stand in any order, as workers write at once. A plan attaches by its key and part, a board line by key and label, all
others by a label that one track of the run alone has. Nothing is collected: tracks, the number of lines that attach and violations are
aggregations and joins by (run, key) or (run, label), whose sums are combined before they are shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import decimal_comma
from pulsegrid.operators.evidence import Violation
from pulsegrid.sources.staged import staged

#: The kinds of lines by the end of the event's name, and what they are called here.
KINDS = {"AnalysisProvenance": "provenance", "SamplingPlan": "plan", "PrimarySegment": "segment", "PolicyCandidateBoard": "board", "PolicyDecision": "policy", "Decision:": "decision", "Track Timing:": "timing", "Final Output:": "final"}
PLAN_SCHEMA, BOARD_SCHEMA = "mir_sampling_plan_v1", "mir_policy_candidate_board_v1"
#: Fields of a board line that make its signature.
BOARD = ("origin", "cluster_bpm", "local_exact_bpm", "local_exact_score", "base_score", "alias_classes", "support", "winner_support", "score_sum", "best_combined_score", "pulse_score", "pulse_section_support", "pulse_phase_vs", "pulse_axial_phase_vs", "continuous_score", "continuous_section_support", "continuous_score_ratio", "continuous_section_stability", "rows", "total_segment_count")
NUMBERS = {
    "plan": ("requested_window_seconds", "requested_passes", "effective_passes", "known_track_length", "offset_min_pct", "offset_max_pct"),
    "segment": ("segment_index", "segment_count", "candidate", "onset_count"), "policy": ("output_would_write", "output_would_review_hold", "source_candidate"), "provenance": ("subsong",),
}
REALS = {"plan": ("effective_window_seconds", "track_length_seconds"), "policy": ("output_bpm",)}
_LINE = r"^[^:]*: \[(.*)\] (\w*AnalysisProvenance|\w*SamplingPlan|\w*PrimarySegment|\w*PolicyCandidateBoard|\w*PolicyDecision|Decision:|Track Timing:|Final Output:)(?: (.*))?$"


def _field(name: str) -> Column:
    """The first value of a field that has one. payload: read() makes spaced of it, with a space before and for each white space.

    The text is cut at the name; a pattern runs only where a name stands without a value, as a later one may have one.
    """
    spaced = F.col("spaced")
    found = F.substring_index(F.split_part(spaced, F.lit(f" {name}="), F.lit(2)), " ", 1)
    x = F.when(F.contains(spaced, F.lit(f" {name}= ")) | F.endswith(spaced, F.lit(f" {name}=")), F.regexp_extract("payload", rf"(?:^|\s){name}=(\S+)", 1)).otherwise(found)
    return F.when(F.contains(spaced, F.lit(f" {name}=")) & (x != ""), x)


def _listed(name: str) -> Column:
    """A field of a comma-separated list; the comma of a decimal is followed by no space."""
    x = F.when(F.contains("payload", F.lit(f"{name}=")), F.regexp_extract("payload", rf"(?:^|, ){name}=(.*?)(?:, |$)", 1))
    return F.when(x != "", x)


def _whole(x: Column) -> Column:
    return F.when(x.rlike("^[0-9]{1,18}$"), x.cast("long"))


def read(lines: DataFrame) -> DataFrame:
    """(run, label, kind, key, subsong and the fields of all kinds) of the lines (run, line) that are records; a mark at the file's begin is no part of a line."""
    line = F.regexp_replace("line", "^\uFEFF", "")
    found = lines.select("run", line.alias("line")).where(F.col("line").rlike(_LINE))
    # no part of a record holds a line's end, so the three come by one pattern
    parts = found.select("run", F.split(F.regexp_replace("line", _LINE, "$1\n$2\n$3"), "\n").alias("part"))
    found = parts.select("run", F.get("part", F.lit(0)).alias("label"), F.get("part", F.lit(1)).alias("name"), F.trim(F.get("part", F.lit(2))).alias("payload"))
    found = found.withColumn("spaced", F.concat(F.lit(" "), F.translate("payload", "\t\n\x0b\f\r", "     ")))
    kind = F.lit(None).cast("string")
    for end, name in KINDS.items():
        kind = F.when(F.col("name").endswith(end), name).otherwise(kind)
    # the shorter names end longer ones, so the longer decide
    kind = F.when(F.col("name").endswith("PolicyDecision"), "policy").otherwise(kind)
    rate = F.regexp_extract("payload", r"^([0-9]+(?:[.,][0-9]+)?) BPM(?:,|$)", 1)
    held = F.col("payload").startswith("no writable BPM")
    fields = {n: _whole(_field(n)) for names in NUMBERS.values() for n in names} | {n: decimal_comma(_field(n)) for names in REALS.values() for n in names}
    fields |= {
        "key": _field("track_key"), "build": _field("build_id"), "policy_schema": _field("policy_schema"), "schema": _field("schema"), "reason": _field("reason"), "fields": F.array(*[_field(b) for b in BOARD]),
        "decided": decimal_comma(_listed("final")), "decision_class": _listed("decision_class"), "total_ms": decimal_comma(_listed("total_ms")), "state": F.when(held, "HOLD").when(rate != "", "WRITE"), "rate": F.when(~held, decimal_comma(rate)),
    }
    out = found.withColumn("kind", kind).select("run", "label", "kind", *[v.alias(k) for k, v in fields.items()])
    # a board's fields are found once, for its signature and for what lacks
    signature = F.array_join("fields", " ", "?")
    return out.withColumn("signature", signature).withColumn("holes", F.size("fields") - F.size(F.array_compact("fields"))).drop("fields")


#: Of each kind what must be there and in range; else the line is a violation by this name.
LINE_RULES = {
    "malformed_identity": "kind = 'provenance' AND NOT coalesce(key RLIKE '^[0-9]+$', FALSE)",
    "missing_field": (
        "(kind = 'provenance' AND (subsong IS NULL OR build IS NULL OR policy_schema IS NULL)) OR (kind = 'plan' AND (key IS NULL OR subsong IS NULL OR requested_window_seconds IS NULL OR requested_passes IS NULL OR effective_window_seconds IS NULL OR effective_passes IS NULL OR known_track_length IS NULL OR track_length_seconds IS NULL OR offset_min_pct IS NULL OR offset_max_pct IS NULL))"
        " OR (kind = 'segment' AND (segment_index IS NULL OR segment_count IS NULL OR candidate IS NULL OR onset_count IS NULL OR reason IS NULL)) OR (kind = 'board' AND (key IS NULL OR holes > 0)) OR (kind = 'policy' AND (output_would_write IS NULL OR output_would_review_hold IS NULL OR source_candidate IS NULL OR output_bpm IS NULL))"
        " OR (kind = 'decision' AND (decided IS NULL OR decision_class IS NULL)) OR (kind = 'timing' AND total_ms IS NULL)"
    ),
    "unknown_schema": f"(kind = 'plan' AND NOT coalesce(schema = '{PLAN_SCHEMA}', FALSE)) OR (kind = 'board' AND NOT coalesce(schema = '{BOARD_SCHEMA}', FALSE))",
    "bad_segment": "kind = 'segment' AND (segment_count = 0 OR segment_index >= segment_count OR candidate NOT IN (0, 1) OR NOT reason RLIKE '^[a-z][a-z0-9_]*$')",
    "bad_flag": "kind = 'policy' AND source_candidate NOT IN (0, 1)",
    "unknown_output": "kind = 'final' AND (state IS NULL OR (state = 'WRITE' AND NOT coalesce(rate > 0, FALSE)))",
    "negative_time": "kind = 'timing' AND total_ms < 0",
}
#: What must hold for a track as a whole.
TRACK_RULES = {
    "duplicate_provenance": "n_provenance > 1", "duplicate_record": "n_plan > 1 OR n_policy > 1 OR n_decision > 1 OR n_timing > 1 OR n_final > 1", "duplicate_segment": "again > 0", "inconsistent_segments": "least_count < segment_count",
    "incomplete": "n_plan = 0 OR n_decision = 0 OR n_timing = 0 OR n_final = 0", "invalid_geometry": "window_seconds <= 0 OR passes <= 0 OR effective_window <= 0 OR effective_passes <= 0 OR NOT (offset_min >= 0 AND offset_min <= offset_max AND offset_max <= 100)", "contradiction": "state = 'WRITE' AND decided <= 0",
}
#: What must be the same for all tracks of a run.
RUN_RULES = {"mixed_builds": "build", "mixed_schemas": "policy_schema", "mixed_geometry": "geometry"}
_BY_LABEL = ("segment", "policy", "decision", "timing", "final")


def attached(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines with the key and subsong of their track, violations of lines that have none). records: read()."""
    source = records.where("kind = 'provenance'").select("run", "key", "subsong", "label")
    names = {"key": "t_key", "subsong": "t_subsong"}
    one = F.min(F.struct("key", "subsong"))
    labels = source.groupBy("run", "label").agg(F.count("*").alias("owners"), one.alias("t")).select("run", "label", "owners", *[F.col(f"t.{k}").alias(v) for k, v in names.items()])
    boards = source.groupBy("run", "label", "key").agg(F.count("*").alias("owners"), F.min("subsong").alias("t_subsong"))
    plans = source.groupBy("run", "key", "subsong").agg(F.count("*").alias("owners"))
    by_label = records.where(F.col("kind").isin(*_BY_LABEL)).drop("key", "subsong").join(labels, ["run", "label"], "left").withColumnsRenamed({v: k for k, v in names.items()})
    by_both = records.where("kind = 'board'").drop("subsong").join(boards, ["run", "label", "key"], "left").withColumnRenamed("t_subsong", "subsong")
    by_key = records.where("kind = 'plan'").join(plans, ["run", "key", "subsong"], "left")
    own = records.where("kind = 'provenance'").withColumn("owners", F.lit(1).cast("long"))
    every = own.unionByName(by_key).unionByName(by_both).unionByName(by_label)
    # a plan whose provenance came twice is the provenance's fault
    lost = every.where("owners IS NULL OR (owners > 1 AND kind <> 'plan')")
    name = F.when(F.col("owners").isNull(), "orphan").otherwise("ambiguous_label")
    return every.where("owners = 1 OR kind = 'plan' AND owners IS NOT NULL"), lost.groupBy("run", name.alias("violation")).agg(F.count("*").alias("n"))


def tracks(lines: DataFrame) -> DataFrame:
    """One row for each (run, key, subsong) of the attached lines, with what its lines say and how many there are of each kind."""
    again = lines.where("kind = 'segment'").groupBy("run", "key", "subsong", "segment_index").agg(F.count("*").alias("c")).groupBy("run", "key", "subsong").agg(F.sum(F.col("c") - 1).alias("again"))
    most = lambda name, of=None: F.max(of or name).alias(name)
    out = lines.groupBy("run", "key", "subsong").agg(
        F.max(F.when(F.col("kind") == "provenance", F.col("label"))).alias("label"), most("build"), most("policy_schema"), *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS.values()],
        most("window_seconds", "requested_window_seconds"), most("passes", "requested_passes"), most("effective_window", "effective_window_seconds"), most("effective_passes"), most("offset_min", "offset_min_pct"), most("offset_max", "offset_max_pct"),
        most("segment_count"), F.min("segment_count").alias("least_count"), F.sum("candidate").alias("candidates"), F.sum("onset_count").alias("onsets"), most("source_candidate"), most("decided"), most("decision_class"), most("total_ms"), most("state"), most("rate"),
        F.sum(F.when(F.col("kind") == "board", F.xxhash64("signature").cast("decimal(38,0)"))).alias("board_digest"),
    )
    out = out.join(again, ["run", "key", "subsong"], "left").withColumn("again", F.coalesce("again", F.lit(0)))
    geometry = F.concat_ws("/", "window_seconds", "passes", "offset_min", "offset_max")
    trace = F.when(F.col("n_segment") == 0, "NO_TRACE").when(F.col("n_segment") == F.col("segment_count"), "COMPLETE").otherwise("PARTIAL")
    return out.withColumn("geometry", geometry).withColumn("trace", trace)


def violations(records: DataFrame, lost: DataFrame, found: DataFrame) -> DataFrame:
    """(run, violation, n): everything that forbids to trust a run; no row for a sound one. found: tracks()."""

    def counted(df: DataFrame, rules: dict[str, str]) -> DataFrame:
        names = F.array_compact(F.array(*[F.when(F.expr(rule), F.lit(name)) for name, rule in rules.items()]))
        return df.select("run", F.explode(names).alias("violation")).groupBy("run", "violation").agg(F.count("*").alias("n"))

    runs = found.groupBy("run").agg(*[F.min(c).alias(f"lo_{n}") for n, c in RUN_RULES.items()], *[F.max(c).alias(f"hi_{n}") for n, c in RUN_RULES.items()])
    none = records.groupBy("run").agg(F.count_if(F.col("kind") == "provenance").alias("p")).where("p = 0").select("run", F.lit("no_provenance").alias("violation"), F.lit(1).cast("long").alias("n"))
    return counted(records, LINE_RULES).unionByName(lost).unionByName(counted(found, TRACK_RULES)).unionByName(counted(runs, {n: f"lo_{n} < hi_{n}" for n in RUN_RULES})).unionByName(none)


def sessions(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tracks, violations) of the runs in lines (run, line)."""
    records = staged(read(lines), "records")  # parsed once; four ways to attach read it
    every, lost = attached(records)
    found = staged(tracks(every), "tracks")
    return found, violations(records, lost, found)


def trusted(lines: DataFrame) -> DataFrame:
    """The tracks of runs that nothing speaks against, else Violation."""
    found, wrong = sessions(lines)
    first = wrong.orderBy("run", "violation").limit(1).collect()
    if first:
        raise Violation(f"{first[0]['violation']} ({first[0]['n']}) in run {first[0]['run']}")
    return found


def compared(a: DataFrame, b: DataFrame, across_builds: bool = False) -> DataFrame:
    """(key, subsong, from_state, to_state, changed, same_board, delta) of the tracks of two runs, or Violation where they can't be compared.

    Tracks, builds (unless across_builds) and policy must be the same, and of window length and number of passes one at most may differ; none may where builds do.
    """
    j = a.select("key", "subsong", F.lit(1).alias("a")).join(b.select("key", "subsong", F.lit(1).alias("b")), ["key", "subsong"], "full")
    if not j.where("a IS NULL OR b IS NULL").isEmpty():
        raise Violation("the runs have different tracks")
    one = lambda df: df.agg(*[F.min(c).alias(c) for c in ("build", "policy_schema", "window_seconds", "passes", "offset_min", "offset_max")]).first()
    x, y = one(a), one(b)
    if (x["policy_schema"], x["offset_min"], x["offset_max"]) != (y["policy_schema"], y["offset_min"], y["offset_max"]) or (x["build"] != y["build"] and not across_builds):
        raise Violation("the runs differ in build, policy or offsets")
    changed = (x["window_seconds"] != y["window_seconds"]) + (x["passes"] != y["passes"])
    if changed > (0 if across_builds else 1):
        raise Violation("more than one setting of the windows differs" if changed == 2 else "the windows of different builds differ")
    named = lambda df, n: df.select("key", "subsong", F.col("state").alias(f"{n}_state"), F.col("rate").alias(f"{n}_rate"), F.struct("n_board", "board_digest").alias(f"{n}_board"))
    met = named(a, "from").join(named(b, "to"), ["key", "subsong"])
    moved = ~F.col("from_state").eqNullSafe(F.col("to_state")) | (F.abs(F.coalesce("from_rate", F.lit(0.0)) - F.coalesce("to_rate", F.lit(0.0))) > 0.001)
    return met.select("key", "subsong", "from_state", "to_state", moved.alias("changed"), F.col("from_board").eqNullSafe(F.col("to_board")).alias("same_board"), (F.col("to_rate") - F.col("from_rate")).alias("delta"))
