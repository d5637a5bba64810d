"""Runs whose lines stand mixed: tracks by provenance, violations, and what two sound runs say of the same tracks."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import sessions
from pulsegrid.sources import inputs

#: Events whose lines one task parses.
SHARE = 100_000

_K = {True: "CAST(get_json_object(props, '$.k') AS BIGINT)", False: "CAST((props->>'$.k') AS BIGINT)"}
_OF = "'host: [T' || (CASE WHEN u % 37 = 0 THEN u - 1 ELSE u END) || '] '"
_KEY = "'track_key=' || (1000 + u) || ' subsong=' || (u % 2)"
_USERS = "SELECT user_id AS u, count(*) AS n, CAST(floor(max(value) * 10) AS BIGINT) AS v FROM {events} GROUP BY user_id"


def _lines(spark: bool) -> str:
    """One text for both engines: lines of a run whose tracks are users; some share a label, lack a plan or repeat a segment."""
    board = " || ' ' || ".join(f"'{b}=' || (event_id % {7 + i})" for i, b in enumerate(sessions.BOARD))
    per_user = {
        "TRUE": f"'RunAnalysisProvenance ' || {_KEY} || ' build_id=b1 policy_schema=p1'",
        "u % 29 <> 0": f"'RunSamplingPlan ' || {_KEY} || ' schema={sessions.PLAN_SCHEMA} requested_window_seconds=20 requested_passes=50 effective_window_seconds=20.0 effective_passes=50 known_track_length=1 track_length_seconds=180.5 offset_min_pct=20 offset_max_pct=80'",
        "u % 31 <> 0": "'RunPolicyDecision output_would_write=1 output_would_review_hold=0 source_candidate=' || (u % 2) || ' output_bpm=' || (v % 90 + 60)",
        "u >= 0": "'Decision: final=' || (v % 90 + 60) || ',25, decision_class=measured'",
        "n >= 0": "'Track Timing: decode_ms=3, total_ms=' || n || ',5'",
        "v >= 0": "'Final Output: ' || CASE WHEN u % 5 = 0 THEN 'no writable BPM' ELSE (v % 90 + 60) || ',50 BPM, confidence=80' END",
    }
    own = [f"SELECT 'A' AS run, {_OF} || {line} AS line FROM us WHERE {where}" for where, line in per_user.items()]
    events = f"SELECT user_id AS u, event_id, event_type, {_K[spark]} AS k FROM {{{'dealt' if spark else 'events'}}}"
    segment = f"SELECT 'A', {_OF} || 'RunPrimarySegment segment_index=' || k || ' segment_count=100 candidate=' || (event_id % 2) || ' onset_count=' || (event_id % 50) || ' reason=' || CASE WHEN event_id % 3 = 0 THEN 'insufficient_onsets' ELSE 'below_threshold' END FROM ev WHERE event_type = 'view'"
    boards = f"SELECT 'A', {_OF} || 'RunPolicyCandidateBoard track_key=' || (1000 + u) || ' schema={sessions.BOARD_SCHEMA} ' || {board} FROM ev WHERE event_type = 'click'"
    other = f"SELECT 'A', {_OF} || 'Unrelated id=' || event_id FROM ev WHERE event_type = 'error'"
    return f"WITH us AS ({_USERS}), ev AS ({events}) {' UNION ALL '.join([*own, segment, boards, other])}"


def _run(spark, d):  # noqa: ANN001, ANN202
    events = inputs.table(spark, d, "events")
    # lines are made of events that are dealt out while narrow: a file of few row groups would keep few tasks at parsing
    return spark.sql(_lines(True), events=events, dealt=events.repartition(inputs.tasks(spark, d, SHARE, "events"), "event_id"))


def run_sessions(spark, d):  # noqa: ANN001, ANN201
    found, _ = sessions.sessions(_run(spark, d))
    return found.select("key", "subsong", "label", "build", "geometry", "n_segment", "again", "trace", "candidates", "onsets", "n_board", "source_candidate", "state", F.round("rate", 6).alias("rate"), F.round("decided", 6).alias("decided"), "decision_class", F.round("total_ms", 6).alias("total_ms"))


def run_violations(spark, d):  # noqa: ANN001, ANN201
    return sessions.sessions(_run(spark, d))[1]


_R = sessions._LINE.replace("'", "''")
_F = lambda name: f"nullif(regexp_extract(payload, '(?:^|\\s){name}=(\\S+)', 1), '')"
_L = lambda name: f"nullif(regexp_extract(payload, '(?:^|, ){name}=(.*?)(?:, |$)', 1), '')"
_I = lambda name: f"TRY_CAST({_F(name)} AS BIGINT) AS {name}"
_D = lambda text: f"TRY_CAST(replace({text}, ',', '.') AS DOUBLE)"
_KINDS = " ".join(f"WHEN name LIKE '%{e}' THEN '{k}'" for e, k in reversed(sessions.KINDS.items()))
_SQL = f"""lines AS ({_lines(False).replace('{events}', 'events')}), r0 AS (SELECT regexp_extract(line, '{_R}', 1) AS label, regexp_extract(line, '{_R}', 2) AS name, trim(regexp_extract(line, '{_R}', 3)) AS payload FROM lines WHERE regexp_matches(line, '{_R}')),
rec AS (SELECT label, CASE WHEN name LIKE '%PolicyDecision' THEN 'policy' {_KINDS} END AS kind, {_F('track_key')} AS key, {', '.join(_I(n) for n in ('subsong', 'requested_window_seconds', 'requested_passes', 'offset_min_pct', 'offset_max_pct', 'segment_index', 'segment_count', 'candidate', 'onset_count', 'source_candidate'))}, {_F('build_id')} AS build,
  {_D(_L('final'))} AS decided, {_L('decision_class')} AS decision_class, {_D(_L('total_ms'))} AS total_ms, CASE WHEN payload LIKE 'no writable BPM%' THEN 'HOLD' WHEN payload LIKE '% BPM%' THEN 'WRITE' END AS state, {_D("regexp_extract(payload, '^([0-9,]+) BPM', 1)")} AS rate FROM r0),
pv AS (SELECT key, subsong, label, build FROM rec WHERE kind = 'provenance'), lb AS (SELECT label, count(*) AS owners, min(key) AS key, min(subsong) AS subsong FROM pv GROUP BY label),
att AS (SELECT rec.* EXCLUDE (key, subsong), lb.key, lb.subsong, owners FROM rec LEFT JOIN lb USING (label) WHERE kind NOT IN ('provenance', 'plan', 'board') UNION ALL BY NAME SELECT rec.*, (SELECT nullif(count(*), 0) FROM pv WHERE pv.key = rec.key AND pv.subsong = rec.subsong) AS owners FROM rec WHERE kind IN ('plan', 'provenance')
  UNION ALL BY NAME SELECT rec.* EXCLUDE (subsong), pv.subsong, CASE WHEN pv.key IS NOT NULL THEN 1 END AS owners FROM rec LEFT JOIN pv ON rec.key = pv.key AND rec.label = pv.label WHERE kind = 'board'),
ok AS (SELECT * FROM att WHERE owners = 1), ag AS (SELECT key, subsong, sum(c - 1)::BIGINT AS again FROM (SELECT key, subsong, segment_index, count(*) AS c FROM ok WHERE kind = 'segment' GROUP BY ALL) GROUP BY ALL),
tr AS (SELECT ok.key, ok.subsong, max(CASE WHEN kind = 'provenance' THEN label END) AS label, max(build) AS build, max(requested_window_seconds) || '/' || max(requested_passes) || '/' || max(offset_min_pct) || '/' || max(offset_max_pct) AS geometry, count_if(kind = 'segment') AS n_segment, max(segment_count) AS segment_count, sum(candidate)::BIGINT AS candidates, sum(onset_count)::BIGINT AS onsets, count_if(kind = 'board') AS n_board,
  max(source_candidate) AS source_candidate, max(state) AS state, max(rate) AS rate, max(decided) AS decided, max(decision_class) AS decision_class, max(total_ms) AS total_ms, count_if(kind = 'plan') AS n_plan, count_if(kind = 'decision') AS n_decision, count_if(kind = 'timing') AS n_timing, count_if(kind = 'final') AS n_final, count_if(kind = 'policy') AS n_policy FROM ok GROUP BY ok.key, ok.subsong),
tk AS (SELECT tr.*, coalesce(again, 0) AS again, CASE WHEN n_segment = 0 THEN 'NO_TRACE' WHEN n_segment = segment_count THEN 'COMPLETE' ELSE 'PARTIAL' END AS trace FROM tr LEFT JOIN ag USING (key, subsong))"""

QUERIES = {f.__name__: f for f in (run_sessions, run_violations)}
ORACLE = {
    "run_sessions": f"WITH {_SQL} SELECT key, subsong, label, build, coalesce(geometry, '') AS geometry, n_segment, again, trace, candidates, onsets, n_board, source_candidate, state, round(rate, 6) AS rate, round(decided, 6) AS decided, decision_class, round(total_ms, 6) AS total_ms FROM tk",
    "run_violations": f"""WITH {_SQL} SELECT 'A' AS run, violation, n FROM (SELECT CASE WHEN owners IS NULL THEN 'orphan' ELSE 'ambiguous_label' END AS violation, count(*) AS n FROM att WHERE owners IS NULL OR owners > 1 GROUP BY ALL
      UNION ALL SELECT 'duplicate_segment', count_if(again > 0) FROM tk UNION ALL SELECT 'incomplete', count_if(n_plan = 0 OR n_decision = 0 OR n_timing = 0 OR n_final = 0) FROM tk UNION ALL SELECT 'mixed_geometry', CASE WHEN min(coalesce(geometry, '')) < max(coalesce(geometry, '')) THEN 1 ELSE 0 END FROM tk) WHERE n > 0""",
}
