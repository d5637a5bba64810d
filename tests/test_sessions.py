"""Runs whose lines stand mixed: sound ones, and one for each way in which a run can't be trusted."""

import random

import pytest

from pulsegrid.operators import sessions
from pulsegrid.operators.evidence import Violation

BOARD = " ".join(f"{b}={i}" for i, b in enumerate(sessions.BOARD))


def track(key, sub=0, label=None, *, build="b1", policy="p1", window=20, passes=50, segments=((0, 2, "single_event"), (1, 2, "below_threshold")), boards=(BOARD,), final="120,50 BPM, confidence=80", decided="120,5", ms="500,25", write=True):
    label = label or f"Artist - {key}"
    own = f"track_key={key} subsong={sub}"
    lines = {
        "provenance": [f"MirAnalysisProvenance {own} build_id={build} policy_schema={policy}"],
        "plan": [f"MirSamplingPlan schema=mir_sampling_plan_v1 {own} requested_window_seconds={window} requested_passes={passes} effective_window_seconds={window}.0 effective_passes={passes} known_track_length=1 track_length_seconds=180,5 offset_min_pct=20 offset_max_pct=80"],
        "segment": [f"XPrimarySegment segment_index={i} segment_count={n} candidate=0 onset_count=4 reason={r}" for i, n, r in segments],
        "board": [f"MirPolicyCandidateBoard schema=mir_policy_candidate_board_v1 track_key={key} index={i} {b}" for i, b in enumerate(boards)],
        "policy": [f"MirPolicyDecision output_would_write={int(write)} output_would_review_hold={int(not write)} source_candidate=1 output_bpm=120.5"],
        "decision": [f"Decision: final={decided}, decision_class=measured, x=1"], "timing": [f"Track Timing: decode_ms=3, total_ms={ms}"], "final": [f"Final Output: {final}"],
    }
    return {k: [f"host: [{label}] {x}" for x in v] for k, v in lines.items()}


def lines_of(*tracks):
    return [x for t in tracks for v in t.values() for x in v]


def changed(t, kind, old, new):
    return t | {kind: [x.replace(old, new) for x in t[kind]]}


A, B = track(11), track(12, 1)
BROKEN = {
    "duplicate_provenance": lines_of(A, B) + A["provenance"],
    "malformed_identity": lines_of(changed(A, "provenance", "track_key=11", "track_key=x1"), B),
    "missing_field": lines_of(changed(A, "plan", "effective_passes=50 ", ""), B),
    "orphan": lines_of(A, B) + track(99)["timing"],
    "ambiguous_label": lines_of(track(11, label="same"), track(12, label="same")),
    "unknown_schema": lines_of(changed(A, "plan", "plan_v1", "plan_v2"), B),
    "bad_segment": lines_of(track(11, segments=((2, 2, "single_event"),)), B),
    "bad_flag": lines_of(changed(A, "policy", "source_candidate=1", "source_candidate=2"), B),
    "unknown_output": lines_of(track(11, final="maybe 120"), B),
    "negative_time": lines_of(track(11, ms="-5"), B),
    "duplicate_record": lines_of(A, B) + A["final"],
    "duplicate_segment": lines_of(track(11, segments=((0, 2, "single_event"), (0, 2, "single_event"))), B),
    "inconsistent_segments": lines_of(track(11, segments=((0, 2, "single_event"), (1, 3, "single_event"))), B),
    "incomplete": lines_of(A | {"plan": []}, B),
    "invalid_geometry": lines_of(track(11, window=0), track(12, window=0)),
    "contradiction": lines_of(track(11, decided="0"), B),
    "mixed_builds": lines_of(A, track(12, build="b2")),
    "mixed_schemas": lines_of(A, track(12, policy="p2")),
    "mixed_geometry": lines_of(A, track(12, passes=20)),
    "no_provenance": lines_of(A | {"provenance": []}),
}
SOUND = {
    "sound": lines_of(A, B), "held": lines_of(track(11, final="no writable BPM (review)", write=False), B), "comma_label": lines_of(track(11, label="a, b] [c"), B),
    "noise": ["", "host: [x] Unrelated a=1", "no record at all", *lines_of(A, B)], "marked": ["\ufeff" + lines_of(A, B)[0], *lines_of(A, B)[1:]],
}


@pytest.fixture(scope="module")
def results(spark):
    rows = [(name, line) for name, lines in {**BROKEN, **SOUND}.items() for line in lines]
    random.Random(3).shuffle(rows)
    found, wrong = sessions.sessions(spark.createDataFrame(rows, "run string, line string").repartition(5))
    violations = {}
    for r in wrong.collect():
        violations.setdefault(r["run"], {})[r["violation"]] = r["n"]
    return {(r["run"], r["key"], r["subsong"]): r for r in found.collect()}, violations


@pytest.mark.parametrize("name", BROKEN)
def test_rejected(results, name):
    assert name in results[1].get(name, {}), results[1].get(name)


@pytest.mark.parametrize("name", SOUND)
def test_sound(results, name):
    tracks, violations = results
    assert name not in violations
    one, two = tracks[name, "11", 0], tracks[name, "12", 1]
    assert (one["n_segment"], one["trace"], one["n_board"], one["total_ms"], two["rate"]) == (2, "COMPLETE", 1, 500.25, 120.5)
    assert one["state"] == ("HOLD" if name == "held" else "WRITE") and (one["rate"] is None) == (name == "held")
    assert one["label"] == ("a, b] [c" if name == "comma_label" else "Artist - 11")


def frame(spark, lines):
    return spark.createDataFrame([("r", x) for x in lines], "run string, line string")


def test_trusted(spark):
    assert sessions.trusted(frame(spark, SOUND["sound"])).count() == 2
    with pytest.raises(Violation, match="duplicate_record"):
        sessions.trusted(frame(spark, BROKEN["duplicate_record"]))


def test_partial_and_missing_traces(spark):
    got = {r["key"]: r["trace"] for r in sessions.trusted(frame(spark, lines_of(track(11, segments=((0, 3, "single_event"),)), track(12, segments=())))).collect()}
    assert got == {"11": "PARTIAL", "12": "NO_TRACE"}


def test_compared(spark):
    run = lambda *t: sessions.trusted(frame(spark, lines_of(*t)))
    before = run(track(11, final="no writable BPM", write=False), B)
    after = run(track(11), track(12, 1, boards=(BOARD, BOARD.replace("origin=0", "origin=9"))))
    got = {r["key"]: tuple(r)[2:] for r in sessions.compared(before, after).collect()}
    assert got == {"11": ("HOLD", "WRITE", True, True, None), "12": ("WRITE", "WRITE", False, False, 0.0)}
    assert sessions.compared(before, run(track(11, passes=20), track(12, 1, passes=20))).count() == 2
    assert sessions.compared(before, run(track(11, build="b2"), track(12, 1, build="b2")), across_builds=True).count() == 2
    for other in (run(A), run(track(11, build="b2"), track(12, 1, build="b2")), run(track(11, policy="p2"), track(12, 1, policy="p2")), run(track(11, passes=20, window=10), track(12, 1, passes=20, window=10))):
        with pytest.raises(Violation):
            sessions.compared(before, other)
    with pytest.raises(Violation):
        sessions.compared(before, run(track(11, build="b2", passes=20), track(12, 1, build="b2", passes=20)), across_builds=True)


ODD = {
    "build_id=b1": "b1", "x build_id=b=2 y": "b=2", "build_id= build_id=b3": "b3", "x build_id=": None, "xbuild_id=b4": None, "x\tbuild_id=b5\tz": "b5", "build_id=b6 build_id=b7": "b6", "build_id=\u00a0b8": "\u00a0b8", "": None,
    "build_id= x build_id=b9": "b9", "build_id=\r\fbuild_id=c1": None, "a build_id": None,
}


def test_fields_of_odd_payloads(spark):
    """Of several the first that has a value; any white space parts them."""
    import re

    lines = [f"h: [{i}] MirAnalysisProvenance {x}" for i, x in enumerate(ODD)]
    got = {r["label"]: r["build"] for r in sessions.read(frame(spark, lines)).collect()}
    for i, (payload, want) in enumerate(ODD.items()):
        if "\r" in payload:  # a line's end is in no record
            assert str(i) not in got
            continue
        found = re.search(r"(?:^|[ \t\n\x0b\f\r])build_id=([^ \t\n\x0b\f\r]+)", payload)
        assert got[str(i)] == want == (found and found[1])


def test_board_signature(spark):
    lines = [f"h: [a] MirPolicyCandidateBoard {BOARD}", f"h: [b] MirPolicyCandidateBoard {BOARD.replace('rows=', 'row=')}", "h: [c] MirPolicyDecision x=1"]
    got = {r["label"]: (r["signature"], r["holes"]) for r in sessions.read(frame(spark, lines)).collect()}
    whole = [str(i) for i in range(len(sessions.BOARD))]
    assert got["a"] == (" ".join(whole), 0) and got["c"] == (" ".join("?" * len(whole)), len(whole))
    assert got["b"] == (" ".join("?" if b == "rows" else i for i, b in zip(whole, sessions.BOARD)), 1)


def test_lines_are_parsed_by_few_patterns(spark, sf_dir):
    """Events are dealt out before they are lines, and no line meets its pattern more than twice."""
    from pulsegrid.plans import sessions as plans

    lines = plans._run(spark, sf_dir)
    assert "event_id" in "".join(x for x in lines._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Repartition" in x)
    plan = sessions.read(frame(spark, ["h: [a] Decision: final=1"])).select("label", "kind", "key")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("AnalysisProvenance|") == 2
