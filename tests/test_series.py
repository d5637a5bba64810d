import random

import numpy as np
import pytest

from pulsegrid.operators import board, dsp, evidence, series, tags
from pulsegrid.sources import text_files, wave_files


@pytest.mark.parametrize(("length", "seconds", "passes", "want"), [(20.0, 20.0, 50, (50, 1, 950.0, 19.0, 50.0)), (180.0, 20.0, 50, (50, 50, 1000.0, 128.0, 7.8125)), (180.0, 20.0, 1, (1, 1, 20.0, 20.0, 1.0))])
def test_coverage(spark, length, seconds, passes, want):
    plan = series.window_plan(spark.createDataFrame([(1, length)], "track long, length_s double"), seconds, passes)
    r = series.window_coverage(plan).first()
    assert (r["passes"], r["distinct_starts"]) == want[:2]
    assert [r["processed_s"], r["unique_s"], r["redundancy"]] == pytest.approx(want[2:], abs=1e-3)


def test_plan_of_all_settings(spark):
    tracks = spark.createDataFrame([(1, 240.0), (2, None)], "track long, length_s double")
    for seconds in (5, 10, 15, 20, 30, 45, 60, 90):
        for passes in (1, 5, 50):
            rows = series.window_plan(tracks, float(seconds), passes).orderBy("track", "segment_index").collect()
            own = [r["start_s"] for r in rows if r["track"] == 1]
            assert len(own) == passes and own == sorted(own) and 0 <= own[0] and own[-1] <= 240 - seconds - 0.5
            assert [r["start_s"] for r in rows if r["track"] == 2] == [0.0]
    assert series.window_plan(tracks, 0.0, 3).first()["error"] == "invalid_window"


def test_segment_join_is_the_interval_join(spark):
    rng = random.Random(3)
    peaks = [(k % 2, rng.uniform(-5, 100)) for k in range(200)] + [(0, 10.0), (0, 30.0)]
    windows = [(t, i, s, d) for t in (0, 1) for i, (s, d) in enumerate([(0.0, 20.0), (10.0, 20.0), (5.5, 70.0), (30.0, 0.0), (99.0, 1.0)])]
    got = series.segment_join(spark.createDataFrame(peaks, "track long, t double"), spark.createDataFrame(windows, "track long, segment_index int, start_s double, duration_s double"), 20.0)
    want = sorted((t, i, p) for t, p in peaks for w, i, s, d in windows if t == w and s <= p < s + d)
    assert sorted(map(tuple, got.collect())) == want


def test_spacing_fold(spark):
    rng = random.Random(5)
    peaks = [(k % 3, round(rng.uniform(0, 50), 3), round(rng.uniform(0, 1), 3)) for k in range(150)]
    want = []
    for track in range(3):
        kept = []
        for _, t, w in sorted(p for p in peaks if p[0] == track):
            if kept and t - kept[-1][1] < 1.5:
                if w > kept[-1][2]:
                    kept[-1] = (track, t, w)
            else:
                kept.append((track, t, w))
        want += kept
    got = series.spaced(spark.createDataFrame(peaks, "track long, t double, weight double"), 1.5)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_cluster_fold(spark):
    rng = random.Random(7)
    values = [(k % 2, round(rng.uniform(0, 8), 2)) for k in range(80)]
    want = []
    for track in (0, 1):
        found: list[list] = []
        for x in sorted(v for t, v in values if t == track):
            for c in found:
                if abs(c[0] - x) <= 0.5:
                    c[0] = (c[0] * c[1] + x) / (c[1] + 1)
                    c[1] += 1
                    break
            else:
                found.append([x, 1])
        want += [(track, c, n) for c, n in sorted(found, key=lambda c: (-c[1], c[0]))[:3]]
    got = sorted(map(tuple, series.clusters(spark.createDataFrame(values, "track long, x double")).collect()))
    for g, w in zip(got, sorted(want), strict=True):
        assert g == pytest.approx(w)


def test_a_steady_pulse_is_found(spark):
    clicks = [(1, k * 0.5, 30.0) for k in range(60)]  # 120 a minute
    on = spark.createDataFrame(clicks, "track long, t double, span double")
    found = series.best_of_scan(series.scan(on, spark.createDataFrame([(1, 120.3)], "track long, centre double"), 0.75, 0.01, 60.0)).first()
    assert found["rate"] == pytest.approx(120.0, abs=0.011)
    assert series.recurrence(on.select("track", "t"), spark.createDataFrame([(1, 120.0)], "track long, rate double"), 60.0).first()["score"] > 0.9
    r = series.theil_sen(on.select("track", "t")).first()
    assert (r["taps"], r["period_s"], r["mad_s"]) == (30, pytest.approx(0.5), pytest.approx(0.0))


def test_window_fit():
    x = np.zeros(512)
    x[::32] = 1.0  # sixteen pulses in eight seconds: 120 a minute
    reason, tatums, error, rate, meter, score = dsp.window_fit(x, 64.0, 8.0)
    assert reason == "fit" and tatums % 16 == 0 and error == 0 and rate in (60, 90, 120, 180, 150) and meter and score > 0
    none = (0, 1.0, 0.0, "", 0.0)
    assert dsp.window_fit(np.zeros(4), 64.0, 8.0) == ("insufficient_odf", *none)
    assert dsp.window_fit(np.zeros(64), 64.0, 8.0) == ("insufficient_onsets", *none)
    one = np.zeros(64)
    one[[5, 20, 40]] = [9.0, 0.01, 0.01]
    assert dsp.window_fit(one, 64.0, 8.0) == ("single_event", *none)
    assert dsp.window_fit(x, 64.0, 0.1)[0] == "no_loop_hypotheses"


def test_onset_lag():
    x = np.zeros(40)
    x[[3, 13, 23, 33]] = 1.0
    assert dsp.onset_lag(x, 4) == 3
    assert dsp.onset_lag(np.arange(10.0), 1) == 9
    assert dsp.onset_lag(np.arange(10.0)[::-1], 1) == 0


def test_clicks_in_samples(spark):
    """Clicks at 120 a minute in eight seconds of samples are found as tatums of that rate; windows that can't be read say why."""
    rate, rng = 4096, np.random.default_rng(1)
    x = rng.standard_normal(8 * rate) * 1e-4
    for at in range(0, len(x), rate // 2):
        x[at : at + 40] += np.hanning(40) * np.sin(np.arange(40))
    rows = [(1, x.tolist()), (2, [0.0] * 100), (3, None), (4, [0.0] * 4096), (5, [float("nan")] * 2048)]
    got = {r["k"]: r for r in dsp.evaluate_windows(spark.createDataFrame(rows, "k long, x array<double>"), "k", "x", float(rate)).collect()}
    assert got[1]["reason"] == "fit" and got[1]["num_tatums"] % 16 == 0
    assert [got[k]["reason"] for k in (2, 3, 4, 5)] == ["invalid_input", "invalid_input", "insufficient_onsets", "invalid_input"]


def test_circular_frames():
    f = dsp.circular_frames(np.arange(16.0), 6, 4)
    assert f.shape == (4, 6) and f[0].tolist() == [14, 15, 0, 1, 2, 3] and f[-1].tolist() == [10, 11, 12, 13, 14, 15]


def test_autocorrelation_of_odd_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, None), (3, [1.0, None]), (4, [1.0, 0.0, 1.0, 0.0])], "k long, x array<double>")
    got = {r["k"]: r["acf"] for r in dsp.circular_autocorrelation(df, "k", "x").collect()}
    assert got[1] == [0.0, 0.0] and got[2] is None and got[3] is None and got[4] == pytest.approx([1.0, 0.0, 1.0])


def test_log_checks(spark):
    lines = spark.createDataFrame([("host: [a] view id=1 value=120,00 k=3 reason=x",), ("host: [a] view id=1 value=oops k=3 reason=y",), ("noise",)], "line string")
    found = evidence.parsed(evidence.events(lines))
    assert sorted((r["violation"], r["n"]) for r in evidence.violations(found, ["view"]).collect()) == [("bad_number", 1), ("duplicate_id", 1)]
    with pytest.raises(evidence.Violation):
        evidence.checked(found, ["view"])


def test_score_categories(spark):
    ref = spark.createDataFrame([(0, 120.0), (1, 128.0), (2, 140.0), (3, None), (4, None)], "ordinal int, reference double")
    seen = spark.createDataFrame([(0, 119.9, False), (1, 64.0, False), (2, 141.0, True), (3, 0.0, True), (4, 99.0, False)], "ordinal int, bpm double, held boolean")
    got = {r["ordinal"]: r["category"] for r in evidence.score_categories(ref, seen).collect()}
    assert got == {0: "within_two_percent", 1: "half_double_alias", 2: "abstained", 3: "correct_abstention", 4: "false_positive"}


def test_dry_run_writes_nothing(spark, tmp_path):
    d = spark.createDataFrame([(1, 120.0, False, 99.6), (2, 0.0, False, 1.0), (3, 99.0, True, 1.0), (4, 120.0, False, -5.0)], "track long, rate double, held boolean, confidence double")
    old = spark.createDataFrame([(1, "119.00"), (4, "120.00")], "track long, old string")
    out = tags.write(tags.delta(d, old), str(tmp_path / "t"), dry_run=True)
    assert [tuple(r) for r in out.collect()] == [(1, "119.00", "120.00", 100)] and not (tmp_path / "t").exists()
    tags.write(out, str(tmp_path / "t"), dry_run=False)
    assert (tmp_path / "t").exists()


def test_files(spark, tmp_path):
    import wave

    with wave.open(str(tmp_path / "a.wav"), "wb") as w:
        w.setnchannels(2), w.setsampwidth(2), w.setframerate(100)
        w.writeframes((np.arange(500, dtype="<i2")).repeat(2).tobytes())
    wave_files.register(spark)
    rows = spark.read.format("wave_windows").option("path", str(tmp_path / "*.wav")).option("seconds", 2).load().orderBy("segment_index").collect()
    assert [len(r["samples"]) for r in rows] == [200, 200, 100] and rows[1]["samples"][0] == pytest.approx(200 / 32768, abs=1e-3)
    (tmp_path / "rules.txt").write_text("﻿# c\nA = 128\r\n")
    assert [tuple(r) for r in text_files.rule_lines(spark, str(tmp_path / "rules.txt")).collect()][1] == (1, "A = 128")
    (tmp_path / "o.csv").write_text("index,bpm,held\n0,119.9,0\n")
    assert text_files.observations(spark, str(tmp_path / "o.csv")).first()["bpm"] == 119.9
    (tmp_path / "bad.csv").write_text("index,bpm,held\n0,x,0\n")
    with pytest.raises(Exception):  # noqa: B017
        text_files.observations(spark, str(tmp_path / "bad.csv")).collect()
    assert text_files.file_snapshot(spark, str(tmp_path / "o.csv")).first()["bytes"] == len("index,bpm,held\n0,119.9,0\n")


def test_manifest_and_observations_fail_closed(spark, tmp_path):
    case = '{"id": "%s", "reference_bpm": 120.0, "style": "s", "duration_sec": 8, "sample_rate": 100, "event_sample_positions": [0, 50]}'
    whole = '{"schema": "%s", "cases": [%s]}'
    good = whole % (text_files.MANIFEST_SCHEMA, ", ".join(case % x for x in "ab"))
    for name, text in (("good", good), ("version", good.replace("_v1", "_v2")), ("twice", whole % (text_files.MANIFEST_SCHEMA, ", ".join(case % x for x in "aa")))):
        (tmp_path / f"{name}.json").write_text(text)
    assert [(r["ordinal"], r["id"]) for r in text_files.manifest(spark, str(tmp_path / "good.json")).collect()] == [(0, "a"), (1, "b")]
    for name in ("version", "twice"):
        with pytest.raises(ValueError, match="manifest"):
            text_files.manifest(spark, str(tmp_path / f"{name}.json"))
    for i, rows in enumerate(("0,1.0,2", "0,1.0,0\n0,2.0,0", "0,1.0,0\n2,2.0,0")):
        (tmp_path / f"{i}.csv").write_text(f"index,bpm,held\n{rows}\n")
        with pytest.raises(ValueError, match="numbered"):
            text_files.observations(spark, str(tmp_path / f"{i}.csv"))


def test_snapshot_changes(spark, tmp_path):
    for name in "abc":
        (tmp_path / name).write_text(name)
    before = spark.createDataFrame(text_files.file_snapshot(spark, str(tmp_path), "salt").collect())
    (tmp_path / "a").write_text("changed")
    (tmp_path / "b").unlink()
    (tmp_path / "d").write_text("d")
    after = text_files.file_snapshot(spark, str(tmp_path), "salt")
    assert sorted(r["change"] for r in text_files.snapshot_changes(before, after).collect()) == ["added", "content", "removed"]
    assert before.first()["id"] != text_files.file_snapshot(spark, str(tmp_path), "other").first()["id"]


def test_folds_over_partitions(spark):
    """A fold sees each track whole and in order, however its rows were dealt out, and a long track streams through."""
    from pulsegrid.operators import families, folds

    rows = spark.range(0, 50_000).selectExpr("id % 3 as track", "id as t", "cast(id % 7 as double) as weight").repartition(13)
    got = folds.folded(rows, ["track"], ["t"], lambda: folds.Spaced(30), "t long, weight double")
    for track in range(3):
        kept, last = [], None
        for i in range(track, 50_000, 3):
            if last is None or i - last[0] >= 30:
                kept += [last] if last else []
                last = (i, i % 7)
            elif i % 7 > last[1]:
                last = (i, i % 7)
        assert [tuple(r) for r in got.where(f"track = {track}").orderBy("t").select("t", "weight").collect()] == [*kept, last]
    odd = spark.createDataFrame([(1, 1, None, 1.0, True), (1, 2, 100.0, 1.0, True), (1, 3, 101.0, 3.0, False)], "track long, segment int, rate double, score double, winner boolean")
    first = families.families(odd.where("rate is not null")).first()
    assert (first["rate"], first["support"], first["candidate_support"], first["best_rate"]) == (100.75, 2, 1, 101.0)


def test_empty_board(spark):
    rows = spark.createDataFrame([], "track long, segment int, rate double, score double, quant double, winner boolean")
    assert board.full_board(board.collapse(board.raw_board(rows))).count() == 0
