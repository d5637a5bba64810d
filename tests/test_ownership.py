"""Tokens that change their rule: each outcome, the lists after it, and counts that add up."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import ownership

RULES = {0: ["House", "Deep House"], 1: ["Techno"], 2: ["Drum Bass"], 9: ["Dance", "Techno House", "Old Words", "Minimal"]}
CASES = {
    # spelling: (source, target, outcome)
    "House": (0, 0, "stable"), "TECHNO": (1, 1, "stable"), "Techno House": (9, 1, "C"), "Old Words": (9, 9, "stable"), "Drum-Bass": (2, 2, "stable"), "Liquid Drum Bass": (None, 2, "B"), "Hard Techno": (None, 1, "C"),
    "Deep House Party": (None, 0, "B"), "Polka": (None, 9, "fallback"), "Dance Party": (None, 9, "fallback"), "one two three four techno": (None, 9, "fallback"), "Minimal": (9, 9, "stable"),
}


def canon(s):
    return s.lower().translate(str.maketrans("", "", " \t\r\n-_/\\.,|"))


@pytest.fixture(scope="module")
def frames(spark):
    tokens = spark.createDataFrame([(canon(s), s) for s in CASES], "canonical string, spelling string")
    owned = spark.createDataFrame([(r, p, canon(t), t) for r, ts in RULES.items() for p, t in enumerate(ts)], "rule_index int, place int, canonical string, token string")
    return tokens, owned, spark.createDataFrame([("dance",), ("minimal",)], "canonical string")


def test_outcomes(frames):
    tokens, owned, anchors = frames
    got = {r["spelling"]: (r["source"], r["target"], r["outcome"]) for r in ownership.outcomes(tokens, owned, anchors, F.lit(9)).collect()}
    assert got == CASES


def test_lists_and_counts(frames):
    tokens, owned, anchors = frames
    decided = ownership.outcomes(tokens, owned, anchors, F.lit(9))
    lists = {}
    for r in ownership.transferred(owned, decided, F.lit(9)).orderBy("rule_index", "place").collect():
        lists.setdefault(r["rule_index"], []).append(r["token"])
    assert lists == {0: ["House", "Deep House", "Deep House Party"], 1: ["Techno", "Hard Techno", "Techno House"], 2: ["Drum Bass", "Liquid Drum Bass"], 9: ["Dance", "Old Words", "Minimal", "Dance Party", "one two three four techno", "Polka"]}
    n = ownership.counts(decided, F.lit(9)).first()
    assert n["migrated"] == 1 and n["tokens"] == len(CASES) == n["stable"] + n["by_token"] + n["by_words"] + n["by_word"] + n["fallback"] + n["discarded"]


def test_without_a_catch_all_or_tokens(spark, frames):
    tokens, owned, anchors = frames
    none = F.lit(None).cast("int")
    got = {r["spelling"]: (r["target"], r["outcome"]) for r in ownership.outcomes(tokens, owned.where("rule_index < 9"), anchors, none).collect()}
    assert got["Polka"] == (None, "discarded") and got["Hard Techno"] == (1, "C")
    assert ownership.outcomes(tokens.where("false"), owned, anchors, F.lit(9)).count() == 0
    assert ownership.transferred(owned, ownership.outcomes(tokens.where("false"), owned, anchors, F.lit(9)), F.lit(9)).count() == owned.count()
