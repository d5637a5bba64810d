"""Which rule owns a token of a library: rules keep what is theirs, the catch-all gives tokens up to rules that know them better.

A token that a specific rule has stays there. Others look for a rule: as they are (A), by two to four of their first four words together
(B), or by a single word (C); a word that only the catch-all or the anchors know finds none. What the catch-all has moves to the rule found; what nobody has
joins the rule found, or else the catch-all, or else is left out. The rules' lists are then rebuilt in their order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.operators.routing import canonical

STABLE, FALLBACK, DISCARDED = "stable", "fallback", "discarded"


def grams(tokens: DataFrame) -> DataFrame:
    """(canonical, gram, stage, size) of tokens (canonical, spelling): the token itself, and what its first four words spell together or alone."""
    words = F.slice(F.filter(F.split(F.lower("spelling"), "[ _-]+"), lambda x: x != ""), 1, 4)
    spelt = tokens.select("canonical", words.alias("w")).where(F.size("w") > 0)
    ends = F.transform(F.sequence(F.lit(1), F.size("w")), lambda a: F.transform(F.sequence(a, F.size("w")), lambda b: F.struct(a.alias("a"), (b - a + 1).alias("size"))))
    spans = spelt.select("canonical", "w", F.explode(F.flatten(ends)).alias("s"))
    several = spans.select("canonical", canonical(F.array_join(F.slice("w", F.col("s.a"), F.col("s.size")), "")).alias("gram"), F.when(F.col("s.size") > 1, "B").otherwise("C").alias("stage"), F.col("s.size").alias("size"))
    return tokens.select("canonical", F.col("canonical").alias("gram"), F.lit("A").alias("stage"), F.lit(0).alias("size")).union(several)


def outcomes(tokens: DataFrame, owned: DataFrame, anchors: DataFrame, catch_all: Column) -> DataFrame:
    """(canonical, spelling, source, target, outcome) for each token (canonical, spelling).

    owned: the rules' tokens (rule_index, place, canonical, token); anchors: (canonical), words that name no genre; catch_all: the index of the
    catch-all rule, or null. Of several rules a token finds, the best by stage, then more words, then longer text, then the first rule.
    """
    caught = F.coalesce(F.col("rule_index") == catch_all, F.lit(False))
    holders = owned.groupBy("canonical").agg(F.min(F.when(~caught, F.col("rule_index"))).alias("specific"), F.min(F.when(caught, F.col("rule_index"))).alias("general"))
    knows = owned.where(~caught).select(F.col("canonical").alias("gram"), "rule_index").distinct().join(anchors.select(F.col("canonical").alias("gram")), "gram", "left_anti")
    met = grams(tokens).join(knows, "gram")
    order = Window.partitionBy("canonical").orderBy("stage", F.desc("size"), F.desc(F.char_length("gram")), "rule_index")
    best = met.withColumn("n", F.row_number().over(order)).where("n = 1").select("canonical", "rule_index", "stage")
    j = tokens.select("canonical", "spelling").join(holders, "canonical", "left").join(best, "canonical", "left")
    source = F.coalesce("specific", "general")
    outcome = F.when(F.col("specific").isNotNull(), STABLE).when(F.col("rule_index").isNotNull(), F.col("stage")).when(F.col("general").isNotNull(), STABLE).when(catch_all.isNotNull(), FALLBACK).otherwise(DISCARDED)
    target = F.when(F.col("specific").isNotNull(), F.col("specific")).otherwise(F.coalesce("rule_index", "general", F.when(F.col("general").isNull(), catch_all)))
    return j.select("canonical", "spelling", source.cast("int").alias("source"), target.cast("int").alias("target"), outcome.alias("outcome"))


def transferred(owned: DataFrame, decided: DataFrame, catch_all: Column) -> DataFrame:
    """(rule_index, place, canonical, token): the rules' tokens after all transfers, numbered anew; new ones come last, by their spelling.

    A token leaves the catch-all when a rule was found for it, and joins a rule's list once. owned and decided: as for outcomes().
    """
    moves = decided.where(F.col("outcome").isin("A", "B", "C", FALLBACK))
    gone = moves.where((F.col("source") == catch_all) & (F.col("source") != F.col("target"))).select(F.col("source").alias("rule_index"), "canonical")
    kept = owned.join(gone, ["rule_index", "canonical"], "left_anti").select("rule_index", F.lit(0).alias("new"), F.col("place").cast("long").alias("at"), "canonical", "token")
    added = moves.select(F.col("target").alias("rule_index"), "canonical", F.col("spelling").alias("token")).join(owned.select("rule_index", "canonical"), ["rule_index", "canonical"], "left_anti")
    added = added.select("rule_index", F.lit(1).alias("new"), F.lit(0).cast("long").alias("at"), "canonical", "token")
    order = Window.partitionBy("rule_index").orderBy("new", "at", F.lower("token"), "token")
    return kept.union(added).select("rule_index", (F.row_number().over(order) - 1).alias("place"), "canonical", "token")


def counts(decided: DataFrame, catch_all: Column) -> DataFrame:
    """(tokens, stable, by_token, by_words, by_word, fallback, discarded, migrated): one row; the outcomes add up to the tokens."""
    of = lambda *names: F.count_if(F.col("outcome").isin(*names))
    moved = F.count_if(F.coalesce((F.col("source") == catch_all) & (F.col("target") != F.col("source")), F.lit(False)))
    return decided.agg(F.count("*").alias("tokens"), of(STABLE).alias("stable"), of("A").alias("by_token"), of("B").alias("by_words"), of("C").alias("by_word"), of(FALLBACK).alias("fallback"), of(DISCARDED).alias("discarded"), moved.alias("migrated"))
