"""Rule import: patterns, anchors, the catch-all rule, edits of a rule list and what an import did."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsegrid.operators import routing
from pulsegrid.operators.routing import canonical

#: The tokens that mark the old factory catch-all rule.
SIGNATURE = ("dance", "electro", "club", "electronic", "edm")
#: The generic anchors that a user starts with.
ANCHORS = "Beat; Beats; Club; Dance; EDM; Electro; Electronic"
DEFAULT_RULES = """
Hardstyle = center 150.00, spread 12.00
Hard Techno = center 152.50, spread 16.00
Hardcore; Gabber; Mainstream Hardcore = center 180.00, spread 16.00
Frenchcore = center 195.00, spread 18.00
Rave; Oldskool Rave; Bouncy Techno = center 140.00, spread 20.00
Happy Hardcore = center 170.00, spread 16.00
Drum & Bass; Drum And Bass; Drum n Bass; Drum'n'Bass; DnB; D&B; Jungle; Neurofunk; Liquid DnB; Liquid Funk; Jump Up = center 174.00, spread 12.00
Breakcore; Digital Hardcore = center 210.00, spread 18.00
Breakbeat; Breaks; Nu-Skool Breaks; Progressive Breaks = center 130.00, spread 15.00
Happy Breakbeat; Breakbeat Hardcore; Hardcore Breaks = center 165.00, spread 18.00
Big Beat; Chemical Breaks = center 125.00, spread 18.00
Lo-Fi Beats; Boom Bap Beats = center 85.00, spread 25.00
Beat; 60s Beat; Beats = center 120.00, spread 35.00
Eurodance; Hands Up; Italo Dance = center 138.00, spread 15.00
Dance Pop 90s = center 135.00, spread 20.00
Uplifting Trance; Melodic Trance; Club-Trance = center 140.00, spread 14.00
Vocal Trance; Progressive-Vocal-Trance; Vocal-Club-Trance = center 136.00, spread 16.00
Trance = center 138.00, spread 20.00
Progressive Trance; Psy-Prog; Progressive Psytrance = center 135.00, spread 16.00
Psytrance; Psy-Trance; Goa; Goa Trance; Psy = center 144.00, spread 14.00
Euro-House; Euro House; Hip-House; Hip House; Garage House; 90s House = center 125.00, spread 16.00
House; Deep House; Progressive House; Melodic House; Tech House; Acid House; Club-House; Electro House; Future House; Italo House; Minimal-House = center 127.00, spread 14.00
Disco; Nu Disco; Boogie; Italo Disco = center 120.00, spread 18.00
Minimal-Techno; Minimal Techno = center 125.00, spread 12.00
Techno; Peak Time Techno; Hardgroove = center 134.00, spread 14.00
Dubstep; Grime = center 140.00, spread 14.00
Trap = center 145.00, spread 20.00
Halftime; Halftime DnB = center 86.00, spread 12.00
UK Garage; 2-Step = center 130.00, spread 12.00
Bassline; Speed Garage = center 139.00, spread 12.00
Phonk; Drift Phonk; Phonk House = center 135.00, spread 22.00
Amapiano = center 111.00, spread 12.00
Afro House; Gqom = center 122.00, spread 14.00
Hip-Hop; Rap; R&B; RnB; Boom Bap = center 92.50, spread 25.00
Reggaeton; Dancehall; Dembow = center 107.50, spread 18.00
Tribal; Tribal House; Tribal Trance = center 125.00, spread 18.00
Salsa = center 180.00, spread 20.00
Merengue = center 165.00, spread 18.00
Bachata; Cumbia = center 120.00, spread 18.00
Downtempo; Lounge = center 90.00, spread 22.00
Chill; Chillout; Easy Listening = center 85.00, spread 30.00
Dance; Electro; Club; Electronic; EDM = center 125.00, spread 20.00
""".strip().split("\n")  # fmt: skip


def composed(text: Column | str) -> Column:
    """Unicode composition (NFC), for which there is no built-in function; null stays null."""

    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(nfc, T.StringType())(text)


def pattern_terms(rows: DataFrame) -> DataFrame:
    """(rule_index, tokenizable, terms) of rule patterns (rule_index, names): a wrapped alternation, a list, or one name.

    Any other regular expression is left as it is and has no terms. Stars at either end of a term go; empty terms count for nothing.
    """
    p = F.trim("names")
    wrapped = p.startswith(".*(") & p.endswith(").*") & (F.length(p) > 6)
    clean = lambda x: F.trim(F.regexp_replace(F.trim(x), r"^\*+|\*+$", ""))
    terms = lambda a: F.filter(F.transform(a, clean), lambda x: x != "")
    body = F.substring(p, 4, F.length(p) - 6)
    # a backslash escapes what follows it; one at the end stands for itself
    inner = terms(F.transform(F.split(body, r"\|"), lambda x: F.regexp_replace(x, r"\\(.)", "$1")))
    several = p.contains(";") | p.contains(",")
    meta = p.rlike(r"[\^$()\[\]{}+?*|\\]")
    found = F.when(wrapped, inner).when(several, terms(F.split(p, "[;,]"))).when(meta, F.array().cast("array<string>")).otherwise(terms(F.array(p)))
    return rows.select("rule_index", (wrapped | several | ~meta).alias("tokenizable"), found.alias("terms"))


def anchors_of(text: Column) -> Column:
    """The distinct canonical tokens of a list, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.split(text, "[,;]"), canonical), lambda x: x != "")))


def with_generic(tokened: DataFrame, anchors: list[str]) -> DataFrame:
    """Adds generic to rules' tokens (rule_index, canonical, ...): anchors, and all tokens of the catch-all rule.

    That is a rule of two anchors or more and nothing else, or one with the whole factory signature; of several, the one with the
    most anchors, then the greatest share of them, then the first.
    """
    anchor = F.col("canonical").isin(*anchors) if anchors else F.lit(False)
    n, a = F.count("*"), F.count_if(anchor)
    signed = F.size(F.collect_set(F.when(F.col("canonical").isin(*SIGNATURE), F.col("canonical")))) == len(SIGNATURE)
    rules = tokened.groupBy("rule_index").agg(n.alias("n"), a.alias("a"), signed.alias("signed")).where("a >= 2 and a = n or signed")
    best = rules.select(F.struct(F.col("a"), (F.col("a") / F.col("n")).alias("share"), (-F.col("rule_index")).alias("r")).alias("s")).agg(F.max("s").alias("s")).select((-F.col("s.r")).alias("chosen"))
    out = tokened.join(F.broadcast(best), F.lit(True), "left")  # one row
    return out.withColumn("generic", anchor | F.coalesce(F.col("rule_index") == F.col("chosen"), F.lit(False))).drop("chosen")


def newly_generic(tokened: DataFrame, anchors: list[str]) -> DataFrame:
    """(canonical, token): tokens of the catch-all rule that no other rule has and that aren't anchors yet; `?` never counts."""
    marked = with_generic(tokened, anchors)
    all_generic = F.bool_and("generic").over(Window.partitionBy("rule_index"))
    catch_all = marked.withColumn("all", all_generic).where("all")
    several = catch_all.groupBy("rule_index").agg(F.count("*").alias("n")).where("n >= 2").select("rule_index")
    own = catch_all.join(several, "rule_index", "left_semi").where(~F.col("canonical").isin(*anchors, "?"))
    owned = tokened.select("canonical", F.col("rule_index").alias("other"))
    return own.join(owned, (own["canonical"] == owned["canonical"]) & (own["rule_index"] != owned["other"]), "left_anti").select("canonical", "token")


def with_fallback(matched: DataFrame, tracks: DataFrame, rule_tokens: DataFrame) -> DataFrame:
    """matches(), with the first rule that has a `?` for tracks that meet none. A generic match has no rail of its own: centre and spread are 0."""
    q = rule_tokens.where("canonical = '?'").agg(F.min("rule_index").alias("rule_index")).where("rule_index is not null")
    rest = tracks.select("track").distinct().join(matched, "track", "left_anti").join(F.broadcast(q), F.lit(True))  # one row at most
    return matched.unionByName(rest.select("track", F.lit(1).alias("rank"), "rule_index", F.lit("?").alias("token"), F.lit(False).alias("generic")))


def renumbered(rules: DataFrame, order: Column) -> DataFrame:
    """rules numbered anew from 0 by the given order; a rule list is small, one task orders it."""
    return rules.withColumn("rule_index", (F.row_number().over(Window.orderBy(order)) - 1).cast("int"))


def appended(rules: DataFrame, names: str, centre: float, spread: float = routing.HALF_WIDTH) -> DataFrame:
    """rules (rule_index, names, centre, spread) with one more at the end; its spread stays under its centre by one at least."""
    if centre <= 1:
        raise ValueError("a rule's centre must be over 1")
    last = rules.agg((F.coalesce(F.max("rule_index"), F.lit(-1)) + 1).cast("int").alias("rule_index"))
    new = last.select("rule_index", F.lit(names).alias("names"), F.lit(float(centre)).alias("centre"), F.lit(float(min(spread, centre - 1))).alias("spread"))
    return rules.select("rule_index", "names", "centre", "spread").unionByName(new)


def deleted(rules: DataFrame, index: int) -> DataFrame:
    return renumbered(rules.where(F.col("rule_index") != index), F.col("rule_index"))


def moved(rules: DataFrame, index: int, by: int) -> DataFrame:
    """rules with one a place up (-1) or down (1); at an end nothing moves."""
    if by not in (-1, 1):
        raise ValueError("a rule moves by one place")
    i = F.col("rule_index")
    return renumbered(rules, F.when(i == index, i + 1.5 * by).otherwise(i.cast("double")))


def replaced(rule_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rules, numbered anew; counts (valid, invalid)) of a text that replaces all rules; blank lines and comments are neither."""
    parsed = routing.parse(rule_lines)
    counts = parsed.agg(F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"))
    return renumbered(parsed.where("valid"), F.col("rule_index")), counts


def display_list(text: Column, delimiters: str = "[;,/|]") -> Column:
    """A list with each canonical token once, as first spelled, joined by `; `."""
    kept = F.filter(F.transform(F.split(text, delimiters), lambda x: F.trim(x)), lambda x: canonical(x) != "")
    keys = F.transform(kept, canonical)
    return F.array_join(F.filter(kept, lambda x, i: F.array_position(keys, canonical(x)) == i + 1), "; ")


def merged_list(text: Column, more: Column) -> Column:
    """Two lists as one, without what is there already."""
    return display_list(F.concat_ws(";", text, more))


def import_counts(resolved: DataFrame) -> DataFrame:
    """One row: tokens by outcome of an import, and whether the outcomes add up to all of them."""
    names = {"A": "exact", "B": "joined", "C": "single", "generic": "generic", "discarded": "discarded"}
    counts = resolved.agg(F.count("*").alias("total"), *[F.count_if(F.col("outcome") == k).alias(v) for k, v in names.items()])
    return counts.withColumn("adds_up", F.col("total") == sum(F.col(v) for v in names.values()))
