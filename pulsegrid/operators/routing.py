"""Tag routing: rules and tags become tokens, tokens meet by equi-join, and a track takes the rail of its best rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import number

#: Half the width of a rail that a rule gives no spread for, the rail of a track without a rule, and matches kept.
HALF_WIDTH, OPEN_RAIL, MATCHES = 15.0, (40.0, 220.0), 8
GENERIC = ("dance", "electro", "club", "electronic", "edm")


def canonical(text: Column) -> Column:
    """Lower case, without white space, hyphens, underscores, slashes, dots, commas and bars. Composed characters are expected."""
    return F.translate(F.lower(F.trim(text)), " \t\r\n-_/\\.,|", "")


def word_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.size(F.filter(F.split(text, "[ \\t\\r\\n_-]+"), lambda x: x != "")))


def lines(spark: SparkSession, rules: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(rules)), "rule_index int, line string")


def parse(rule_lines: DataFrame) -> DataFrame:
    """(rule_index, names, low, high, centre, spread, valid) of lines `names = value`; blank lines and comments go.

    A value is `center c[, spread s]`, a single centre, or `low, high[, ...]`.
    """
    text = F.trim("line")
    rows = rule_lines.where((text != "") & ~text.rlike("^(#|;|//)")).select("rule_index", F.split(text, "=", 2).alias("p"))
    rows = rows.select("rule_index", F.trim(F.get("p", F.lit(0))).alias("names"), F.transform(F.split(F.coalesce(F.get("p", F.lit(1)), F.lit("")), ","), lambda x: F.trim(x)).alias("v"))
    part = lambda i: F.get("v", F.lit(i))
    named = F.lower(part(0)).rlike("^center[ :]")
    value = lambda c, name: number(F.regexp_replace(F.lower(c), f"^{name}\\s*[:=]?\\s*", ""))
    spread_ok = F.lower(part(1)).startswith("spread")
    centre = F.when(named, value(part(0), "center")).when(F.size("v") == 1, number(part(0)))
    spread = F.when(named & (F.size("v") == 2), F.when(spread_ok, value(part(1), "spread"))).when(named & (F.size("v") > 2), F.lit(None)).otherwise(HALF_WIDTH)
    low, high = number(part(0)), number(part(1))
    by_centre = named | (F.size("v") == 1)
    rows = rows.select("rule_index", "names", F.when(by_centre, centre - spread).otherwise(low).alias("low"), F.when(by_centre, centre + spread).otherwise(high).alias("high"), by_centre.alias("by_centre"), "v")
    ok = F.coalesce((F.col("low") > 0) & (F.col("high") > F.col("low")) & (F.col("names") != ""), F.lit(False))
    num = lambda c: F.when(ok, c)
    return rows.select("rule_index", "names", num(F.col("low")).alias("low"), num(F.col("high")).alias("high"), num((F.col("low") + F.col("high")) / 2).alias("centre"), num((F.col("high") - F.col("low")) / 2).alias("spread"), ok.alias("valid"))


def tokens(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, field, position, token, canonical, words, length): `;` parts fields, `,`, `/` and `|` tokens; empty tokens still count a place."""
    bare = F.regexp_replace(text, "^\\.\\*\\((.*)\\)\\.\\*$", "$1")
    fields = rows.select(key, F.posexplode(F.split(bare, ";")).alias("field", "f"))
    out = fields.select(key, "field", F.posexplode(F.split("f", "[,/|]")).alias("position", "t"))
    out = out.select(key, "field", "position", F.trim(F.replace("t", F.lit("*"), F.lit(""))).alias("token"))
    return out.select("*", canonical(F.col("token")).alias("canonical"), word_count(F.col("token")).alias("words"), F.char_length("token").alias("length")).where("canonical <> ''")


def distinct_tokens(tokened: DataFrame, key: str) -> DataFrame:
    """The first of equal tokens of each key."""
    w = Window.partitionBy(key, "canonical").orderBy("field", "position")
    return tokened.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def composites(tokened: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """(key, canonical): two or three of a key's first twelve tokens, in any order, that together are a rule's name of two words or more."""
    first = tokened.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy("field", "position"))).where("i <= 12")
    a, b, c = (first.select(key, F.col("i").alias(x), F.col("canonical").alias(f"c{x}")) for x in "abc")
    two = a.join(b, key).where("a <> b")
    pairs = two.select(key, F.concat("ca", "cb").alias("canonical"))
    triples = two.join(c, key).where("c <> a and c <> b").select(key, F.concat("ca", "cb", "cc").alias("canonical"))
    return pairs.union(triples).join(wanted.where("words >= 2").select("canonical").distinct(), "canonical", "left_semi").select(key, "canonical").distinct()


def matches(tags: DataFrame, rules: DataFrame, keep: int = MATCHES) -> DataFrame:
    """(track, rank, rule_index, token, generic): the best token for each rule that a track meets, specific ones first; at most `keep`.

    tags: tokens of tracks; rules: tokens of rules. Rules are few and tokens of tracks many; Spark broadcasts the rules when they are small enough.
    """
    r = rules.select("rule_index", "canonical", F.col("words").alias("rule_words"), F.col("length").alias("rule_length"))
    met = tags.join(r, "canonical").withColumn("generic", F.col("canonical").isin(*GENERIC))
    order = ["generic", "field", "position", F.desc("rule_words"), F.desc("rule_length"), "rule_index", "token"]
    one = met.withColumn("n", F.row_number().over(Window.partitionBy("track", "rule_index").orderBy(*order))).where("n = 1")
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("track").orderBy(*order))).where(F.col("rank") <= keep)
    return ranked.select("track", "rank", "rule_index", "token", "generic")


def priors(tracks: DataFrame, matched: DataFrame, rules: DataFrame) -> DataFrame:
    """(track, rule_index, low, high, centre, route): the rail of the best match; a generic match or none leaves it open."""
    best = matched.where("rank = 1").join(rules.select("rule_index", "low", "high", "centre"), "rule_index")
    j = tracks.select("track").join(best, "track", "left")
    route = F.when(F.col("rule_index").isNull(), "unmatched").when(F.col("generic"), "generic").otherwise("matched")
    own = route == "matched"
    return j.select(
        "track", "rule_index", F.when(own, F.col("low")).otherwise(OPEN_RAIL[0]).alias("low"), F.when(own, F.col("high")).otherwise(OPEN_RAIL[1]).alias("high"),
        F.when(own, F.col("centre")).when(route == "generic", 0.0).otherwise(sum(OPEN_RAIL) / 2).alias("centre"), route.alias("route"),
    )


def buckets(tokened: DataFrame) -> DataFrame:
    """(canonical, n, spelling): how often each token comes and the first of its spellings, by lower case, then bytes."""
    return tokened.groupBy("canonical").agg(F.count("*").alias("n"), F.min(F.struct(F.lower("token").alias("l"), F.col("token").alias("t"))).alias("m")).select("canonical", "n", F.col("m.t").alias("spelling"))


def resolve(bucketed: DataFrame, rules: DataFrame) -> DataFrame:
    """(canonical, outcome, rule_index): a token as it is (A), two to four of its first four words together (B), or a single word (C) names a rule."""
    words = F.slice(F.filter(F.split(F.lower("spelling"), "[ _-]+"), lambda x: x != ""), 1, 4)
    grams = bucketed.select("canonical", words.alias("w"))
    n = F.size("w")
    spans = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda a: F.transform(F.sequence(a, F.greatest(n, a)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("s")
    grams = grams.where(n > 0).select("canonical", "w", spans).select("canonical", canonical(F.array_join(F.slice("w", F.col("s.a"), F.col("s.b") - F.col("s.a") + 1), "")).alias("gram"), (F.col("s.b") - F.col("s.a") + 1).alias("size"))
    whole = bucketed.select("canonical", F.col("canonical").alias("gram"), F.lit(0).alias("size"))
    stage = F.when(F.col("size") == 0, "A").when(F.col("size") > 1, "B").otherwise("C")
    met = whole.union(grams).withColumn("stage", stage).join(rules.select(F.col("canonical").alias("gram"), "rule_index"), "gram")
    generic = F.col("gram").isin(*GENERIC)
    order = Window.partitionBy("canonical").orderBy(generic, "stage", F.desc("size"), F.desc(F.char_length("gram")), "rule_index")
    best = met.withColumn("generic", generic).withColumn("n", F.row_number().over(order)).where("n = 1")
    out = bucketed.join(best.select("canonical", "rule_index", "stage", "generic"), "canonical", "left")
    return out.select("canonical", F.when(F.col("rule_index").isNull(), "discarded").when(F.col("generic"), "generic").otherwise(F.col("stage")).alias("outcome"), "rule_index")


def edited(rules: DataFrame, index: int, centre: float, spread: float) -> DataFrame:
    """rules with one rule's centre set; its spread stays under the centre by one at least."""
    if centre <= 1:
        raise ValueError("a rule's centre must be over 1")
    s = min(spread, centre - 1)
    at = F.col("rule_index") == index
    put = {"low": centre - s, "high": centre + s, "centre": centre, "spread": s}
    return rules.withColumns({k: F.when(at, F.lit(float(v))).otherwise(F.col(k)) for k, v in put.items()})


def as_text(rules: DataFrame) -> DataFrame:
    """(rule_index, line): valid rules as they are written."""
    return rules.where("valid").select("rule_index", F.format_string("%s = center %.2f, spread %.2f", "names", "centre", "spread").alias("line"))
