"""Rules made of the parts' words, a catch-all among them, and who owns the parts' names, types and brands once all are imported."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import ownership
from pulsegrid.operators.routing import canonical
from pulsegrid.plans.routing import _CANON
from pulsegrid.sources import inputs

CATCH_ALL = 99
#: One text for both engines: rules know some of the names' second words; the catch-all has the types and the names of red things.
TOKENS = "SELECT DISTINCT spelling FROM (SELECT p_name AS spelling FROM {part} UNION ALL SELECT p_type FROM {part} UNION ALL SELECT p_brand FROM {part}) AS s"
OWNED = f"""SELECT CAST(place AS INT) AS rule_index, 0 AS place, token FROM (SELECT token, row_number() OVER (ORDER BY token) AS place FROM (SELECT DISTINCT split_part(p_name, ' ', 2) AS token FROM {{part}}) AS w) AS r WHERE place <= 4
  UNION ALL SELECT 10, CAST(row_number() OVER (ORDER BY token) - 1 AS INT), token FROM (SELECT DISTINCT p_name AS token FROM {{part}} WHERE p_name LIKE 'hot %' OR p_name = 'old ring') AS h UNION ALL SELECT 11, 0, 'small'
  UNION ALL SELECT {CATCH_ALL}, CAST(row_number() OVER (ORDER BY token) - 1 AS INT), token FROM (SELECT DISTINCT p_name AS token FROM {{part}} WHERE p_name LIKE 'red %' UNION SELECT p_type FROM {{part}}) AS c"""
ANCHORS = ["small", "large"]


def _decided(spark, d):  # noqa: ANN001, ANN202
    part = inputs.table(spark, d, "part")
    tokens = spark.sql(TOKENS, part=part).withColumn("canonical", canonical(F.col("spelling")))
    owned = spark.sql(OWNED, part=part).withColumn("canonical", canonical(F.col("token")))
    anchors = spark.createDataFrame([(a,) for a in ANCHORS], "canonical string")
    return owned, ownership.outcomes(tokens, owned, anchors, F.lit(CATCH_ALL))


def ownership_outcomes(spark, d):  # noqa: ANN001, ANN201
    return _decided(spark, d)[1]


def ownership_transfer(spark, d):  # noqa: ANN001, ANN201
    owned, decided = _decided(spark, d)
    lists = ownership.transferred(owned, decided, F.lit(CATCH_ALL))
    return lists.groupBy("rule_index").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "token"))), lambda x: x["token"]), "; ").alias("names"))


def ownership_counts(spark, d):  # noqa: ANN001, ANN201
    return ownership.counts(_decided(spark, d)[1], F.lit(CATCH_ALL))


_SQL = f"""tok AS (SELECT spelling, {_CANON('spelling')} AS canonical FROM ({TOKENS.replace('{part}', 'part')})), own AS (SELECT *, {_CANON('token')} AS canonical FROM ({OWNED.replace('{part}', 'part')})),
w AS (SELECT canonical, list_filter(regexp_split_to_array(lower(spelling), '[ _-]+'), lambda x: x <> '')[1:4] AS w FROM tok),
g AS (SELECT canonical, canonical AS gram, 'A' AS stage, 0 AS size FROM tok UNION ALL SELECT canonical, {_CANON("array_to_string(w[a:b], '')")}, CASE WHEN b > a THEN 'B' ELSE 'C' END, b - a + 1 FROM w, (SELECT unnest(range(1, 5)) AS a), (SELECT unnest(range(1, 5)) AS b) WHERE a <= b AND b <= len(w)),
h AS (SELECT canonical, min(CASE WHEN rule_index <> {CATCH_ALL} THEN rule_index END) AS specific, min(CASE WHEN rule_index = {CATCH_ALL} THEN rule_index END) AS general FROM own GROUP BY canonical),
b AS (SELECT * FROM (SELECT g.canonical, k.rule_index, stage, row_number() OVER (PARTITION BY g.canonical ORDER BY stage, size DESC, length(gram) DESC, k.rule_index) AS n FROM g JOIN (SELECT DISTINCT canonical, rule_index FROM own WHERE rule_index <> {CATCH_ALL} AND canonical NOT IN ('small', 'large')) AS k ON g.gram = k.canonical) WHERE n = 1),
o AS (SELECT tok.canonical, spelling, coalesce(specific, general)::INT AS source, CASE WHEN specific IS NOT NULL THEN specific ELSE coalesce(rule_index, general, {CATCH_ALL}) END::INT AS target,
  CASE WHEN specific IS NOT NULL THEN 'stable' WHEN rule_index IS NOT NULL THEN stage WHEN general IS NOT NULL THEN 'stable' ELSE 'fallback' END AS outcome FROM tok LEFT JOIN h USING (canonical) LEFT JOIN b USING (canonical)),
l AS (SELECT rule_index, 0 AS new, place, token FROM own WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.canonical = own.canonical AND o.source = {CATCH_ALL} AND own.rule_index = {CATCH_ALL} AND o.target <> {CATCH_ALL} AND outcome IN ('A', 'B', 'C'))
  UNION ALL SELECT target, 1, 0, spelling FROM o WHERE outcome IN ('A', 'B', 'C', 'fallback') AND NOT EXISTS (SELECT 1 FROM own WHERE own.canonical = o.canonical AND own.rule_index = o.target))"""
QUERIES = {f.__name__: f for f in (ownership_outcomes, ownership_transfer, ownership_counts)}
ORACLE = {
    "ownership_outcomes": f"WITH {_SQL} SELECT canonical, spelling, source, target, outcome FROM o",
    "ownership_transfer": f"WITH {_SQL} SELECT rule_index, count(*) AS n, string_agg(token, '; ' ORDER BY new, place, lower(token), token) AS names FROM l GROUP BY rule_index",
    "ownership_counts": f"WITH {_SQL} SELECT count(*) AS tokens, count_if(outcome = 'stable') AS stable, count_if(outcome = 'A') AS by_token, count_if(outcome = 'B') AS by_words, count_if(outcome = 'C') AS by_word, count_if(outcome = 'fallback') AS fallback, count_if(outcome = 'discarded') AS discarded, count_if(source = {CATCH_ALL} AND target <> source) AS migrated FROM o",
}
