"""Queries over rules and tags; part names are the tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.operators import routing
from pulsegrid.sources import inputs
from pulsegrid.sources.inputs import TAGS

RULES = [
    "# rates for parts", "", "red; blue = center 127.00, spread 14.00", "small ring; Large-Ring = center 92.5, spread 25", "widget = 128", "gear; gizmo = 90, 140, legacy", "hot rod = center: 150", "cold * = spread 3",
    "new bolt = 10, 5", "old anvil = center 12, spread 20", "economy; standard = center 105, spread 30", "anvil", "plate = 120d", "ring small = center 99, spread 9", "dance = center 125, spread 20", "// end",
]


def _rules(spark):  # noqa: ANN001, ANN202
    return routing.parse(routing.lines(spark, RULES))


def _rule_tokens(spark):  # noqa: ANN001, ANN202
    return routing.distinct_tokens(routing.tokens(_rules(spark).where("valid"), "rule_index", "names"), "rule_index")


def _tag_tokens(spark, d):  # noqa: ANN001, ANN202
    return routing.distinct_tokens(routing.tokens(inputs.tags(spark, d), "track", "value"), "track")


def rule_parse(spark, d):  # noqa: ANN001, ANN201
    return _rules(spark)


def tokenise(spark, d):  # noqa: ANN001, ANN201
    return _tag_tokens(spark, d)


def token_composites(spark, d):  # noqa: ANN001, ANN201
    return routing.composites(_tag_tokens(spark, d), _rule_tokens(spark), "track")


def _matched(spark, d):  # noqa: ANN001, ANN202
    return routing.matches(_tag_tokens(spark, d), _rule_tokens(spark))


def route_match(spark, d):  # noqa: ANN001, ANN201
    return _matched(spark, d)


def route_prior(spark, d):  # noqa: ANN001, ANN201
    return routing.priors(inputs.tags(spark, d), _matched(spark, d), _rules(spark))


def unmatched_tracks(spark, d):  # noqa: ANN001, ANN201
    return inputs.tags(spark, d).join(_matched(spark, d), "track", "left_anti").select("track", "value")


def token_buckets(spark, d):  # noqa: ANN001, ANN201
    return routing.buckets(routing.tokens(inputs.tags(spark, d), "track", "value"))


def ngram_resolver(spark, d):  # noqa: ANN001, ANN201
    return routing.resolve(routing.buckets(routing.tokens(inputs.tags(spark, d), "track", "value")), _rule_tokens(spark))


def rule_text(spark, d):  # noqa: ANN001, ANN201
    return routing.as_text(routing.edited(_rules(spark), 2, 10.0, 15.0))


_LINES = "(VALUES " + ", ".join(f"({i}, '{r}')" for i, r in enumerate(RULES)) + ") l(rule_index, line)"
_NUM = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
_N = lambda x: f"(CASE WHEN regexp_matches({x}, {_NUM}) THEN try_cast(trim({x}) AS DOUBLE) END)"
_NAMED = lambda x, n: _N(f"regexp_replace(lower({x}), '^{n}\\s*[:=]?\\s*', '')")
_CANON = lambda x: f"regexp_replace(lower(trim({x})), '[ \\t\\r\\n_/\\\\.,|-]', '', 'g')"
_WORDS = lambda x: f"greatest(1, len(list_filter(regexp_split_to_array({x}, '[ \\t\\r\\n_-]+'), lambda w: w <> '')))::INT"
_PARSE = f"""l0 AS (SELECT rule_index::INT AS rule_index, trim(line) AS line FROM {_LINES} WHERE trim(line) <> '' AND NOT regexp_matches(trim(line), '^(#|;|//)')),
l1 AS (SELECT rule_index, trim(CASE WHEN contains(line, '=') THEN line[:position('=' IN line) - 1] ELSE line END) AS names, list_transform(string_split(CASE WHEN contains(line, '=') THEN line[position('=' IN line) + 1:] ELSE '' END, ','), lambda x: trim(x)) AS v FROM l0),
l2 AS (SELECT *, regexp_matches(lower(v[1]), '^center[ :]') AS named FROM l1),
l3 AS (SELECT *, CASE WHEN named THEN {_NAMED('v[1]', 'center')} WHEN len(v) = 1 THEN {_N('v[1]')} END AS c, CASE WHEN named AND len(v) = 2 THEN CASE WHEN starts_with(lower(v[2]), 'spread') THEN {_NAMED('v[2]', 'spread')} END WHEN named AND len(v) > 2 THEN NULL ELSE 15.0::DOUBLE END AS s FROM l2),
l4 AS (SELECT *, CASE WHEN named OR len(v) = 1 THEN c - s ELSE {_N('v[1]')} END AS lo, CASE WHEN named OR len(v) = 1 THEN c + s ELSE {_N('v[2]')} END AS hi FROM l3),
rules AS (SELECT rule_index, names, coalesce(lo > 0 AND hi > lo AND names <> '', FALSE) AS valid, CASE WHEN valid THEN lo END AS low, CASE WHEN valid THEN hi END AS high, CASE WHEN valid THEN (lo + hi) / 2 END AS centre, CASE WHEN valid THEN (hi - lo) / 2 END AS spread FROM l4)"""


def _tokens(key: str, text: str, source: str, name: str) -> str:
    return f"""{name}0 AS (SELECT {key}, (fi - 1)::INT AS field, string_split(f, '|') AS ts FROM (SELECT {key}, unnest(fs) AS f, generate_subscripts(fs, 1) AS fi FROM (SELECT {key}, list_transform(string_split({text}, ';'), lambda x: regexp_replace(x, '[,/|]', '|', 'g')) AS fs FROM {source}))),
{name}1 AS (SELECT {key}, field, (i - 1)::INT AS position, trim(replace(t, '*', '')) AS token FROM (SELECT {key}, field, unnest(ts) AS t, generate_subscripts(ts, 1) AS i FROM {name}0)),
{name}2 AS (SELECT *, {_CANON('token')} AS canonical, {_WORDS('token')} AS words, length(token)::INT AS length FROM {name}1 WHERE {_CANON('token')} <> ''),
{name} AS (SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY {key}, canonical ORDER BY field, position) AS n FROM {name}2) WHERE n = 1)"""


_RT = f"{_PARSE}, vr AS (SELECT * FROM rules WHERE valid), {_tokens('rule_index', 'names', 'vr', 'rt')}"
_TT = f"tags AS ({TAGS}), {_tokens('track', 'value', 'tags', 'tt')}"
_GEN = "IN ('dance', 'electro', 'club', 'electronic', 'edm')"
_MATCH = f"""{_RT}, {_TT}, m0 AS (SELECT tt.*, rt.rule_index, rt.words AS rw, rt.length AS rl, canonical {_GEN} AS generic FROM tt JOIN rt USING (canonical)),
m1 AS (SELECT *, row_number() OVER (PARTITION BY track, rule_index ORDER BY generic, field, position, rw DESC, rl DESC, rule_index, token) AS n FROM m0),
mt AS (SELECT * FROM (SELECT track, row_number() OVER (PARTITION BY track ORDER BY generic, field, position, rw DESC, rl DESC, rule_index, token)::INT AS rank, rule_index, token, generic FROM m1 WHERE n = 1) WHERE rank <= 8)"""
_BUCK = f"{_RT}, {_TT}, bu AS (SELECT canonical, count(*) AS n, (min({{'l': lower(token), 't': token}})).t AS spelling FROM tt2 GROUP BY canonical)"
QUERIES = {f.__name__: f for f in (rule_parse, tokenise, token_composites, route_match, route_prior, unmatched_tracks, token_buckets, ngram_resolver, rule_text)}
ORACLE = {
    "rule_parse": f"WITH {_PARSE} SELECT * FROM rules",
    "tokenise": f"WITH {_TT} SELECT * FROM tt",
    "token_composites": f"""WITH {_RT}, {_TT}, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY field, position) AS i FROM tt) WHERE i <= 12),
      c AS (SELECT a.track, a.canonical || b.canonical AS canonical FROM f a JOIN f b ON a.track = b.track AND a.i <> b.i UNION ALL
      SELECT a.track, a.canonical || b.canonical || c.canonical FROM f a JOIN f b ON a.track = b.track AND a.i <> b.i JOIN f c ON a.track = c.track AND c.i NOT IN (a.i, b.i)) SELECT DISTINCT track, canonical FROM c WHERE canonical IN (SELECT canonical FROM rt WHERE words >= 2)""",
    "route_match": f"WITH {_MATCH} SELECT * FROM mt",
    "route_prior": f"""WITH {_MATCH}, b AS (SELECT tags.track, rule_index, CASE WHEN rule_index IS NULL THEN 'unmatched' WHEN generic THEN 'generic' ELSE 'matched' END AS route, low, high, centre FROM tags LEFT JOIN (SELECT * FROM mt JOIN rules USING (rule_index) WHERE rank = 1) USING (track))
      SELECT track, rule_index, CASE WHEN route = 'matched' THEN low ELSE 40 END AS low, CASE WHEN route = 'matched' THEN high ELSE 220 END AS high, CASE route WHEN 'matched' THEN centre WHEN 'generic' THEN 0 ELSE 130 END AS centre, route FROM b""",
    "unmatched_tracks": f"WITH {_MATCH} SELECT track, value FROM tags WHERE track NOT IN (SELECT track FROM mt)",
    "token_buckets": f"WITH {_BUCK} SELECT * FROM bu",
    "ngram_resolver": f"""WITH {_BUCK}, w AS (SELECT canonical, list_filter(regexp_split_to_array(lower(spelling), '[ _-]+'), lambda x: x <> '')[1:4] AS w FROM bu),
      g AS (SELECT canonical, canonical AS gram, 0 AS size FROM bu UNION ALL SELECT canonical, {_CANON("array_to_string(w[a:b], '')")}, b - a + 1 FROM w, (SELECT unnest(range(1, 5)) AS a), (SELECT unnest(range(1, 5)) AS b) WHERE a <= b AND b <= len(w)),
      r AS (SELECT g.canonical, rule_index, CASE WHEN size = 0 THEN 'A' WHEN size > 1 THEN 'B' ELSE 'C' END AS stage, gram {_GEN} AS generic, size, gram FROM g JOIN rt ON gram = rt.canonical),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY generic, stage, size DESC, length(gram) DESC, rule_index) AS n FROM r) WHERE n = 1)
      SELECT bu.canonical, CASE WHEN rule_index IS NULL THEN 'discarded' WHEN generic THEN 'generic' ELSE stage END AS outcome, rule_index FROM bu LEFT JOIN b USING (canonical)""",
    "rule_text": f"""WITH {_PARSE} SELECT rule_index, format('{{}} = center {{:.2f}}, spread {{:.2f}}', names, CASE WHEN rule_index = 2 THEN 10 ELSE centre END::DOUBLE, CASE WHEN rule_index = 2 THEN 9 ELSE spread END::DOUBLE) AS line FROM rules WHERE valid""",
}
