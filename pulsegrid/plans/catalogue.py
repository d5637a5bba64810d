"""Queries over rule import, settings, tag text, tables in order, single-value functions, event folds and run comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from pulsegrid.functions import scalars
from pulsegrid.operators import catalogue, evidence, imports, routing, series
from pulsegrid.plans.routing import _BUCK, _CANON, _PARSE, _RT, _TT, RULES, _rule_tokens, _rules, _tag_tokens
from pulsegrid.plans.series import fold_sql
from pulsegrid.sources import inputs
from pulsegrid.sources.inputs import ONSETS

ANCHORS = ["dance", "club", "hotrod", "gear", "gizmo"]


def _r(df, places=6):  # noqa: ANN001, ANN202
    return df.withColumns({c: F.round(c, places) for c, k in df.dtypes if k == "double"})


def skip_existing(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "part")
    tags = F.when(F.col("p_size") > 5, F.create_map(F.when(F.col("p_size") > 30, F.lit("BPM")).otherwise(F.lit("GENRE")), F.array("p_name")))
    return catalogue.to_analyse(t.select(F.col("p_partkey").alias("track"), tags.alias("tags"))).select("track")


def settings_domain(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "part")
    s, p = catalogue.allowed(F.col("p_size"), (F.col("p_size") * 5).cast("int"))
    return t.select("p_partkey", s.cast("int").alias("seconds"), p.cast("int").alias("passes"))


def tag_projection(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "part")
    tags = F.map_filter(F.create_map(F.lit("genre"), F.split("p_name", " "), F.lit("style"), F.array("p_type")), lambda k, v: F.when(k == "genre", F.col("p_size") > 15).otherwise(F.col("p_size") % 2 == 0))
    return t.select("p_partkey", catalogue.tag_text(tags).alias("text"))


def rail_slack(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "part")
    return t.select("p_partkey", catalogue.in_rail(F.col("p_retailprice") / 10, 95.0, 140.0).alias("inside"))


def result_table(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "part").select("p_brand", "p_name", "p_type", "p_size", "p_partkey")
    return catalogue.table_order(t, "p_brand", "p_type", ["p_name", "p_type", "p_size"], "p_partkey", descending=True).select("p_partkey", "place")


def candidate_table(spark, d):  # noqa: ANN001, ANN201
    c = inputs.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), F.when(F.col("l_linenumber") < 5, F.col("l_linenumber")).alias("rank"), (F.col("l_linenumber") * 3.0 + 40).alias("rate")).distinct()
    return catalogue.candidate_order(c, "rank", descending=True)


def run_figures(spark, d):  # noqa: ANN001, ANN201
    o = inputs.table(spark, d, "orders")
    return _r(catalogue.run_figures(o.select(F.when(F.col("o_orderstatus") == "F", "WRITE").when(F.col("o_orderstatus") == "O", "HOLD").otherwise("FAIL").alias("state"), F.floor(F.col("o_totalprice") / 1000).alias("ms"))))


def pattern_terms(spark, d):  # noqa: ANN001, ANN201
    kinds = F.when(F.col("p_size") % 5 == 0, F.concat(F.lit(".*("), F.replace("p_name", F.lit(" "), F.lit("|*")), F.lit("\\.x).*"))).when(F.col("p_size") % 5 == 1, F.concat("p_name", F.lit("; *"), F.col("p_type"), F.lit("*, ,"))).when(F.col("p_size") % 5 == 2, F.concat(F.lit("^"), F.col("p_name"))).otherwise(F.col("p_name"))
    out = imports.pattern_terms(inputs.table(spark, d, "part").select(F.col("p_partkey").alias("rule_index"), kinds.alias("names")))
    return out.select("rule_index", "tokenizable", F.array_join("terms", "#").alias("terms"))


def anchor_list(spark, d):  # noqa: ANN001, ANN201
    text = F.concat("p_name", F.lit("; "), F.col("p_type"), F.lit(",, "), F.upper("p_name"), F.lit(" ;"))
    return inputs.table(spark, d, "part").select("p_partkey", F.array_join(imports.anchors_of(text), ", ").alias("anchors"))


def generic_tokens(spark, d):  # noqa: ANN001, ANN201
    return imports.with_generic(_rule_tokens(spark), ANCHORS).select("rule_index", "canonical", "generic")


def newly_generic(spark, d):  # noqa: ANN001, ANN201
    more = routing.parse(routing.lines(spark, [*RULES, "dance; electro; Club; electronic; EDM; Fresh; anvil; red = center 125, spread 20"])).where("valid and names <> 'gear; gizmo'")
    return imports.newly_generic(routing.distinct_tokens(routing.tokens(more, "rule_index", "names"), "rule_index"), ANCHORS)


def route_fallback(spark, d):  # noqa: ANN001, ANN201
    rules = routing.distinct_tokens(routing.tokens(routing.parse(routing.lines(spark, [*RULES, "? = center 120, spread 20"])).where("valid"), "rule_index", "names").union(spark.createDataFrame([(99, 0, 0, "?", "?", 1, 1)], "rule_index int, field int, position int, token string, canonical string, words int, length int")), "rule_index")
    tags = inputs.tags(spark, d)
    return imports.with_fallback(routing.matches(_tag_tokens(spark, d), rules), tags, rules).where("rank = 1")


def rule_edits(spark, d):  # noqa: ANN001, ANN201
    rules = imports.renumbered(_rules(spark).where("valid"), F.col("rule_index"))
    return imports.moved(imports.deleted(imports.appended(rules, "brass", 8.0), 1), 4, -1)


def rules_replace(spark, d):  # noqa: ANN001, ANN201
    return imports.replaced(routing.lines(spark, RULES))[1]


def display_lists(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "part")
    both = imports.merged_list(F.concat("p_name", F.lit(" ; "), F.initcap("p_name"), F.lit("; "), F.col("p_type")), F.concat(F.col("p_type"), F.lit("/ new one")))
    return t.select("p_partkey", both.alias("names"))


def import_counts(spark, d):  # noqa: ANN001, ANN201
    return imports.import_counts(routing.resolve(routing.buckets(routing.tokens(inputs.tags(spark, d), "track", "value")), _rule_tokens(spark)))


def default_rules(spark, d):  # noqa: ANN001, ANN201
    return routing.parse(routing.lines(spark, imports.DEFAULT_RULES)).select("rule_index", "centre", "spread", "valid")


def composed_names(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "part").select("p_partkey", F.replace("p_name", F.lit("e"), F.lit("é")).alias("n"))
    return t.select("p_partkey", imports.composed("n").alias("name"))


def harmony(spark, d):  # noqa: ANN001, ANN201
    a, b = F.col("l_quantity") + 40.0, F.col("l_quantity") + F.col("l_linenumber") * 11.0 + 30
    t = inputs.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", a.alias("a"), b.alias("b"))
    return _r(t.select("l_orderkey", "l_linenumber", scalars.harmonic_agreement(F.col("a"), F.col("b")).alias("agreement"), scalars.cross_rhythm(F.col("a"), F.col("b")).alias("cross_rhythm"), scalars.rate_tolerance(F.col("a")).alias("tolerance"), scalars.gaussian((F.col("a") - 80) / 10).alias("gaussian"), scalars.circular_distance(F.col("a") / 7).alias("distance")))


def hop_quantised(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "part").select("p_partkey", (F.col("p_retailprice") / 10).alias("rate"))
    return _r(t.select("p_partkey", scalars.hop_quantised(F.col("rate"), 44_100, 512).alias("h")).select("p_partkey", "h.hops", F.col("h.rate").alias("rate"), F.col("h.error").alias("error")))


def _places(spark, d):  # noqa: ANN001, ANN202
    return inputs.onsets(spark, d).select("track", F.floor(F.col("us") / 1_000_000).alias("place"), F.col("value").alias("weight")).dropDuplicates(["track", "place"])


def burst_suppression(spark, d):  # noqa: ANN001, ANN201
    return series.unburst(_places(spark, d), 43_200, 30_000)


def greedy_spacing(spark, d):  # noqa: ANN001, ANN201
    return series.spread_out(_places(spark, d), 40_000, 7)


def near_share(spark, d):  # noqa: ANN001, ANN201
    x = inputs.onsets(spark, d).select("track", F.col("value").alias("x"))
    return _r(series.near_share(x, x.groupBy("track").agg(F.round(F.percentile("x", 0.5), 3).alias("centre")), 5.0, 25.0))


def spread_confidence(spark, d):  # noqa: ANN001, ANN201
    x = inputs.onsets(spark, d).select("track", (F.col("value") / 50 + 100).alias("x"))
    return _r(series.spread_confidence(x, x.groupBy("track").agg(scalars.rounded(F.percentile("x", 0.5), 3).alias("rate"))))


def hop_energy(spark, d):  # noqa: ANN001, ANN201
    e = inputs.table(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.posexplode("embedding").alias("sample", "x"))
    return _r(series.hops(e.select("track", "sample", F.col("x").cast("double").alias("x")), 12))


def low_energy(spark, d):  # noqa: ANN001, ANN201
    e = inputs.table(spark, d, "embeddings").select(F.col("vec_id").alias("track"), F.transform("embedding", lambda v: v.cast("double")).alias("x"))
    return _r(series.low_energy(e, 0.25))


def phase_offset(spark, d):  # noqa: ANN001, ANN201
    return _r(series.phase_offset(_places(spark, d), F.lit(86_400.0)), 2)


def separated_peaks(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("track"), (F.col("l_quantity") * 0.05 + 100).alias("rate")).agg(F.max("l_extendedprice").alias("score"))
    return _r(series.separated(t), 4)


def best_three(spark, d):  # noqa: ANN001, ANN201
    t = inputs.table(spark, d, "lineitem").groupBy((F.col("l_orderkey") % 200).alias("track"), F.col("l_quantity").alias("rate")).agg(F.max("l_extendedprice").alias("score"))
    return series.best_three(t)


def stage_classes(spark, d):  # noqa: ANN001, ANN201
    o = inputs.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("track")).agg(F.count_if(F.col("o_orderstatus") == "F").alias("board"), F.max(F.when(F.col("o_totalprice") < 200_000, (F.col("o_orderkey") % 3).cast("int"))).alias("source"), F.when(F.max("o_totalprice") > 300_000, "WRITE").otherwise("HOLD").alias("state"))
    s = evidence.stage_class(F.col("board"), F.col("source"), F.col("state"))
    return o.select("track", s.alias("stage"), evidence.short_stage(s).alias("short"))


def trace_coverage(spark, d):  # noqa: ANN001, ANN201
    li = inputs.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("segment"), F.col("l_returnflag").alias("reason"), (F.col("l_orderkey") % 4 + 3).cast("int").alias("declared"))
    return evidence.trace_coverage(li)


def _settings(spark, d, seconds, passes):  # noqa: ANN001, ANN202
    return inputs.table(spark, d, "customer").select(F.col("c_custkey").alias("track"), F.lit(seconds).alias("seconds"), F.lit(passes).alias("passes"), F.lit(20.0).alias("low"), F.lit(80.0).alias("high"))


def sweep_dimension(spark, d):  # noqa: ANN001, ANN201
    base = _settings(spark, d, 20, 50)
    runs = [("repeat", base), ("seconds", _settings(spark, d, 30, 50)), ("passes", _settings(spark, d, 20, 10)), ("both", _settings(spark, d, 30, 10)), ("other", base.where("track > 3")), ("mixed", base.withColumn("passes", F.when(F.col("track") == 1, 10).otherwise(50))), ("range", base.withColumn("low", F.lit(10.0)))]
    out = None
    for name, run in runs:
        one = evidence.sweep(base, run).select(F.lit(name).alias("run"), "dimension", "error")
        out = one if out is None else out.unionByName(one)
    return out


_PL = f"pl AS (SELECT track, place, weight FROM (SELECT user_id AS track, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000)::BIGINT AS place, value AS weight, row_number() OVER (PARTITION BY user_id, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1000000) ORDER BY ts) AS r FROM events) WHERE r = 1)"


QUERIES = {
    f.__name__: f
    for f in (
        skip_existing, settings_domain, tag_projection, rail_slack, result_table, candidate_table, run_figures, pattern_terms, anchor_list, generic_tokens, newly_generic, route_fallback, rule_edits, rules_replace, display_lists, import_counts,
        default_rules, composed_names, harmony, hop_quantised, burst_suppression, greedy_spacing, near_share, spread_confidence, hop_energy, low_energy, phase_offset, separated_peaks, best_three, stage_classes, trace_coverage, sweep_dimension,
    )
}
_A = "(" + ", ".join(f"'{a}'" for a in ANCHORS) + ")"
_DL = "string_split(regexp_replace(p_name || ' ; ' || initc || '; ' || p_type || ';' || p_type || '/ new one', '[;,/|]', ';', 'g'), ';')"
ORACLE = {
    "skip_existing": "SELECT p_partkey AS track FROM part WHERE p_size > 5 AND p_size <= 30",
    "settings_domain": "SELECT p_partkey, CASE WHEN p_size IN (5, 10, 15, 20, 30, 45, 60, 90) THEN p_size ELSE 20 END::INT AS seconds, CASE WHEN p_size * 5 IN (1, 3, 5, 10, 20, 50) THEN p_size * 5 ELSE 50 END::INT AS passes FROM part",
    "tag_projection": "SELECT p_partkey, CASE WHEN p_size > 15 THEN replace(p_name, ' ', ', ') || CASE WHEN p_size % 2 = 0 THEN '; ' || p_type ELSE '' END WHEN p_size % 2 = 0 THEN p_type ELSE '?' END AS text FROM part",
    "rail_slack": "SELECT p_partkey, p_retailprice / 10 BETWEEN 94.95 AND 140.05 AS inside FROM part",
    "result_table": "SELECT p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY lower(p_type) DESC, p_type DESC, lower(p_name) DESC, p_name DESC, p_size DESC, p_partkey DESC)::INT AS place FROM part",
    "candidate_table": "SELECT *, row_number() OVER (PARTITION BY track ORDER BY rank IS NULL, rank DESC, rate DESC)::INT AS place FROM (SELECT DISTINCT l_orderkey AS track, CASE WHEN l_linenumber < 5 THEN l_linenumber END AS rank, l_linenumber * 3.0::DOUBLE + 40 AS rate FROM lineitem)",
    "run_figures": "SELECT *, round(tracks * 1000.0::DOUBLE / ms, 6) AS tracks_per_s, round(ms::DOUBLE / tracks, 6) AS ms_per_track FROM (SELECT count(*) AS tracks, count(*) FILTER (WHERE o_orderstatus = 'F') AS written, count(*) FILTER (WHERE o_orderstatus = 'O') AS held, sum(floor(o_totalprice / 1000)::BIGINT)::BIGINT AS ms FROM orders)",
    "pattern_terms": r"""WITH p AS (SELECT p_partkey AS rule_index, CASE p_size % 5 WHEN 0 THEN '.*(' || replace(p_name, ' ', '|*') || '\.x).*' WHEN 1 THEN p_name || '; *' || p_type || '*, ,' WHEN 2 THEN '^' || p_name ELSE p_name END AS n, p_size % 5 AS k, p_name, p_type FROM part)
      SELECT rule_index, k <> 2 AS tokenizable, CASE k WHEN 0 THEN replace(p_name, ' ', '#') || '.x' WHEN 1 THEN p_name || '#' || p_type WHEN 2 THEN '' ELSE p_name END AS terms FROM p""",
    "anchor_list": f"SELECT p_partkey, array_to_string(list_sort(list_distinct([{_CANON('p_name')}, {_CANON('p_type')}])), ', ') AS anchors FROM part",
    "generic_tokens": f"""WITH {_RT}, g AS (SELECT rule_index, count(*) AS n, count(*) FILTER (WHERE canonical IN {_A}) AS a, count(DISTINCT canonical) FILTER (WHERE canonical IN ('dance', 'electro', 'club', 'electronic', 'edm')) = 5 AS s FROM rt GROUP BY 1),
      b AS (SELECT rule_index AS chosen FROM g WHERE (a >= 2 AND a = n) OR s ORDER BY a DESC, a / n DESC, rule_index LIMIT 1) SELECT rule_index, canonical, canonical IN {_A} OR coalesce(rule_index = (SELECT chosen FROM b), FALSE) AS generic FROM rt""",
    "newly_generic": "SELECT * FROM (VALUES ('electro', 'electro'), ('electronic', 'electronic'), ('edm', 'EDM'), ('fresh', 'Fresh'), ('anvil', 'anvil')) v(canonical, token)",
    "route_fallback": f"""WITH {_RT}, {_TT}, m0 AS (SELECT tt.*, rt.rule_index, rt.words AS rw, rt.length AS rl, canonical IN ('dance', 'electro', 'club', 'electronic', 'edm') AS generic FROM tt JOIN rt USING (canonical)),
      m1 AS (SELECT track, rule_index, token, generic, row_number() OVER (PARTITION BY track ORDER BY generic, field, position, rw DESC, rl DESC, rule_index, token) AS n FROM m0)
      SELECT track, 1::INT AS rank, rule_index, token, generic FROM m1 WHERE n = 1 UNION ALL SELECT track, 1, (SELECT max(rule_index) + 2 FROM rules), '?', FALSE FROM tags WHERE track NOT IN (SELECT track FROM m1)""",
    "rule_edits": f"""WITH {_PARSE}, v AS (SELECT row_number() OVER (ORDER BY rule_index) - 1 AS i, names, centre, spread FROM rules WHERE valid UNION ALL SELECT (SELECT count(*) FROM rules WHERE valid), 'brass', 8, 7),
      w AS (SELECT row_number() OVER (ORDER BY i) - 1 AS i, names, centre, spread FROM v WHERE i <> 1) SELECT (row_number() OVER (ORDER BY CASE WHEN i = 4 THEN 2.5 ELSE i END) - 1)::INT AS rule_index, names, centre, spread FROM w""",
    "rules_replace": f"WITH {_PARSE} SELECT count(*) FILTER (WHERE valid) AS valid, count(*) FILTER (WHERE NOT valid) AS invalid FROM rules",
    "display_lists": f"""WITH i AS (SELECT *, array_to_string(list_transform(string_split(p_name, ' '), lambda x: upper(x[1]) || lower(x[2:])), ' ') AS initc FROM part), k AS (SELECT p_partkey, list_filter(list_transform({_DL}, lambda x: trim(x)), lambda x: {_CANON('x')} <> '') AS l FROM i),
      c AS (SELECT *, list_transform(l, lambda x: {_CANON('x')}) AS ks FROM k) SELECT p_partkey, array_to_string(list_filter(l, lambda x, j: list_position(ks, {_CANON('x')}) = j), '; ') AS names FROM c""",
    "import_counts": f"""WITH {_BUCK}, w AS (SELECT canonical, list_filter(regexp_split_to_array(lower(spelling), '[ _-]+'), lambda x: x <> '')[1:4] AS w FROM bu),
      g AS (SELECT canonical, canonical AS gram, 0 AS size FROM bu UNION ALL SELECT canonical, {_CANON("array_to_string(w[a:b], '')")}, b - a + 1 FROM w, (SELECT unnest(range(1, 5)) AS a), (SELECT unnest(range(1, 5)) AS b) WHERE a <= b AND b <= len(w)),
      r AS (SELECT g.canonical, rule_index, CASE WHEN size = 0 THEN 'A' WHEN size > 1 THEN 'B' ELSE 'C' END AS stage, gram IN ('dance', 'electro', 'club', 'electronic', 'edm') AS generic, size, gram FROM g JOIN rt ON gram = rt.canonical),
      b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY canonical ORDER BY generic, stage, size DESC, length(gram) DESC, rule_index) AS n FROM r) WHERE n = 1),
      o AS (SELECT CASE WHEN rule_index IS NULL THEN 'discarded' WHEN generic THEN 'generic' ELSE stage END AS outcome FROM bu LEFT JOIN b USING (canonical))
      SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'A') AS exact, count(*) FILTER (WHERE outcome = 'B') AS joined, count(*) FILTER (WHERE outcome = 'C') AS single, count(*) FILTER (WHERE outcome = 'generic') AS generic, count(*) FILTER (WHERE outcome = 'discarded') AS discarded, TRUE AS adds_up FROM o""",
    "default_rules": "SELECT (row_number() OVER () - 1)::INT AS rule_index, c::DOUBLE AS centre, s::DOUBLE AS spread, TRUE AS valid FROM (VALUES " + ", ".join(f"({line.rsplit('center ', 1)[1].split(',')[0]}, {line.rsplit(' ', 1)[1]})" for line in imports.DEFAULT_RULES) + ") v(c, s)",
    "composed_names": "SELECT p_partkey, replace(p_name, 'e', chr(233)) AS name FROM part",
    "harmony": """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity + 40 AS a, l_quantity + l_linenumber * 11 + 30 AS b FROM lineitem), e AS (SELECT *, a / b AS r, list_min(list_transform([1, 2, 0.5, 1.5, 0.75, 4 / 3::DOUBLE, 2 / 3::DOUBLE]::DOUBLE[], lambda q: abs(a / b - q) / q)) AS e, a / 7 - floor(a / 7) AS p FROM t)
      SELECT l_orderkey, l_linenumber, round(least(1, greatest(0, 1 - (e - 0.005::DOUBLE) / (0.03::DOUBLE - 0.005::DOUBLE))), 6) AS agreement, abs(r - 0.75::DOUBLE) <= 0.025 OR abs(r - 4 / 3::DOUBLE) <= 0.025 OR abs(r - 1.5::DOUBLE) <= 0.025 OR abs(r - 2 / 3::DOUBLE) <= 0.025 AS cross_rhythm, round(greatest(a * 0.008::DOUBLE, 0.6), 6) AS tolerance,
      round(CASE WHEN a <= 80 THEN 1 WHEN (a - 80) / 10 >= 8 THEN 0 ELSE exp(-0.5::DOUBLE * ((a - 80) / 10) * ((a - 80) / 10)) END, 6) AS gaussian, round(least(p, 1 - p), 6) AS distance FROM e""",
    "hop_quantised": "WITH t AS (SELECT p_partkey, p_retailprice / 10 AS r FROM part), h AS (SELECT *, greatest(round(60.0::DOUBLE * 44100 / (r * 512)), 1) AS h FROM t) SELECT p_partkey, h::BIGINT AS hops, round(60.0::DOUBLE * 44100 / (h * 512), 6) AS rate, round(r - 60.0::DOUBLE * 44100 / (h * 512), 6) AS error FROM h",
    "burst_suppression": f"""WITH RECURSIVE {_PL}, k AS (SELECT * FROM (SELECT *, max(weight) OVER (PARTITION BY track ORDER BY place RANGE BETWEEN 43200 PRECEDING AND 43200 FOLLOWING) AS top FROM pl) WHERE NOT (top > 0 AND weight + 1e-12::DOUBLE < top * 0.62::DOUBLE)),
      {fold_sql("SELECT track, place AS p, weight AS w FROM k", "p", "p AS place, w AS weight, TRUE AS kept", "CASE WHEN p - place > 0 AND p - place < 30000 AND w < weight * 0.9::DOUBLE THEN place ELSE p END, CASE WHEN p - place > 0 AND p - place < 30000 AND w < weight * 0.9::DOUBLE THEN weight ELSE w END, NOT (p - place > 0 AND p - place < 30000 AND w < weight * 0.9::DOUBLE)")}
      SELECT track, place, weight FROM go WHERE kept""",
    "greedy_spacing": f"WITH RECURSIVE {_PL}, {fold_sql('SELECT track, place AS p FROM pl', 'p', 'p AS place, TRUE AS kept', 'CASE WHEN p - place < 40000 THEN place ELSE p END, p - place >= 40000')} SELECT track, place + 7 AS place FROM go WHERE kept",
    "near_share": f"WITH x AS (SELECT track, value AS x FROM ({ONSETS})), c AS (SELECT track, round(quantile_cont(x, 0.5), 3) AS c FROM x GROUP BY 1) SELECT track, count(*) AS n, round(avg(CASE WHEN abs(x - c) <= 5 THEN 1.0::DOUBLE ELSE 0 END), 6) AS near_1, round(avg(CASE WHEN abs(x - c) <= 25 THEN 1.0::DOUBLE ELSE 0 END), 6) AS near_2 FROM x JOIN c USING (track) GROUP BY track",
    "spread_confidence": f"""WITH x AS (SELECT track, value / 50 + 100 AS x FROM ({ONSETS})), c AS (SELECT track, round(quantile_cont(x, 0.5), 3) AS c FROM x GROUP BY 1), g AS (SELECT track, c, count(*) AS n, avg(CASE WHEN abs(x - c) <= greatest(c * 0.008::DOUBLE, 0.6) THEN 1.0::DOUBLE ELSE 0 END) AS t,
      avg(CASE WHEN abs(x - c) <= greatest(c * 0.02::DOUBLE, 1.2) THEN 1.0::DOUBLE ELSE 0 END) AS w, avg(abs(x - c)) AS m FROM x JOIN c USING (track) WHERE c > 0 GROUP BY 1, 2), s AS (SELECT *, (w * 0.5::DOUBLE + t * 0.35::DOUBLE + (1 - least(1, m / greatest(c * 0.06::DOUBLE, 1.6))) * 0.15::DOUBLE) * least(1, n / 50.0::DOUBLE * 0.25::DOUBLE + 0.75::DOUBLE) AS raw FROM g)
      SELECT track, n, round(CASE WHEN n = 1 THEN 55 WHEN 100 * pow(least(1, greatest(0, raw)), 0.45::DOUBLE) < 5 AND w > 0 THEN 5 ELSE least(100, 100 * pow(least(1, greatest(0, raw)), 0.45::DOUBLE)) END, 6) AS confidence FROM s""",
    "hop_energy": "WITH e AS (SELECT vec_id AS track, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS sample FROM embeddings), d AS (SELECT *, floor(sample / 12)::BIGINT AS hop, x - lag(x) OVER (PARTITION BY track, floor(sample / 12) ORDER BY sample) AS d FROM e) SELECT track, hop, round(ln(avg(x * x) + 1), 6) AS energy, round(ln(avg(d * d) + 1), 6) AS high FROM d GROUP BY 1, 2 HAVING count(*) = 12",
    "low_energy": """WITH e AS (SELECT vec_id AS track, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings), l AS (SELECT track, x, list_transform(range(1, len(x) + 1), lambda i: list_sum(list_transform(range(1, i + 1), lambda k: x[k] * 0.25::DOUBLE * pow(0.75::DOUBLE, i - k)))) AS y FROM e),
      r AS (SELECT track, sqrt(list_sum(list_transform(x, lambda v: v * v)) / len(x)) AS rms, sqrt(list_sum(list_transform(y, lambda v: v * v)) / len(x)) AS low FROM l) SELECT track, round(rms, 6) AS rms, round(low, 6) AS low_rms, round(CASE WHEN rms > 0 THEN least(4, greatest(0, low / rms)) ELSE 0 END, 6) AS ratio FROM r""",
    "phase_offset": f"""WITH {_PL}, a AS (SELECT track, greatest(weight, 0) AS w, (place % 86400) / 86400.0::DOUBLE * 2 * pi() AS a FROM pl), s AS (SELECT track, sum(w * sin(a)) AS s, sum(w * cos(a)) AS c, sum(w) AS w FROM a GROUP BY 1)
      SELECT track, 86400.0::DOUBLE AS period, round(CASE WHEN w > 0 THEN (CASE WHEN atan2(s, c) < 0 THEN atan2(s, c) + 2 * pi() ELSE atan2(s, c) END) / (2 * pi()) * 86400 ELSE 0 END, 2) AS offset FROM s""",
    "best_three": "WITH t AS (SELECT l_orderkey % 200 AS track, l_quantity AS rate, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY score DESC, rate)::INT AS place FROM t) SELECT * FROM k WHERE place <= 3",
    "stage_classes": """WITH o AS (SELECT o_custkey AS track, count(*) FILTER (WHERE o_orderstatus = 'F') AS b, max(CASE WHEN o_totalprice < 200000 THEN o_orderkey % 3 END) AS s, CASE WHEN max(o_totalprice) > 300000 THEN 'WRITE' ELSE 'HOLD' END AS st FROM orders GROUP BY 1),
      c AS (SELECT track, CASE WHEN s IS NULL THEN 'UNKNOWN_POLICY' WHEN s NOT IN (0, 1) THEN 'INCONSISTENT' WHEN b = 0 AND s = 0 THEN 'NO_MEASURED_SOURCE' WHEN b = 0 THEN 'SOURCE_WITHOUT_POLICY_BOARD' WHEN st = 'HOLD' THEN 'MEASURED_BUT_HOLD' ELSE 'MEASURED_AND_OUTPUT' END AS stage FROM o)
      SELECT track, stage, CASE stage WHEN 'SOURCE_WITHOUT_POLICY_BOARD' THEN 'SOURCE_WITHOUT_BOARD' WHEN 'MEASURED_BUT_HOLD' THEN 'MEASURED_HELD' WHEN 'MEASURED_AND_OUTPUT' THEN 'MEASURED_OUTPUT' ELSE stage END AS short FROM c""",
    "trace_coverage": """WITH g AS (SELECT l_orderkey AS track, l_returnflag AS reason, count(*) AS n FROM lineitem GROUP BY 1, 2) SELECT track, string_agg(reason || '=' || n, ' ' ORDER BY reason) AS reasons, sum(n)::BIGINT AS seen, (track % 4 + 3)::INT AS declared, CASE WHEN sum(n) = track % 4 + 3 THEN 'COMPLETE' ELSE 'PARTIAL' END AS coverage FROM g GROUP BY track""",
    "sweep_dimension": "SELECT * FROM (VALUES ('repeat', 'repeat', NULL), ('seconds', 'window_seconds', NULL), ('passes', 'passes', NULL), ('both', NULL, 'confounded'), ('other', NULL, 'track_identity'), ('mixed', NULL, 'mixed_settings'), ('range', NULL, 'offset_policy')) v(run, dimension, error)",
    "separated_peaks": """WITH RECURSIVE t AS (SELECT l_orderkey % 200 AS track, l_quantity * 0.05::DOUBLE + 100 AS rate, max(l_extendedprice) AS score FROM lineitem GROUP BY 1, 2), src AS (SELECT *, row_number() OVER (PARTITION BY track ORDER BY rate, score) AS n FROM t),
      go AS (SELECT track, 1::BIGINT AS n, [{'r': rate, 's': score}] AS b FROM src WHERE n = 1 UNION ALL SELECT go.track, src.n, CASE WHEN len(list_filter(b, lambda z: abs(z.r - rate) < 0.2::DOUBLE)) > 0 THEN
        list_transform(b, lambda z, i: CASE WHEN i = list_position(list_transform(b, lambda y: abs(y.r - rate) < 0.2::DOUBLE), TRUE) AND score > z.s THEN {'r': rate, 's': score} ELSE z END)
        WHEN len(b) < 3 THEN list_append(b, {'r': rate, 's': score}) ELSE list_transform(b, lambda z, i: CASE WHEN i = list_position(list_transform(b, lambda y: y.s), list_min(list_transform(b, lambda y: y.s))) AND score > z.s THEN {'r': rate, 's': score} ELSE z END) END
        FROM go JOIN src ON go.track = src.track AND src.n = go.n + 1),
      f AS (SELECT track, unnest(b) AS z FROM (SELECT *, max(n) OVER (PARTITION BY track) AS last FROM go) WHERE n = last) SELECT track, round(z.r, 4) AS rate, round(z.s, 4) AS score, row_number() OVER (PARTITION BY track ORDER BY z.s DESC, z.r)::INT AS place FROM f""",
}
