"""DuckDB SQL of the training-data operators that it can express."""

from __future__ import annotations


def ball_clusters(k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1) -> str:
    """The plain comparison of every vector with every centroid, round by round."""
    parts = [
        f"kept AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS c, v FROM kept WHERE vec_id IS NOT NULL QUALIFY c < {k})",
    ]
    for r in range(rounds + 1):
        gap = f"list_sum(list_transform(range(1, {dim + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
        parts.append(f"a{r} AS (SELECT rid, any_value(vec_id) AS vec_id, any_value(kv) AS v, min({{'d': d, 'c': c}}) AS m FROM (SELECT rid, vec_id, k.v AS kv, CAST({gap} AS BIGINT) AS d, c.c AS c FROM kept AS k, c{r} AS c) GROUP BY rid)")
        if r < rounds:
            whole = "CAST((s - ((s % n) + n) % n) // n AS BIGINT)"
            parts.append(f"s{r} AS (SELECT c, list({whole} ORDER BY i) AS v FROM (SELECT m.c AS c, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, (SELECT unnest(range(1, {dim + 1})) AS i) GROUP BY m.c, i) GROUP BY c)")
            parts.append(f"c{r + 1} AS (SELECT c{r}.c AS c, coalesce(s{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN s{r} ON c{r}.c = s{r}.c)")
    last = f"SELECT a.vec_id, CAST(a.m.c AS INTEGER) AS cluster, a.m.d AS distance, CAST(sum(a.m.d) OVER (PARTITION BY a.m.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256 FROM a{rounds} AS a JOIN c{rounds} AS c ON a.m.c = c.c"
    return f"WITH {', '.join(parts)} {last}"


#: States of the turn grammar `(s?(ua)+)?`, the role that an edit makes in each and where that leads.
_MADE = {0: ("user", 2), 1: ("user", 2), 2: ("assistant", 3), 3: ("user", 2)}
_KEPT = {"s": [(0, 1)], "u": [(0, 2), (1, 2), (3, 2)], "a": [(2, 3)]}
_FAR = "'900000000'"


def _after(value: str, cost: str, edit: str, made: str) -> str:
    """A way, nine digits of cost, its audit, a mark, its text, with one more edit."""
    cut = f"strpos({value}, chr(1))"
    return f"(CASE WHEN {value} >= {_FAR} THEN {_FAR} ELSE lpad(CAST(CAST({value}[1:9] AS BIGINT) + {cost} AS VARCHAR), 9, '0') || {value}[10:{cut} - 1] || '{edit}' || {value}[{cut}:] || {made} END)"


def _inserted(w: list[str]) -> list[str]:
    """The ways to each state with an insert before the next turn."""
    news = {s: _after(w[s], "3", "I", f"chr(10) || '{_MADE[s][0]}:'") for s in range(4)}
    return [w[0], w[1], f"least({w[2]}, {news[0]}, {news[1]}, {news[3]})", f"least({w[3]}, {news[2]})"]


def turn_repair() -> str:
    """The damage, the faults, and the cheapest way to each state turn by turn."""
    step = "list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, b))"
    crc = f"xor(list_reduce(list_transform(range(1, length(k) + 1), lambda i: CAST(ascii(k[i]) AS BIGINT)), lambda c, b: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    base, twice = ["w0", "w1", "w2", "w3"], ["i0", "i1", "i2", "i3"]
    goes = {s: [_after(f"i{s}", "4", "D", "''")] for s in range(4)}
    own = "chr(10) || role || ':' || text"
    for s, (role, to) in _MADE.items():
        goes[to].append(f"(CASE WHEN gone THEN {_FAR} ELSE {_after(f'i{s}', '3 + more', 'R', f"chr(10) || '{role}:' || text")} END)")
    for initial, ways in _KEPT.items():
        for s, to in ways:
            goes[to].append(f"(CASE WHEN gone OR role[1] <> '{initial}' THEN {_FAR} ELSE {_after(f'i{s}', 'more', 'K', own)} END)")
    once = ", ".join(f"{v} AS {n}" for v, n in zip(_inserted(base), ["j0", "j1", "j2", "j3"], strict=True))
    again = ", ".join(f"{v} AS {n}" for v, n in zip(_inserted(["j0", "j1", "j2", "j3"]), twice, strict=True))
    stepped = ", ".join(f"least({', '.join(v)}) AS w{s}" for s, v in goes.items())
    return f"""WITH RECURSIVE clean AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
    hurt AS (SELECT conv_id, turn, role, text, {crc} % 20 AS d FROM clean),
    rows_ AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM hurt WHERE d <> 0),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(role) || ':' || role || text)) AS n, rtrim(text, {space}) AS bare FROM rows_),
    faulty AS (SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 AS seen, right(bare, 1) NOT IN ('.', '!', '?') AS cut, lag(role[1]) OVER (PARTITION BY conv_id ORDER BY n) AS prior FROM numbered),
    turns AS (SELECT *, blank OR seen AS gone, CASE WHEN cut AND NOT blank AND NOT seen THEN 3 ELSE 0 END AS more FROM faulty),
    ways AS (SELECT conv_id, 0 AS n, '000000000' || chr(1) AS w0, {_FAR} AS w1, {_FAR} AS w2, {_FAR} AS w3 FROM (SELECT DISTINCT conv_id FROM conversations)
      UNION ALL SELECT conv_id, n, {stepped} FROM (SELECT conv_id, n, role, text, gone, more, {again} FROM (SELECT t.conv_id AS conv_id, t.n AS n, role, text, gone, more, {once} FROM ways AS w JOIN turns AS t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.n = w.n + 1))),
    ended AS (SELECT conv_id, n, {again} FROM (SELECT conv_id, n, {once} FROM ways QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n DESC) = 1)),
    best AS (SELECT conv_id, least(i0, i3) AS w FROM ended),
    counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank, count_if(seen AND NOT blank) AS duplicate, count_if(more > 0) AS truncated, count_if(n > 1 AND prior || role[1] NOT IN ('su', 'ua', 'au')) AS illegal FROM turns GROUP BY conv_id)
    SELECT b.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal,
      CAST(w[1:9] AS BIGINT) AS cost, w[10:strpos(w, chr(1)) - 1] AS audit, sha256(w[strpos(w, chr(1)) + 2:]) AS repaired_sha256 FROM best AS b LEFT JOIN counts AS c ON b.conv_id IS NOT DISTINCT FROM c.conv_id"""
