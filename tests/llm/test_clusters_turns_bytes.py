"""Ball k-means, conversation repair and byte-level BPE against plain versions, with odd rows."""

import base64
import hashlib
import heapq
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from pulsegrid.llm import ball_clusters, byte_pairs, queries, turn_repair
from pulsegrid.llm.common import table

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# clusters


def plain_clusters(rows, k=16, rounds=3, dim=64):
    kept = [(i, [int(np.floor(64 * float(x))) for x in e]) for i, e in rows if e is not None and len(e) == dim and all(x is not None and np.isfinite(x) for x in e)]
    start = sorted((sha(f"1:{i}"), v) for i, v in kept if i is not None)[:k]
    centroids = [v for _, v in start]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        got = [nearest(v)[1] for _, v in kept]
        for c in range(len(centroids)):
            members = [v for (_, v), g in zip(kept, got) if g == c]
            if members:
                centroids[c] = [sum(x) // len(members) for x in zip(*members)]
    last = [nearest(v) for _, v in kept]
    return sorted((i if i is not None else -1, c, d, sum(x for x, y in last if y == c), sum(x for x, _ in last), sha(",".join(map(str, centroids[c])))) for (i, _), (d, c) in zip(kept, last))


def got_clusters(df):
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    return sorted(tuple(-1 if r[n] is None else r[n] for n in names) for r in df.collect())


def test_clusters_whole_table(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    assert got_clusters(queries.op11_ball_clusters(spark, sf_dir)) == plain_clusters(rows)


@pytest.mark.parametrize("spread", [0.01, 0.3, 5.0])
def test_clusters_of_balls_and_ties(spark, spread):
    rng = np.random.default_rng(7)
    centres = rng.normal(0, 1, (9, 64))
    vectors = (centres[rng.integers(0, 9, 300)] + rng.normal(0, spread, (300, 64))).tolist() + [[0.5] * 64] * 9 + [[-0.5] * 64] * 3
    rows = list(enumerate(vectors)) + [(4, vectors[7]), (None, vectors[3]), (500, None), (501, [1.0] * 63), (502, [None] + [1.0] * 63), (503, [float("nan")] * 64), (504, [float("inf")] * 64), (505, [])]
    df = spark.createDataFrame([(i, e, 1, "x") for i, e in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(5)
    assert got_clusters(ball_clusters.inertias(df)) == plain_clusters(rows)


def test_clusters_few_and_none(spark):
    df = spark.createDataFrame([(i, [float(i)] * 64) for i in range(3)], "vec_id long, embedding array<float>")
    assert got_clusters(ball_clusters.inertias(df)) == plain_clusters([(i, [float(i)] * 64) for i in range(3)])
    for empty in (df.where("false"), spark.createDataFrame([(None, [1.0] * 64)], df.schema)):
        out = ball_clusters.inertias(empty)
        assert out.count() == 0 and out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_clusters_beyond_exact_distances(spark):
    df = spark.createDataFrame([(1, [1e9] * 64)], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        ball_clusters.inertias(df).collect()


def test_balls_skip_what_they_may():
    rng = np.random.default_rng(3)
    centroids = rng.integers(-500, 500, (12, 8))
    v = centroids[rng.integers(0, 12, 2000)] + rng.integers(-40, 40, (2000, 8))
    first = ball_clusters.Balls(centroids)
    to, d = first.assign(v, None)
    sums = {int(c): (v[to == c].sum(axis=0).tolist(), int((to == c).sum()), int(d[to == c].max())) for c in np.unique(to)}
    balls = first.moved(sums)
    plain = ((v[:, None, :] - balls.centroids[None]) ** 2).sum(axis=2)
    moved, distance = balls.assign(v, to)
    assert (moved == plain.argmin(axis=1)).all() and (distance == plain.min(axis=1)).all()
    assert sum(map(len, balls.neighbours)) < 12 * 11


# turns


def plain_audit(signs):
    heap, seen = [(0, "", 0, 0)], set()
    made = {0: 2, 1: 2, 2: 3, 3: 2}
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
    while True:
        cost, audit, i, s = heapq.heappop(heap)
        if (i, s) in seen:
            continue
        seen.add((i, s))
        if i == len(signs) and s in (0, 3):
            return cost, audit
        heapq.heappush(heap, (cost + 3, audit + "I", i, made[s]))
        if i == len(signs):
            continue
        heapq.heappush(heap, (cost + 4, audit + "D", i + 1, s))
        initial, cut, gone = signs[i]
        if not gone:
            heapq.heappush(heap, (cost + 3 + 3 * cut, audit + "R", i + 1, made[s]))
            if (s, initial) in kept:
                heapq.heappush(heap, (cost + 3 * cut, audit + "K", i + 1, kept[s, initial]))


def plain_repair(rows):
    """rows: (turn, role, text) of one conversation after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
    blank = duplicate = truncated = illegal = 0
    seen, signs = set(), []
    for n, (_, role, text) in enumerate(rows):
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        is_blank, is_again, is_cut = bare == "", (role, text) in seen, bare[-1:] not in (".", "!", "?")
        blank, duplicate, truncated = blank + is_blank, duplicate + (is_again and not is_blank), truncated + (is_cut and not is_again and not is_blank)
        seen.add((role, text))
        signs.append((role[:1], is_cut, is_blank or is_again))
        illegal += n > 0 and rows[n - 1][1][:1] + role[:1] not in ("su", "ua", "au")
    cost, audit = plain_audit(signs)
    out, i, assistant = [], 0, False
    for edit in audit:
        role, text = (rows[i][1], rows[i][2]) if edit in "KR" else (None, "")
        if edit in "RI":
            role = "assistant" if assistant else "user"
        if edit != "D":
            out.append((role, text))
            assistant = role[:1] == "u"
        i += edit != "I"
    known = {t for t, _, _ in rows if t is not None}
    return (max(known) - min(known) + 1 - len(known) if known else 0), blank, duplicate, truncated, illegal, cost, audit, out


def check_repair(spark, rows, size):
    """rows: (conv_id, turn, role, text), without nulls but for ids."""
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], "conv_id long, turn long, role string, text string, h string, sign int").repartition(4)
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(df, summary=True, size=size).collect()}
    turns = {}
    for r in turn_repair.repair(df, size=size).collect():
        turns.setdefault(r["conv_id"], []).append((r["place"], r["role"], r["text"]))
    assert got.keys() == {r[0] for r in rows}
    for conv, row in got.items():
        *counts, out = plain_repair([r[1:] for r in rows if r[0] == conv])
        assert row == (*counts, sha("\n".join(f"{a}:{b}" for a, b in out))), conv
        assert sorted(turns.get(conv, [])) == [(i, *x) for i, x in enumerate(out)]


@pytest.mark.parametrize("size", [1, 3, 256])
def test_repair_of_random_turns(spark, size):
    rng = random.Random(size)
    roles, said = ["user", "assistant", "system", "tool", "ai", ""], ["Yes.", "no", "", " \t\n", "Well?  ", "so ", "Fine!\r\n", "é"]
    rows = [(c if c else None, rng.choice([None, *range(12)]), rng.choice(roles[:3] if c % 2 else roles), rng.choice(said) + (str(rng.randrange(9)) + "." if rng.random() < 0.5 else "")) for c in range(60) for _ in range(rng.randrange(14))]
    check_repair(spark, rows, size)


def test_repair_of_a_long_conversation(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["same.", f"{t}.", f"{t}", " "])) for t in range(1500)]
    rows += [(2, t, "user" if t % 2 == 0 else "assistant", "the very same.") for t in range(400)] + [(3, 0, "user", "x" * 300_000 + "."), (3, 1, "assistant", "y" * 3_000_000)] + [(4, 7, "user", "again.")] * 700
    check_repair(spark, rows, turn_repair.SEGMENT)


def test_repair_of_damaged_rows(spark, sf_dir):
    import zlib

    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").collect()
    odd = [(None, None, None, None), (None, 3, "user", None), (-5, None, "user", "Hi."), (-6, 1, None, "Hi."), (-6, 1, "user", "")] + [(i, 0, "user", f"{i}.") for i in range(-60, -20)]
    df = spark.createDataFrame([tuple(r) for r in rows] + odd, "conv_id long, turn long, role string, text string")
    hurt = {}
    for conv, turn, role, text in [tuple(r) for r in df.collect()]:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if d == 1 else text.translate(str.maketrans("", "", ".!?")) if d == 2 else text
        hurt.setdefault(conv, []).extend([(turn, "user" if d == 4 else role, text)] * (0 if d == 0 else 2 if d == 3 else 1))
    assert any(not v for v in hurt.values())
    got = {r["conv_id"]: tuple(r)[1:] for r in turn_repair.repair(turn_repair.damage(df), summary=True).collect()}
    assert got.keys() == hurt.keys()
    for conv, rows_ in hurt.items():
        *counts, out = plain_repair(rows_)
        assert got[conv] == (*counts, sha("\n".join(f"{a}:{b}" for a, b in out))), conv


def test_repair_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert turn_repair.repair(turn_repair.damage(df), summary=True).count() == 0 and turn_repair.repair(df).count() == 0


def test_each_signature_alike_is_solved_alike():
    rng = random.Random(2)
    final = [3 * n for n in turn_repair.LAST]
    for _ in range(3000):
        signs = "".join(rng.choice("suaSUAoOxuaua") for _ in range(rng.randrange(11)))
        audit, cost, end = turn_repair.Signature(signs).cheapest(0, final)
        assert (cost + final[end], audit + "I" * turn_repair.LAST[end]) == plain_audit([(c.lower(), c.isupper(), c == "x") for c in signs])


# bytes


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def check_bytes(spark, library, texts):
    df = spark.createDataFrame([(i, t, "x", [1]) for i, t in enumerate(texts)], "doc_id long, text string, decoded string, ids array<int>").repartition(3)
    rows = {r["doc_id"]: r for r in byte_pairs.round_trip(df, PATH, PATTERN).collect()}
    encoded = byte_pairs.encode_documents(df, PATH, PATTERN)
    back = {r["doc_id"]: r for r in byte_pairs.decode_documents(encoded, PATH, PATTERN).collect()}
    assert len(rows) == len(back) == len(texts)
    for i, t in enumerate(texts):
        ids = library.encode_ordinary(t or "")
        assert (rows[i]["n_tokens"], rows[i]["ids_sha256"], rows[i]["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(t or "")), repr(t)[:80]
        assert back[i]["ids"] == ids and bytes(back[i]["decoded"]) == (t or "").encode()


def test_bytes_of_odd_texts(spark, library):
    rng = random.Random(1)
    signs = ["ab", "abc ", "aeiounrst", "éè ü", "0123456789", "中文字符漢字", "\U0001f389\U0001f600a", "\t \n\r\x0b\x1c\x85 　", "'sdmtlvre "]
    texts = [None, "", " ", "\n\n ", "a" * 30_000, "zx" * 20_000 + "q", "é" * 9_000, "= -" * 9_000, "word and word, " * 20_000, "<|endoftext|>", "\x00", "\U0010ffff"]
    texts += ["".join(rng.choice(rng.choice(signs)) for _ in range(rng.randint(1, 60))) for _ in range(500)]
    texts += ["".join(rng.choice(s) for _ in range(rng.randint(1, 60))) for s in signs for _ in range(100)]
    check_bytes(spark, library, texts)


def test_bytes_of_pieces_that_are_tokens_and_joined_tokens(spark, library):
    rng = random.Random(4)
    tokens = library.token_byte_values()
    texts = [b.decode() for b in tokens[::29] if b.decode("utf-8", "ignore").encode() == b]
    texts += [b"".join(rng.choice(tokens) for _ in range(rng.randint(2, 6))).decode("utf-8", "ignore") for _ in range(1500)]
    check_bytes(spark, library, texts)


def test_bytes_of_characters_that_unicode_tables_class_apart(spark, library):
    theirs = {k: byte_pairs._members(k) for k in (r"\p{L}", r"\p{N}")}
    import regex

    odd = sorted(set().union(*(m ^ set(regex.findall(k, "".join(map(chr, range(0x110000))))) for k, m in theirs.items())))
    check_bytes(spark, library, [f"a{c}b {c}{c} 1{c}2 !{c}? " for c in odd[:: max(1, len(odd) // 400)]] + ["plain"])


def test_bytes_whole_table(spark, sf_dir, library):
    texts = {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}
    rows = queries.op13_byte_pairs(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (len(ids), sha(",".join(map(str, ids))), sha(texts[r["doc_id"]]))


def test_bytes_of_nothing_and_repeats(spark):
    df = spark.createDataFrame([(None, "a b"), (1, "a b"), (1, "a b"), (1, None)], "doc_id long, text string")
    assert [r["n_tokens"] for r in byte_pairs.round_trip(df, PATH, PATTERN).orderBy("n_tokens").collect()] == [0, 2, 2, 2]
    assert byte_pairs.round_trip(df.where("false"), PATH, PATTERN).count() == 0


# SQL


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(name, spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, sf_dir).toPandas(), con.execute(queries.ORACLE[name]).df()
    key = got.columns[0]
    assert sorted(got.columns) == sorted(want.columns)
    assert got.sort_values(key).reset_index(drop=True).astype(str).equals(want[got.columns].sort_values(key).reset_index(drop=True).astype(str))
