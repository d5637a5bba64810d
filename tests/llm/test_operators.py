"""Each operator against a plain version of what it computes, over a whole small table."""

import hashlib
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash

from pulsegrid.llm import chat_grammar, embedding_links, license_join, line_dedup, packing, quality, queries, rare_features, repair_shards, simhash_links, viterbi_pieces
from pulsegrid.llm.common import table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def classes(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return {r["doc_id"]: r["text"] or "" for r in table(spark, sf_dir, "documents").collect()}


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def base_of(text):
    words = WORD.findall(lower(text))
    found = []
    for phrase, label in {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return len(words), found


def check_base(row, text):
    n, found = base_of(text)
    assert row["n_words"] == n and row["n_base"] == len(found)
    assert row["first_word"] == min((i for i, _ in found), default=None) and row["last_word"] == max((i for i, _ in found), default=None)
    assert row["base_labels"] == ",".join(sorted({x for _, x in found}))
    assert set(filter(None, row["base_labels"].split(","))) <= set(row["labels"].split(","))
    assert 0 <= row["score"] <= 1 and (row["score"] == 1 or not found)


def test_op1(spark, sf_dir, docs):
    for i, row in by_id(queries.op1_license_join(spark, sf_dir)).items():
        check_base(row, docs[i])


def test_op1_phrases_side_by_side(spark):
    texts = {0: "All rights reserved all RIGHTS reserved", 1: "cc by cc by cc-by", 2: "general public license general public license", 3: "cc byé cc  by", 4: "rights all reserved", 5: "all rights reserved" * 3, 6: "x " * 5000 + "cc by"}
    for i, row in by_id(license_join.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string"))).items():
        check_base(row, texts[i])


def test_op1_blocks_of_lines(spark):
    """A notice may stand in one line or be wrapped over as many as a block has; every block that holds enough of a template counts, and no other."""
    notice = license_join.TEMPLATES[6][1].split()
    third = len(notice) // 3
    wrapped = "\n".join(" ".join(notice[i : i + third]) for i in range(0, len(notice), third))
    texts = {
        0: " ".join(notice), 1: "intro\n" + wrapped + "\nmore", 2: wrapped.replace("\n", "\n\n\nother words\n"), 3: " ".join(notice[: len(notice) // 2]), 4: None, 5: "\n\n",
        6: "# This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either", 7: "plain words of a letter\nto a friend",
    }
    got = by_id(license_join.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")))
    for i, text in texts.items():
        lines, own = [set(WORD.findall(lower(x))) for x in (text or "").split("\n")], set()
        blocks = [set().union(*lines[k : k + license_join.SPAN]) for k in range(len(lines))]
        for label, template in license_join.TEMPLATES:
            words = set(WORD.findall(lower(template)))
            own |= {label} if any(len(b & words) >= license_join.THRESHOLD * len(words) - 1e-9 for b in blocks) else set()
        assert set(filter(None, got[i]["labels"].split(","))) - set(filter(None, got[i]["base_labels"].split(","))) == own - set(filter(None, got[i]["base_labels"].split(","))), i
    assert "cc-by-4.0" in got[0]["labels"] and "cc-by-4.0" in got[1]["labels"] and got[2]["labels"] == got[7]["labels"] == "" and "lgpl" in got[6]["labels"]


def test_op1_join_is_exact(spark):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(30)]
    templates = [(f"t{i}", rng.sample(words, rng.randint(1, 9)), 0.8) for i in range(12)]
    blocks = [(k, rng.sample(words, rng.randint(0, 20))) for k in range(300)] + [(300 + i, t[1][: max(1, len(t[1]) - 1)]) for i, t in enumerate(templates)]
    got = license_join.containment_join(spark.createDataFrame(blocks, "block long, words array<string>"), templates)
    want = {(b, k) for b, ws in blocks for k, ts, th in templates if len(set(ws) & set(ts)) >= th * len(ts) - 1e-9}
    assert {(r["block"], r["template"]) for r in got.collect()} == want


def test_op2(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    got, start = by_id(queries.op2_token_shards(spark, sf_dir)), 0
    for i in sorted(docs):
        ids = [*t.encode(docs[i], add_special_tokens=False).ids, 2]
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)


def test_op2_random_access():
    rng = np.random.default_rng(0)
    counts = np.array([0, 1, 500, 0, 3000, 2, 0])
    ids = rng.integers(0, 9, counts.sum()).astype(np.uint32)
    shard = repair_shards.Shard(repair_shards.to_bytes(np.arange(len(counts)), counts, ids, 49_408))
    assert (shard.all() == ids).all() and len(shard.symbols) < len(ids)
    ends = np.cumsum(counts)
    for k in range(len(counts)):
        assert (shard.ids(k) == ids[ends[k] - counts[k] : ends[k]]).all()


def test_op2_no_frequent_pair_left():
    rng = np.random.default_rng(3)
    words = [rng.integers(0, 300, rng.integers(2, 6)) for _ in range(200)]
    counts = rng.integers(0, 400, 120)
    ids = np.concatenate([words[i] for i in rng.zipf(1.3, 20_000) % 200])[: counts.sum()].astype(np.uint32)
    ids[5000:5400] = 7
    ends = np.cumsum(counts)
    s, behind, rules = repair_shards.compress(ids, ends, 49_408)
    pairs = {}
    for a, b in zip([0, *behind[:-1].tolist()], behind.tolist(), strict=True):
        own, k = s[a:b].tolist(), 0
        while k + 1 < len(own):
            pairs[own[k], own[k + 1]] = pairs.get((own[k], own[k + 1]), 0) + 1
            k += 2 if own[k : k + 2] == own[k + 1 : k + 3] else 1
    assert max(pairs.values()) < repair_shards.LEAST and len(rules) > 100
    shard = repair_shards.Shard(repair_shards.to_bytes(np.arange(len(counts)), counts, ids, 49_408))
    assert (shard.all() == ids).all()
    for k in range(len(counts)):
        own = ids[ends[k] - counts[k] : ends[k]]
        a, b = sorted(rng.integers(0, counts[k] + 1, 2))
        assert (shard.ids(k) == own).all() and (shard.ids(k, int(a), int(b)) == own[a:b]).all()


def test_op2_ids_over_16_bits():
    one = np.array([1])
    for ids, terminals in ((np.array([70_000], np.uint32), 80_000), (np.array([50_000], np.uint32), 49_408)):
        with pytest.raises(ValueError, match="65,536"):
            repair_shards.compress(ids, one, terminals)


@pytest.mark.parametrize(("name", "lower"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_encoder_odd_texts(name, lower):
    import pyarrow as pa
    from tokenizers import Tokenizer

    from pulsegrid.llm.chunk_tokens import encoder

    path = public_tokenizers.path(name)
    t, code, rng = Tokenizer.from_file(path), encoder(path, 2, lower), random.Random(12)
    t.encode_special_tokens = True
    parts = ["a", "The", "word", "don't", "I'll", "\u00e9t\u00e9", "\u4e2d\u6587", "42", "3.14", ".", ",", "!?", "\u00a0", "\u2003", "\t", "\n", "\r\n", "\x0b", "\x1c", "\x85", " ", "  ", "_", "\U0001f389", "<|endoftext|>", "</w>", "\u0130", "e\u0301"]
    texts = ["".join(rng.choice(parts) + rng.choice(["", " ", " ", "\n"]) for _ in range(rng.randint(0, 30))) for _ in range(600)]
    texts += ["x y " * 60_000, " ".join(texts)]
    for at, flat, counts in code.encode(pa.array(texts)):
        ends = np.cumsum(counts)
        for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
            assert flat[a:b].tolist() == [*t.encode(texts[at + k], add_special_tokens=False).ids, 2], texts[at + k][:80]


def test_op3(spark, sf_dir, docs):
    got, order = by_id(queries.op3_rare_features(spark, sf_dir)), sorted(docs, reverse=True)
    prints = {}
    for i, j in zip(order, order[1:] + order[:1], strict=True):
        half = len(docs[i]) // 2
        edited = docs[i][: len(docs[i]) - half] + docs[j][:half]
        r = got[i]
        assert r["n_chars"] == len(docs[i]) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert prints.setdefault(docs[i], r["fingerprint"]) == r["fingerprint"]
        a, b = (rare_features.digests([t.encode()])[0] for t in (docs[i], edited))
        assert r["fingerprint"] == rare_features.fingerprint(a) and r["near_edited"] == rare_features.likeness(a, b)
    near = np.array([(got[i]["near_edited"], got[i]["near_next"]) for i in order])
    assert (near[:, 0] > near[:, 1]).mean() > 0.9


def plain_features(text):
    """Selected windows of both scales, one window after another."""
    import math

    def chosen(scale):
        n = len(text) - scale.window + 1
        ranks = []
        for i in range(max(n, 0)):
            w = text[i : i + scale.window]
            clog = [0] + [round(c * math.log2(c) * 65536) for c in range(1, scale.window + 1)]
            left = (scale.most - sum(clog[w.count(x)] for x in set(w))) * 1000 // scale.most
            ranks.append(int(scale.rank[min(max(left, 0), 1000)]))
        popular = [0] * max(n, 0)
        for begin in range(-scale.pad, max(n, 0)):
            some = [(ranks[i], i) for i in range(max(begin, 0), min(begin + scale.neighbours, n)) if ranks[i] < 1024]
            if some:
                popular[min(some)[1]] += 1
        return [text[i : i + scale.window] for i in range(max(n, 0)) if popular[i] >= scale.popular]

    large, small = chosen(rare_features.LARGE), chosen(rare_features.SMALL)
    if len(text) < 16:
        return large, None
    return large, small or [text[i : i + 16] for i in range(len(text) - 15)]


def test_op3_features_are_selected_by_rarity(docs):
    rng, n_large, n_small = random.Random(2), 0, 0
    texts = [t.encode() for t in docs.values() if len(t) < 1500][:60] + [b"", b"short", b"a" * 40, b"abcdefghijklmnopqrstuvwxyz" * 9, bytes(rng.randrange(256) for _ in range(300))]
    for text, found in zip(texts, rare_features.features(texts), strict=True):
        large, small = plain_features(text)
        key = lambda w: int(rare_features._hash(np.frombuffer(w.ljust(64, b"\0"), np.uint8).reshape(1, -1))[0])
        share = 1 - len(large) / rare_features.FADE
        want = [key(w) for w in large]
        if share > 0:
            shorter = [key(w) for w in small] if small is not None else [int.from_bytes(hashlib.sha256(text).digest()[:8], "little")]
            want += shorter if share == 1 else [h for h in shorter if h < int(share * (1 << 64))]
        assert found.tolist() == list(dict.fromkeys(want)), text[:50]
        n_large, n_small = n_large + len(large), n_small + len(want) - len(large)
    assert n_large > 100 and n_small > 100


def test_op3_no_step():
    """A few bytes more change the features of a text little, whatever its length."""
    rng = random.Random(9)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    for size in (40, 100, 400, 700, 900, 1200, 2500):
        near = []
        for _ in range(20):
            t = " ".join(rng.choice(words) for _ in range(size))[:size]
            a, b = rare_features.digests([t.encode(), (t + " " + rng.choice(words)).encode()])
            near.append(rare_features.likeness(a, b))
        assert np.mean(near) > (0.9 if size > 300 else 0.6), (size, np.mean(near))


def test_op3_one_id(spark):
    df = spark.createDataFrame([(7, "some text here"), (7, "other text there"), (7, "third")], "doc_id long, text string")
    rows = rare_features.compare_with_edited(df).collect()
    assert len(rows) == 3 and all(r["n_chars"] > 0 for r in rows)


def plain_score(model, text):
    """The chance of label 1, computed step by step."""
    import zstandard

    size = lambda data, d: len(zstandard.ZstdCompressor(level=1, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
    good, bad = (zstandard.ZstdCompressionDict(x) for x in (model.good, model.bad))
    data = text.encode()
    blocks = [data[i : i + 512] for i in range(0, len(data), 512)] or [b""]
    g, b = [size(x, good) for x in blocks], [size(x, bad) for x in blocks]
    each = [(y - x) / (y + x) for x, y in zip(g, b, strict=True)]
    alone = len(zstandard.ZstdCompressor(level=1, write_content_size=False, write_checksum=False, write_dict_id=False).compress(data))
    f = [(sum(b) - sum(g)) / (sum(b) + sum(g)), min(each), max(each), alone / (len(data) + 1)]
    z = sum(w * (x - m) / s for w, x, m, s in zip(model.weights, f, model.mean, model.spread, strict=False)) + model.weights[-1]
    return 1 / (1 + np.exp(-z))


def test_op4_again_and_plain(spark):
    sf = "/root/testdata/sf0.01"
    docs_, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    one, two = quality.fit(docs_, labels), quality.fit(docs_.repartition(5), labels.repartition(3))
    assert one.good == two.good and one.bad == two.bad and np.allclose(one.weights, two.weights)
    text = {r["doc_id"]: r["text"] or "" for r in docs_.collect()}
    for r in quality.score(docs_, one).limit(150).collect():
        assert r["score"] == pytest.approx(plain_score(one, text[r["doc_id"]]), abs=1e-9)


def test_op4_calibrated(spark):
    """Over labelled rows that were held out, scores say how often label 1 is right."""
    sf = "/root/testdata/sf0.1"
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    held = np.array([(r["score"], labels[r["doc_id"]]) for r in queries.op4_quality(spark, sf).where("held_out").collect() if r["doc_id"] in labels])
    order = held[np.argsort(held[:, 0])]
    bins = np.array_split(order, 8)
    error = sum(len(b) * abs(b[:, 0].mean() - b[:, 1].mean()) for b in bins) / len(held)
    assert error < 0.08, error


def test_op4_held_out(spark):
    sf = "/root/testdata/sf0.01"
    got = by_id(queries.op4_quality(spark, sf))
    labels = {r["doc_id"]: r["quality"] for r in table(spark, sf, "labels").collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    held = [(got[i]["score"], labels[i]) for i in got if got[i]["held_out"] and i in labels]
    good, bad = [s for s, q in held if q == 1], [s for s, q in held if q == 0]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.8
    assert all(r["predicted"] == (r["score"] >= 0.7) for r in got.values())


def test_op5(spark, sf_dir, docs):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    for i, r in by_id(queries.op5_viterbi_pieces(spark, sf_dir)).items():
        ids = model.encode(docs[i])
        assert (r["n_tokens"], r["ids_crc32"], r["same"]) == (len(ids), crc(ids), True)


def test_op5_apart(spark):
    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "hello  world"), (2, None), (3, "a\nb")], "doc_id long, text string")
    got = by_id(viterbi_pieces.decode_documents(viterbi_pieces.encode_documents(df, path), path))
    assert [got[i]["decoded"] for i in (1, 2, 3)] == ["hello  world", "", "a\nb"] and got[3]["n_byte_tokens"] == 1


def test_op5_odd_texts():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model, code = sentencepiece.SentencePieceProcessor(model_file=path), viterbi_pieces.coder(path)
    rng = random.Random(2)
    texts = ["", " ", "      ", "a  b", "▁x ▁", "x" * 700, " " * 100 + "q", "</s><0x0A>", "\r\n \n", "🎉 中文é", "aaa" * 9]
    texts += ["".join(rng.choice("abeinrst é中,.\n\t▁01  ") for _ in range(rng.randint(0, 50))) for _ in range(400)]
    import pyarrow as pa

    for at, flat, counts in code.encode(pa.array(texts)):
        ends = np.cumsum(counts)
        for k, (a, b) in enumerate(zip(ends - counts, ends, strict=True)):
            assert flat[a:b].tolist() == model.encode(texts[at + k])
        assert code.decode(flat.astype(np.int64), counts) == [t.replace("▁", " ") for t in texts]


def test_op6(spark, sf_dir, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    rows = queries.op6_packing(spark, sf_dir).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
    for i, text in docs.items():
        ids, at = [*t.encode(text, add_special_tokens=False).ids, 0], 0
        for r in sorted(pieces[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at, len(ids), crc(ids[at : at + r["length"]]))
            at += r["length"]
        assert at == len(ids)
    padded = 0
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= packing.ROOM
        padded += packing.ROOM - at
    assert padded < 0.03 * sum(r["length"] for r in rows) + packing.ROOM


def char_shingles(line):
    """All windows of ten characters; written apart from the module."""
    return {line[i : i + 10] for i in range(max(1, len(line) - 9))}


def line_groups(texts):
    """(rows, sets, similar pairs) of all lines, by brute force."""
    rows = [(d, n, " ".join(x.lower().split())) for d, t in texts for n, x in enumerate(t.split("\n")) if x.strip()]
    sets = [char_shingles(x) for _, _, x in rows]
    pairs = []
    for a in range(len(rows)):
        for b in range(a):
            if 0.8 * max(len(sets[a]), len(sets[b])) <= min(len(sets[a]), len(sets[b])) and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                pairs.append((a, b))
    return rows, sets, pairs


def gone_of(got):
    return {(r["doc_id"], int(n)) for r in got for n in r["dropped"].split(",") if n}


def test_op7(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(2, 60))) for _ in range(60)]
    lines = []
    for k in range(500):
        own = rng.choice(base).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            own[rng.randrange(len(own))] = rng.choice(words)
        lines.append(" ".join(own))
    texts = [(k // 5, "\n".join(x.upper() if k % 2 else f"  {x.replace(' ', '   ')}\t" for x in lines[k : k + 5]) + "\n\n") for k in range(0, 500, 5)]
    rows, _, pairs = line_groups(texts)
    root = classes(len(rows), pairs)
    gone = {(d, n) for k, (d, n, _) in enumerate(rows) if root[k] != k}
    found = gone_of(line_dedup.line_counts(spark.createDataFrame(texts, "doc_id long, text string")).collect())
    assert found <= gone and len(found) >= 0.97 * len(gone)
    out = by_id(line_dedup.dedup(spark.createDataFrame([(i, t, "x", 9) for i, t in texts], "doc_id long, text string, th string, n int")))
    for i, t in texts:
        assert out[i]["text"] == "\n".join(x for n, x in enumerate(t.split("\n")) if (i, n) not in found) and out[i]["th"] == "x"


def test_op7_whole_table(spark, sf_dir, docs):
    rows, sets, pairs = line_groups(sorted(docs.items())[:120])
    root = classes(len(rows), pairs)
    gone = {(d, n) for k, (d, n, _) in enumerate(rows) if root[k] != k}
    some = spark.createDataFrame(sorted(docs.items())[:120], "doc_id long, text string")
    found = gone_of(line_dedup.line_counts(some).collect())
    assert found <= gone and len(found) >= 0.97 * len(gone)


def test_op7_recall_by_length(spark):
    """Pairs at a similarity of 0.8 to 0.9, each apart from all others: found are 0.97 or more at every length, short lines too."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8)))
    by, texts = {}, []
    for size in (7, 8, 9, 10, 14, 20, 40):
        made = 0
        while made < 150:
            own = [word() for _ in range(size)]
            other = list(own)
            for _ in range(rng.randint(1, 1 + size // 12)):
                at = rng.randrange(len(other))
                other[at : at + 1] = rng.choice([[word()], [other[at], word()], []])
            a, b = char_shingles(" ".join(own)), char_shingles(" ".join(other))
            if 0.8 <= len(a & b) / len(a | b) < 0.9:
                by[len(texts) + 1] = size
                texts += [(len(texts), " ".join(own)), (len(texts) + 1, " ".join(other))]
                made += 1
    found = {d for d, _ in gone_of(line_dedup.line_counts(spark.createDataFrame(texts, "doc_id long, text string")).collect())}
    assert found <= set(by)
    recall = {s: sum(d in found for d, x in by.items() if x == s) / 150 for s in sorted(set(by.values()))}
    assert sum(recall.values()) / len(recall) >= 0.97 and min(recall.values()) >= 0.94, recall


@pytest.mark.parametrize("edits", [(1, 3), (2, 5)])
def test_op7_crowd(spark, edits):
    """Bands of hundreds of lines, many of which don't link with the pivot: no link that shares a band is lost."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    base, lines = [rng.choice(words) for _ in range(45)], []
    for _ in range(600):
        own = list(rng.choice(lines)) if lines and rng.random() < 0.5 else list(base)
        for _ in range(rng.randint(*edits)):
            own[rng.randrange(len(own))] = rng.choice(words)
        lines.append(own)
    texts = [(k, " ".join(x)) for k, x in enumerate(lines)]
    rows, _, pairs = line_groups(texts)
    signed = line_dedup.signatures(spark.createDataFrame(texts, "id long, line string"))
    values = {r["id"]: [r[f"m{i}"] for i in range(line_dedup.SIGNATURE)] for r in signed.collect()}
    share = [(a, b) for a, b in pairs if any(all(values[a][i] == values[b][i] for i in band) for band in line_dedup.BANDS)]
    assert len(share) >= 0.97 * len(pairs)
    bands = line_dedup.band_keys(line_dedup.with_nodes(signed))
    assert bands.groupBy("key").count().where("count > 128").count() > 0
    found, _ = line_dedup.links(bands, spark.createDataFrame(texts, "id long, line string"))
    mask = (1 << 62) - 1
    linked = [(r["a"] & mask, r["b"] & mask) for r in found.collect()]
    assert classes(len(texts), linked) == classes(len(texts), share)


def test_op7_two_centres_meet_by_labels(spark, monkeypatch):
    """Lines a word off one of two centres: what meets when the leftovers are joined grows no faster than the lines."""
    meeting, met = line_dedup._meeting, []

    def counted(x, y, on):
        out = meeting(x, y, on)
        met.append(out.count())
        return out

    monkeypatch.setattr(line_dedup, "_meeting", counted)
    totals = []
    for n in (300, 1200):
        rng = random.Random(3)
        words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
        centres = [[rng.choice(words) for _ in range(45)]]
        centres.append([rng.choice(words) if i % 5 == 0 else w for i, w in enumerate(centres[0])])
        lines = []
        for k in range(n):
            own = list(centres[k % 2])
            own[rng.randrange(45)] = rng.choice(words)
            lines.append((k, " ".join(own)))
        df = spark.createDataFrame(lines, "id long, line string")
        met.clear()
        found, _ = line_dedup.links(line_dedup.band_keys(line_dedup.with_nodes(line_dedup.signatures(df))), df)
        assert found.count() >= n - 10
        totals.append(sum(met))
    assert totals[1] <= 6 * max(totals[0], 1000), totals


def test_op7_reads_and_shuffles_once(spark, tmp_path, monkeypatch):
    """Documents are read once, no text is split twice, each band and each term of a difference is shuffled and written once at most."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(60)]
    base = [rng.choice(words) for _ in range(40)]
    texts = [(0, None), (1, "\n\n"), (2, " \n" + " ".join(base)), (2, " \n" + " ".join(base)), (None, "\t")]
    for k in range(3, 120):
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(len(own))] = rng.choice(words)
        texts.append((k, "\n" * (k % 3) + " ".join(own)))
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents")
    docs, plans, stage = spark.read.parquet(f"{tmp_path}/documents"), {}, line_dedup.stage

    def seen(df, name, *replaces, **options):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stage(df, name, *replaces, **options)

    monkeypatch.setattr(line_dedup, "stage", seen)
    out = line_dedup.line_counts(docs)
    assert sorted((r["doc_id"] or -1, r["n_lines"]) for r in out.collect()) == sorted((i or -1, (t or "").count("\n") + 1) for i, t in texts)
    assert not set(out.inputFiles()) & set(docs.inputFiles())
    assert "size(split" not in plans["lines"] and plans["line-bands"].count("Exchange hashpartitioning") == 1
    assert "line-terms" not in plans and "size(concat" not in plans["line-differences"]


def digest_of(turns):
    return hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()


def test_op8(spark, sf_dir):
    turns = {}
    for r in table(spark, sf_dir, "conversations").orderBy("conv_id", "turn").collect():
        turns.setdefault(r["conv_id"], []).append((r["role"], r["text"] or ""))
    turns[-7] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    got = by_id(queries.op8_chat_grammar(spark, sf_dir), "conv_id")
    assert got.keys() == turns.keys()
    for i, own in turns.items():
        said = "".join(t for r, t in own if r == "assistant")
        assert (got[i]["n_turns"], got[i]["turns_sha256"], got[i]["loss_chars"], got[i]["loss_sha256"]) == (len(own), digest_of(own), len(said), hashlib.sha256(said.encode()).hexdigest())


def test_op8_any_text():
    rng = random.Random(6)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", " ", "a", "[/INST]</s>", "<s>[INST] "]
    for _ in range(3000):
        role, text = ("".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(2))
        turn, a, b = chat_grammar.render(role, text)
        assert list(chat_grammar.parse(turn)) == [(role, text, a, b)]


def test_op8_reader_finds_turns_alone():
    """One parse of the joined text finds turns and masks, wherever it is cut into parts."""
    rng = random.Random(13)
    parts = ["<s>", "</s>", "[INST]", "[/INST]", "\\", "\n", " ", "a", "[/INST]</s>", "<s>[INST] "]
    for _ in range(400):
        turns = [tuple("".join(rng.choice(parts) for _ in range(rng.randint(0, 6))) for _ in range(2)) for _ in range(rng.randint(0, 6))]
        whole = "".join(chat_grammar.render(*t)[0] for t in turns)
        reader, found, at = chat_grammar.Reader(), [], 0
        while at < len(whole):
            to = at + rng.randint(1, 30)
            found += list(reader.feed(whole[at:to]))
            at = to
        reader.close()
        assert found == list(chat_grammar.parse(whole)) and [f[:2] for f in found] == turns
        if whole:
            broken = chat_grammar.Reader()
            list(broken.feed(whole[:-1]))
            with pytest.raises(chat_grammar.NotInGrammar):
                broken.close()


def plain_simhash(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_op9(spark, sf_dir, docs):
    ids = sorted(docs)
    prints = [plain_simhash(docs[i]) for i in ids]
    root = classes(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 4])
    got = by_id(queries.op9_simhash(spark, sf_dir))
    for k, i in enumerate(ids):
        assert (got[i]["fingerprint"], got[i]["component_id"]) == (f"{prints[k]:016x}", ids[root[k]])


def test_op9_large_groups(spark):
    rng = np.random.default_rng(8)
    centre = rng.integers(0, 1 << 63, 6).astype(np.int64)
    fp = np.unique(np.concatenate([c ^ np.bitwise_or.reduce([np.int64(1) << rng.integers(0, 40, 300) for _ in range(3)], axis=0) for c in centre]))
    pairs = [(a, b) for a in range(len(fp)) for b in range(a) if int((fp[a] ^ fp[b]) & np.int64(-1)).bit_count() <= 4 if (fp[a] ^ fp[b]) >= 0]
    nodes = spark.createDataFrame([(i, int(x)) for i, x in enumerate(fp)], "node long, fp long")
    found = [(r["a"], r["b"]) for r in simhash_links.link(nodes, limit=32).collect()]
    assert classes(len(fp), found) == classes(len(fp), pairs)


def test_op10(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").orderBy("vec_id").collect()
    x = np.array([r["embedding"] for r in rows], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    got = {r["vec_id"]: r for r in queries.op10_embedding_links(spark, sf_dir).collect()}
    want = np.bincount(near.ravel(), minlength=len(x))
    have = np.array([got[r["vec_id"]]["n_links"] for r in rows])
    assert (have <= want).all() and have.sum() >= 0.97 * want.sum()
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())
    check_components(got, [r["vec_id"] for r in rows], near)


def check_components(got, ids, near):
    """Components are unions of found links: never over a border of the true ones, and where no link was missed, the same."""
    root = classes(len(ids), near.tolist())
    true = {i: ids[r] for i, r in zip(ids, root, strict=True)}
    assert all(true[r["component_id"]] == true[i] for i, r in got.items())
    want = np.bincount(near.ravel(), minlength=len(ids))
    for c in set(true.values()):
        own = [k for k, i in enumerate(ids) if true[i] == c]
        if all(got[ids[k]]["n_links"] == want[k] for k in own):
            assert all(got[ids[k]]["component_id"] == c for k in own)


def test_op10_tiles(spark):
    """A crowd of near vectors whose cells are larger than one place takes; every pair in a common cell is still met once."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((3, 24))
    x = np.concatenate([c + 0.16 * rng.standard_normal((150, 24)) for c in centre] + [rng.standard_normal((50, 24))])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argwhere(np.triu(x @ x.T >= 0.95, 1))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    small, whole = ({r["vec_id"]: r for r in embedding_links.near_duplicates(df, limit=n).collect()} for n in (40, 100_000))
    assert {i: (r["n_links"], r["component_id"]) for i, r in small.items()} == {i: (r["n_links"], r["component_id"]) for i, r in whole.items()}
    want = np.bincount(near.ravel(), minlength=len(x))
    have = np.array([small[i]["n_links"] for i in range(len(x))])
    assert len(near) > 5000 and (have <= want).all() and have.sum() >= 0.98 * want.sum()
    check_components(small, list(range(len(x))), near)


def test_op10_collisions_counted():
    rng = np.random.default_rng(6)
    values = rng.integers(-60, 60, (90, 32)).astype(np.int8)
    values[1] = values[0] + 3
    group = np.sort(rng.integers(0, 4, 90))
    group[1] = group[0]
    i, j = embedding_links.collisions(values, group, np.zeros(90, np.int64), np.zeros(90, bool), 12)
    wide = int(np.ceil(embedding_links.WINDOW / embedding_links.STEP)) + 1
    gap = np.abs(values[:, None].astype(int) - values[None].astype(int)) <= wide
    want = {(a, b) for a in range(90) for b in range(a + 1, 90) if group[a] == group[b] and gap[a, b].sum() >= 12}
    assert {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True)} == want and (0, 1) in want


@pytest.mark.parametrize("rows", [500, 6_000, 40_000, 10**6, 10**8])
def test_op10_recall_at_the_threshold(rows):
    """Pairs at a cosine of 0.95 to 0.96 in the tables and windows that so many rows would have."""
    k, tables, least = embedding_links.plan(rows)
    rng = np.random.default_rng(11)
    n, dim = 4000, 64
    a, noise = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.95, 0.96, n)[:, None]
    b = c * a + np.sqrt(1 - c * c) * noise
    p = embedding_links.Projections(dim, k, tables)
    meet = np.zeros(n, bool)
    for at in range(0, n, 500):
        meet[at : at + 500] = (p.cell_keys(a[at : at + 500]) == p.cell_keys(b[at : at + 500])).any(axis=1)
    x = np.stack([a, b], axis=1).reshape(-1, dim)
    group = np.repeat(np.arange(n), 2)
    found = np.zeros(n, bool)
    for i, _ in embedding_links.pair_links(x, p.sketch(x), group, np.zeros(2 * n, np.int64), np.zeros(2 * n, bool), least, 0.9499):
        found[group[i]] = True
    assert (meet & found).mean() >= 0.985


@pytest.mark.parametrize("rows", [2_000, 9_000])
def test_op10_whole_run_at_the_threshold(spark, rows):
    """Half of the rows in pairs at a cosine of 0.95 to 0.955, the others alone, through the whole operator."""
    rng = np.random.default_rng(rows)
    n, dim = rows // 4, 48
    a, noise = rng.standard_normal((n, dim)), rng.standard_normal((n, dim))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise -= (noise * a).sum(axis=1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    c = rng.uniform(0.9501, 0.955, n)[:, None]
    x = np.concatenate([a, c * a + np.sqrt(1 - c * c) * noise, rng.standard_normal((rows - 2 * n, dim))])
    df = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>")
    got = embedding_links.near_duplicates(df).where("n_links > 0").count()
    assert 2 * n >= got >= 0.98 * 2 * n


def test_op10_odd_vectors(spark):
    v = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, []), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [1.0, 0.0, 0.0]), (9, [1e30, 1e29]), (10, [1.0, 0.0]), (11, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_links.near_duplicates(spark.createDataFrame(v, "vec_id long, embedding array<float>")).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 9: (3, 1), 10: (3, 1), **{k: (0, k) for k in (3, 4, 5, 6, 7, 8, 11)}}


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert model is None and [r["score"] for r in quality.score(docs, model).collect()] == [0.5, 0.5]
    assert quality.filter_documents(docs, model).count() == 2
