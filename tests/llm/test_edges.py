"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator and stage."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from pulsegrid.llm import chat_grammar, embedding_links, license_join, line_dedup, packing, quality, rare_features, repair_shards, simhash_links, viterbi_pieces

P = public_tokenizers.path
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, line string, fp long, key string, n int, row string"
LONG = "the quick brown fox jumps over it, " * 20_000
ROWS = [
    (1, None, None, None, None, "x", None, 1, "k", 1, "r"), (2, "", "en", None, 0, "x", None, 1, "k", 1, "r"), (3, " \n\t ", "en", "s", 4, "x", "l", None, "k", 1, "r"), (None, "no id", "en", "s", 5, "x", "l", 1, "k", None, "r"),
    (4, "same text here and there\nsecond line", "en", "s", 5, "x", "l", 1, "k", 1, None), (4, "same text here and there\nsecond line", "en", "s", 5, "x", "l", 1, "k", 1, None), (4, "another text of that id", "en", "s", 5, "x", "l", 1, "k", 1, None),
    (5, LONG, "en", "s", 5, "x", "l", 1, "k", 1, None), (6, "\U0001f389 中文 é " * 9, "en", "s", 5, "x", "l", 1, "k", 1, None), (None, None, None, None, None, None, None, None, None, None, None), (7, "x" * 5000, "en", "s", 5000, "x", "l", 1, "k", 1, None),
]

OPS = {
    "license": license_join.scan,
    "shards": lambda d: repair_shards.read_documents(repair_shards.write_shards(d, P("word_bpe_49k.json"), 2, True, 49_408)[0]),
    "features": rare_features.compare_with_edited,
    "quality": lambda d: quality.score(d, quality.fit(d, d.select("doc_id", F.lit(1).alias("quality")))),
    "pieces": lambda d: viterbi_pieces.round_trip(d, P("piece_bpe_32k.model")),
    "lines": line_dedup.line_counts,
    "dedup": line_dedup.dedup,
    "simhash": simhash_links.near_duplicates,
}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.mark.parametrize("name", OPS)
def test_a_row_for_each_row(spark, odd, name):
    out = OPS[name](odd).collect()
    assert len(out) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(r[0]) for r in ROWS)
    assert OPS[name](odd.where("false")).count() == 0


def test_packing(spark, odd):
    pieces, _ = packing.pieces_of(odd, P("byte_bpe_50k.json"), end_id=0, with_ids=True)
    packed = packing.pack(pieces)
    rows = packed.collect()
    starts = [r for r in rows if r["start"] == 0]
    assert len(starts) == len(ROWS) and sum(r["length"] for r in rows) == sum(r["doc_tokens"] for r in starts)
    for s in packing.sequences(packed).collect():
        n = len(s["ids"]) // 4
        assert n == 1024 or n == s["n_ids"] and n & (n - 1) == 0
    empty, _ = packing.pieces_of(odd.where("false"), P("byte_bpe_50k.json"), end_id=0)
    assert packing.pack(empty).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", None), (1, 1, None, ""), (1, 1, None, ""), (None, None, "assistant", "[/INST]"), (2, 0, "assistant", "\\" * 50 + "</s>"), (None, 5, "user", LONG)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in chat_grammar.read_formatted(chat_grammar.write_formatted(df)[0]).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 3, None: 2, 2: 1} and got[2]["loss_chars"] == 54
    assert chat_grammar.read_formatted(chat_grammar.write_formatted(df.where("false"))[0]).count() == 0


def test_vectors(spark):
    df = spark.createDataFrame([(None, [1.0, 2.0], 3), (5, [1.0, 2.0], 3), (5, [1.0, 2.0], 3)], "vec_id long, embedding array<float>, node int")
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embedding_links.near_duplicates(df).collect()) == [("5", 2, 5), ("5", 2, 5), ("None", 2, 5)]
    assert embedding_links.near_duplicates(df.where("false")).count() == 0


@pytest.mark.parametrize("k", range(4))
def test_stages(spark, odd, sf_dir, k):
    name, function = corpus_pipeline.STAGES[k]
    for d in (odd, odd.where("false")):
        out = function(spark, d, sf_dir)
        rows = out.collect()
        if k < 3:
            assert out.columns == odd.columns
        if d is odd and k == 1:
            assert len(rows) == len(ROWS)
        if d is odd and k == 2:
            kept = [r["doc_id"] for r in rows if r["doc_id"] is not None]
            assert sorted(kept) == sorted(set(kept)) and {4, 5, 6, 7} >= set(kept) - {1, 2, 3} and len({1, 2, 3} & set(kept)) == 1


def test_pipeline_is_its_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = corpus_pipeline.STAGES[0][1](spark, docs, sf_dir)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in ids for i in good) > 0.85 * len(good)
    out = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r["doc_id"] for r in out} <= ids and len(out) > 0
