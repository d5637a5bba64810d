"""The queries of the training-data operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import ball_clusters, byte_pairs, chat_grammar, embedding_links, license_join, line_dedup, packing, quality, rare_features, repair_shards, simhash_links, sql, turn_repair, viterbi_pieces
from pulsegrid.llm.common import table

ORACLE: dict[str, str] = {"op11_ball_clusters": sql.ball_clusters(), "op12_turn_repair": sql.turn_repair()}


def op1_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_join.scan(table(spark, sf_dir, "documents"))


def op2_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    shards, _ = repair_shards.write_shards(table(spark, sf_dir, "documents"), path, end_id=2, lower=True, terminals=49_408)
    return repair_shards.read_documents(shards, with_ids=False)


def op3_rare_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rare_features.compare_with_edited(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.coalesce(quality.is_held_out(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def op5_viterbi_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return viterbi_pieces.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces, _ = packing.pieces_of(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.pack(pieces)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_counts(table(spark, sf_dir, "documents"))


def op8_chat_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-7, 0, "user", own), (-7, 1, "assistant", own)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    formatted, _ = chat_grammar.write_formatted(rows)
    return chat_grammar.read_formatted(formatted)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_links.near_duplicates(table(spark, sf_dir, "documents"))


def op10_embedding_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_ball_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_clusters.inertias(table(spark, sf_dir, "embeddings"))


def op12_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damage(table(spark, sf_dir, "conversations")), summary=True)


def op13_byte_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pairs.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_join": op1_license_join,
    "op2_token_shards": op2_token_shards,
    "op3_rare_features": op3_rare_features,
    "op4_quality": op4_quality,
    "op5_viterbi_pieces": op5_viterbi_pieces,
    "op6_packing": op6_packing,
    "op7_line_dedup": op7_line_dedup,
    "op8_chat_grammar": op8_chat_grammar,
    "op9_simhash": op9_simhash,
    "op10_embedding_links": op10_embedding_links,
    "op11_ball_clusters": op11_ball_clusters,
    "op12_turn_repair": op12_turn_repair,
    "op13_byte_pairs": op13_byte_pairs,
}
