"""The stages of the corpus pipeline: each takes (spark, docs, sf_dir) and works on all its predecessor kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.llm import line_dedup, packing, quality, simhash_links
from pulsegrid.llm.common import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier scores quality.KEEP or more."""
    return quality.filter_documents(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def fuzzy_line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document has, equal or similar. n_chars, where there, counts what is left."""
    out = line_dedup.dedup(docs)
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.when(out["text"].isNull(), out["n_chars"]).otherwise(F.length("text")).cast(dict(docs.dtypes)["n_chars"]))


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one whose doc_id names the group. Rows of one doc_id are one group.

    Rows without a doc_id can't be named: of these, one for each text stays.
    """
    near = simhash_links.near_duplicates(docs)
    keep = near.where("doc_id = component_id").select(F.col("doc_id").alias("keep_id")).distinct()
    text = F.when(docs["doc_id"].isNull(), F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["doc_id"].cast("long").alias("i"), text.alias("t")).dropDuplicates(["i", "t"])
    named = rows.where("i is not null").join(keep, F.col("i") == F.col("keep_id"), "left_semi")
    return named.unionByName(rows.where("i is null")).select("row.*")


def histogram_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of the documents, with its sequence and place there."""
    pieces, _ = packing.pieces_of(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return packing.pack(pieces)
