"""The corpus pipeline: quality classifier, line dedup, SimHash near-dedup, packing. Each stage's result is written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import stages
from pulsegrid.llm.common import stage, table

STAGES = [
    ("quality_classifier", stages.quality_classifier),
    ("line_dedup", stages.fuzzy_line_dedup),
    ("simhash_near_dedup", stages.simhash_dedup),
    ("packing", stages.histogram_packing),
]

#: SQL can express neither the classifier nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows over the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES[:-1]:
        docs, _ = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
