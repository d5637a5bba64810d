"""Rules, evidence logs, manifests and observations from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def rule_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, text) of a rules file. Lines are numbered within one file, which a rules file is: small and read whole."""
    whole = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.regexp_replace("value", "^﻿", ""), "\r?\n")).alias("line_no", "text"))
    return whole


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line) of one or many logs, split over tasks; byte order marks go."""
    return spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))


#: Fixed value: the version of a manifest's layout.
MANIFEST_SCHEMA = "synthetic_bpm_reference_v1"


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The cases of a JSON manifest, in order, by a fixed schema; a manifest of another version, or with an id twice, fails the read."""
    kind = "schema string, cases array<struct<id: string, reference_bpm: double, style: string, duration_sec: int, sample_rate: int, event_sample_positions: array<bigint>>>"
    whole = spark.read.schema(kind).json(path, multiLine=True, mode="FAILFAST")
    twice = F.size(F.array_distinct(F.transform("cases", lambda c: c["id"]))) != F.size("cases")
    bad = whole.where(~F.col("schema").eqNullSafe(MANIFEST_SCHEMA) | F.coalesce(twice, F.lit(True))).limit(1).count()
    if bad:
        raise ValueError(f"not a manifest of {MANIFEST_SCHEMA} with each id once: {path}")
    return whole.select(F.posexplode("cases").alias("ordinal", "c")).select("ordinal", "c.*")


def observations(spark: SparkSession, path: str) -> DataFrame:
    """(index, bpm, held) of a CSV file; another header, a row that doesn't parse, a flag but 0 and 1, an index twice or missing fail the read."""
    rows = spark.read.schema("index int, bpm double, held int").csv(path, header=True, mode="FAILFAST", enforceSchema=False)
    i = F.col("index")
    seen = rows.agg(F.count("*").alias("n"), F.count_distinct("index").alias("d"), F.min(i).alias("lo"), F.max(i).alias("hi"), F.count_if(F.col("held").isNull() | ~F.col("held").isin(0, 1) | F.col("bpm").isNull()).alias("bad")).first()
    if seen["bad"] or seen["n"] and (seen["d"] != seen["n"] or seen["hi"] - seen["lo"] + 1 != seen["n"] or seen["lo"] not in (0, 1)):
        raise ValueError(f"observations of {path} aren't numbered one after another with flags of 0 and 1")
    return rows


def file_snapshot(spark: SparkSession, path: str, salt: str = "") -> DataFrame:
    """(id, bytes, modified, sha256) of the files under a path; the id is a salted hash of the path below it, so no name is told.

    Spark's readers follow what a store lists; links that lead out of the path are refused.
    """
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/").split("://")[-1].rstrip("/")
    below = F.substring_index("path", root, -1)
    out = rows.select("path", F.sha2(F.concat(F.lit(salt), below), 256).alias("id"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), F.sha2("content", 256).alias("sha256"))
    if outside := out.where(~F.col("path").contains(root)).limit(1).count():
        raise ValueError(f"{outside} file is outside {path}")
    return out.drop("path")


def snapshot_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(id, change) of what differs between two snapshots: added, removed, content or touched (only its time)."""
    j = before.alias("a").join(after.alias("b"), "id", "full")
    change = F.when(F.col("a.sha256").isNull(), "added").when(F.col("b.sha256").isNull(), "removed").when((F.col("a.sha256") != F.col("b.sha256")) | (F.col("a.bytes") != F.col("b.bytes")), "content").when(F.col("a.modified") != F.col("b.modified"), "touched")
    return j.select("id", change.alias("change")).where("change is not null")
