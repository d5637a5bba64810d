"""What would be written to tags, and whether it may be."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsegrid.functions.scalars import clamp, format_rate, number, positive


def delta(decisions: DataFrame, existing: DataFrame, places: int = 2) -> DataFrame:
    """(track, old, new, confidence) of tracks whose tag changes: not held, a rate to write, and a text that differs from the old one."""
    new = format_rate(F.col("rate"), places)
    j = decisions.join(existing, "track", "left").withColumn("new", new)
    change = ~F.col("held") & positive(F.col("rate")) & ~F.col("new").eqNullSafe(F.col("old"))
    return j.where(change).select("track", "old", "new", F.round(clamp(F.coalesce("confidence", F.lit(0.0)), 0.0, 100.0)).cast("int").alias("confidence"))


def scaled(existing: DataFrame, factor: float, places: int = 2) -> DataFrame:
    """(track, old, new): tags that are positive numbers, times factor."""
    x = number(F.col("old"))
    return existing.where(positive(x)).select("track", "old", format_rate(x * factor, places).alias("new"))


def safe_batches(batch: DataFrame, blocked: tuple[str, ...] = ("mp3", "flac", "wv")) -> DataFrame:
    """(batch, files, safe): a batch with one subsong of a blocked file type is not written at all."""
    bad = (F.col("subsong") != 0) & F.lower("extension").isin(*blocked)
    return batch.groupBy("batch").agg(F.count("*").alias("files"), (~F.bool_or(bad)).alias("safe"))


def write(changes: DataFrame, path: str, dry_run: bool = True) -> DataFrame:
    """Writes the changes as a table unless it is a dry run, which computes the same rows and writes nothing."""
    if not dry_run:
        changes.write.mode("overwrite").parquet(path)
    return changes


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def committed(spark: SparkSession, path: str, run: str) -> bool:
    """Whether a run's changes were written in full: the writer leaves its mark last, once all of its tasks are done."""
    files, where = _files(spark, f"{path.rstrip('/')}/run={run}/_SUCCESS")
    return files.exists(where)


def publish(changes: DataFrame, path: str, run: str) -> bool:
    """Writes a run's changes (track, old, new, confidence) below path, once: True if written now, False where the run is there already.

    What a failed attempt left has no mark; it is overwritten by the next. A run that is there is neither read nor written again, so a
    retry changes nothing, whatever its rows.
    """
    if not run or "/" in run:
        raise ValueError("a run's name is one part of a path")
    spark = changes.sparkSession
    if committed(spark, path, run):
        return False
    changes.write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(f"{path.rstrip('/')}/run={run}")
    return True


def resolved(review: DataFrame, path: str, run: str, key: str = "track") -> DataFrame:
    """The review list without the tracks that the run's mark confirms as written; the whole list where there is no mark."""
    spark = review.sparkSession
    if not committed(spark, path, run):
        return review.select(key).distinct()
    written = spark.read.parquet(f"{path.rstrip('/')}/run={run}").select(key).distinct()
    return review.select(key).distinct().join(written, key, "left_anti")


def current(existing: DataFrame, path: str, runs: list[str]) -> DataFrame:
    """(track, old): the tags after the committed runs of a list, the last one of it that changed a track counts. Runs without a mark don't."""
    spark = existing.sparkSession
    out = existing.select("track", F.col("old"), F.lit(-1).alias("n"))
    for n, run in enumerate(runs):
        if committed(spark, path, run):
            out = out.union(spark.read.parquet(f"{path.rstrip('/')}/run={run}").select("track", F.col("new").alias("old"), F.lit(n).alias("n")))
    return out.groupBy("track").agg(F.max_by("old", "n").alias("old"))
