"""The supplied tables read as tracks, onsets, candidate rows, frames and tags, with only the columns that each needs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rates are cycles in 30 days where events stand for onsets; as many seconds.
UNIT_S = 2_592_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Order lines that one task takes; they make some 160,000 candidates of a board.
SHARE = 25_000


def tasks(spark: SparkSession, sf_dir: str, share: int = SHARE, name: str = "lineitem") -> int:
    """How many tasks the order lines, or the rows of another table, are dealt out to: in proportion to their number (from the footers of the files), as many as cores at least."""
    return max(spark.sparkContext.defaultParallelism, -(-table(spark, sf_dir, name).count() // share))


def by_track(rows: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """rows dealt out by track, once and while they are narrow: what follows goes by track and needs no other shuffle, and a task holds as much
    of a large table as of a small one. Tables dealt out so meet without a shuffle too."""
    return rows.repartition(tasks(spark, sf_dir), "track")


def onsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, us, value, kind): events as onsets, in microseconds since 2024-01-01; no time zone is involved."""
    ts = F.col("ts")
    day = F.datediff(F.to_date(ts), F.lit("2024-01-01").cast("date")).cast("long")
    whole = (day * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60) * 1_000_000
    us = whole + (F.date_part(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("track"), us.alias("us"), "value", F.col("event_type").alias("kind"))


ONSETS = "SELECT user_id AS track, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us, value, event_type AS kind FROM events"


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, segment, rate, score, quant, winner): order lines as the rows that windows of a track yield, dealt out by track."""
    rate = F.col("l_quantity") * 3.0 + 40.0
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("track"), F.col("l_linenumber").alias("segment"), rate.alias("rate"), F.col("l_discount").alias("score"), F.col("l_tax").alias("quant"), (F.col("l_returnflag") == "R").alias("winner")
    )
    return by_track(rows, spark, sf_dir)


CANDIDATES = (
    "SELECT l_orderkey AS track, l_linenumber AS segment, l_quantity * 3.0::DOUBLE + 40.0::DOUBLE AS rate, l_discount AS score, l_tax AS quant, l_returnflag = 'R' AS winner FROM lineitem"
)


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, length_s): the time a track's onsets cover, a day taken for 5.76 seconds."""
    return onsets(spark, sf_dir).groupBy("track").agg(((F.max("us") - F.min("us")) / 15_000_000_000.0).alias("length_s"))


SPANS = f"SELECT track, (max(us) - min(us)) / 15000000000.0::DOUBLE AS length_s FROM ({ONSETS}) GROUP BY track"


def tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track, value): part names and types as genre tags."""
    value = F.concat(F.regexp_replace("p_name", " ", ", "), F.lit("; "), F.col("p_name"), F.lit("/ "), F.col("p_type"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("track"), value.alias("value"))


TAGS = "SELECT p_partkey AS track, replace(p_name, ' ', ', ') || '; ' || p_name || '/ ' || p_type AS value FROM part"


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(line): events as lines of an evidence log."""
    value = F.replace(F.format_string("%.2f", "value"), F.lit("."), F.lit(","))
    k = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(F.concat(F.lit("host: [T"), F.col("user_id"), F.lit("] "), F.col("event_type"), F.lit(" id="), F.col("event_id"), F.lit(" value="), value, F.lit(" k="), k, F.lit(" reason="), F.when(k.cast("int") > 50, "high_k").otherwise("low_k")).alias("line"))


LOG_LINES = (
    "SELECT 'host: [T' || user_id || '] ' || event_type || ' id=' || event_id || ' value=' || replace(format('{:.2f}', value), '.', ',') || ' k=' || (props->>'$.k') "
    "|| ' reason=' || CASE WHEN (props->>'$.k')::INT > 50 THEN 'high_k' ELSE 'low_k' END AS line FROM events"
)
