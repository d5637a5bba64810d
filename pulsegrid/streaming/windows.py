"""Events as a stream: sliding windows, tap sessions, and spacing with state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pulsegrid.sources.staged import shared_path

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events.parquet of a folder as a stream with event time `at`; the column's type has no zone and a watermark needs one."""
    rows = spark.readStream.schema(EVENTS).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    return rows.select("event_id", F.col("ts").cast("timestamp").alias("at"), "user_id", "event_type", "value")


def sliding(stream: DataFrame, size: str = "12 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """(start, kind, n, total): counts and sums of overlapping windows."""
    w = stream.withWatermark("at", late).groupBy(F.window("at", size, slide).alias("w"), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("event_type").alias("kind"), "n", "total")


def sessions(stream: DataFrame, gap: str = "5 hours", late: str = "1 hour") -> DataFrame:
    """(track, start, taps): taps of a track with no longer gap between them."""
    w = stream.withWatermark("at", late).groupBy("user_id", F.session_window("at", gap).alias("w"))
    return w.agg(F.count("*").alias("taps")).select(F.col("user_id").alias("track"), F.col("w.start").alias("start"), "taps")


def spaced(stream: DataFrame, spacing_s: float, late: str = "1 day") -> DataFrame:
    """(track, us, value): onsets of a stream at least spacing apart, by state: the last one passed on is remembered for each track.

    Rows of a batch are taken in order of time; ones that come late, before the last passed on, are dropped. A track's state goes when the
    watermark has left its last onset behind by the spacing: whatever comes then is far enough from it.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values("us")
        out = []
        for us, value in zip(rows["us"], rows["value"], strict=True):
            if last is None or us - last >= spacing_s * 1e6:
                out.append((key[0], int(us), float(value)))
                last = int(us)
        state.update((last,))
        state.setTimeoutTimestamp(max(int(last / 1000 + spacing_s * 1000), state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=["track", "us", "value"])

    rows = stream.withWatermark("at", late).select(F.col("user_id").alias("track"), F.unix_micros("at").alias("us"), "value", "at")
    return rows.groupBy("track").applyInPandasWithState(step, "track long, us long, value double", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(streamed: DataFrame, mode: str, name: str) -> DataFrame:
    """Takes all there is from the stream, then stops; the result is a table in the shared folder.

    Each batch has a folder of its own, which a batch that is tried again writes over; a complete result has only the last.
    """
    spark = streamed.sparkSession
    out = shared_path(spark, name)
    schema = streamed.schema

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch}")

    query = streamed.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", shared_path(spark, f"{name}-checkpoint"))
    query.foreachBatch(write).start().awaitTermination()
    return spark.read.schema(schema).parquet(out).select(*schema.names)
