"""What is chosen and shown of a library: tracks to analyse, settings, tag text, tables in order, run figures, reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The lengths in seconds and the numbers of windows that may be asked for, with their defaults, and the shortest track.
SECONDS, PASSES, DEFAULT_SECONDS, DEFAULT_PASSES, SHORTEST_S = (5, 10, 15, 20, 30, 45, 60, 90), (1, 3, 5, 10, 20, 50), 20, 50, 3.0


def to_analyse(tracks: DataFrame, again: bool = False, diagnostic: bool = False, tag: str = "BPM") -> DataFrame:
    """tracks (track, tags: map) without those that have the tag already, unless all are wanted again or the run is a diagnostic one."""
    readable = tracks.where("tags is not null")
    return readable if again or diagnostic else readable.where(~F.array_contains(F.map_keys("tags"), tag))


def allowed(seconds: Column, passes: Column) -> tuple[Column, Column]:
    """Settings as asked for where they are among the choices, else the defaults."""
    return F.when(seconds.isin(*SECONDS), seconds).otherwise(F.lit(DEFAULT_SECONDS)), F.when(passes.isin(*PASSES), passes).otherwise(F.lit(DEFAULT_PASSES))


def tag_text(tags: Column) -> Column:
    """The text that rules are held against: genre and style, else style, else `?`; several values of a tag by `, `."""
    value = lambda k: F.when(F.size(F.coalesce(tags[k], F.array().cast("array<string>"))) > 0, F.array_join(tags[k], ", "))
    return F.when(value("genre").isNotNull(), F.concat_ws("; ", value("genre"), value("style"))).otherwise(F.coalesce(value("style"), F.lit("?")))


def in_rail(x: Column, low: float, high: float, slack: float = 0.05) -> Column:
    """Whether a rate is inside a rail, give or take the slack."""
    return F.coalesce(x.between(low - slack, high + slack), F.lit(False))


def table_order(rows: DataFrame, batch: str, column: str, columns: list[str], row_id: str, descending: bool = False) -> DataFrame:
    """Adds place within a batch: rows by one column, ties by the others, then the row; texts without regard to case first, then exactly.

    Descending turns the whole order, ties included.
    """
    kinds = dict(rows.dtypes)
    keys = []
    for c in [column, *[x for x in columns if x != column]]:
        keys += [F.lower(c), F.col(c)] if kinds[c] == "string" else [F.col(c)]
    turned = [k.desc_nulls_last() if descending else k.asc_nulls_first() for k in [*keys, F.col(row_id)]]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(batch).orderBy(*turned)))


def candidate_order(rows: DataFrame, column: str, descending: bool = False) -> DataFrame:
    """Adds place within a track: by any column, what has no value last, ties by the rate; descending turns both."""
    c, r = F.col(column), F.col("rate")
    order = [c.isNull().asc(), c.desc() if descending else c.asc(), r.desc() if descending else r.asc()]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("track").orderBy(*order)))


def run_figures(rows: DataFrame) -> DataFrame:
    """One row for a run of tracks (state, ms): how many of each state, the time, tracks a second and milliseconds a track."""
    out = rows.agg(F.count("*").alias("tracks"), F.count_if(F.col("state") == "WRITE").alias("written"), F.count_if(F.col("state") == "HOLD").alias("held"), F.sum("ms").alias("ms"))
    per = lambda a, b: F.when(b > 0, a / F.nullif(b, F.lit(0)))
    return out.withColumns({"tracks_per_s": per(F.col("tracks") * 1000.0, F.col("ms")), "ms_per_track": per(F.col("ms") * 1.0, F.col("tracks"))})


def write_report(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """A comparison as files: one JSON document for the summary, CSV for the rows, as many parts as tasks wrote them."""
    summary.coalesce(1).write.json(f"{path}/summary")
    rows.write.option("header", "true").csv(f"{path}/rows")


def write_records(evidence: dict[str, DataFrame], path: str) -> None:
    """Evidence tables as records: each row a line of JSON with its kind, in a folder by kind; doubles round-trip."""
    for kind, df in evidence.items():
        df.select(F.to_json(F.struct(F.lit(kind).alias("record"), *df.columns)).alias("value")).write.text(f"{path}/record={kind}")
