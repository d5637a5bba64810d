"""Tags written once and a review list that shrinks only by what was written."""

import pytest
from pyspark.sql import functions as F

from pulsegrid.operators import tags


@pytest.fixture()
def tables(spark):
    changes = spark.createDataFrame([(1, "100", "101", 80), (2, None, "90", 70)], "track long, old string, new string, confidence int")
    return changes, spark.createDataFrame([(1,), (2,), (3,), (3,)], "track long"), spark.createDataFrame([(1, "100"), (4, "50")], "track long, old string")


def listed(df):
    return sorted(r["track"] for r in df.collect())


def test_written_once(spark, tables, tmp_path):
    changes, review, existing = tables
    path = f"file://{tmp_path}/tags"
    assert listed(tags.resolved(review, path, "a")) == [1, 2, 3]
    assert tags.publish(changes, path, "a") and tags.committed(spark, path, "a")
    assert listed(tags.resolved(review, path, "a")) == [3] and listed(tags.resolved(review, path, "b")) == [1, 2, 3]
    # a retry, even with other rows, changes nothing
    assert not tags.publish(changes.where("track = 1").withColumn("new", F.lit("7")), path, "a")
    assert {r["track"]: r["old"] for r in tags.current(existing, path, ["a", "b"]).collect()} == {1: "101", 2: "90", 4: "50"}
    assert tags.publish(changes.where("track = 1").withColumn("new", F.lit("7")), path, "b")
    assert {r["track"]: r["old"] for r in tags.current(existing, path, ["a", "b"]).collect()}[1] == "7"
    assert {r["track"]: r["old"] for r in tags.current(existing, path, ["b", "a"]).collect()}[1] == "101"


def test_a_failed_write_leaves_the_list_as_it_was(spark, tables, tmp_path):
    changes, review, existing = tables
    path = f"file://{tmp_path}/tags"
    broken = changes.withColumn("new", F.when(F.col("track") == 2, F.raise_error(F.lit("disk full")).cast("string")).otherwise(F.col("new")))
    with pytest.raises(Exception, match="disk full"):
        tags.publish(broken.repartition(2), path, "a")
    assert not tags.committed(spark, path, "a")
    assert listed(tags.resolved(review, path, "a")) == [1, 2, 3]
    assert {r["track"]: r["old"] for r in tags.current(existing, path, ["a"]).collect()} == {1: "100", 4: "50"}
    # the next attempt writes over what is left of the first
    assert tags.publish(changes, path, "a")
    assert listed(tags.resolved(review, path, "a")) == [3] and spark.read.parquet(f"{path}/run=a").count() == 2


def test_names_and_empty_runs(spark, tables, tmp_path):
    changes, review, _ = tables
    path = f"file://{tmp_path}/tags"
    for bad in ("", "a/b"):
        with pytest.raises(ValueError, match="one part"):
            tags.publish(changes, path, bad)
    assert tags.publish(changes.where("false"), path, "none") and listed(tags.resolved(review, path, "none")) == [1, 2, 3]
