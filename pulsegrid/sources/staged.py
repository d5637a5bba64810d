"""Tables that later steps of a query share, written once to the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; in local mode one of our own where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    base = base or "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _gone(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the JVM may have gone before us
        return


def staged(df: DataFrame, name: str, by: str | None = None, tasks: int = 0) -> DataFrame:
    """df written as Parquet and read back: its lineage ends here, in files that outlive executors. They go when the program ends.

    by, tasks: the column that df is dealt out by, and to how many tasks; its files are buckets then, and steps that go by it need no shuffle.
    """
    path = shared_path(df.sparkSession, name)
    if by:
        made = f"{name}_{uuid.uuid4().hex}".replace("-", "_")
        df.write.format("parquet").bucketBy(tasks, by).option("path", path).saveAsTable(made)
        atexit.register(_gone, df.sparkSession, path)
        return df.sparkSession.table(made)
    df.write.parquet(path)
    atexit.register(_gone, df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
