"""Connected components over a table of links, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage


def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row reachable over the pairs (a, b)."""
    label = np.arange(n)
    while len(a):
        # only the ends of chains are hooked on: a row that were moved itself would lose what else its end is hooked to
        x, y = label[a], label[b]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != (up := label[label])).any():
            label = up
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def _is_star_forest(e: DataFrame) -> bool:
    inner = e.join(e.select(F.col("u").alias("v")).distinct(), "v", "left_semi")
    return inner.isEmpty() and e.groupBy("u").count().where("count > 1").isEmpty()


def components(links: DataFrame, a: str = "a", b: str = "b", name: str = "links") -> DataFrame:
    """(node, component): every node of a link with the smallest node it can reach. Nodes without links aren't listed.

    Each round is a few joins and aggregations over the links, written to the shared folder, which replaces the round before;
    nothing but whether it is done goes to the driver. Minima are aggregated before they are shuffled, and the joins that
    follow are plain equi-joins, whose large partitions AQE splits, so that a node with very many links is no bottleneck.
    """
    first = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e, path = stage(first, name)
    while not _is_star_forest(e):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        pairs = F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("p")
        small = large.join(low, "u").select(pairs).select(F.col("p.v").alias("u"), F.col("p.m").alias("v")).where("u <> v").distinct()
        e, path = stage(small, name, path)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
