"""k-means over integer vectors with clusters as balls.

A cluster is a ball: its centroid and a radius that holds all its members. Between two rounds the radius needs no pass of its own: the
largest distance of the round before, with the way the centroid went, bounds it. Neighbours of a ball are the centroids nearer than
twice its radius, no other can take a member. Members nearer to their centroid than half the way to the nearest neighbour are the
stable core and stay without a comparison; the rest lies in annuli, by how many neighbours are within twice its own distance,
and is compared with these alone. All of it is integer arithmetic, so the result is that of the plain comparison with every centroid.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import stage

#: Larger components would overflow a long in a squared distance.
LARGEST = 1 << 27


def integers(vectors: DataFrame, dim: int, scale: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, v (array of int): floor(scale * x) of the vectors with dim components, none null or not finite. Others stay behind."""
    x = F.col("e")
    kept = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("e"))
    kept = kept.where(F.coalesce((F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))), F.lit(False)))
    small = F.forall(x, lambda c: F.abs(c) * scale < LARGEST)
    whole = F.transform(x, lambda c: F.floor(c * scale).cast("int"))
    return kept.select("vec_id", F.when(small, whole).otherwise(F.raise_error(F.lit("a component is too large for exact distances"))).alias("v"))


@dataclass
class Balls:
    """k centroids and, once vectors are assigned, for each cluster the centroids that may take a member, nearest first."""

    centroids: np.ndarray
    neighbours: list[np.ndarray] = field(default_factory=list)
    apart: list[np.ndarray] = field(default_factory=list)

    def moved(self, sums: dict[int, tuple[list[int], int, int]]) -> Balls:
        """The balls after a round. sums: for each cluster with members their component sums, their number, their largest squared distance."""
        after = self.centroids.copy()
        for c, (total, n, _) in sums.items():
            after[c] = [s // n for s in total]
        new = Balls(after)
        for c in range(len(after)):
            between = ((after - after[c]) ** 2).sum(axis=1)
            near = np.lexsort((np.arange(len(after)), between))
            near = near[near != c]
            reach = math.sqrt(sums[c][2]) + math.sqrt(((after[c] - self.centroids[c]) ** 2).sum()) if c in sums else 0.0
            near = near[between[near] <= 4 * (reach * (1 + 1e-9) + 1e-6) ** 2]
            new.neighbours.append(near)
            new.apart.append(between[near])
        return new

    def assign(self, v: np.ndarray, cluster: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(cluster, squared distance) for each row of v: the nearest centroid, of equal ones the smaller number. cluster: where each row was."""
        if cluster is None:
            best, to = np.full(len(v), np.iinfo(np.int64).max), np.zeros(len(v), np.int64)
            for c, centroid in enumerate(self.centroids):
                d = ((v - centroid) ** 2).sum(axis=1)
                to[d < best] = c
                best = np.minimum(best, d)
            return to, best
        best, to = np.empty(len(v), np.int64), cluster.copy()
        for c in np.unique(cluster):
            rows = np.flatnonzero(cluster == c)
            members = v[rows]
            own = ((members - self.centroids[c]) ** 2).sum(axis=1)
            annulus = np.searchsorted(self.apart[c], 4 * own, side="right")  # 0 is the stable core
            least, goes = own.copy(), np.full(len(rows), c)
            for place, other in enumerate(self.neighbours[c][: annulus.max(initial=0)]):
                some = np.flatnonzero(annulus > place)
                d = ((members[some] - self.centroids[other]) ** 2).sum(axis=1)
                nearer = (d < least[some]) | ((d == least[some]) & (other < goes[some]))
                least[some[nearer]], goes[some[nearer]] = d[nearer], other
            best[rows], to[rows] = least, goes
        return to, best


def _assigned(rows: DataFrame, balls: Balls, dim: int) -> DataFrame:
    """vec_id, v, cluster, distance; rows: vec_id, v and, after the first round, cluster."""
    before = "cluster" in rows.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)
            to, distance = balls.assign(v, batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64) if before else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(to, pa.int32()), pa.array(distance, pa.int64())], ["vec_id", "v", "cluster", "distance"])

    return rows.select("vec_id", "v", *["cluster"] * before).mapInArrow(each, "vec_id long, v array<int>, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, np.ndarray]:
    """(vec_id, v, cluster, distance for each kept vector; the centroids).

    The first centroids are the k kept vectors with the smallest sha256 of `seed:vec_id`, of equal ids by their components. Each round
    assigns all vectors and moves the centroids to the floor of their members' means; those without members stay. Then
    all are assigned once more. Rows that repeat an id are vectors each; a null id is assigned but starts no centroid. Fewer than k vectors with an id make
    as many centroids; without any, no row comes out. Columns of other names stay behind.
    What goes to the driver is k centroids and k sums.
    """
    rows, path = stage(integers(vectors, dim, scale, id_col, vector_col), "ball-vectors")
    start = rows.where("vec_id is not null").select(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256).alias("h"), "v").orderBy("h", "v").limit(k).collect()
    balls = Balls(np.array([r["v"] for r in start], np.int64).reshape(-1, dim))
    if not start:
        return _assigned(rows.where("false"), balls, dim), balls.centroids
    for _ in range(rounds):
        rows, path = stage(_assigned(rows, balls, dim), "ball-round", path)
        sums = rows.groupBy("cluster").agg(F.count("*").alias("n"), F.max("distance").alias("far"), *[F.sum(F.col("v")[i].cast("long")).alias(f"s{i}") for i in range(dim)]).collect()
        balls = balls.moved({r["cluster"]: ([r[f"s{i}"] for i in range(dim)], r["n"], r["far"]) for r in sums})
    rows, _ = stage(_assigned(rows, balls, dim), "ball-round", path)
    return rows, balls.centroids


def inertias(vectors: DataFrame, **settings) -> DataFrame:  # noqa: ANN003
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 (of the centroid's decimal components, comma-joined) for each kept vector."""
    rows, centroids = cluster(vectors, **settings)
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("d")).collect()}
    known = [(c, d, sum(sums.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for c, d in sums.items()]
    named = rows.sparkSession.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    # k rows at most
    return rows.select("vec_id", "cluster", "distance").join(F.broadcast(named), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
