"""Near-duplicate embeddings by counting collisions of one-dimensional projections.

Rows meet in compound cells of a few projections, so many and so often that a pair at the threshold shares a cell of some table with
probability 0.99; the number of projections in a cell follows the logarithm of the row count, so cells keep their size as the data
grow. What goes to the cells is a sketch of a vector, its further projections in a byte each. In a cell each of these is sorted; a window
around each row as the centre collides with the rows in it, and collisions are counted for each pair. Only vectors in a pair
whose count passes go to the cells themselves, where the pairs that count again, the same ones, are those that cosine in double precision
decides: a near group of n vectors would be n * n pairs to pass on, so rows pass on and not pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import shuffle_partitions, stage
from pulsegrid.llm.components import components, local_components
from pulsegrid.llm.runs import whole_groups

LINK = 0.95
#: Width of a cell side, half-width of the windows, projections counted, and the recall that tables and counts are each set for.
CELL, WINDOW, COUNTED, RECALL = 2.0, 0.6, 32, 0.995
#: Rows that a cell holds on the average, and rows of a cell compared in one place.
CELL_ROWS, GROUP = 64, 2048
#: A projection in a sketch is counted in so many; windows there are as much wider as two roundings may take.
STEP = 0.05
_PAIRS = 100_000


def _near(s: float, w: float) -> float:
    """Chance that two rows whose projections differ by N(0, s) share a cell side of width w."""
    return math.erf(w / s / math.sqrt(2)) - 2 * s / (math.sqrt(2 * math.pi) * w) * (1 - math.exp(-w * w / (2 * s * s)))


def plan(n: int, link: float = LINK) -> tuple[int, int, int]:
    """(projections in a cell, tables, least count) for n rows."""
    s = math.sqrt(2 - 2 * link)
    k = max(4, math.ceil(math.log(max(n, 2) / CELL_ROWS) / -math.log(_near(math.sqrt(2), CELL)))) if n > CELL_ROWS else 4
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - _near(s, CELL) ** k))
    p, tail, least = math.erf(WINDOW / s / math.sqrt(2)), 0.0, 0
    while tail + (x := math.comb(COUNTED, least) * p**least * (1 - p) ** (COUNTED - least)) <= 1 - RECALL:
        tail, least = tail + x, least + 1
    return k, tables, least


class Projections:
    """All directions and offsets for one dimension, from a fixed seed."""

    def __init__(self, dim: int, k: int, tables: int):
        rng = np.random.default_rng([dim, k, tables])
        self.counted = rng.standard_normal((dim, COUNTED))
        self.cells = rng.standard_normal((dim, k * tables))
        self.shift = rng.uniform(0, CELL, k * tables)
        self.mix = rng.integers(1, 1 << 62, k, dtype=np.int64) | 1
        self.k, self.tables, self.dim = k, tables, dim

    def sketch(self, x: np.ndarray) -> np.ndarray:
        """The counted projections of each row, a byte each; what is too large for it stands at its end."""
        return np.clip(np.rint(x @ self.counted / STEP), -127, 127).astype(np.int8)

    def cell_keys(self, x: np.ndarray) -> np.ndarray:
        """A number for the cell of each row in each table."""
        side = np.floor((x @ self.cells + self.shift) / CELL).astype(np.int64).reshape(len(x), self.tables, self.k)
        with np.errstate(over="ignore"):
            key = (side * self.mix).sum(axis=2) + np.arange(self.tables) * np.int64(0x1F123BB5159A55E5)
            key ^= (key >> 29) & np.int64((1 << 35) - 1)
            return key * np.int64(0x5851F42D4C957F2D) + self.dim


def _unit(rows: pa.Array) -> np.ndarray:
    x = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def collisions(sketch: np.ndarray, group: np.ndarray, side: np.ndarray, across: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of one group that stand in each other's window in `least` projections or more. Rows come sorted by group.

    side, across: where across is set, only rows of different sides are paired.
    """
    n = np.bincount(group)
    base, first = np.cumsum(n * n) - n * n, np.cumsum(n) - n
    place = np.arange(len(group)) - first[group]
    count = np.zeros(int((n * n).sum()), np.uint8)
    wide = int(np.ceil(WINDOW / STEP)) + 1
    for p in range(sketch.shape[1]):
        order = np.lexsort((sketch[:, p], group))
        line = group[order] * 1024 + sketch[order, p].astype(np.int64)
        number = np.searchsorted(line, line + wide, side="right") - np.arange(len(line)) - 1
        upto = np.cumsum(number)
        at = 0
        while at < len(line):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + 10 * _PAIRS, side="right")))
            some = number[at:to]
            a = np.repeat(np.arange(at, to), some)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(some) - some, some)
            at = to
            a, b = order[a], order[b]
            g = group[a]
            count[base[g] + np.minimum(place[a], place[b]) * n[g] + np.maximum(place[a], place[b])] += 1
    hit = np.flatnonzero(count >= least)
    g = np.searchsorted(base, hit, side="right") - 1
    i, j = first[g] + (hit - base[g]) // n[g], first[g] + (hit - base[g]) % n[g]
    fit = ~across[i] | (side[i] != side[j])
    return i[fit], j[fit]


def pair_links(x: np.ndarray, sketch: np.ndarray, group: np.ndarray, side: np.ndarray, across: np.ndarray, least: int, link: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of the pairs (i, j) that collisions() counts, those with cosine >= link."""
    i, j = collisions(sketch, group, side, across, least)
    for at in range(0, len(i), _PAIRS):
        a, b = i[at : at + _PAIRS], j[at : at + _PAIRS]
        good = (x[a] * x[b]).sum(axis=1) >= link
        yield a[good], b[good]


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", link: float = LINK, limit: int = GROUP) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row; links are pairs with cosine >= link, found with a recall of about 0.99.

    Null, empty and zero vectors and those with null or non-finite components link with nothing. Vectors of different dimensions never
    link. Equal vectors are one node with a weight: they link with each other and are never paired. A null id counts as a vector
    like any other where links are counted, but names no component while its vector has another id. An empty table gives no rows.
    Ids are taken as distinct; rows that repeat an id each count as a vector.
    """
    spark = vectors.sparkSession
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].alias("embedding"))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))
    good = v.where(usable)
    nodes, _ = stage(good.groupBy("embedding").agg(F.min("vec_id").alias("node"), F.count("*").alias("weight")).where("node is not null"), "vectors")
    k, tables, least = plan(nodes.count(), link)

    def dealer(sketches: bool):  # noqa: ANN202
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made: dict[int, Projections] = {}
            for batch in batches:
                sizes = np.diff(np.asarray(batch.column(0).offsets))
                for dim in np.unique(sizes):
                    part = batch.filter(pa.array(sizes == dim))
                    p = made.setdefault(int(dim), Projections(int(dim), k, tables))
                    for at in range(0, part.num_rows, 1024):
                        few = part.slice(at, 1024)
                        x = _unit(few.column(0))
                        out = [pa.array(p.cell_keys(x).ravel())]
                        if sketches:
                            bytes_ = pa.FixedSizeBinaryArray.from_buffers(pa.binary(COUNTED), len(x), [None, pa.py_buffer(p.sketch(x).tobytes())]).cast(pa.binary())
                            again = pa.array(np.repeat(np.arange(len(x)), tables))
                            out += [few.column(1).take(again), bytes_.take(again)]
                        yield pa.RecordBatch.from_arrays(out, ["cell", "node", "sketch"][: len(out)])

        return deal

    kind = dict(nodes.dtypes)["embedding"]
    cells = nodes.select("embedding", "node").mapInArrow(dealer(True), "cell long, node long, sketch binary")
    sizes = nodes.select("embedding", "node").mapInArrow(dealer(False), "cell long").groupBy("cell").count()
    large = sizes.where(F.col("count") > limit).select("cell", F.ceil(F.col("count") / limit).cast("long").alias("g"))
    # a large cell is dealt out in tiles: a row goes to those of its own share with every other share
    spread = cells.join(large, "cell", "left").withColumn("side", F.when(F.col("g").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("node"), F.col("g"))).cast("long"))
    spread = spread.withColumn("d", F.explode(F.when(F.col("g").isNull(), F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("g") - 1))))
    spread = spread.select("cell", F.least("side", "d").alias("lo"), F.greatest("side", "d").alias("hi"), "side", "node", "sketch")
    by = ["cell", "lo", "hi"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, by, 4096):
            values = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.int8).reshape(-1, COUNTED)
            lo, hi, side = (rows.column(c).to_numpy() for c in ("lo", "hi", "side"))
            i, j = collisions(values, group, side, lo != hi, least)
            keep = np.unique(np.concatenate([i, j]))
            yield from rows.take(pa.array(keep)).select([*by, "side", "node"]).combine_chunks().to_batches()

    near, near_path = stage(spread.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by).mapInArrow(count, "cell long, lo long, hi long, side long, node long"), "vector-cells")
    spread = near.join(nodes, "node").select("cell", "lo", "hi", "side", "embedding", "node", "weight")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Projections] = {}
        for rows, all_groups in whole_groups(batches, by, 4096):
            vectors_ = rows.column("embedding").combine_chunks()
            vectors_ = vectors_ if isinstance(vectors_, pa.Array) else vectors_.chunk(0)
            lengths = np.diff(np.asarray(vectors_.offsets))
            for dim in np.unique(lengths):
                pick = np.flatnonzero(lengths == dim)
                p = made.setdefault(int(dim), Projections(int(dim), k, tables))
                x, group = _unit(vectors_.take(pa.array(pick))), all_groups[pick]
                cell, lo, hi, side, node, weight = (rows.column(c).to_numpy()[pick] for c in ("cell", "lo", "hi", "side", "node", "weight"))
                count, root = np.zeros(len(x), np.int64), np.arange(len(x))
                for i, j in pair_links(x, p.sketch(x), group, side, lo != hi, least, link):
                    if not len(i):
                        continue
                    # a pair counts in the first table in which it shares a cell
                    some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
                    keys = p.cell_keys(x[some])
                    same = keys[place[: len(i)]] == keys[place[len(i) :]]
                    here = keys[place[: len(i)], same.argmax(axis=1)] == cell[i]
                    i, j = i[here], j[here]
                    count += np.bincount(i, weight[j], len(x)).astype(np.int64) + np.bincount(j, weight[i], len(x)).astype(np.int64)
                    root = local_components(len(x), np.concatenate([i, np.arange(len(x))]), np.concatenate([j, root]))
                got = np.flatnonzero((count > 0) | (root != np.arange(len(x))))
                yield pa.RecordBatch.from_arrays([pa.array(node[got]), pa.array(count[got]), pa.array(node[root[got]])], ["node", "n", "root"])

    dealt = spread.repartition(shuffle_partitions(spark), *by).sortWithinPartitions(*by)
    found, _ = stage(dealt.mapInArrow(compare, "node long, n long, root long"), "vector-links", near_path)
    named = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")), name="vector-components")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    known = nodes.join(counts, "node", "left").join(named, "node", "left").select("embedding", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "node").alias("c"))
    linked = good.join(known, "embedding", "left").select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), F.coalesce("c", "vec_id").alias("component_id"))
    alone = v.where(~usable).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
