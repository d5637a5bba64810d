"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints that differ in at most `radius` = 4 bits share one of five parts of 12 or 13 bits; only those are compared. A group that
shares a part and is large is divided again by the rest of the bits in the same way, and what is still large is compared in tiles.
In a group the bits lie in vertical planes: one word holds the same bit of 64 fingerprints. Bitwise counters with carries
add up 64 distances at a time, and rows whose words all exceed the radius are abandoned before the last plane.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import shuffle_partitions, stage, texts
from pulsegrid.llm.components import components, local_components
from pulsegrid.llm.runs import whole_groups

RADIUS, SHINGLE, SEED = 4, 4, 42
#: Rows of a group that are compared in one place, and rows whose planes are compared at a time.
GROUP, QUERIES = 4096, 256
_PARTS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]
_BYTES = 1 << 20


def text_fingerprint(text: str) -> int:
    """The fingerprint of one text: A-Z lower-cased, words between ASCII white space, all runs of four words, XXH64 with seed 42."""
    hashes = _hashes(text.encode())
    if not len(hashes):
        return 0
    on = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(on * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _hashes(data: bytes) -> np.ndarray:
    words = data.lower().split()  # of bytes: ASCII letters and ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    begins = ends - np.diff(ends, prepend=0)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(begins[: len(words) - SHINGLE + 1].tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)), np.uint64, len(words) - SHINGLE + 1)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the 64 bits as a long) for each row; null and blank texts have 0."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1):
                hashes = _hashes(text.as_buffer().to_pybytes() if hasattr(text, "as_buffer") else text.as_py().encode())
                on, n = np.zeros(64, np.int64), len(hashes)
                for at in range(0, n, _BYTES // 64):
                    on += np.unpackbits(hashes[at : at + _BYTES // 64].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
                out.append(np.packbits(on * 2 > n, bitorder="little"))
            fp = np.concatenate(out).view("<i8") if out else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], ["doc_id", "fp"])

    return texts(docs).mapInArrow(each, "doc_id long, fp long")


def _exceeds(counter: list[np.ndarray], radius: int) -> np.ndarray:
    """Where the number in the counter's bit planes (the last one saturates) is over the radius."""
    *bits, over = counter
    more, same = over.copy(), ~over
    for k in reversed(range(len(bits))):
        if radius >> k & 1:
            same &= bits[k]
        else:
            more |= same & bits[k]
            same &= ~bits[k]
    return more


def close_pairs(fp: np.ndarray, group: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows i < j of the same group, at most `radius` bits apart. group is sorted; radius is under 8."""
    n = len(fp)
    bits = np.unpackbits(fp.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((-(-n // 64) * 64, 64), np.uint8)
    padded[:n] = bits
    planes = np.packbits(np.ascontiguousarray(padded.T), axis=1, bitorder="little").view("<u8")
    spread = np.where(bits.astype(bool), np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0))
    ends = np.searchsorted(group, group, side="right")
    for at in range(0, n, QUERIES):
        to = min(n, at + QUERIES)
        low, high = at // 64, -(-int(ends[to - 1]) // 64)
        rows = np.arange(at, to)
        counter = [np.zeros((len(rows), high - low), np.uint64) for _ in range(4)]
        for p in range(64):
            carry = planes[p, low:high][None, :] ^ spread[rows, p][:, None]
            for x in counter[:-1]:
                both = x & carry
                x ^= carry
                carry = both
            counter[-1] |= carry
            if p >= 15 and p % 8 == 7 and p < 63:
                alive = (~_exceeds(counter, radius)).any(axis=1)
                if not alive.any():
                    rows = rows[:0]
                    break
                if alive.sum() < 0.7 * len(rows):
                    rows, counter = rows[alive], [x[alive] for x in counter]
        if not len(rows):
            continue
        near = ~_exceeds(counter, radius)
        r, w = np.nonzero(near)
        k, bit = np.nonzero(np.unpackbits(np.ascontiguousarray(near[r, w]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
        i, j = rows[r[k]], (low + w[k]) * 64 + bit
        good = (j > i) & (j < n)
        i, j = i[good], j[good]
        good = group[i] == group[j]
        yield i[good], j[good]


def _bits(fp: Column, at: int, width: int) -> Column:
    return F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def _without(fp: Column, at: int, width: int) -> Column:
    """The bits besides those of one part, closed up."""
    low = fp.bitwiseAND(F.lit((1 << at) - 1).cast("long"))
    return low.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, at + width), at)) if at + width < 64 else low


def groups(nodes: DataFrame, limit: int = GROUP) -> DataFrame:
    """(tile, node, fp): rows that share a tile are to be compared; any two fingerprints within the radius share one.

    A tile is a hash of what its rows share; when two tiles meet in one hash, their rows are compared as well, which does no harm.
    """
    fp = F.col("fp")
    parts = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), _bits(fp, a, w).alias("bits")) for j, (a, w) in enumerate(_PARTS)])).alias("p")
    keyed = nodes.select("node", "fp", parts).select("node", "fp", F.col("p.j").alias("j"), F.xxhash64("p.j", "p.bits").alias("tile"))
    large = keyed.groupBy("tile").count().where(F.col("count") > limit)
    if large.isEmpty():
        return keyed.select("tile", "node", "fp")
    small = keyed.join(large, "tile", "left_anti").select("tile", "node", "fp")
    finer = []
    for a, w in _PARTS:
        cuts = [i * (64 - w) // 5 for i in range(6)]
        finer.append(F.array(*[F.xxhash64(F.col("tile"), F.lit(i), _bits(_without(fp, a, w), cuts[i], cuts[i + 1] - cuts[i])) for i in range(5)]))
    second = keyed.join(large.select("tile"), "tile").select("node", "fp", F.explode(F.element_at(F.array(*finer), F.col("j") + 1)).alias("tile"))
    sizes = second.groupBy("tile").count()
    tiles = F.ceil(F.col("count") / limit).cast("int")
    spot = F.pmod(F.xxhash64("fp"), F.col("g"))
    others = F.when(F.col("g") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), (F.col("g") - 1).cast("long")))
    third = second.join(sizes.select("tile", tiles.alias("g")), "tile").select("node", "fp", "tile", "g", spot.alias("c"), F.explode(others).alias("d"))
    return small.union(third.select(F.when(F.col("g") == 1, F.col("tile")).otherwise(F.xxhash64("tile", F.least("c", "d"), F.greatest("c", "d"))).alias("tile"), "node", "fp"))


def link(nodes: DataFrame, limit: int = GROUP) -> DataFrame:
    """(a, b): links that join all nodes (long ids with distinct fingerprints fp) within the radius, directly or through others.

    From each tile comes at most one link for each of its rows, not every close pair.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, group in whole_groups(batches, ["tile"], 8192):
            fp, node = rows.column("fp").to_numpy().view(np.uint64), rows.column("node").to_numpy()
            root = np.arange(len(fp))
            for i, j in close_pairs(fp, group):
                if len(i):
                    root = local_components(len(fp), np.concatenate([i, np.arange(len(fp))]), np.concatenate([j, root]))
            other = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(node[other]), pa.array(node[root[other]])], ["a", "b"])

    dealt = groups(nodes, limit).repartition(shuffle_partitions(nodes.sparkSession), "tile").sortWithinPartitions("tile")
    return dealt.mapInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, limit: int = GROUP) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable over links) for every row.

    docs: doc_id, text. Null, empty and blank texts have fingerprint zero and link with each other like any others. Rows of the same
    doc_id are nodes of one name: what either links with is one component. A null doc_id has its fingerprint and the component
    of that. An empty table gives no rows. Equal fingerprints count as one node, so copies are never paired.
    """
    marked, _ = stage(fingerprints(docs), "simhash")
    nodes, _ = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("node")).where("node is not null"), "simhash-nodes")
    # documents of one id but different fingerprints hold together, too
    twice = marked.join(nodes, "fp").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b").select("a", "b")
    found = components(link(nodes, limit).union(twice), name="simhash-links")
    named = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return marked.join(named, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
