"""Shortest-pack-first packing over the length histogram.

Documents are encoded and cut into pieces of at most `room` ids. Only the histogram of piece lengths (at most `room` numbers)
goes to the driver, where lengths are placed longest first into the pack with the most room left; what comes out are packing
patterns with counts. The pieces find their place by length and rank: rank r of a length goes to the pattern whose range of ranks holds r.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.chunk_tokens import encoder
from pulsegrid.llm.common import stage, texts

ROOM = 1024


def pack_histogram(histogram: dict[int, int], room: int = ROOM) -> list[tuple[int, tuple[int, ...]]]:
    """(count, lengths in a pack) for all patterns. Never more than `room` kinds of lengths; each adds a few patterns at most."""
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = {}
    full: list[tuple[int, tuple[int, ...]]] = []

    def put(left: int, count: int, pattern: tuple[int, ...]) -> None:
        if not count:
            return
        if left:
            open_packs.setdefault(left, []).append((count, pattern))
        else:
            full.append((count, pattern))

    for length in sorted(histogram, reverse=True):
        n = histogram[length]
        while n:
            most = max(open_packs, default=0)
            if most >= length:
                count, pattern = open_packs[most].pop()
                if not open_packs[most]:
                    del open_packs[most]
                k = min(n, count)
                put(most, count - k, pattern)
                put(most - length, k, (*pattern, length))
                n -= k
            else:  # each new pack takes all it can of this length, as it stays the shortest while it has room
                each = room // length
                put(room - each * length, n // each, (length,) * each)
                if n % each:
                    put(room - n % each * length, 1, (length,) * (n % each))
                n = 0
    return full + [x for left in sorted(open_packs) for x in open_packs[left]]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys (length * 2**44 + first rank), first sequence and offset of each slot of each pattern."""
    ranks: dict[int, int] = {}
    rows, sequence = [], 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            r = ranks.get(length, 0)
            rows.append((length << 44 | r, sequence, offset))
            ranks[length], offset = r + count, offset + length
        sequence += count
    a = np.array(sorted(rows), np.int64).reshape(-1, 3)
    return a[:, 0], a[:, 1], a[:, 2]


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int, lower: bool = False, room: int = ROOM, with_ids: bool = False) -> tuple[DataFrame, str]:
    """Encodes whole texts (null: empty) and writes a row for each document, with its pieces, to the shared folder.

    task and rank: the number of the task, and of the piece among those of its length in that task. A document without text
    is one piece with the end id. Rows of equal ids each have pieces of their own.
    """
    fields = [("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("rank", pa.int64())] + [("ids", pa.binary())] * with_ids
    kind = pa.list_(pa.struct(fields))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, code = TaskContext.get().partitionId(), encoder(tokenizer_path, end_id, lower)
        seen = np.zeros(room + 1, np.int64)
        for batch in batches:
            for at, flat, counts in code.encode(batch.column(1)):
                n = (counts + room - 1) // room
                doc = np.repeat(np.arange(len(counts)), n)
                ordinal = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                length = np.minimum(counts[doc] - ordinal * room, room)
                order = np.argsort(length, kind="stable")
                kinds, first, number = np.unique(length[order], return_index=True, return_counts=True)
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.repeat(first, number) + np.repeat(seen[kinds], number)
                seen[kinds] += number
                view = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B")
                begins = (np.cumsum(length) - length) * 4
                bounds = list(zip(begins.tolist(), (begins + length * 4).tolist(), strict=True))
                columns = [pa.array(ordinal * room), pa.array(length.astype(np.int32)), pa.array([zlib.crc32(view[a:b]) for a, b in bounds], pa.int64()), pa.array(rank)]
                if with_ids:
                    columns.append(pa.array([bytes(view[a:b]) for a, b in bounds], pa.binary()))
                listed = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in fields]))
                ids = batch.column(0).slice(at, len(counts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64)), pa.array(np.full(len(counts), task, np.int32)), listed.cast(kind)], ["doc_id", "doc_tokens", "task", "pieces"])

    ddl = "doc_id long, doc_tokens long, task int, pieces array<struct<start: long, length: int, crc: long, rank: long" + ", ids: binary" * with_ids + ">>"
    return stage(texts(docs).mapInArrow(cut, ddl), "pieces")


def pack(pieces: DataFrame, room: int = ROOM) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and its ids, where pieces_of kept them).

    Ranks count over all tasks by a sum over (length, task), a number for each; no task sees more than one such number for each task.
    An empty table gives no rows.
    """
    flat = pieces.select("doc_id", "doc_tokens", "task", F.explode("pieces").alias("p")).select("doc_id", "doc_tokens", "task", "p.*")
    counts = flat.groupBy("length", "task").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in flat.groupBy("length").agg(F.count("*").alias("n")).collect()}
    key, sequence, offset = slots(pack_histogram(histogram, room))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        want = length.to_numpy(np.int64) << 44 | rank.to_numpy(np.int64)
        at = np.searchsorted(key, want, side="right") - 1
        return pd.DataFrame({"sequence_id": sequence[at] + want - key[at], "offset": offset[at]})

    placed = flat.join(base, ["length", "task"]).withColumn("at", place("length", F.col("rank") + F.col("base")))
    ids = ["ids"] if "ids" in flat.columns else []
    return placed.select("doc_id", "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens", "at.sequence_id", "at.offset", *ids)


def sequences(packed: DataFrame, room: int = ROOM, pad_id: int = 0) -> DataFrame:
    """The sequences themselves (sequence_id, n_ids, ids as little-endian u32), padded to `room` unless their length is a power of two.

    packed: what pack() gives with ids; a sequence has at most `room` pieces.
    """
    joined = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_ids"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("p"))
    whole = F.aggregate("p", F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    pad = F.unhex(F.repeat(F.lit(pad_id.to_bytes(4, "little").hex()), (F.lit(room) - F.col("n_ids")).cast("int")))
    power = F.bit_count(F.col("n_ids")) == 1
    return joined.select("sequence_id", "n_ids", F.when(power, whole).otherwise(F.concat(whole, pad)).alias("ids"))
