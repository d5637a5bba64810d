"""Token-id shards with Re-Pair grammars.

A shard holds the ids of consecutive documents. In rounds, frequent adjacent pairs of symbols become nonterminals, until no pair
stands LEAST times in the shard or all 65,536 symbols are in use; no pair reaches over a document's end, so each document is a
slice of the compressed sequence and can be decoded alone, or any part of it by the stored lengths of the rules' expansions.

Layout of a shard, little-endian: magic "RPS1"; n_docs, n_rules, n_symbols, terminals as u32; then doc ids (i64), compressed
symbols of each document (u32), ids of each document (u32), rules (pairs of u16), expansion lengths of the rules (u32), symbols (u16).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.chunk_tokens import encoder, gather
from pulsegrid.llm.common import shuffle_partitions, stage, texts

MAGIC, BITS = b"RPS1", 20
#: Ids of a shard, rules made in a round, and how often a pair must stand in the shard to become one: a rule costs 8 bytes in the file
#: and a pair replaced saves 2, so a pair that stands five times pays.
SHARD_IDS, RULES_A_ROUND, LEAST = 1 << 20, 6000, 5
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1)


def frequent_pairs(s: np.ndarray, may: np.ndarray, mult: int, most: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the pairs to replace, most frequent first; the places of these pairs; the rank of the pair at each).

    Places are counted in hash buckets, one pair to a bucket; those of pairs whose bucket another holds are sorted and counted apart, so
    all counts are exact. Overlapping places in a run of one symbol count each, so such a pair is rather replaced than left.
    """
    key = s[:-1].astype(np.uint32)
    key <<= np.uint32(16)
    key |= s[1:]
    h = (key * np.uint32(mult)) >> np.uint32(32 - BITS)
    owner = np.zeros(1 << BITS, np.uint32)
    owner[h] = key
    owns = owner[h] == key
    own, rest = np.flatnonzero(owns & may), np.flatnonzero(~owns & may)
    count = np.bincount(h[own], minlength=1 << BITS)
    bucket = np.flatnonzero(count >= least)
    others, times = np.unique(key[rest], return_counts=True)
    other = np.flatnonzero(times >= least)
    keys, counts = np.concatenate([owner[bucket], others[other]]), np.concatenate([count[bucket], times[other]])
    best = np.argsort(-counts, kind="stable")[:most]
    place = np.full(len(keys), -1, np.int32)
    place[best] = np.arange(len(best))
    of_bucket, of_other = np.full(1 << BITS, -1, np.int32), np.full(len(others), -1, np.int32)
    of_bucket[bucket], of_other[other] = place[: len(bucket)], place[len(bucket) :]
    rank = np.full(len(key), -1, np.int32)
    rank[own] = of_bucket[h[own]]
    if len(other):
        rank[rest] = of_other[np.searchsorted(others, key[rest])]
    at = np.flatnonzero(rank >= 0)
    return keys[best], at, rank[at]


def compress(ids: np.ndarray, ends: np.ndarray, terminals: int, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, places behind each document's last symbol, rules). ends: the same places in ids.

    Afterwards no pair of symbols stands `least` times, unless all symbols are in use.
    """
    if terminals >= 1 << 16 or len(ids) and int(ids.max()) >= terminals:
        raise ValueError("ids must be less than terminals, and terminals less than 65,536")
    s = ids.astype(np.uint16)
    last = np.zeros(len(s), bool)
    last[ends[ends > 0] - 1] = True
    rules: list[np.ndarray] = []
    made, rounds = terminals, 0
    while len(s) > 1 and made < 1 << 16:
        most = min(RULES_A_ROUND, (1 << 16) - made)
        keys, at, rank = frequent_pairs(s, ~last[:-1], _MULTIPLIERS[rounds % len(_MULTIPLIERS)], most, least)
        rounds += 1
        if not len(keys):
            break
        # of overlapping places in a run, every other one counts, from the left
        place = np.arange(len(at))
        begins = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) > 1, place, 0))
        odd = ((place - begins) & 1) == 0
        take = at[odd]
        s[take] = (made + rank[odd]).astype(np.uint16)
        last[take] = last[take + 1]
        keep = np.ones(len(s), bool)
        keep[take + 1] = False
        s, last = s[keep], last[keep]
        rules.append(np.stack([keys >> np.uint32(16), keys & np.uint32(0xFFFF)], axis=1).astype(np.uint16))
        made += len(keys)
    marks = np.flatnonzero(last) + 1
    behind = np.zeros(len(ends), np.int64)
    full = np.diff(ends, prepend=0) > 0
    behind[full] = marks
    return s, np.maximum.accumulate(behind) if len(behind) else behind, np.concatenate(rules or [np.zeros((0, 2), np.uint16)])


def expansions(rules: np.ndarray, terminals: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, flat): the terminals of symbol x are flat[start[x]:start[x] + length[x]]."""
    n = terminals + len(rules)
    start, length = np.arange(n, dtype=np.int64), np.ones(n, np.int64)
    flat, at, done = [np.arange(terminals, dtype=np.uint32)], terminals, terminals
    while done < n:
        # rules up to the first that uses one of this run can be expanded together
        ahead = rules[done - terminals :].max(axis=1)
        run = int(np.argmax(ahead >= done)) if (ahead >= done).any() else n - done
        pair = rules[done - terminals : done - terminals + run].astype(np.int64)
        got = gather(start[pair].ravel(), length[pair].ravel(), np.concatenate(flat))
        size = length[pair].sum(axis=1)
        start[done : done + run], length[done : done + run] = at + np.cumsum(size) - size, size
        flat.append(got)
        at, done = at + len(got), done + run
    return start, length, np.concatenate(flat)


def to_bytes(doc_ids: np.ndarray, counts: np.ndarray, ids: np.ndarray, terminals: int) -> bytes:
    s, behind, rules = compress(ids, np.cumsum(counts), terminals)
    size = expansions(rules, terminals)[1][terminals:]
    head = MAGIC + struct.pack("<4I", len(doc_ids), len(rules), len(s), terminals)
    if 12 * len(rules) + 2 * len(s) + 16 * len(doc_ids) >= (1 << 31) - 64:
        raise ValueError("a shard is one binary value of a row, which ends at 2 GiB: a document is too long, split it")
    parts = (doc_ids.astype("<i8"), np.diff(behind, prepend=0).astype("<u4"), counts.astype("<u4"), rules.astype("<u2"), size.astype("<u4"), s.astype("<u2"))
    return head + b"".join(p.tobytes() for p in parts)


class Shard:
    """A shard read back. ids(k) decodes document k or a part of it alone, all() every document."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a shard of this format")
        n, r, m, self.terminals = struct.unpack_from("<4I", data, 4)
        at = 20
        parts = []
        for kind, count in (("<i8", n), ("<u4", n), ("<u4", n), ("<u2", 2 * r), ("<u4", r), ("<u2", m)):
            parts.append(np.frombuffer(data, kind, count, at))
            at += parts[-1].nbytes
        self.doc_ids, self.n_symbols, self.n_ids, rules, self.rule_sizes, self.symbols = parts
        self.rules = rules.reshape(-1, 2)
        self.behind = np.cumsum(self.n_symbols, dtype=np.int64)

    def _sizes(self, s: np.ndarray) -> np.ndarray:
        """How many ids each symbol stands for, by the stored lengths."""
        made = s >= self.terminals
        out = np.ones(len(s), np.int64)
        out[made] = self.rule_sizes[s[made] - self.terminals]
        return out

    def ids(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """Ids begin to end of document k. Only symbols that reach into this part are expanded, step by step."""
        s = self.symbols[self.behind[k] - self.n_symbols[k] : self.behind[k]].astype(np.int64)
        end = int(self.n_ids[k]) if end is None else min(end, int(self.n_ids[k]))
        begin = max(0, begin)
        if begin >= end:
            return np.zeros(0, np.uint32)
        while True:
            upto = np.cumsum(self._sizes(s))
            lo, hi = int(np.searchsorted(upto, begin, side="right")), int(np.searchsorted(upto, end, side="left")) + 1
            before = int(upto[lo - 1]) if lo else 0
            s, begin, end = s[lo:hi], begin - before, end - before
            made = s >= self.terminals
            if not made.any():
                return s.astype(np.uint32)
            place = np.cumsum(1 + made) - 1 - made
            out = np.empty(len(s) + int(made.sum()), np.int64)
            out[place[~made]] = s[~made]
            out[place[made]], out[place[made] + 1] = self.rules[s[made] - self.terminals].T
            s = out

    def all(self) -> np.ndarray:
        start, length, flat = expansions(self.rules, self.terminals)
        return gather(start[self.symbols], length[self.symbols], flat)


SHARDS = "part int, shard int, part_offset long, first_doc long, n_docs int, n_ids long, payload binary"


def write_shards(docs: DataFrame, tokenizer_path: str, end_id: int, lower: bool, terminals: int, name: str = "repair") -> tuple[DataFrame, str]:
    """Encodes whole texts and writes them as shards in ascending doc_id order; gives the written table and its path.

    docs: doc_id, text (null counts as empty; equal ids stand in any order; a null id comes first and is written as the lowest long).
    terminals must be under 65,536, else ValueError. The shards are the binary column of a Parquet table, so that any store Spark can reach holds them;
    part counts the ranges of ids, shard those in a range, part_offset the ids before the shard in its range.
    A shard ends with the document that fills it, so a very long document makes one long shard; over 2 GiB of symbols are a ValueError.
    """
    parts = shuffle_partitions(docs.sparkSession)
    rows = texts(docs).repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, code = TaskContext.get().partitionId(), encoder(tokenizer_path, end_id, lower)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = shard = before = 0

        def close() -> pa.RecordBatch:
            nonlocal size, shard, before, held
            ids, counts, docs_ = (np.concatenate([h[i] for h in held]) for i in range(3))
            row = [part, shard, before, int(docs_[0]), len(docs_), len(ids), to_bytes(docs_, counts, ids, terminals)]
            held, size, shard, before = [], 0, shard + 1, before + len(ids)
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], SHARD_NAMES)

        for batch in batches:
            doc_ids = np.asarray(batch.column(0).fill_null(-(1 << 63)), np.int64)
            for at, flat, counts in code.encode(batch.column(1)):
                ends = np.cumsum(counts)
                done = 0
                while done < len(counts):
                    began = ends[done - 1] if done else 0
                    to = min(len(counts), max(done + 1, int(np.searchsorted(ends, began + SHARD_IDS - size, side="left")) + 1))
                    held.append((flat[began : ends[to - 1]], counts[done:to], doc_ids[at + done : at + to]))
                    size += int(ends[to - 1] - began)
                    done = to
                    if size >= SHARD_IDS:
                        yield close()
        if held:
            yield close()

    return stage(rows.mapInArrow(shards, SHARDS), name)


SHARD_NAMES = ["part", "shard", "part_offset", "first_doc", "n_docs", "n_ids", "payload"]


def read_documents(shards: DataFrame, with_ids: bool = True) -> DataFrame:
    """A row for each document of the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32, and its ids as
    little-endian unsigned 32-bit integers.

    Only one sum for each range of ids goes to the driver; their number is the partition count of the job that wrote them.
    """
    sums = {r["part"]: r["n"] for r in shards.groupBy("part").agg(F.max(F.col("part_offset") + F.col("n_ids")).alias("n")).collect()}
    first, so_far = {}, 0
    for p in sorted(sums):
        first[p], so_far = so_far, so_far + sums[p]

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, offset, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                shard = Shard(payload.as_buffer().to_pybytes())
                data = np.ascontiguousarray(shard.all(), "<u4")
                ends = np.cumsum(shard.n_ids, dtype=np.int64)
                view = memoryview(data).cast("B")
                bounds = np.concatenate([[0], ends]) * 4
                crc = [zlib.crc32(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                null = shard.doc_ids == -(1 << 63)
                out = [pa.array(shard.doc_ids, pa.int64(), mask=null), pa.array(first[part] + offset + ends - shard.n_ids, pa.int64()), pa.array(shard.n_ids.astype(np.int64)), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.array([bytes(view[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(out)])

    return shards.select("part", "part_offset", "payload").mapInArrow(documents, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


__all__ = ["LEAST", "Shard", "compress", "expansions", "read_documents", "to_bytes", "write_shards"]
