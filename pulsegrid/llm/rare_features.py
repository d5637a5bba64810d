"""Document fingerprints from statistically improbable features.

Every window of 64 bytes of a text is a feature. Its Shannon entropy, exact in integers, gives a rank by how improbable such an
entropy is in text; of each 64 neighbouring windows the rarest counts as popular once, and windows popular at least 16 times
are selected. Where a text has few of these, windows of 16 bytes are ranked and selected alike, of 8 neighbours each, and join in. A hash of each selected window sets five bits of a Bloom filter; 160 windows fill a filter of 2,048 bits and the
next one begins. Two fingerprints are compared filter by filter: the common bits over what chance gives, over the most there could be.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import shuffle_partitions, texts

FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
#: Each window of the large scale that is selected takes 1 / FADE of those of the small scale away, so that a short text has features enough
#: and a few bytes more or less change few of them.
FADE = 32
#: In thousandths of the most there can be: entropy that is too low to tell texts apart.
TOO_LOW = 250
_SCALE, _NEVER = 1 << 16, 1 << 10
_BUFFER, _SEGMENT = 1 << 18, 1 << 18


class Scale:
    """Windows of one length: how many neighbours each has, how often it must be the rarest, and the entropy that most windows have.

    bits: the most that a byte of a window can tell; typical and spread: thousandths of it.
    """

    def __init__(self, window: int, neighbours: int, popular: int, bits: int, typical: int, spread: int):
        self.window, self.neighbours, self.popular, self.pad = window, neighbours, popular, neighbours - 1
        count = np.arange(window + 2)
        self.clog = np.rint(count * np.log2(np.maximum(count, 1)) * _SCALE).astype(np.int64)
        bins = np.arange(1001)
        self.rank = np.where(bins < TOO_LOW, _NEVER, np.rint(1000 * np.exp(-(((bins - typical) / spread) ** 2) / 2))).astype(np.int64)
        self.most = bits * window * _SCALE

    def ranks(self, b: np.ndarray) -> np.ndarray:
        """The rank of the window that begins at each place; the lower, the rarer."""
        n, w, clog = len(b), self.window, self.clog
        behind, ahead = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
        for k in range(1, w):
            same = (b[k:] == b[:-k]).view(np.uint8)
            behind[k:] += same
            ahead[:-k] += same
        leaves = clog[ahead[: n - w]] - clog[ahead[: n - w] + np.uint8(1)]
        enters = clog[behind[w:] + np.uint8(1)] - clog[behind[w:]]
        total = np.empty(n - w + 1, np.int64)
        total[0] = clog[np.bincount(b[:w], minlength=256)].sum()
        np.cumsum(leaves + enters, out=total[1:])
        total[1:] += total[0]
        return self.rank[np.clip((self.most - total) * 1000 // self.most, 0, 1000)]

    def select(self, b: np.ndarray, valid: np.ndarray) -> np.ndarray:
        """Places of selected windows. valid: where a window begins that lies in one text."""
        n = len(valid)
        rank = np.where(valid, self.ranks(b)[:n], _NEVER)
        least = rank << 20 | np.arange(n)
        step = 1
        while step < self.neighbours:
            least = np.minimum(least[:-step], least[step:])
            step *= 2
        least = least[(least >> 20) < _NEVER]
        return np.flatnonzero(np.bincount(least & ((1 << 20) - 1), minlength=n) >= self.popular)


LARGE, SMALL = Scale(64, 64, 16, 6, 660, 70), Scale(16, 8, 3, 4, 790, 70)
WINDOW, _PAD = LARGE.window, LARGE.pad
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def _hash(windows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(windows).view(np.uint64)
    h = np.zeros(len(words), np.uint64)
    for i in range(8):
        h = (h ^ (h >> np.uint64(29))) * _MIX[i] + words[:, i]
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return h ^ (h >> np.uint64(29))


def _short_windows(text: bytes) -> np.ndarray:
    """Hashes of the small scale's selected windows, of all where none is selected, or of the whole text where it has no window."""
    if len(text) < SMALL.window:
        return np.frombuffer(hashlib.sha256(text).digest()[:8], np.uint64)
    found = []
    for lo in range(0, len(text) - SMALL.window + 1, _SEGMENT):
        # a part with what stands around it
        a, hi = max(0, lo - SMALL.pad), min(len(text) - SMALL.window + 1, lo + _SEGMENT)
        part = text[a : hi + SMALL.pad + SMALL.window - 1]
        b = np.frombuffer(bytes(SMALL.pad) + part + bytes(SMALL.pad + SMALL.window), np.uint8)
        valid = np.zeros(len(b) - SMALL.window + 1, bool)
        valid[SMALL.pad : SMALL.pad + len(part) - SMALL.window + 1] = True
        places = SMALL.select(b, valid)
        found.append(text_windows(b, places[(places - SMALL.pad >= lo - a) & (places - SMALL.pad < hi - a)]))
    some = np.concatenate(found)
    return some if len(some) else text_windows(np.frombuffer(text, np.uint8), np.arange(len(text) - SMALL.window + 1))


def text_windows(b: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Hashes of the small scale's windows at some places, the rest of each taken for zeros."""
    windows = np.zeros((len(places), WINDOW), np.uint8)
    windows[:, : SMALL.window] = np.lib.stride_tricks.sliding_window_view(b, SMALL.window)[places]
    return _hash(windows)


def features(data: list[bytes]) -> list[np.ndarray]:
    """The hashes of the selected windows of each text, each once, in the order in which they first stand. They depend on that text alone."""
    found: list[list[np.ndarray]] = [[] for _ in data]
    held: list[tuple[int, bytes, int, int, int]] = []  # text, bytes, first place of these that counts, one past the last, windows
    size = 0

    def close() -> None:
        nonlocal held, size
        pad = bytes(_PAD)
        b = np.frombuffer(b"".join(pad + x[1] for x in held) + bytes(_PAD + WINDOW), np.uint8)
        valid = np.zeros(len(b) - WINDOW + 1, bool)
        begins, at = [], 0
        for _, part, _, _, windows in held:
            at += _PAD
            begins.append(at)
            valid[at : at + windows] = True
            at += len(part)
        places = LARGE.select(b, valid)
        hashes = _hash(np.lib.stride_tricks.sliding_window_view(b, WINDOW)[places]) if len(places) else np.zeros(0, np.uint64)
        for (k, _, lo, hi, _), begin in zip(held, begins, strict=True):
            x, y = np.searchsorted(places, [begin + lo, begin + hi])
            if y > x:
                found[k].append(hashes[x:y])
        held, size = [], 0

    for k, text in enumerate(data):
        windows = len(text) - WINDOW + 1
        for lo in range(0, windows, _SEGMENT):
            # a part with what stands around it, so that its windows are selected as in the whole text
            a, hi = max(0, lo - _PAD), min(windows, lo + _SEGMENT)
            part = text[a : min(windows, hi + _PAD) + WINDOW - 1]
            held.append((k, part, lo - a, hi - a, len(part) - WINDOW + 1))
            size += len(part) + _PAD
            if size >= _BUFFER:
                close()
    if held:
        close()
    out = []
    for k, parts in enumerate(found):
        share = 1 - sum(map(len, parts)) / FADE
        if share > 0:
            short = _short_windows(data[k])
            parts.append(short if share == 1 else short[short < np.uint64(int(share * (1 << 64)))])
        h = np.concatenate(parts)
        out.append(h[np.sort(np.unique(h, return_index=True)[1])])
    return out


def filters(hashes: np.ndarray) -> np.ndarray:
    """The chained Bloom filters, a row of 32 words each."""
    number = -(-len(hashes) // FILTER_FEATURES)
    bits = np.zeros((number, FILTER_BITS), np.uint8)
    row = np.arange(len(hashes)) // FILTER_FEATURES
    for i in range(HASHES):
        bits[row, (hashes >> np.uint64(11 * i) & np.uint64(FILTER_BITS - 1)).astype(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view("<u8")


def fingerprint(f: np.ndarray) -> str:
    """The filters as hex digits, 512 to a filter."""
    return f.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1. Each filter of the shorter chain takes its best match in the other; the mean counts filters by their bits."""
    if len(a) > len(b) or len(a) == len(b) and a.tobytes() > b.tobytes():
        a, b = b, a
    ones_a, ones_b = np.bitwise_count(a).sum(axis=1, dtype=np.int64), np.bitwise_count(b).sum(axis=1, dtype=np.int64)
    best = np.empty(len(a))
    for i in range(len(a)):
        common = np.bitwise_count(a[i] & b).sum(axis=1, dtype=np.int64)
        chance = ones_a[i] * ones_b / FILTER_BITS
        best[i] = np.clip((common - chance) / (np.minimum(ones_a[i], ones_b) - chance), 0, 1).max()
    return float((best * ones_a).sum() / ones_a.sum())


def digests(data: list[bytes]) -> list[np.ndarray]:
    return [filters(h) for h in features(data)]


def _range_of(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are less than key; looked up in two steps, so that many bounds stay cheap."""
    if not bounds:
        return F.lit(0)
    m = max(1, int(len(bounds) ** 0.5))
    lists = [bounds[i : i + m] for i in range(0, len(bounds), m)]
    less = lambda a: F.size(F.filter(a, lambda b: b < key))
    array = lambda x: F.array(*[F.lit(b).cast("long") for b in x])
    coarse = less(array([x[0] for x in lists]))
    return F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * m + less(F.element_at(F.array(*[array(x) for x in lists]), F.greatest(coarse, F.lit(1)))))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, extra: docs dealt out by ranges of ids, each partition by descending id and closed by the document after it (extra = 1).

    Bounds of the ranges and the first id of each go to the driver: as many numbers as there are partitions. Rows of one id
    follow each other by a hash of their text; a null id comes last. A table of one row is followed by itself.
    """
    n = shuffle_partitions(docs.sparkSession)
    rows = texts(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63)).cast("long")))
    bounds = rows.agg(F.percentile_approx("key", [i / n for i in range(1, n)], 10_000)).first()[0] if n > 1 else []
    bounds = sorted(set(bounds or []))
    rows = rows.withColumn("bucket", _range_of(F.col("key"), bounds))
    heads = {r["bucket"]: r["key"] for r in rows.groupBy("bucket").agg(F.max("key").alias("key")).collect()}
    order = sorted(heads, reverse=True)
    # the head of a range also closes the range before it; the first head closes the last range
    closes = {heads[b]: order[i - 1] for i, b in enumerate(order)}
    own = F.struct("bucket", F.lit(0).alias("extra"))
    to = F.array(own)
    if closes:
        other = F.element_at(F.create_map(*[F.lit(x) for k, v in closes.items() for x in (k, v)]), F.col("key"))
        to = F.when(F.col("key").isin(list(closes)), F.array(own, F.struct(other.cast("int").alias("bucket"), F.lit(1).alias("extra")))).otherwise(to)
    dealt = rows.withColumn("to", F.explode(to)).select("doc_id", "text", "key", "to.bucket", "to.extra").repartitionById(len(bounds) + 1, F.col("bucket"))
    return dealt.sortWithinPartitions("extra", F.desc("key"), F.xxhash64("text"), "text").select("doc_id", "text", "extra")


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare_with_edited(docs: DataFrame) -> DataFrame:
    """A row for each document: its fingerprint, that of its edited text, and how like they and the next document's are.

    docs: doc_id, text (null: empty). Edited: the last floor(n_chars / 2) code points give way to the first as many of the next
    document by descending id. Texts with few rare windows, as short ones are, also have their windows of 12 bytes as features; those under 12 bytes have their SHA-256.
    """

    def results(rows: list[tuple[int, str]]) -> pa.RecordBatch:
        """For all rows but the last, which is only the next document."""
        own = [t for _, t in rows]
        sent = [(t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode() for t, after in zip(own, own[1:], strict=False)]
        made = digests([t.encode() for t in own] + sent)
        prints, edited = made[: len(own)], made[len(own) :]
        columns = [
            [i for i, _ in rows[:-1]], [len(t) for t in own[:-1]], [hashlib.sha256(e).hexdigest() for e in sent], [fingerprint(f) for f in prints[:-1]], [fingerprint(f) for f in edited],
            [likeness(f, e) for f, e in zip(prints, edited, strict=False)], [likeness(f, g) for f, g in zip(prints, prints[1:], strict=False)],
        ]
        kinds = [pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in RESULT.split(", ")])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, str]] = []
        chars, ended = 0, False
        for batch in batches:
            for i, text, extra in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ended:  # further rows of the id that closes the range
                    continue
                held.append((i, text))
                chars, ended = chars + len(text), bool(extra)
                if len(held) > 1 and (ended or len(held) > 64 or chars > 1 << 20):
                    yield results(held)
                    held, chars = held[-1:], len(text)

    return with_next(docs).mapInArrow(each, RESULT)
