"""Ordered folds: what depends on the order of a track's rows, one row after another, in constant memory for each track.

Rows are dealt out by track and sorted within a partition; a fold sees them as they stream past. So a track of any length needs
neither an array nor a group in memory, and the work is linear.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame

#: Rows that a fold gives back at a time.
_OUT = 8192


def folded(rows: DataFrame, keys: list[str], order: list[str | Column], start: Callable[[], object], schema: str, dealt: bool = False) -> DataFrame:
    """One fold object for each group of keys: add(*values) and end() yield output rows, tuples that stand behind the keys.

    rows: the keys first, then the values; dealt: they come dealt out by the keys. schema: the output's columns behind the keys. Ties in order are broken by all values.
    """
    values = [c for c in rows.columns if c not in keys]
    kinds = dict(rows.dtypes)
    full = ", ".join([f"{k} {kinds[k]}" for k in keys] + [schema])
    names = [x.split()[0] for x in full.split(", ")]
    ready = rows.select(*keys, *values) if dealt else rows.select(*keys, *values).repartition(*keys)
    ready = ready.sortWithinPartitions(*keys, *order, *values)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        kind, here, fold = None, None, None

        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(kind)], names)

        for batch in batches:
            if kind is None:
                kind = [batch.schema.field(i) for i in range(len(keys))] + [pa.field(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(", "))]
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns, strict=True):
                key, rest = row[: len(keys)], row[len(keys) :]
                if fold is None or key != here:
                    if fold is not None:
                        out += [(*here, *x) for x in fold.end()]
                    here, fold = key, start()
                made = fold.add(*rest)
                if made:
                    out += [(*here, *x) for x in made]
                if len(out) >= _OUT:
                    yield batch_of(out)
                    out = []
        if fold is not None:
            out += [(*here, *x) for x in fold.end()]
        if out:
            yield batch_of(out)

    return ready.mapInArrow(each, full)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_()}


class Families:
    """Rates join the nearest family within `tolerance` of its centre, which is their mean weighted by score; else they found one."""

    def __init__(self, tolerance: float):
        self.tolerance, self.all = tolerance, []

    def add(self, _order, rate: float, score: float, candidate: bool) -> list:  # noqa: ANN001
        if rate is None or score is None or not (rate > 0 and score > 0):
            return []
        near, least = None, self.tolerance
        for f in self.all:
            off = abs(f[0] - rate)
            if off < least or (near is None and off == least):
                near, least = f, off
        if near is None:
            self.all.append([rate, score, score, 1, int(candidate), rate])
            return []
        before = near[1]
        near[1] += score
        near[0] = (near[0] * before + rate * score) / near[1]
        near[3] += 1
        near[4] += int(candidate)
        if score > near[2]:
            near[2], near[5] = score, rate
        return []

    def end(self) -> list[tuple]:
        return [tuple(f) for f in self.all]


class Spaced:
    """Peaks at least `spacing` apart: of two nearer ones the stronger stays, and its place counts from then on."""

    def __init__(self, spacing: int):
        self.spacing, self.last = spacing, None

    def add(self, place: int, weight: float) -> list[tuple]:
        if self.last is None or place - self.last[0] >= self.spacing:
            done, self.last = self.last, (place, weight)
            return [done] if done else []
        if weight > self.last[1]:
            self.last = (place, weight)
        return []

    def end(self) -> list[tuple]:
        return [self.last] if self.last else []


class Clusters:
    """Sorted values join the first cluster whose running mean is within `tolerance`; end() gives the `keep` largest, then lowest."""

    def __init__(self, tolerance: float, keep: int):
        self.tolerance, self.keep, self.all = tolerance, keep, []

    def add(self, x: float) -> list:
        # values come sorted, so means ascend and only the last cluster can still be near
        for c in self.all[-1:]:
            if abs(x - c[0]) <= self.tolerance:
                c[0] = (c[0] * c[1] + x) / (c[1] + 1)
                c[1] += 1
                return []
        self.all.append([x, 1])
        if len(self.all) > 2 * self.keep + 1:  # only the last can still grow
            self.all = sorted(sorted(self.all[:-1], key=lambda c: (-c[1], c[0]))[: self.keep]) + self.all[-1:]
        return []

    def end(self) -> list[tuple]:
        return [(centre, count, rank) for rank, (centre, count) in enumerate(sorted(self.all, key=lambda c: (-c[1], c[0]))[: self.keep], 1)]


class Separated:
    """The `keep` best points at least `apart` from each other; a better one near a kept one takes its place, else that of the weakest."""

    def __init__(self, keep: int, apart: float):
        self.keep, self.apart, self.best = keep, apart, []

    def add(self, rate: float, score: float) -> list:
        for k, (other, had) in enumerate(self.best):
            if abs(other - rate) < self.apart:
                if score > had:
                    self.best[k] = (rate, score)
                return []
        if len(self.best) < self.keep:
            self.best.append((rate, score))
        else:
            k = min(range(self.keep), key=lambda i: self.best[i][1])
            if score > self.best[k][1]:
                self.best[k] = (rate, score)
        return []

    def end(self) -> list[tuple]:
        return [(rate, score, k) for k, (rate, score) in enumerate(sorted(self.best, key=lambda p: (-p[1], p[0])), 1)]


class Bursts:
    """Drops an onset that follows a kept one within `window` and is weaker than `share` of it."""

    def __init__(self, window: int, share: float):
        self.window, self.share, self.last = window, share, None

    def add(self, place: int, weight: float) -> list[tuple]:
        if self.last and 0 < place - self.last[0] < self.window and weight < self.last[1] * self.share:
            return []
        self.last = (place, weight)
        return [self.last]

    def end(self) -> list:
        return []


class Spread:
    """Onsets that are at least `spacing` behind the last one appended; an offset moves them all."""

    def __init__(self, spacing: int, offset: int):
        self.spacing, self.offset, self.last = spacing, offset, None

    def add(self, place: int) -> list[tuple]:
        if self.last is not None and place - self.last < self.spacing:
            return []
        self.last = place
        return [(place + self.offset,)]

    def end(self) -> list:
        return []
