"""Repair of conversations by the cheapest edits, each distinct signature solved once.

A conversation's turns become a signature, a letter for each: the initial of its role, in upper case where its text is truncated, or x where
it must go. Long conversations are cut into segments, dealt out by ranges of turns, so that none is too much for one task. What a
segment can do is a table of costs from each state of the grammar `(s?(ua)+)?` to each other; such tables chain, from the
last segment to the first, and tell what each segment's ends are worth. Every distinct (signature, worth) is solved once, by memoised
recursion, for all four states to start from; the audits are joined back and the edits are replayed in order.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import shuffle_partitions, stage

#: Turns in a segment, and characters of text after which it ends.
SEGMENT, SEGMENT_CHARS = 256, 1 << 20
#: States of the grammar: nothing yet, after the system's turn, after a user's, after an assistant's. Where a kept turn, by its initial, leads.
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
#: Where a turn made by an edit leads, and its role.
MADE = [2, 2, 3, 2]
ROLES = {2: "user", 3: "assistant"}
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Inserts that end a conversation, by the state that its turns lead to.
LAST = [0, 2, 1, 0]
_FINAL = ",".join(str(n * INSERT) for n in LAST)
_FAR = 1 << 40
_SPACE = " \t\n\x0b\x0c\r"


class Signature:
    """All ways through one signature."""

    def __init__(self, signs: str):
        self.signs = signs
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 8 * SEGMENT))

        @cache
        def ways(i: int, state: int, inserted: int) -> tuple[int, ...]:
            if i == len(signs):
                return tuple(0 if e == state else _FAR for e in range(4))
            found = [[cost + c for c in ways(*to)] for _, cost, to in self.edits(i, state, inserted)]
            return tuple(map(min, *found)) if len(found) > 1 else tuple(found[0])

        self.ways = ways

    def edits(self, i: int, state: int, inserted: int) -> Iterator[tuple[str, int, tuple[int, int, int]]]:
        """(initial, cost, where it leads) of each edit at turn i, the least initial first. A third insert in a row leads nowhere new."""
        sign = self.signs[i]
        yield "D", DELETE, (i + 1, state, 0)
        if sign == "x":
            return
        if inserted < 2:
            yield "I", INSERT, (i, MADE[state], inserted + 1)
        more = TRUNCATED * sign.isupper()
        if (to := KEEPS.get((state, sign.lower()))) is not None:
            yield "K", more, (i + 1, to, 0)
        yield "R", REROLE + more, (i + 1, MADE[state], 0)

    def costs(self) -> list[int]:
        """Sixteen numbers: from each state to each."""
        return [c for s in range(4) for c in self.ways(0, s, 0)]

    def cheapest(self, start: int, worth: list[int]) -> tuple[str, int, int]:
        """(audit, cost, end) of the cheapest way with what its end costs besides; the ASCII-least of equal ones."""

        def least(at: tuple[int, int, int]) -> int:
            return min(c + w for c, w in zip(self.ways(*at), worth, strict=True))

        at, audit, spent = (start, 0), [], 0
        here = (0, start, 0)
        while here[0] < len(self.signs):
            goal = least(here)
            initial, cost, here = next(e for e in self.edits(*here) if e[1] + least(e[2]) == goal)
            audit.append(initial)
            spent += cost
        return "".join(audit), spent, here[1]


def damage(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, gone: the rows damaged as crc32(`conv_id:turn`) % 20 says; nulls count as one space.

    0: gone is set (the row only says that its conversation is there), 1: empty text, 2: without its .!?, 3: twice, 4: a user's.
    """

    def spaced(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(" "))

    clean = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), spaced(rows["role"]).alias("role"), spaced(rows["text"]).alias("text"))
    clean = clean.withColumn("d", F.crc32(F.concat(spaced(F.col("conv_id")), F.lit(":"), spaced(F.col("turn"))).cast("binary")) % 20)
    text = F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("d") == 4, "user").otherwise(F.col("role"))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("d") == 3, 2).otherwise(1)))
    return clean.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("d") == 0).alias("gone"), twice.alias("copy")).drop("copy")


def flagged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, h, later, sign, gone: h digests role and text; later: an earlier turn has the same; sign: the signature's letter."""
    gone = F.coalesce(rows["gone"].cast("boolean"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    role, text = (F.coalesce(rows[c].cast("string"), F.lit(" ")) for c in ("role", "text"))
    clean = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), role.alias("role"), text.alias("text"), gone.alias("gone"))
    clean = clean.withColumn("h", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    # minima are combined before the shuffle, and the join is one of equal keys, whose large partitions AQE splits
    firsts = clean.where("not gone").groupBy("conv_id", "h").agg(F.min(place)["turn"].alias("first"))
    same = F.col("l.conv_id").eqNullSafe(F.col("r.conv_id")) & (F.col("l.h") == F.col("r.h"))
    met = clean.alias("l").join(firsts.alias("r"), same, "left")
    stripped = F.rtrim("text", F.lit(_SPACE))
    initial = F.substring("role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    sign = F.when(stripped == "", "x").when(F.substring(stripped, -1, 1).isin(".", "!", "?"), initial).otherwise(F.upper(initial))
    return met.select("l.conv_id", "turn", "role", "text", "l.h", (~F.col("turn").eqNullSafe(F.col("first"))).alias("later"), sign.alias("sign"), "gone")


SEGMENTS = "conv_id long, seg long, signature string, roles array<string>, texts array<string>, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, from_turn long, to_turn long, turns long"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 5]


def _batch(rows: list, ddl: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in ddl.split(", ")])


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


class _Segment:
    """What the turns of one segment, as they pass, leave."""

    def __init__(self, conv: int | None, seg: int):
        self.conv, self.seg = conv, seg
        self.signs: list[str] = []
        self.roles: list[str | None] = []
        self.texts: list[str | None] = []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = self.chars = 0
        self.first = self.last = None
        self.low = self.high = self.begin = self.end = None

    def add(self, turn: int | None, role: str, text: str, sign: str, again: bool) -> None:
        initial = role[:1]
        if self.first is None:
            self.first = initial
        else:
            self.illegal += not _legal(self.last, initial)
        self.last = initial
        if turn is not None:
            self.low, self.high = (turn, turn) if self.low is None else (min(self.low, turn), max(self.high, turn))
            self.turns += turn != self.end
            self.begin, self.end = (turn if self.begin is None else self.begin), turn
        self.blank += sign == "x"
        self.duplicate += again and sign != "x"
        self.truncated += sign.isupper() and not again
        gone = again or sign == "x"
        self.signs.append("x" if gone else sign)
        # the text of a turn that must go is never read again
        self.roles.append(None if gone else role)
        self.texts.append(None if gone else text)
        self.chars += 0 if gone else len(text)

    def row(self) -> tuple:
        return self.conv, self.seg, "".join(self.signs), self.roles, self.texts, self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last, self.low, self.high, self.begin, self.end, self.turns


def _segments(rows: DataFrame, size: int) -> DataFrame:
    """Segments in the order of their numbers. rows: as flagged() gives them."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        here, before, done, chars = None, None, [], 0
        for batch in batches:
            for conv, turn, role, text, h, later, sign, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here is None or here.conv != conv or len(here.signs) >= size or here.chars >= SEGMENT_CHARS:
                    if here is not None:
                        done.append(here.row())
                        chars += here.chars
                    if chars >= SEGMENT_CHARS or len(done) >= 1024:
                        yield _batch(done, SEGMENTS, _KINDS)
                        done, chars = [], 0
                    here, number = _Segment(conv, number), number + 1
                if not gone:
                    here.add(turn, role, text, sign, later or before == (conv, turn, h))
                    before = conv, turn, h
        if here is not None:
            yield _batch([*done, here.row()], SEGMENTS, _KINDS)

    by = ["conv_id", "turn", "h"]
    dealt = rows.repartitionByRange(shuffle_partitions(rows.sparkSession), *by).sortWithinPartitions(*by)
    return dealt.select("conv_id", "turn", "role", "text", "h", "later", "sign", "gone").mapInArrow(each, SEGMENTS)


def _costs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([Signature(s).costs() for s in batch.column(0).to_pylist()], pa.list_(pa.int64()))], ["signature", "costs"])


def _worths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From the last segment of each conversation to the first: what each end state costs from there on, less the least of the four."""
    here, worth = (), []
    for batch in batches:
        out = []
        for conv, seg, costs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if here != (conv,):
                here, worth = (conv,), [int(x) for x in _FINAL.split(",")]
            out.append((seg, ",".join(map(str, worth))))
            worth = [min(c + w for c, w in zip(costs[4 * s : 4 * s + 4], worth, strict=True)) for s in range(4)]
            worth = [w - min(worth) for w in worth]
        yield _batch(out, "seg long, worth string", [pa.int64(), pa.string()])


SOLVED = "signature string, worth string, audits array<string>, spent array<long>, ends array<int>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for signs, worth in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            s, ends = Signature(signs), [int(x) for x in worth.split(",")]
            out.append((signs, worth, *zip(*(s.cheapest(start, ends) for start in range(4)), strict=True)))
        yield _batch(out, SOLVED, [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32())])


REPAIRED = "conv_id long, place long, edit string, role string, text string"
AUDITED = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Replay:
    """One conversation, its segments in order."""

    def __init__(self, conv: int | None):
        self.conv, self.state, self.cost, self.place = conv, 0, 0, 0
        self.audit: list[str] = []
        self.sums = [0, 0, 0, 0]
        self.last = self.low = self.high = self.end = None
        self.turns, self.digest = 0, hashlib.sha256()

    def _made(self, edit: str, role: str, text: str) -> tuple:
        self.digest.update(("\n" * (self.place > 0) + f"{role}:{text}").encode())
        self.place += 1
        return self.conv, self.place - 1, edit, role, text

    def _edit(self, edit: str, role: str | None, text: str) -> tuple:
        if edit == "K":
            self.state = KEEPS[self.state, role[:1]]
        else:
            self.state = MADE[self.state]
            role = ROLES[self.state]
        return self._made(edit, role, text)

    def segment(self, roles: list, texts: list, counts: tuple, ends: tuple, turns: tuple, audits: list, spent: list) -> Iterator[tuple]:
        """The repaired turns of the next segment."""
        first, last = ends
        self.sums = [a + b for a, b in zip(self.sums, counts, strict=True)]
        if first is not None:
            self.sums[3] += self.last is not None and not _legal(self.last, first)
            self.last = last
        low, high, begin, end, n = turns
        if low is not None:
            self.low, self.high = (low, high) if self.low is None else (min(self.low, low), max(self.high, high))
            self.turns += n - (begin == self.end)
            self.end = end
        audit, i = audits[self.state], 0
        self.cost += spent[self.state]
        self.audit.append(audit)
        for edit in audit:
            if edit != "D":
                yield self._edit(edit, None if edit == "I" else roles[i], "" if edit == "I" else texts[i])
            i += edit != "I"

    def close(self) -> Iterator[tuple]:
        """The turns that end the conversation, made anew."""
        n = LAST[self.state]
        self.cost += n * INSERT
        self.audit.append("I" * n)
        for _ in range(n):
            yield self._edit("I", None, "")

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.sums, self.cost, "".join(self.audit), self.digest.hexdigest()


def _replay(summary: bool):  # noqa: ANN202
    ddl = AUDITED if summary else REPAIRED
    kinds = [*[pa.int64()] * 7, pa.string(), pa.string()] if summary else [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, out, chars = None, [], 0
        for batch in batches:
            for conv, _, roles, texts, *counts, first, last, low, high, begin, end, n, audits, spent in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here is None or here.conv != conv:
                    if here is not None:
                        rest = list(here.close())
                        out += [here.row()] if summary else rest
                    here = _Replay(conv)
                for made in here.segment(roles, texts, tuple(counts), (first, last), (low, high, begin, end, n), audits, spent):
                    if not summary:
                        out.append(made)
                        chars += len(made[4])
                if chars >= SEGMENT_CHARS or len(out) >= 4096:
                    yield _batch(out, ddl, kinds)
                    out, chars = [], 0
        if here is not None:
            rest = list(here.close())
            yield _batch([*out, here.row()] if summary else [*out, *rest], ddl, kinds)

    return each, ddl


def repair(rows: DataFrame, summary: bool = False, size: int = SEGMENT) -> DataFrame:
    """The repaired turns (conv_id, place from 0, edit, role, text), or, with summary, one row for each conversation: AUDITED.

    rows: conv_id, turn, role, text; where there is a column gone, rows in which it is true only say that their conversation is there.
    Rows are taken by turn, null first, then by a digest of role and text; rows that repeat each other wholly are adjacent, all but the first duplicates. A null role or
    text counts as one space, a null conversation as one. A conversation without turns has zeros, an empty audit and the digest of nothing.
    Texts of any length pass whole; an empty table gives no rows; columns of other names stay behind. size: turns in a segment.
    """
    spark = rows.sparkSession
    clean, clean_path = stage(flagged(rows), "turns")
    segments, _ = stage(_segments(clean, size), "turn-segments", clean_path)
    parts = segments.select("seg", "conv_id", "signature")
    many = parts.groupBy("conv_id").count().where("count > 1").select(F.col("conv_id").alias("c"))
    chained = parts.join(many, F.col("conv_id").eqNullSafe(F.col("c")), "left_semi")
    costs = chained.select("signature").distinct().mapInArrow(_costs, "signature string, costs array<long>")
    ordered = chained.join(costs, "signature").select("conv_id", "seg", "costs").repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions(F.col("conv_id"), F.col("seg").desc())
    worths = ordered.mapInArrow(_worths, "seg long, worth string")
    keyed, keyed_path = stage(parts.join(worths, "seg", "left").select("seg", "signature", F.coalesce("worth", F.lit(_FINAL)).alias("worth")), "turn-signatures")
    solved = keyed.select("signature", "worth").distinct().mapInArrow(_solve, SOLVED)
    audits, _ = stage(keyed.join(solved, ["signature", "worth"]).select("seg", "audits", "spent"), "turn-audits", keyed_path)
    dealt = segments.drop("signature").join(audits, "seg").repartition(shuffle_partitions(spark), "conv_id").sortWithinPartitions("conv_id", "seg")
    names = [x.split()[0] for x in SEGMENTS.split(", ") if not x.startswith("signature")]
    each, ddl = _replay(summary)
    return dealt.select(*names, "audits", "spent").mapInArrow(each, ddl)
