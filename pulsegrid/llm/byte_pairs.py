"""Byte-level BPE encoding by longest matches and backtracking, and decoding.

The bytes of a piece are read as Latin-1, so that one automaton over the vocabulary finds the longest token at each place. Tokens are laid
one after another, the longest first, where neighbours keep apart: where the merges, run over both, would not join any part of one with
a part of the other. Where no token fits, the place is dead and the token before it gives way to its next shorter prefix. A place is dead
once at most and tells nothing of the way there, for a prefix has one encoding alone; so the time is linear, and the ids are those that the
merges themselves make.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from pulsegrid.llm.common import texts

#: Pieces that go through at once, and entries of a worker's memories, which are emptied when full.
RUN, REMEMBERED = 1 << 16, 1 << 20
#: Longest piece that is remembered, in characters.
SHORT = 48
_NEVER = 1 << 62


def _members(kind: str) -> set[str]:
    """The characters of a Unicode class as the tiktoken library knows it; other libraries' tables are of other versions."""
    singles = tiktoken.Encoding("bytes", pat_str=kind, mergeable_ranks={bytes([i]): i for i in range(256)}, special_tokens={})
    return set(bytes(singles.encode_ordinary("".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000))).decode())


def _ranges(chars: set[str]) -> str:
    points = sorted(map(ord, chars))
    starts = [p for i, p in enumerate(points) if not i or p - 1 != points[i - 1]]
    ends = [p for i, p in enumerate(points) if i + 1 == len(points) or p + 1 != points[i + 1]]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts, ends, strict=True))


class Splitter:
    """The matches of a pattern over \\p{L}, \\p{N} and \\s, with letters and numbers as the tiktoken library has them."""

    def __init__(self, pattern: str):
        every = "".join(chr(c) for c in range(0x110000))
        theirs = {kind: _members(kind) for kind in (r"\p{L}", r"\p{N}")}
        odd = set().union(*(members ^ set(regex.findall(kind, every)) for kind, members in theirs.items()))
        own, inside = [], False
        for sign in regex.findall(r"\\p\{\w+\}|\\.|.", pattern):
            inside = (inside or sign == "[") and sign != "]"
            ranges = _ranges(theirs[sign]) if sign in theirs else sign
            own.append(f"[{ranges}]" if sign in theirs and not inside else ranges)
        self.plain, self.own = regex.compile(pattern), regex.compile("".join(own))
        self.odd = np.zeros(0x110000, bool)
        self.odd[[ord(c) for c in odd]] = True

    def runs(self, text: str) -> Iterator[list[str]]:
        """All matches in order, up to RUN at once. The plain pattern serves where no character is classed differently."""
        by = self.own if not text.isascii() and self.odd[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any() else self.plain
        if len(text) <= RUN:
            yield by.findall(text)
            return
        found = by.finditer(text)
        while some := [m[0] for m in islice(found, RUN)]:
            yield some


class _Pieces(dict):
    """The ids of pieces; those of short ones are remembered."""

    def __init__(self, merges: Merges):
        super().__init__()
        self.merges = merges

    def __missing__(self, piece: str) -> list[int]:
        ids = self.merges.laid(piece.encode())
        if len(piece) <= SHORT:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


class Merges:
    """Encodes pieces by the ranks of a vocabulary that holds all single bytes."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.spelling = ranks, {i: b for b, i in ranks.items()}
        self.size = {i: len(b) for b, i in ranks.items()}
        self.words = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.words.add_word(b.decode("latin-1"), (len(b) - 1, i))
        self.words.make_automaton()
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.spines: tuple[dict[int, list], dict[int, list]] = {}, {}
        self.shorter: dict[int, int | None] = {}
        self.together: dict[tuple[int, int], bool] = {}
        self.pieces = _Pieces(self)
        self.decimals = {i: str(i) for i in self.spelling}

    def parts_of(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of a token's own bytes joins; None for a byte, or where merges don't lead to the token."""
        if token not in self.halves:
            parts = [self.spelling[token][i : i + 1] for i in range(len(self.spelling[token]))]
            while len(parts) > 2:
                rank, i = min((self.ranks.get(a + b, _NEVER), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
                if rank == _NEVER:
                    break
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
            self.halves[token] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self.halves[token]

    def spine(self, token: int, side: int) -> list[tuple[bytes, int]]:
        """What stands at the left (0) or right (1) end of a token while its merges run, each with the rank that ends it."""
        if token not in self.spines[side]:
            out, until, at = [], _NEVER, token
            while True:
                out.append((self.spelling[at], until))
                halves = self.parts_of(at)
                if not halves:
                    break
                until, at = at, halves[side]
            self.spines[side][token] = out
        return self.spines[side][token]

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbours stay two: no merge across comes before the one that ends what it needs; of equal ones the left comes first."""
        pair = left, right
        if pair not in self.together:
            if len(self.together) >= REMEMBERED:
                self.together.clear()
            across = ((self.ranks.get(a + b, _NEVER), x, y) for a, x in self.spine(left, 1) for b, y in self.spine(right, 0))
            self.together[pair] = not any(rank < x and rank <= y and rank != _NEVER for rank, x, y in across)
        return self.together[pair]

    def prefix(self, token: int) -> int | None:
        """The longest token that a token begins with, besides itself."""
        if token not in self.shorter:
            b = self.spelling[token]
            self.shorter[token] = next((self.ranks[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ranks), None)
        return self.shorter[token]

    def laid(self, b: bytes) -> list[int]:
        if b in self.ranks:
            return [self.ranks[b]]
        longest = [0] * len(b)
        for end, (back, token) in self.words.iter(b.decode("latin-1")):
            longest[end - back] = token  # ends ascend, so the longest comes last
        size, together, last = self.size, self.together, len(b)
        dead = bytearray(last + 1)
        out = [longest[0]]
        at = size[longest[0]]
        token = longest[at]
        while at < last:
            end = at + size[token]
            if not dead[end]:
                fits = together.get((out[-1], token)) if out else True
                if fits or (fits is None and self.apart(out[-1], token)):
                    out.append(token)
                    at = end
                    if at < last:
                        token = longest[at]
                    continue
            while (less := self.prefix(token)) is None:
                dead[at] = 1
                token = out.pop()
                at -= size[token]
            token = less
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.spelling.__getitem__, ids))


_CODERS: dict[tuple[str, str], tuple[Merges, Splitter]] = {}


def coder(path: str, pattern: str) -> tuple[Merges, Splitter]:
    """One for each worker, from a file of base64 spellings and ranks."""
    if (path, pattern) not in _CODERS:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(b): int(i) for b, i in (line.split() for line in f if line.strip())}
        _CODERS[path, pattern] = Merges(ranks), Splitter(pattern)
    return _CODERS[path, pattern]


def _ids(text: str, merges: Merges, splitter: Splitter) -> Iterator[list[int]]:
    """The ids of a text, a run of pieces at once."""
    for run in splitter.runs(text):
        yield list(chain.from_iterable(map(merges.pieces.__getitem__, run)))


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int) for each row of docs (doc_id, text); null counts as empty, an empty text has no ids. Nothing is shuffled."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                ids = [x for run in _ids(batch.column(1)[i].as_py(), *code) for x in run]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([ids], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return texts(docs).mapInArrow(each, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """encoded (doc_id, ids) with decoded, the bytes of the ids; null ids count as none."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, _ = coder(path, pattern)
        for batch in batches:
            decoded = [merges.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return encoded.select(encoded["doc_id"].cast("long").alias("doc_id"), encoded["ids"].cast("array<int>").alias("ids")).mapInArrow(each, "doc_id long, ids array<int>, decoded binary")


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the bytes of the ids) for each row, in any order.

    Null and empty texts have no ids and the digests of nothing; repeated rows each give a row, as do rows without an id; an empty table gives none.
    A text of any length goes through in runs of pieces, so only its ids of a run are held; columns of other names stay behind.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges, splitter = coder(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for i in range(batch.num_rows):
                n, ids_hash, bytes_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in _ids(batch.column(1)[i].as_py(), merges, splitter):
                    ids_hash.update(("," * (n > 0 and len(ids) > 0) + ",".join(map(merges.decimals.__getitem__, ids))).encode())
                    bytes_hash.update(merges.decode(ids))
                    n += len(ids)
                counts.append(n)
                of_ids.append(ids_hash.hexdigest())
                of_bytes.append(bytes_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_bytes, pa.string())], [x.split()[0] for x in RESULT.split(", ")])

    return texts(docs).mapInArrow(each, RESULT)
