"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

The vocabulary is one of merges: the library joins neighbouring pieces, best score first, until none can be joined. A sequence of pieces
is its result exactly if each piece and the next would be left as they are when they stood alone, and for each prefix of a word
one last piece is so. So the search goes over the places of a word: the substrings that end there are hashed and looked up among the
pieces' sorted hashes, those that fit the last piece before them stay, and their maximum is the place's backpointer. Words
of equal length advance together, and each distinct word is searched once.

Words begin with the space mark, which no piece has behind another character. Runs of bare space marks are joined last, from the left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from pulsegrid.llm.chunk_tokens import gather
from pulsegrid.llm.common import texts

MARK = "▁"
_PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of text encoded at a time, distinct words remembered, characters searched at a time, and the length beyond which a word is
#: first cut where no piece reaches over.
SLICE_BYTES, REMEMBERED, CELLS, LONG = 4 << 20, 300_000, 1 << 19, 32
_NONE = np.int64(-1)


def _codes(words: list[str]) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le"), "<u4")


def _hashes(codes: np.ndarray) -> np.ndarray:
    """Prefix hashes of rows of code points, a column more than these."""
    h = np.zeros((len(codes), codes.shape[1] + 1), np.uint64)
    for i in range(codes.shape[1]):
        h[:, i + 1] = h[:, i] * _PRIME + codes[:, i] + np.uint64(1)
    return h


def _merge(chars: list[str], order: dict[str, int]) -> list[str]:
    """The library's merges over a few characters, for the pieces themselves."""
    while len(chars) > 1:
        at = min(range(len(chars) - 1), key=lambda i: (order.get(chars[i] + chars[i + 1], 1 << 30), i))
        if chars[at] + chars[at + 1] not in order:
            break
        chars[at : at + 2] = [chars[at] + chars[at + 1]]
    return chars


class Vocabulary:
    """What the search needs of a model: pieces by order (single characters, then merges by falling score), their hashes, halves and ids."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(model.vocab_size())
        plain = {model.id_to_piece(i): i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
        self.byte_ids = np.zeros(256, np.int64)
        for i in ids:
            if model.is_byte(i):
                self.byte_ids[int(model.id_to_piece(i)[3:-1], 16)] = i
        self.bytes_of = [bytes([int(model.id_to_piece(i)[3:-1], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(MARK, " ").encode() if model.id_to_piece(i) in plain else b"" for i in ids]
        runs = {len(p): i for p, i in plain.items() if len(p) > 1 and not p.strip(MARK)}
        self.runs = runs | {1: plain[MARK]}
        pieces = [p for p in plain if len(p) == 1 or p.strip(MARK)]
        if any(MARK in p[1:] for p in pieces):
            raise ValueError("a piece has the space mark inside")
        single = [p for p in pieces if len(p) == 1]
        merged = sorted((p for p in pieces if len(p) > 1), key=lambda p: -model.get_score(plain[p]))
        if len({model.get_score(plain[p]) for p in merged}) < len(merged):
            raise ValueError("merges of one score have no order")
        order = {p: i for i, p in enumerate(single + merged)}
        n = len(order)
        self.ids = np.array([plain[p] for p in order], np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        reached = np.ones(n, bool)
        only = {p: i for p, i in order.items() if i >= len(single)}
        for p, i in only.items():
            if not set(p) <= order.keys():
                reached[i] = False
                continue
            below = {q: k for q, k in ((p[a:b], only.get(p[a:b])) for a in range(len(p)) for b in range(a + 2, len(p) + 1)) if k is not None and k < i}
            halves = _merge(list(p), below)
            reached[i] = len(halves) == 2
            if reached[i]:
                self.left[i], self.right[i] = order[halves[0]], order[halves[1]]
        made = np.flatnonzero(reached & (np.arange(n) >= len(single)))
        pair = self.left[made].astype(np.int64) << 20 | self.right[made]
        sort = np.argsort(pair)
        self.pairs, self.made = pair[sort], made[sort]
        self.unknown = n
        self.by_length: list[tuple[np.ndarray, np.ndarray]] = []
        of: dict[int, list[str]] = {}
        for p, i in order.items():
            if reached[i]:
                of.setdefault(len(p), []).append(p)
        for k in range(1, max(of) + 1):
            words = of.get(k, [])
            h = _hashes(_codes(words).reshape(-1, k))[:, k] if words else np.zeros(0, np.uint64)
            if len(np.unique(h)) < len(h):
                raise ValueError("two pieces have one hash")
            sort = np.argsort(h)
            self.by_length.append((h[sort], np.array([order[p] for p in words], np.int64)[sort]))
        inner = [np.frombuffer(p.encode("utf-32-le"), "<u4").astype(np.int64) for p in order if len(p) > 1]
        self.joined = np.unique(np.concatenate([c[:-1] << 32 | c[1:] for c in inner]))


class PieceCoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.powers = np.full(len(self.v.by_length) + 1, _PRIME, np.uint64)
        self.powers[0] = 1
        self.powers = np.cumprod(self.powers, dtype=np.uint64)
        sizes = np.array([len(b) for b in self.v.bytes_of], np.int64)
        self.text_start, self.text_size = np.cumsum(sizes) - sizes, sizes
        self.text_bytes = np.frombuffer(b"".join(self.v.bytes_of), np.uint8)
        self.run_ids: dict[int, list[int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat, self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where pieces a and b, standing alone, stay apart: taking both back to the characters they meet in, no merge over the border comes
        before those that made them."""
        v = self.v
        good = np.ones(len(a), bool)
        at = np.flatnonzero((a < v.unknown) & (b < v.unknown))
        a, b = a[at], b[at]
        limit = np.full(len(at), 1 << 40)
        while len(at):
            key = a << 20 | b
            place = np.minimum(np.searchsorted(v.pairs, key), len(v.pairs) - 1)
            bad = (v.pairs[place] == key) & (v.made[place] < limit)
            good[at[bad]] = False
            # the later of the two merges is taken back; of equal ones the right one, as the left one came first
            first = a > b
            la, lb = v.right[a], v.left[b]
            bare_a, bare_b = la == a, lb == b
            undo_a = first & ~bare_a | bare_b & ~bare_a
            undo_b = ~undo_a & ~bare_b
            limit = np.where(undo_a, a, np.where(undo_b, b + 1, limit))
            a, b = np.where(undo_a, la, a), np.where(undo_b, lb, b)
            on = ~bad & (undo_a | undo_b)
            at, a, b, limit = at[on], a[on], b[on], limit[on]
        return good

    def search(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, how many for each row) for rows of code points, words of one length."""
        v, (n, size) = self.v, codes.shape
        h = _hashes(codes)
        last = np.full((n, size + 1), _NONE)
        back = np.zeros((n, size + 1), np.int32)
        for i in range(1, size + 1):
            best = np.full(n, _NONE)
            for k in range(1, min(len(v.by_length), i) + 1):
                keys, order = v.by_length[k - 1]
                if not len(keys):
                    continue
                key = h[:, i] - h[:, i - k] * self.powers[k]
                place = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                rows = np.flatnonzero((keys[place] == key) & ((last[:, i - k] >= 0) | (i == k)))
                piece = order[place[rows]]
                if k == 1:
                    alone = np.ones(n, bool)
                    alone[np.flatnonzero(keys[place] == key)] = False
                    best[alone] = 1 << 32 | v.unknown
                if i > k:
                    fit = self.fits(last[rows, i - k], piece)
                    rows, piece = rows[fit], piece[fit]
                best[rows] = np.maximum(best[rows], np.int64(k) << 32 | piece)
            last[:, i] = np.where(best < 0, _NONE, best & 0xFFFFFFFF)
            back[:, i] = best >> 32
        # from the ends back; what a row has no more of stays -1
        place, rows, out = np.full(n, size), np.arange(n), []
        while (place > 0).any():
            piece = last[rows, place]
            char = codes[rows, np.maximum(place, 1) - 1].astype(np.int64)
            token = np.where(piece == v.unknown, -2 - char, v.ids[np.minimum(np.maximum(piece, 0), v.unknown - 1)])
            out.append(np.where(place > 0, token, -1))
            place = place - np.where(place > 0, back[rows, place], 0)
        tokens = np.stack(out[::-1], axis=1) if out else np.zeros((n, 0), np.int64)
        used = tokens != -1
        return self._spell(tokens[used], used.sum(axis=1))

    def _spell(self, tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Characters that aren't pieces as their bytes."""
        odd = np.flatnonzero(tokens < -1)
        if not len(odd):
            return tokens, counts
        chars, which = np.unique(-2 - tokens[odd], return_inverse=True)
        spelled = [self.v.byte_ids[list(chr(c).encode())] for c in chars.tolist()]
        reps = np.ones(len(tokens), np.int64)
        reps[odd] = np.array([len(s) for s in spelled])[which]
        out, start = np.repeat(tokens, reps), np.cumsum(reps) - reps
        for k, s in enumerate(spelled):
            for j, i in enumerate(s):
                out[start[odd[which == k]] + j] = i
        row = np.repeat(np.arange(len(counts)), counts)
        return out, np.bincount(row, reps, len(counts)).astype(np.int64)

    def _cut(self, word: str) -> list[str]:
        """A long word in parts between which no piece reaches."""
        c = _codes([word]).astype(np.int64)
        pair = c[:-1] << 32 | c[1:]
        place = np.minimum(np.searchsorted(self.v.joined, pair), len(self.v.joined) - 1)
        bounds = [0, *(np.flatnonzero(self.v.joined[place] != pair) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, how many for each word)."""
        parts, of = [], []
        for k, w in enumerate(words):
            own = self._cut(w) if len(w) > LONG else [w]
            parts += own
            of += [k] * len(own)
        sizes = np.array([len(p) for p in parts], np.int64)
        order = np.argsort(sizes, kind="stable")
        flat, counts = [], np.zeros(len(parts), np.int64)
        at = 0
        while at < len(order):
            size = int(sizes[order[at]])
            to = min(int(np.searchsorted(sizes[order], size, side="right")), at + max(1, CELLS // max(size, 1)))
            own = order[at:to]
            if size:
                ids, counts[own] = self.search(_codes([parts[k] for k in own.tolist()]).reshape(len(own), size))
                flat.append(ids)
            at = to
        start = np.zeros(len(parts), np.int64)
        start[order] = np.cumsum(counts[order]) - counts[order]
        return gather(start, counts, np.concatenate(flat or [np.zeros(0, np.int64)])), np.bincount(of, counts, len(words)).astype(np.int64)

    def run(self, n: int) -> list[int]:
        """The ids of n bare space marks."""
        if n not in self.run_ids:
            known, left, done = self.v.runs, n, []
            while left:
                done.append(1)
                left -= 1
                while True:  # the leftmost that can be joined: what stands before, else the next mark
                    if len(done) > 1 and done[-2] + done[-1] in known:
                        more = done.pop()
                        done[-1] += more
                    elif left and done[-1] + 1 in known:
                        done[-1] += 1
                        left -= 1
                    else:
                        break
            self.run_ids[n] = [known[k] for k in done]
        return self.run_ids[n]

    def _join_runs(self, flat: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bare = flat == self.v.runs[1]
        begins = np.zeros(len(flat) + 1, bool)
        ends = np.cumsum(counts)
        begins[ends - counts] = True
        starts = np.flatnonzero(bare & (begins[:-1] | ~np.concatenate([[False], bare[:-1]])))
        if not len(starts):
            return flat, counts
        stops = np.flatnonzero(bare & (begins[1:] | np.concatenate([~bare[1:], [True]]))) + 1
        sizes = stops - starts
        keep = np.ones(len(flat), bool)
        for n in np.unique(sizes[sizes > 1]).tolist():
            own, ids = starts[sizes == n], self.run(n)
            for j in range(n):
                if j < len(ids):
                    flat[own + j] = ids[j]
                else:
                    keep[own + j] = False
        upto = np.concatenate([[0], np.cumsum(keep)])
        return flat[keep], upto[ends] - upto[ends - counts]

    def _look_up(self, distinct: pa.Array) -> np.ndarray:
        if len(self.known) > REMEMBERED:
            self._forget()
        found = pc.index_in(distinct, value_set=self.known)
        fresh = distinct.filter(pc.is_null(found))
        place = pc.fill_null(found, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        if len(fresh):
            flat, count = self.words([MARK + w for w in fresh.to_pylist()])
            place[place < 0] = len(self.known) + np.arange(len(fresh))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.length = np.concatenate([self.length, count])
            self.flat = np.concatenate([self.flat, flat])
            self.known = pa.concat_arrays([self.known, fresh])
        return place

    def encode(self, texts_: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, flat ids, ids of each text) for one run of rows after another; null counts as empty, which has no ids."""
        rows = pc.fill_null(texts_.cast(pa.large_string()), "")
        size = np.cumsum(np.asarray(pc.binary_length(rows), np.int64))
        at = 0
        while at < len(rows):
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + SLICE_BYTES, side="right")))
            part = pc.replace_substring(rows.slice(at, to - at), MARK, " ")
            pieces = pc.split_pattern(part, " ")
            ends = np.asarray(pieces.offsets, np.int64)
            ends = ends - ends[0]
            coded = pieces.flatten().cast(pa.large_string()).dictionary_encode()
            place = self._look_up(coded.dictionary)[np.asarray(coded.indices)]
            length = self.length[place]
            length[ends[:-1][np.asarray(pc.equal(part, ""))]] = 0
            upto = np.concatenate([[0], np.cumsum(length)])[ends]
            flat, counts = self._join_runs(gather(self.start[place], length, self.flat), np.diff(upto))
            yield at, flat.astype(np.uint32), counts
            at = to

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        """The texts of flat ids; bytes that aren't UTF-8 become U+FFFD, and the space before a text's first word goes."""
        size = self.text_size[ids]
        data = gather(self.text_start[ids], size, self.text_bytes).tobytes()
        upto = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(counts)])].tolist()
        return [data[a:b].removeprefix(b" ").decode("utf-8", "replace") for a, b in zip(upto, upto[1:], strict=False)]


_CODERS: dict[str, PieceCoder] = {}


def coder(path: str) -> PieceCoder:
    """One coder for each worker process, so that words stay known from one task to the next."""
    if path not in _CODERS:
        _CODERS[path] = PieceCoder(Vocabulary(path))
    return _CODERS[path]


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, text, ids (little-endian unsigned 32-bit integers) for each row, nothing shuffled. docs: doc_id, text; null counts as empty."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        for batch in batches:
            for at, flat, counts in code.encode(batch.column(1)):
                data, ends = flat.astype("<u4").tobytes(), np.concatenate([[0], np.cumsum(counts)]) * 4
                ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), batch.column(1).slice(at, len(counts)), ids], ["doc_id", "text", "ids"])

    return texts(docs).mapInArrow(each, "doc_id long, text string, ids binary")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """encoded (doc_id, text, ids) with decoded, the text of its ids, and n_byte_tokens."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        spelled = np.zeros(len(code.text_size), bool)
        spelled[code.v.byte_ids] = True
        for batch in batches:
            data = [x.as_buffer() if x.is_valid else b"" for x in batch.column(2)]
            counts = np.array([len(d) // 4 for d in data], np.int64)
            ids = np.frombuffer(b"".join(data), "<u4").astype(np.int64)
            odd = np.concatenate([[0], np.cumsum(spelled[ids])])[np.concatenate([[0], np.cumsum(counts)])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(code.decode(ids, counts), pa.string()), pa.array(np.diff(odd).astype(np.int64))], ["doc_id", "text", "ids", "decoded", "n_byte_tokens"])

    return encoded.select("doc_id", "text", "ids").mapInArrow(each, "doc_id long, text string, ids binary, decoded string, n_byte_tokens long")


RESULT = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_crc32 long, same boolean"


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_crc32, decoded_crc32, same (the text comes back; the space mark in a text comes back as a space).

    Encodes and decodes in one pass, so that texts and ids cross to Python once. A row for each row of docs, in any order.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        spelled = np.zeros(len(code.text_size), bool)
        spelled[code.v.byte_ids] = True
        for batch in batches:
            for at, flat, counts in code.encode(batch.column(1)):
                ids, bounds = flat.astype(np.int64), np.concatenate([[0], np.cumsum(counts)])
                odd = np.diff(np.concatenate([[0], np.cumsum(spelled[ids])])[bounds])
                view, ends = memoryview(np.ascontiguousarray(flat, "<u4")).cast("B"), (bounds * 4).tolist()
                back, source = code.decode(ids, counts), batch.column(1).slice(at, len(counts)).to_pylist()
                columns = [
                    pa.array(counts.astype(np.int64)), pa.array(odd.astype(np.int64)), pa.array([zlib.crc32(view[a:b]) for a, b in zip(ends, ends[1:], strict=False)], pa.int64()),
                    pa.array([zlib.crc32(t.encode()) for t in back], pa.int64()), pa.array([b == t.replace(MARK, " ") for b, t in zip(back, source, strict=True)], pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(counts)), *columns], [x.split()[0] for x in RESULT.split(", ")])

    return texts(docs).mapInArrow(each, RESULT)
