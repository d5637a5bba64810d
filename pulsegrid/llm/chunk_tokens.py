"""Whole-text encoding with the tokenizers library, at the price of the distinct words only.

Both public vocabularies used here cut a text into words before any merge, and a single space between two characters
that aren't white space is always such a cut. So a text is split there, each distinct chunk of a batch is encoded once by
the library, and the ids of the texts are gathered from those of the chunks. Texts in which a space stands beside
other white space are encoded in one piece, so the ids are the library's own in every case.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time, and the distinct chunks remembered from one time to the next.
SLICE_BYTES, REMEMBERED = 6 << 20, 1_000_000
_PLAIN = r"^ \p{L}+$"
_ENDS = r"^(?P<a> ?\p{L}+)(?P<b>[.,!?;:$%&*#|]+)$"
_LINES = r"^(?P<a>[^\n]*[\p{L}.,!?;:$%&*#|])(?P<c>\n)(?P<d>\p{L}[^\n]*)$"
_ODD_SPACE = r"^ | $| [\s\x0b\x1c-\x1f\x{85}\p{Z}]|[\s\x0b\x1c-\x1f\x{85}\p{Z}] "


def gather(starts: np.ndarray, lengths: np.ndarray, flat: np.ndarray) -> np.ndarray:
    """The concatenation of flat[s:s+n] over all (s, n)."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - (ends - lengths), lengths) + np.arange(total)]


class ChunkEncoder:
    """path: the tokenizer's JSON file. end_id goes behind each text. lower: the vocabulary has no capital letters."""

    def __init__(self, path: str, end_id: int, lower: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.lower = Tokenizer.from_file(path), end_id, lower
        self.tokenizer.encode_special_tokens = True
        # a lone word shows where it ends: its last token has a word end, or else the first token of the next one has the space
        tokens = self.tokenizer.get_vocab()
        self.by_end = len(self._ids(" a")) == 1 and self.tokenizer.id_to_token(self._ids(" a")[0]).endswith("</w>")
        self.edge = np.zeros(max(tokens.values()) + 1, bool)
        self.edge[[i for t, i in tokens.items() if (t.endswith("</w>") if self.by_end else t.startswith("\u0120"))]] = True
        self._forget()

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _forget(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.array([self.end_id], np.uint32)
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _encode_each(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and the number of ids of each chunk. Plain words go through the library some hundred at a time."""
        plain = np.asarray(pc.match_substring_regex(chunks, _PLAIN).to_numpy(zero_copy_only=False), bool)
        words, ids, counts = chunks.filter(pa.array(plain)).to_pylist(), [], []
        for at in range(0, len(words), 256):
            part = words[at : at + 256]
            got = np.array(self._ids("".join(part)), np.uint32)
            edges = np.flatnonzero(self.edge[got])
            if len(edges) != len(part):  # a letter that the vocabulary takes for something else
                each = [self._ids(w) for w in part]
                got, count = np.array([i for x in each for i in x], np.uint32), [len(x) for x in each]
            else:
                count = np.diff(edges, prepend=-1) if self.by_end else np.diff(edges, append=len(got))
            ids.append(got)
            counts.append(count)
        for text in chunks.filter(pa.array(~plain)).to_pylist():
            ids.append(np.array(self._ids(text), np.uint32))
            counts.append([len(ids[-1])])
        count = np.concatenate(counts or [np.zeros(0, np.int64)]).astype(np.int64)
        start, place = np.cumsum(count) - count, np.argsort(np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)]), kind="stable")
        return gather(start[place], count[place], np.concatenate(ids or [np.zeros(0, np.uint32)])), count[place]

    def _encode(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Like _encode_each; words, the marks behind them and a line break are always apart, so each is encoded once."""
        none = pa.scalar("", pa.large_string())

        def split(x: pa.Array, pattern: str) -> list[pa.Array]:
            found = pc.extract_regex(x, pattern)
            first, *rest = (pc.struct_field(found, i) for i in range(found.type.num_fields))
            return [pc.if_else(pc.is_null(found), x, first), *(pc.fill_null(y, none) for y in rest)]

        broken = pc.match_substring(chunks, "\n")
        first, second = chunks, [pa.array([], pa.large_string())] * 2
        at = np.flatnonzero(broken.to_numpy(zero_copy_only=False))
        if len(at):
            head, *second = split(chunks.filter(broken), _LINES)
            first = pc.replace_with_mask(chunks, broken, head)
        pad = np.full(len(chunks), -1)
        pad[at] = np.arange(len(at))
        pad = pa.array(pad, mask=pad < 0)
        second = [pc.fill_null(x.take(pad), none) for x in second]
        parts = [*split(first, _ENDS), second[0], *split(second[1], _ENDS)]
        if self.lower:
            parts[0], parts[3] = pc.ascii_lower(parts[0]), pc.ascii_lower(parts[3])
        if self.by_end:
            parts[3] = pc.if_else(pc.equal(parts[3], none), none, pc.binary_join_element_wise(none, parts[3], pa.scalar(" ", pa.large_string())))
        coded = pa.concat_arrays(parts).dictionary_encode()
        flat, count = self._encode_each(coded.dictionary)
        place = np.asarray(coded.indices).reshape(5, -1).T.ravel()
        start = np.cumsum(count) - count
        return gather(start[place], count[place], flat), count[place].reshape(-1, 5).sum(axis=1)

    def _look_up(self, distinct: pa.Array) -> np.ndarray:
        """Places of the chunks in start and length, encoding those not yet known."""
        if len(self.known) > REMEMBERED:
            self._forget()
        found = pc.index_in(distinct, value_set=self.known)
        fresh = distinct.filter(pc.is_null(found))
        at = found.to_numpy(zero_copy_only=False)
        place = np.where(np.isnan(at), -1, at).astype(np.int64) if at.dtype.kind == "f" else at.astype(np.int64)
        if len(fresh):
            flat, count = self._encode(fresh)
            place[place < 0] = len(self.known) + np.arange(len(fresh))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(count) - count])
            self.length = np.concatenate([self.length, count])
            self.flat = np.concatenate([self.flat, flat])
            self.known = pa.concat_arrays([self.known, fresh])
        return place

    def _slice(self, part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(part, _ODD_SPACE)
        pieces = pc.split_pattern(part, " ")
        if pc.any(odd).as_py():
            whole = pa.LargeListArray.from_arrays(pa.array(np.arange(len(part) + 1), pa.int64()), part)
            pieces = pc.if_else(odd, whole, pieces.cast(whole.type))
        ends = np.asarray(pieces.offsets, np.int64)
        ends = ends - ends[0]
        # a chunk in the middle of a text has its space before it, the first of a text has none
        first = np.zeros(ends[-1], bool)
        first[ends[:-1]] = True
        flat = pieces.flatten().cast(pa.large_string())
        text = pa.large_string()
        flat = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise(pa.scalar("", text), flat, pa.scalar(" ", text)))
        coded = flat.dictionary_encode()
        place = self._look_up(coded.dictionary)[np.asarray(coded.indices)]
        start, length = np.insert(self.start[place], ends[1:], 0), np.insert(self.length[place], ends[1:], 1)
        upto = np.cumsum(length)[ends[1:] + np.arange(len(part))]
        return gather(start, length, self.flat), np.diff(upto, prepend=0)

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, flat ids, ids of each text with its end id) for one run of rows after another; null counts as empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        size = np.cumsum(np.asarray(pc.binary_length(texts), np.int64))
        at = 0
        while at < len(texts):
            before = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, before + SLICE_BYTES, side="right")))
            flat, count = self._slice(texts.slice(at, to - at))
            yield at, flat, count
            at = to


_ENCODERS: dict[tuple, ChunkEncoder] = {}


def encoder(path: str, end_id: int, lower: bool = False) -> ChunkEncoder:
    """One encoder for each worker process, so that words stay known from one task to the next."""
    key = (path, end_id, lower)
    if key not in _ENCODERS:
        _ENCODERS[key] = ChunkEncoder(*key)
    return _ENCODERS[key]
