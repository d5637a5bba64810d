r"""Chat formatting that is proved by parsing it again.

Grammar of a formatted conversation, which is its turns without anything between them:

    turn  := "<s>[INST] " role "\n" text "[/INST]</s>"

In role and text no control string ("<s>", "</s>", "[INST]", "[/INST]"; in a role also "\n") stands bare. "\" before a control
string or before another "\" is an escape and goes when parsed; any other "\" is itself. Each turn is rendered bare first and parsed;
if the result isn't the source, control strings are escaped, and if that isn't enough, every "\" as well.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import shuffle_partitions, stage

OPEN, CLOSE, BREAK = "<s>[INST] ", "[/INST]</s>", "\n"
_CONTROL = r"</?s>|\[/?INST\]"
_TEXT = re.compile(rf"\\(\\|{_CONTROL})|{_CONTROL}")
_ROLE = re.compile(rf"\\(\\|\n|{_CONTROL})|\n|{_CONTROL}")
_ESCAPES = (
    (lambda x: x, lambda x: x),
    (lambda x: re.sub(rf"(\n|{_CONTROL})", r"\\\1", x), lambda x: re.sub(rf"({_CONTROL})", r"\\\1", x)),
    (lambda x: re.sub(rf"(\\|\n|{_CONTROL})", r"\\\1", x), lambda x: re.sub(rf"(\\|{_CONTROL})", r"\\\1", x)),
)


class NotInGrammar(ValueError):
    pass


class _Open(NotInGrammar):
    """The text ends before the turn does."""


def _field(s: str, at: int, pattern: re.Pattern, end: str) -> tuple[str, int]:
    """(the field without escapes, the place of the control string that ends it)."""
    parts, begin = [], at
    for m in pattern.finditer(s, at):
        if m[1] is None:
            if not s.startswith(end, m.start()):
                raise (_Open if end.startswith(s[m.start() :]) else NotInGrammar)(f"{m[0]!r} stands bare at {m.start()}")
            parts.append(s[begin : m.start()])
            return "".join(parts), m.start()
        parts.append(s[begin : m.start()])
        parts.append(m[1])
        begin = m.end()
    raise _Open("a field has no end")


def _turn(s: str, at: int) -> tuple[str, str, int, int, int]:
    """(role, text, begin and end of the text with its escapes, end) of the turn that begins at `at`."""
    if not s.startswith(OPEN, at):
        raise (_Open if OPEN.startswith(s[at:]) else NotInGrammar)(f"no turn begins at {at}")
    role, to = _field(s, at + len(OPEN), _ROLE, BREAK)
    begin = to + len(BREAK)
    text, end = _field(s, begin, _TEXT, CLOSE)
    return role, text, begin, end, end + len(CLOSE)


def parse(s: str, at: int = 0) -> Iterator[tuple[str, str, int, int]]:
    """(role, text, begin, end) for each turn; s[begin:end] is the text with its escapes."""
    while at < len(s):
        role, text, begin, end, at = _turn(s, at)
        yield role, text, begin, end


class Reader:
    """Parses one formatted conversation that comes in parts of any lengths; the grammar alone finds where a turn ends.

    Of the text only what no turn has ended is held.
    """

    def __init__(self) -> None:
        self.held: list[str] = []
        self.tail, self.at = "", 0

    def feed(self, part: str) -> Iterator[tuple[str, str, int, int]]:
        """(role, text, begin, end) for each turn that ends in this part; begin and end are code points of the whole conversation."""
        if not part:
            return
        self.held.append(part)
        seen = self.tail + part
        self.tail = seen[1 - len(CLOSE) :]
        if CLOSE not in seen:  # no turn can end here
            return
        s, done = "".join(self.held), 0
        while done < len(s):
            try:
                role, text, begin, end, to = _turn(s, done)
            except _Open:
                break
            yield role, text, self.at + begin, self.at + end
            done = to
        self.held, self.at = [s[done:]] * (done < len(s)), self.at + done

    def close(self) -> None:
        if self.held:
            raise NotInGrammar("the conversation ends within a turn")


def render(role: str, text: str) -> tuple[str, int, int]:
    """(turn, begin and end of the text in it)."""
    for of_role, of_text in _ESCAPES:
        head = OPEN + of_role(role) + BREAK
        body = of_text(text)
        turn = head + body + CLOSE
        try:
            if [x[:2] for x in parse(turn)] == [(role, text)]:
                return turn, len(head), len(head) + len(body)
        except NotInGrammar:
            pass
    raise AssertionError("escapes don't make a turn parse")  # can't be: the last escapes leave nothing bare


FORMATTED = "conv_id long, turn long, formatted string, mask_begin long, mask_end long"


def write_formatted(rows: DataFrame) -> tuple[DataFrame, str]:
    """Formats each turn of conversations (conv_id, turn, role, text; other columns stay behind) and writes them to the shared folder.

    A conversation's text is its turns' `formatted` one after another, by turn, then formatted text; mask_begin and mask_end
    (code points in the turn) are what training takes a loss from: an assistant's text, else nothing (0, 0).
    Null roles and texts count as empty, null conversations are one, null turns come first.
    """
    clean = rows.select(rows["conv_id"].cast("long").alias("conv_id"), rows["turn"].cast("long").alias("turn"), F.coalesce(rows["role"], F.lit("")).alias("role"), F.coalesce(rows["text"], F.lit("")).alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                turn, begin, end = render(role, text)
                made.append((turn, begin, end) if role == "assistant" else (turn, 0, 0))
            out = [pa.array([m[i] for m in made], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *out], [x.split()[0] for x in FORMATTED.split(", ")])

    return stage(clean.mapInArrow(each, FORMATTED), "formatted")


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_formatted(formatted: DataFrame) -> DataFrame:
    """Parses each conversation's joined text and digests what it finds; a row for each.

    Turns and the loss mask, an assistant's text, are what the parser finds in the joined text, not what the rows say; a stored mask
    that differs from it is a NotInGrammar error. Parts pass one by one, so no conversation need fit in memory.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: list = []
        reader, masks, parsed = Reader(), 0, 0
        for batch in batches:
            done = []
            for conv, _, s, begin, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not here or here[0] != conv:
                    if here:
                        reader.close()
                        done.append(here)
                    here, reader = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0], Reader()
                    masks = parsed = 0
                # sums over places say whether the stored masks and those found are the same
                if end > begin:
                    masks += (here[5] + begin) * 1_000_003 + here[5] + end
                here[5] += len(s)
                for role, text, a, b in reader.feed(s):
                    here[1] += 1
                    here[2].update(f"{role}\n{text}\n".encode())
                    if role == "assistant":
                        here[3] += len(text)
                        here[4].update(text.encode())
                        parsed += (a * 1_000_003 + b) * (b > a)
                if not reader.held and masks != parsed:
                    raise NotInGrammar(f"the loss mask of conversation {conv} isn't that of its text")
            yield table_of(done)
        if here:
            reader.close()
            yield table_of([here])

    def table_of(done: list) -> pa.RecordBatch:
        rows = [(c, n, t.hexdigest(), k, h.hexdigest(), f) for c, n, t, k, h, f in done]
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in READ.split(", ")])

    dealt = formatted.repartition(shuffle_partitions(formatted.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.mapInArrow(each, READ)
