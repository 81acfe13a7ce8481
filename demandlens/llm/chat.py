"""Chat logs: events of a conversation are folded into its final messages, which are then rendered.

Events are ``conv_id, turn, seq, kind, role, text``. They are partitioned by conversation and sorted by
turn and sequence; a task folds them as a stream and holds one message at a time, so a conversation may
be of any length. Kinds:

* ``message`` starts a message with its whole text,
* ``delta`` adds text to the turn's message and starts one if there is none,
* ``edit`` puts its text in place of the message's text,
* ``regenerate`` empties the message, whose deltas then follow anew,
* ``delete`` removes the message.

A rendered message is ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and texts are broken
by a backslash after their first character, and each backslash is doubled, so that reading back gives
exactly what went in. The text of assistant messages is under the loss mask.

Defined cases: a null text or role is empty; a null kind is a whole message; null conversations form one
of their own; nulls of a sort key come first; equal keys are ordered by role, then text; repeated rows are
repeated messages; ``edit``, ``regenerate`` and ``delete`` without a message do nothing. Empty tables give
empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The template's control strings (fixed values).
BEGIN, OPEN, CLOSE, END = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = re.compile(r"(<)(/?s>)|(\[)(/?INST\])")
_ESCAPED = re.compile(r"\\(\\?)")
_MESSAGE = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>", re.S)
TRAINED = "assistant"

RENDERED = "conv_id long, turn long, formatted string, loss_start long, loss_end long"
READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: f"{m[1] or m[3]}\\{m[2] or m[4]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: Iterable[tuple]) -> Iterator[tuple]:
    """Final ``(conv_id, turn, role, text)`` of sorted ``(conv_id, turn, kind, role, text)`` events."""
    place, message = None, None
    for conv, turn, kind, role, text in events:
        if (conv, turn) != place or kind == "message":
            if message:
                yield (*place, message[0], "".join(message[1]))
            place, message = (conv, turn), None
        if kind == "message" or kind == "delta" and message is None:
            message = [role, [text]]
        elif message is None:
            continue
        elif kind == "delta":
            message[1].append(text)
        elif kind == "edit":
            message[1] = [text]
        elif kind == "regenerate":
            message[1] = []
        elif kind == "delete":
            message = None
        else:
            raise ValueError(f"unknown kind of event: {kind}")
    if message:
        yield (*place, message[0], "".join(message[1]))


def render(role: str, text: str) -> tuple[str, int, int]:
    """The formatted message, and where its part under the loss mask starts and ends."""
    head, body = f"{BEGIN}{OPEN}{escape(role)}{CLOSE}", escape(text)
    start = len(head)
    return f"{head}{body}{END}", start, start + len(body) * (role == TRAINED)


def _in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    held, chars = [], 0
    for row in rows:
        held.append(row)
        chars += 100 + sum(len(v) for v in row if isinstance(v, str))
        if chars >= size:
            yield _batch(held, schema)
            held, chars = [], 0
    yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from zip(*(c.to_pylist() for c in batch.slice(at, 512).columns))


def format_events(events: DataFrame) -> DataFrame:
    """One row for each final message, in order of turns within each conversation's partition."""
    empty = F.lit("")
    kept = events.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
        "seq",
    )
    kept = kept.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "seq", "role", "text")
    schema = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _in_batches(((c, t, *render(role, text)) for c, t, role, text in fold(_rows(batches))), schema)

    return kept.select("conv_id", "turn", "kind", "role", "text").mapInArrow(run, RENDERED)


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of each conversation, taken from what ``format_events`` wrote, in one pass and without a shuffle.

    ``formatted`` must be as ``format_events`` leaves it: whole conversations in a partition, in order.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def digests(rows: Iterable[tuple]) -> Iterator[tuple]:
        conv, state = None, None
        for key, _, formatted, start, end in rows:
            if state is None or key != conv:
                if state:
                    yield state.result(conv)
                conv, state = key, _Digest()
            state.add(formatted, start, end)
        if state:
            yield state.result(conv)

    return formatted.mapInArrow(lambda batches: _in_batches(digests(_rows(batches)), schema), READ_BACK)


class _Digest:
    def __init__(self) -> None:
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, formatted: str, start: int, end: int) -> None:
        found = _MESSAGE.fullmatch(formatted)
        if not found:
            raise ValueError("a formatted message can't be read back")
        for part in (found[1], found[2]):
            self.turns.update(f"{unescape(part)}\n".encode())
        masked = unescape(formatted[start:end])
        self.loss.update(masked.encode())
        self.n += 1
        self.loss_chars += len(masked)
        self.chars += len(formatted)

    def result(self, conv: int | None) -> tuple:
        return conv, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of whole messages (``conv_id, turn, role, text``) as a log."""
    return conversations.select(
        "conv_id", "turn", F.lit(0).cast("long").alias("seq"), F.lit("message").alias("kind"), "role", "text"
    )
