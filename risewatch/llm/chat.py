"""Chat formatting: records of several layouts to canonical turns, and turns to training text.

The layout of a JSON record is known by the fingerprint of its nested field paths.  A fingerprint selects
a declarative mapping, which says where turns are and where their roles and texts come from.

Training text is a sequence of turns, `### role`, a line feed, the text, `</turn>` and a line feed.  Inside
roles and texts a backslash goes before every backslash, `###` and `</turn>` (and every line feed of a
role), so no text can open or close a turn and every text can be read back.  The loss mask is the spans of
the assistant's texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risewatch.llm.common import slices

OPEN, CLOSE = "### ", "</turn>\n"
LEARNED = "assistant"
_CONTROL = re.compile(r"\\|###|</turn>")
_ROLE_CONTROL = re.compile(r"\\|###|</turn>|\n")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|\n)")
_TURN = re.compile(r"### ((?:[^\\\n]+|\\.)*)\n((?:[^\\<]+|\\.|<(?!/turn>))*)</turn>\n", re.S)


# Layouts

@dataclass(frozen=True)
class Turn:
    """Where a turn comes from: `role` names it, or `role_at` is the path of its role; `text_at` is the
    path of its text.  With `each`, the path of a list, there is a turn for every element of it."""

    text_at: str
    role: str | None = None
    role_at: str | None = None
    each: str | None = None


@dataclass(frozen=True)
class Mapping:
    name: str
    paths: tuple[str, ...]  # of all leaves, list elements as []
    turns: tuple[Turn, ...]

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def paths_of(value, at: str = "") -> set[str]:
    """Paths of a record's leaves; an empty object or list is a leaf."""
    if isinstance(value, dict) and value:
        return set().union(*(paths_of(v, f"{at}.{k}" if at else k) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(paths_of(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.blake2b("\0".join(sorted(set(paths))).encode(), digest_size=8).hexdigest()


MAPPINGS = (
    Mapping("message", ("message.role", "message.content"), (Turn("message.content", role_at="message.role"),)),
    Mapping("messages", ("messages[].role", "messages[].content"), (Turn("content", role_at="role", each="messages"),)),
    Mapping("no messages", ("messages",), (Turn("content", role_at="role", each="messages"),)),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), (Turn("value", role_at="from", each="conversations"),)),
    Mapping("prompt", ("prompt",), (Turn("prompt", role="user"),)),
    Mapping("completion", ("completion.text",), (Turn("completion.text", role="assistant"),)),
    Mapping("prompt and completion", ("prompt", "completion"), (Turn("prompt", role="user"), Turn("completion", role="assistant"))),
    Mapping("instruction", ("instruction", "output"), (Turn("instruction", role="user"), Turn("output", role="assistant"))),
    Mapping(
        "instruction and input", ("instruction", "input", "output"),
        (Turn("instruction", role="system"), Turn("input", role="user"), Turn("output", role="assistant")),
    ),
    Mapping("system instruction", ("instruction.system",), (Turn("instruction.system", role="system"),)),
)


def _at(value, path: str):
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def turns_of(record, mapping: Mapping) -> list[tuple[str, str]]:
    """(role, text) of each turn; what is null or no text becomes the empty text or its JSON."""
    def text(value) -> str:
        return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)

    found = []
    for turn in mapping.turns:
        for item in (_at(record, turn.each) or [] if turn.each else [record]):
            found.append((turn.role if turn.role is not None else text(_at(item, turn.role_at)), text(_at(item, turn.text_at))))
    return found


def canonical(records: DataFrame, mappings: Sequence[Mapping] = MAPPINGS) -> DataFrame:
    """Rows (conv_id, turn, layout, step, role, text) of JSON records (conv_id, turn, record).

    `turn` orders the records of a conversation and `step` the turns of a record.  A record that is null,
    no JSON, or of an unknown layout gives one row with a null layout and role and the record as its text,
    so nothing is lost silently.  Other columns are left out.
    """
    by_print = {m.fingerprint: m for m in mappings}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "record"):
            out = []
            for conv_id, turn, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "record"))):
                mapping = None
                try:
                    record = json.loads(text) if text is not None else None
                    mapping = by_print.get(fingerprint(paths_of(record)))
                except ValueError:
                    pass
                if mapping is None:
                    out.append((conv_id, turn, None, 0, None, text))
                else:
                    out += [(conv_id, turn, mapping.name, i, *x) for i, x in enumerate(turns_of(record, mapping))]
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.string()]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "layout", "step", "role", "text"]
            )

    return records.select("conv_id", "turn", "record").mapInArrow(
        run, "conv_id bigint, turn bigint, layout string, step int, role string, text string"
    )


def as_records(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the JSON records they would come in: users' as prompts,
    assistants' as completions, system texts as instructions, all others as messages."""
    def record(*fields: Column) -> Column:
        return F.to_json(F.struct(*fields), {"ignoreNullFields": "false"})

    text = F.coalesce("text", F.lit(""))
    of = (
        F.when(F.col("role") == "user", record(text.alias("prompt")))
        .when(F.col("role") == "assistant", record(F.struct(text.alias("text")).alias("completion")))
        .when(F.col("role") == "system", record(F.struct(text.alias("system")).alias("instruction")))
        .otherwise(record(F.struct("role", text.alias("content")).alias("message")))
    )
    return rows.select("conv_id", "turn", of.alias("record"))


# Template

def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def formatted(role: str, text: str) -> tuple[str, int, int]:
    """A turn's training text, and the start and end of its text in it."""
    head = OPEN + _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role) + "\n"
    body = escape(text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def format_turns(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, position, chunk, loss_start, loss_end) of turns (conv_id, turn, step, role, text).

    A conversation's training text is its chunks in the order of position, one for each turn; the span
    under the loss mask, in code points of the whole conversation, is null where nothing is learned.
    Turns are ordered by turn, step, role and text, nulls first; repeated rows are repeated turns; a null
    role or text is empty; rows without conv_id are one conversation.  A task holds one batch, however
    long a conversation is.
    """
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "step", "role", "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position, at = object(), 0, 0
        for batch in slices(batches, "text"):
            out = []
            for conv_id, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv_id != now:
                    now, position, at = conv_id, 0, 0
                chunk, start, end = formatted(role or "", text or "")
                learned = role == LEARNED
                out.append((conv_id, position, chunk, at + start if learned else None, at + end if learned else None))
                position, at = position + 1, at + len(chunk)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv_id", "position", "chunk", "loss_start", "loss_end"]
            )

    ordered = turns.select("conv_id", "turn", "step", "role", "text").repartition("conv_id").sortWithinPartitions(*order)
    return ordered.mapInArrow(run, "conv_id bigint, position bigint, chunk string, loss_start bigint, loss_end bigint")


class _Reader:
    """Digests of one conversation, read from its training text piece by piece."""

    def __init__(self):
        self.turns, self.chars, self.at = 0, 0, 0
        self.all, self.learned, self.learned_chars = hashlib.sha256(), hashlib.sha256(), 0
        self.rest, self.spans = "", []

    def add(self, chunk: str, start: int | None, end: int | None) -> None:
        self.chars += len(chunk)
        self.rest += chunk
        if start is not None:
            self.spans.append((start, end))
        done = 0
        while turn := _TURN.match(self.rest, done):
            role, text = unescape(turn[1]), unescape(turn[2])
            self.all.update(f"{role}\n{text}\n".encode())
            self.turns += 1
            done = turn.end()
        # What lies under the mask, from the text itself and not from the turns.
        for start, end in self.spans:
            text = unescape(self.rest[start - self.at : end - self.at])
            self.learned.update(text.encode())
            self.learned_chars += len(text)
        self.spans.clear()
        self.rest, self.at = self.rest[done:], self.at + done

    def row(self, conv_id) -> tuple:
        if self.rest:
            raise ValueError(f"conversation {conv_id} ends inside a turn")
        return conv_id, self.turns, self.all.hexdigest(), self.learned_chars, self.learned.hexdigest(), self.chars


def read_back(chunks: DataFrame) -> DataFrame:
    """Per conversation, from its training text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reader = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

        def rows(done):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*done)) or [()] * 6, kinds)], names)

        for batch in slices(batches, "chunk"):
            done = []
            for conv_id, chunk, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "chunk", "loss_start", "loss_end"))):
                if reader is None or conv_id != now:
                    if reader is not None:
                        done.append(reader.row(now))
                    now, reader = conv_id, _Reader()
                reader.add(chunk, start, end)
            yield rows(done)
        if reader is not None:
            yield rows([reader.row(now)])

    ordered = chunks.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "position")
    return ordered.mapInArrow(
        run, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    )
