"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by sequence, and the events that
a later edit or regeneration overrules are dropped in one backward pass. What is left is
sorted by message and folded into final messages, which are rendered one row a turn. Both
passes stream: a task holds one message at a time (and the numbers of edited messages), so a
conversation of any length needs no more memory than a short one.

Events are (conv_id, seq, kind, target, role, text):

- message: a whole message at place target; several at one place follow each other;
- delta: text appended to the message at place target, which begins with its first delta;
- edit: replaces all earlier text at place target (the earlier role stays if role is null);
- regenerate: drops all earlier events at place target and beyond.

Template of a turn: ``### role: text </turn>`` and a newline. In texts and roles a backslash
is put before every backslash, ``#`` and ``<`` (in roles also before ``:``), so no text can
hold a mark of the template and every text can be read back.

Defined cases: null text and null role are empty; a null conv_id is a conversation of its
own; events of equal seq are ordered by target, role and text, nulls first; repeated rows are
repeated turns; a very long text is one message; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftspan.llm.common import read_table

TRAINED_ROLE = "assistant"
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", " </turn>\n"
_TEXT = re.compile(r"[\\#<]")
_ROLE = re.compile(r"[\\#<:]")
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ([^\\#<:]*(?:\\.[^\\#<:]*)*): ([^\\#<]*(?:\\.[^\\#<]*)*) </turn>\n", re.S)
EVENT = "conv_id long, seq long, kind string, target long, role string, text string"
#: Rows of one output batch.
ROWS = 1000


def escape(text: str, marks: re.Pattern = _TEXT) -> str:
    return marks.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, str))
        if len(held) >= ROWS or size > 1 << 22:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


_EVENTS = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("kind", pa.string()), ("target", pa.int64()), ("role", pa.string()), ("text", pa.string())])
_TURNS = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("formatted", pa.string()), ("start", pa.int64()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
_DIGESTS = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def _surviving(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward over each conversation: what no later event overrules. An edit stays as the text that begins its message."""

    def rows() -> Iterator[tuple]:
        now, cut, edited = object(), None, set()
        for conv, seq, kind, target, role, text in _rows(batches):
            if conv != now:
                now, cut, edited = conv, None, set()
            place = -1 if target is None else target
            if kind == "regenerate":
                if cut is None or place < cut:
                    cut = place
            elif cut is not None and place >= cut:
                pass
            elif place in edited:
                if role is not None:  # its text is overruled, its role may be needed
                    yield conv, seq, "role", target, role, None
            else:
                if kind == "edit":
                    edited.add(place)
                yield conv, seq, kind, target, role, text

    return _batches(rows(), _EVENTS)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, str, str]]:
    """Forward over each conversation's surviving events by place: (conv, role, text) of every final message."""
    key, role, parts = None, None, None
    for conv, _, kind, target, r, text in _rows(batches):
        same = key == (conv, target)
        if not same or kind == "message":
            if parts is not None:
                yield key[0], role or "", "".join(parts)
            key, role, parts = (conv, target), None if kind == "edit" or not same else role, None
        if kind == "role":
            role = r
            continue
        if kind == "edit":
            role, parts = r if r is not None else role, [text or ""]
            continue
        if kind == "message" or role is None:
            role = r
        parts = [*(parts or []), text or ""] if kind == "message" or parts is None else (parts.append(text or "") or parts)
    if parts is not None:
        yield key[0], role or "", "".join(parts)


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        now, turn, start = object(), 0, 0
        for conv, role, text in _messages(batches):
            if conv != now:
                now, turn, start = conv, 0, 0
            head, body = f"{OPEN}{escape(role, _ROLE)}{AFTER_ROLE}", escape(text)
            whole = f"{head}{body}{CLOSE}"
            trained = role == TRAINED_ROLE
            at = start + len(head)
            yield conv, turn, whole, start, at if trained else None, at + len(body) if trained else None
            turn, start = turn + 1, start + len(whole)

    return _batches(rows(), _TURNS)


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of rendered turns, read from the formatted text and the loss mask alone."""

    def rows() -> Iterator[tuple]:
        now, state = object(), None
        for conv, _, formatted, start, loss_start, loss_end in _rows(batches):
            if conv != now:
                if state:
                    yield state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]
                now, state = conv, [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            m = _TURN.fullmatch(formatted)
            state[1] += 1
            state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode())
            state[5] += len(formatted)
            if loss_start is not None:
                text = unescape(formatted[loss_start - start : loss_end - start])
                state[3] += len(text)
                state[4].update(text.encode())
        if state:
            yield state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

    return _batches(rows(), _DIGESTS)


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: each row is a whole message, its turn its place and sequence."""
    turn = F.col("turn").cast("long")
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("seq"), F.lit("message").alias("kind"), turn.alias("target"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted, start, loss_start, loss_end) of every turn of the final messages.

    A conversation's text is its formatted turns one after the other; start and the loss span
    (null outside the trained role) are code points of that text. Rows lie in order within
    their partition, and a conversation in one partition.
    """
    backward = [F.col("conv_id"), F.col("seq").desc(), F.col("target").desc(), F.col("role").desc(), F.col("text").desc()]
    kept = events.repartition("conv_id").sortWithinPartitions(*backward).mapInArrow(_surviving, EVENT)
    forward = ["conv_id", "target", "seq", "role", "text"]
    return kept.repartition("conv_id").sortWithinPartitions(*forward).mapInArrow(_render, "conv_id long, turn long, formatted string, start long, loss_start long, loss_end long")


def chat_digests(turns: DataFrame) -> DataFrame:
    """Digests of format_chats' rows, in their order."""
    return turns.mapInArrow(_read_back, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


#: The conversation that the contract adds, to show the escapes.
EXTRA_TEXT = r"\### Assistant: </turn> ok"


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns over all of conversations and conversation -7."""
    events = conversation_events(read_table(spark, sf_dir, "conversations"))
    extra = spark.createDataFrame([(-7, k, "message", k, r, EXTRA_TEXT) for k, r in enumerate(("user", TRAINED_ROLE))], EVENT)
    return chat_digests(format_chats(events.unionByName(extra)))


def _escaped_length(column: str, marks: str) -> str:
    return f"(length({column}) + length(regexp_replace({column}, '[^{marks}]', '', 'g')))"


ORACLE = rf"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{EXTRA_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{EXTRA_TEXT}'
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum({_escaped_length("role", r"\\#<:")} + {_escaped_length("text", r"\\#<")} + {len(OPEN + AFTER_ROLE + CLOSE)}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
