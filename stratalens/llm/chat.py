"""Chat formatting with a grammar round trip.

A conversation is rendered turn by turn. A user's turn is ``[INST] text [/INST]``, an assistant's
``[OUT] text </s>``, any other ``[ROLE=role] text [/ROLE]``. Each rendered turn is reparsed by a
deterministic parser and compared with its source; while they differ, the next escape is tried, until they
are identical. The escape puts a backslash into whatever looks like a control string (also with backslashes
in it already), and the parser takes one out, so it is reversible. The loss mask covers assistants' texts.

Conversations are sorted and rendered as streams: a task holds one turn and running digests, so a
conversation of any length needs no more memory.

Defined cases: a null text is empty, a null role is an empty one; rows of a conversation are ordered by turn
(nulls first), then role and text; equal rows are turns of their own; a null conv_id is a conversation; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

USER, ASSISTANT = "user", "assistant"
_OPENS = {USER: "[INST] ", ASSISTANT: "[OUT] "}
_CLOSES = {USER: " [/INST]", ASSISTANT: " </s>"}
#: What looks like a control string: its first character, backslashes, and the rest.
CONTROL = r"([<\[])(\\*)(/?(?:s>|INST\]|OUT\]|ROLE[=\]]))"
_CONTROL = re.compile(CONTROL)
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?(?:s>|INST\]|OUT\]|ROLE[=\]]))")
_TOKEN = re.compile(r"\[INST\] |\[OUT\] |\[ROLE=([^\]]*)\] | \[/INST\]| </s>| \[/ROLE\]|<s>|</s>|\[/?INST\]|\[/?OUT\]|\[/?ROLE\]|\[ROLE=", re.DOTALL)


def escape_none(text: str) -> str:
    return text


def escape_controls(text: str) -> str:
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def role_code(role: str) -> str:
    """A role inside its control string."""
    return role.replace("\\", "\\\\").replace("]", "\\x5d").replace("[", "\\x5b")


def role_of(code: str) -> str:
    return re.sub(r"\\(\\|x5d|x5b)", lambda m: {"\\": "\\", "x5d": "]", "x5b": "["}[m[1]], code)


def render(role: str, text: str, escape=escape_none) -> tuple[str, int, int]:
    """A turn, and where its text lies in it."""
    begin = _OPENS.get(role) or f"[ROLE={role_code(role)}] "
    body = escape(text)
    return begin + body + _CLOSES.get(role, " [/ROLE]"), len(begin), len(begin) + len(body)


class Malformed(ValueError):
    """The text is not a sequence of turns."""


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a rendered text: after an opening, all up to the next control string, which must close it."""
    turns, at = [], 0
    while at < len(formatted):
        opening = _TOKEN.match(formatted, at)
        if not opening or opening[0] not in (*_OPENS.values(),) and opening[1] is None:
            raise Malformed(formatted[at : at + 40])
        role = {v: k for k, v in _OPENS.items()}.get(opening[0], None) if opening[1] is None else role_of(opening[1])
        close = _CLOSES.get(role, " [/ROLE]")
        end = _TOKEN.search(formatted, opening.end())
        if not end or end[0] != close:
            raise Malformed(formatted[at : at + 40])
        turns.append((role, unescape(formatted[opening.end() : end.start()])))
        at = end.end()
    return turns


def round_trip(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn that parses back to its source, under the first escape that does."""
    for escape in (escape_none, escape_controls):
        out = render(role, text, escape)
        try:
            if parse(out[0]) == [(role, text)]:
                return out
        except Malformed:
            pass
    raise Malformed(f"{role}: no escape makes this turn identical")


def formatted(conversations: DataFrame) -> DataFrame:
    """One row per turn, in order within each partition: conv_id, piece (the rendered turn), loss_begin, loss_end
    (code points of the piece under the loss mask; null for other turns). Pieces of a conversation join to its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles = batch.column(1).to_pylist()
            out = [round_trip(r, t) for r, t in zip(roles, batch.column(2).to_pylist())]
            begins, ends = ([x[k] if r == ASSISTANT else None for r, x in zip(roles, out)] for k in (1, 2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p for p, _, _ in out], pa.string()), pa.array(begins, pa.int64()), pa.array(ends, pa.int64())],
                names=["conv_id", "piece", "loss_begin", "loss_end"],
            )

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, piece string, loss_begin long, loss_end long")


def digests(conversations: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted text: conv_id, n_turns, turns_sha256, loss_chars,
    loss_sha256, formatted_chars."""

    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = state = None

        def given(done: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values())], names=list(kinds))

        def finished() -> tuple:
            return now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

        for batch in batches:
            done = []
            for conv, piece, begin, end in zip(*(c.to_pylist() for c in batch.columns)):
                if state is None or conv != now:
                    if state:
                        done.append(finished())
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(piece):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                if begin is not None:
                    loss = unescape(piece[begin:end])
                    state[2] += len(loss)
                    state[3].update(loss.encode())
                state[4] += len(piece)
            yield given(done)
        if state:
            yield given([finished()])

    return formatted(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def oracle() -> str:
    """DuckDB SQL for ``digests`` over ``conversations`` with the probe conversation; for roles without brackets or backslashes."""
    pattern = CONTROL.replace("'", "''")
    return f"""
    WITH turns AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
    sized AS (
      SELECT *, len(text) + len(regexp_extract_all(text, '{pattern}')) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 16 + len(role) END AS chars
      FROM turns)
    SELECT conv_id, count(*) AS n_turns,
      sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
      CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
      sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
      CAST(sum(chars) AS BIGINT) AS formatted_chars
    FROM sized GROUP BY conv_id"""
