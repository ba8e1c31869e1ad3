"""Chat formatting with a grammar round trip (operator 1).

Grammar of the rendered text, for each turn::

    ### <role>: <text></turn>\n

``### ``, ``</turn>`` and, within a role, ``: `` are control strings. A run of
backslashes before a control string stands for half as many; if it is odd, the control
string is plain text. Elsewhere backslashes stand for themselves. Each turn is rendered
as it is and parsed again; where the turn read back is not the source, its conflicting
content is escaped, and the result must be identical.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HEAD, MIDDLE, END = "### ", ": ", "</turn>"
_IN_ROLE = re.compile(r"(\\*)(### |</turn>|: )")
_IN_TEXT = re.compile(r"(\\*)(### |</turn>)")
_TAIL = re.compile(r"(\\+)\Z")


class GrammarError(ValueError):
    """The rendered text does not follow the grammar."""


def escape(text: str, controls: re.Pattern) -> str:
    return _TAIL.sub(r"\1\1", controls.sub(lambda m: m[1] * 2 + "\\" + m[2], text))


def _field(rendered: str, at: int, controls: re.Pattern, closing: str) -> tuple[str, int, int]:
    """(plain text, end of the field, position behind its closing control string) of the field that starts at ``at``."""
    parts, last = [], at
    for found in controls.finditer(rendered, at):
        slashes = len(found[1])
        parts.append(rendered[last : found.start()] + "\\" * (slashes // 2))
        if slashes % 2:
            parts.append(found[2])
            last = found.end()
        elif found[2] == closing:
            return "".join(parts), found.start(2), found.end()
        else:
            raise GrammarError(f"{found[2]!r} at {found.start(2)}")
    raise GrammarError(f"no {closing!r} behind {at}")


def parse(rendered: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the rendered text field) of each turn; raises ``GrammarError``."""
    turns, at = [], 0
    while at < len(rendered):
        if not rendered.startswith(HEAD, at):
            raise GrammarError(f"no turn at {at}")
        role, _, start = _field(rendered, at + len(HEAD), _IN_ROLE, MIDDLE)
        text, end, at = _field(rendered, start, _IN_TEXT, END)
        if rendered[at : at + 1] != "\n":
            raise GrammarError(f"no line end at {at}")
        at += 1
        turns.append((role, text, start, end))
    return turns


def _drawn(role: str, text: str) -> str:
    return f"{HEAD}{role}{MIDDLE}{text}{END}\n"


def render(role: str, text: str) -> tuple[str, int, int]:
    """The rendered turn, and where its text field starts and ends; parsing it gives the turn back."""
    for shown in (_drawn(role, text), _drawn(escape(role, _IN_ROLE), escape(text, _IN_TEXT))):
        try:
            turns = parse(shown)
        except GrammarError:
            continue
        if len(turns) == 1 and turns[0][:2] == (role, text):
            return shown, *turns[0][2:]
    raise GrammarError("escaping did not make the turn identical")


def format_turns(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", learned: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """``conv_id, turn, role, text, rendered, loss_start, loss_end`` for every row.

    ``rendered`` texts of a conversation, joined by turn, are the formatted conversation;
    code points ``loss_start`` to ``loss_end`` (exclusive) of each are under the loss mask,
    null unless the role is in ``learned``. A null role or text counts as empty. Null ids and
    turns, and repeated rows, stay; an empty table gives an empty table; other columns are
    not read, whatever their names.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roles, texts = batch.column("role").to_pylist(), batch.column("text").to_pylist()
            shown, starts, ends = [], [], []
            for role, text in zip(roles, texts, strict=True):
                rendered, start, end = render(role, text)
                shown.append(rendered)
                starts.append(start if role in learned else None)
                ends.append(end if role in learned else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shown, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], [*batch.schema.names, "rendered", "loss_start", "loss_end"])

    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))))
    return rows.mapInArrow(task, "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations hold, read from ``rendered`` and the loss mask alone.

    ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``. Rows are
    streamed in order of (turn, role, text), null turns first, through running digests, so a
    conversation of any length takes constant memory; null conversation ids are one group.
    The digest runs over a conversation's turns in order, so one conversation is one task's.
    Repeated rows count as often as they come; an empty table gives an empty table; columns
    besides those of ``format_turns`` are not read.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, done = None, None, []

        def close() -> None:
            if state:
                n, turns, loss, loss_hash, size = state
                done.append((current, n, turns.hexdigest(), loss, loss_hash.hexdigest(), size))

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), types, strict=True)], names)

        for batch in batches:
            for conv, rendered, start, end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "rendered", "loss_start", "loss_end")), strict=True):
                if state is None or conv != current:
                    close()
                    current, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, a, b in parse(rendered):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if start == a and end == b:
                        state[2] += len(text)
                        state[3].update(text.encode())
                state[4] += len(rendered)
            if len(done) > 4096:
                yield out()
                done.clear()
        close()
        if done:
            yield out()

    ordered = formatted.select("conv_id", "turn", "role", "text", "rendered", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "rendered", "loss_start", "loss_end").mapInArrow(task, schema)
