"""Chat formatting with a grammar round trip.

conversation = turn*            turn = "<|im_start|>" role "\\n" text "<|im_end|>\\n"

Neither role nor text may hold "<|im_start|>" or "<|im_end|>", so every such mark is one that a turn made.

A turn is rendered, read back with the deterministic parser below and compared with its source; while they differ, the
conflicting part is escaped and tried again. Escaping puts a backslash into `<|` (and one more into `<\\|`, `<\\\\|`, ..),
so an escaped text holds no control string and the parser can always undo it. A new line inside a role becomes
`<|nl|>`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trafficloom.llm.texts import emitted, rows_of

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
LOSS_ROLE = "assistant"
PART_CHARS = 1 << 20
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_TURNS = "conv_id long, turn long, role string, text string, rendered string, loss_start long, loss_end long"
_PARTS = "conv_id long, part long, text string, loss_starts array<long>, loss_ends array<long>"
_READ = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
)


def escape(text: str) -> str:
    return _ESCAPE.sub(r"<\1\\|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def parse(formatted: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of every turn; start and end bound the text as it stands. None if it isn't in the grammar."""
    turns, at = [], 0
    while at < len(formatted):
        line = formatted.find("\n", at)
        if not formatted.startswith(START, at) or line < 0:
            return None
        end = formatted.find(END, line + 1)
        if end < 0 or not formatted.startswith("\n", end + len(END)):
            return None
        name = formatted[at + len(START) : line]
        if START in name or END in name or formatted.find(START, line + 1, end) >= 0:
            return None
        role = unescape(name.replace(NEWLINE, "\n"))
        turns.append((role, unescape(formatted[line + 1 : end]), line + 1, end))
        at = end + len(END) + 1
    return turns


def render_turn(role: str, text: str) -> tuple[str, int, int]:
    """The turn as text with the bounds of its content, escaped only as far as the round trip asks for."""
    for name, content in (
        (role, text),
        (role, escape(text)),
        (escape(role).replace("\n", NEWLINE), text),
        (escape(role).replace("\n", NEWLINE), escape(text)),
    ):
        rendered = f"{START}{name}\n{content}{END}\n"
        turns = parse(rendered)
        if turns is not None and [t[:2] for t in turns] == [(role, text)]:
            return rendered, turns[0][2], turns[0][3]
    raise ValueError("no rendering reads back as its source")


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for conv_id, turn, role, text in rows_of(batches, "conv_id", "turn", "role", "text"):
            yield (conv_id, turn, role, text, *render_turn(role, text))

    return emitted(_TURNS, rows())


def _parts(part_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, part, held, spans, size = (), 0, [], [], 0
            for conv_id, role, rendered, start, end in rows_of(
                batches, "conv_id", "role", "rendered", "loss_start", "loss_end"
            ):
                fresh = now != (conv_id,)
                if held and (fresh or size + len(rendered) > part_chars):
                    yield now[0], part, "".join(held), spans
                    part, held, spans, size = part + 1, [], [], 0
                if fresh:
                    now, part = (conv_id,), 0
                if role == LOSS_ROLE:
                    spans.append((size + start, size + end))
                held.append(rendered)
                size += len(rendered)
            if held:
                yield now[0], part, "".join(held), spans

        return emitted(_PARTS, ((c, p, t, [a for a, _ in s], [b for _, b in s]) for c, p, t, s in rows()))

    return run


def format_conversations(turns: DataFrame, part_chars: int = PART_CHARS) -> DataFrame:
    """(conv_id, part, text, loss_starts, loss_ends): the formatted conversations.

    A conversation is the concatenation of its parts; a part ends before the turn that would take it above `part_chars`
    characters, so that a conversation of any length streams through. The starts and ends are those of the
    assistant's texts in the part. Turns go by turn, nulls first, ties by role and text. Null role or text is empty, rows with a null
    conv_id are one conversation, repeated rows are repeated turns; an empty table gives an empty result.
    """
    clean = turns.select(
        F.col("conv_id").cast("long"),
        F.col("turn").cast("long"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    ordered = (
        clean.mapInArrow(_rendered, _TURNS)
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "turn", "role", "text")
    )
    return ordered.mapInArrow(_parts(part_chars), _PARTS)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        now, state = (), None
        for conv_id, text, starts, ends in rows_of(batches, "conv_id", "text", "loss_starts", "loss_ends"):
            if now != (conv_id,):
                if state is not None:
                    yield (now[0], *done(state))
                now, state = (conv_id,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            turns = parse(text)
            if turns is None:
                raise ValueError(f"conversation {conv_id} does not follow the grammar")
            for role, content, _, _ in turns:
                state[1].update(f"{role}\n{content}\n".encode())
            for start, end in zip(starts, ends, strict=True):
                content = unescape(text[start:end])
                state[2] += len(content)
                state[3].update(content.encode())
            state[0] += len(turns)
            state[4] += len(text)
        if state is not None:
            yield (now[0], *done(state))

    def done(state: list) -> tuple:
        return state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]

    return emitted(_READ, rows())


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns, loss text and length of every formatted conversation, as the parser finds them."""
    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "part").mapInArrow(_read, _READ)
