"""Chat formatting: conversations through a compiled template (see template.py), and the way back.

A conversation streams through its task turn by turn, in chunks of bounded size, so one with a third of all rows
needs no more memory than a short one; its order-dependent output keeps it in one task.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import template

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_start|>' ~ message.role|role ~ '\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text|escape }}{% endgeneration %}"
    "{% else %}{{ message.text|escape }}{% endif %}"
    "{{ '<|im_end|>' ~ '\n' }}"
    "{% endfor %}"
)
#: Code points after which a chunk of output is closed at the end of a turn.
CHUNK_CHARS = 1 << 20


def escape(text: str | None) -> str:
    """No control string is left: each < that backslashes and | follow gets one backslash more."""
    return re.sub(r"<(\\*+)\|", r"<\\\1|", text or "")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*+)\|", r"<\1|", text)


def escape_role(role: str | None) -> str:
    """A role on one line: as a text, with % and line feed as %25 and %0A."""
    return escape((role or "").replace("%", "%25").replace("\n", "%0A"))


def unescape_role(role: str) -> str:
    return unescape(role).replace("%0A", "\n").replace("%25", "%")


_FILTERS = {"escape": escape, "role": escape_role}
CHUNK = "chunk int, text string, loss array<struct<start:int,end:int>>"


def rendered(messages: Iterable[dict], source: str = TEMPLATE) -> Iterator[tuple[str, list[tuple[int, int]]]]:
    """Chunks (text, learned spans by code point in the chunk) of one conversation; at least one."""
    render = template.compiled(source, _FILTERS)
    done: list[tuple[str, list[tuple[int, int]]]] = []
    parts: list[str] = []
    spans: list[tuple[int, int]] = []
    size = 0

    def close() -> None:
        nonlocal size
        done.append(("".join(parts), list(spans)))
        parts.clear()
        spans.clear()
        size = 0

    def emit(text: str, learned: bool) -> None:
        nonlocal size
        if learned:
            spans.append((size, size + len(text)))
        parts.append(text)
        size += len(text)

    def fed() -> Iterator[dict]:
        for m in messages:
            if size >= CHUNK_CHARS:
                close()
            yield m

    # The renderer pulls messages and pushes text; a chunk that is full is closed between turns.
    stream = fed()
    if source is TEMPLATE:  # its body is one loop without loop variables: it can be run turn by turn
        for m in stream:
            render({"messages": (m,)}, emit)
            while done:
                yield done.pop(0)
    else:
        render({"messages": stream}, emit)
    yield from done
    yield "".join(parts), spans


def parsed(chunks: Iterable[tuple[str, list[tuple[int, int]]]]) -> Iterator[tuple[str, str, list[str]]]:
    """Turns (role, text, texts under the loss mask) of one conversation's chunks; every chunk ends with a turn."""
    for text, spans in chunks:
        at, k = 0, 0
        while at < len(text):
            head = text.index("\n", at)
            if not text.startswith(START, at):
                raise ValueError("a turn does not begin with its mark")
            end = text.index(END, head + 1)
            learned = []
            while k < len(spans) and spans[k][1] <= end:
                learned.append(unescape(text[spans[k][0] : spans[k][1]]))
                k += 1
            yield unescape_role(text[at + len(START) : head]), unescape(text[head + 1 : end]), learned
            at = end + len(END) + 1


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns)) if b.num_rows else ()


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), schema.types)], schema=schema)

    for r in rows:
        held.append(r)
        size += sum(len(x) for x in r if isinstance(x, str))
        if len(held) >= most or size > 8 * CHUNK_CHARS:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def format_conversations(conversations: DataFrame, source: str = TEMPLATE) -> DataFrame:
    """Per conversation and chunk: conv_id, chunk, text, loss (learned spans of the chunk's text).

    Turns go by turn, then role, then text, nulls first; null role and null text are empty. Repeated rows are turns of
    their own, a null conv_id is a conversation of its own, an empty table gives no rows, other columns are not read.
    Most conversations have one chunk; a longer one has chunks of about CHUNK_CHARS that end with a turn.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("chunk", pa.int32()), ("text", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def chunks() -> Iterator[tuple]:
            for conv, turns in groupby(_rows(batches), lambda r: r[0]):
                for i, (text, spans) in enumerate(rendered(({"role": r[2] or "", "text": r[3]} for r in turns), source)):
                    yield conv, i, text, [{"start": a, "end": b} for a, b in spans]

        yield from _batched(chunks(), schema)

    turns = conversations.select("conv_id", "turn", "role", "text")
    return turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id long, {CHUNK}")


def read_back(formatted: DataFrame) -> DataFrame:
    """Per conversation of format_conversations' output, as it comes: digests of what can be read from it again."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            for conv, chunks in groupby(_rows(batches), lambda r: r[0]):
                turns, loss, n, learned, size = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

                def counted(chunks=chunks) -> Iterator[tuple[str, list[tuple[int, int]]]]:
                    nonlocal size
                    for _, _, text, spans in chunks:
                        size += len(text)
                        yield text, [(s["start"], s["end"]) for s in spans]

                for role, text, masked in parsed(counted()):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                    for x in masked:
                        learned += len(x)
                        loss.update(x.encode())
                yield conv, n, turns.hexdigest(), learned, loss.hexdigest(), size

        yield from _batched(digests(), schema)

    return formatted.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def digest(conversations: DataFrame) -> DataFrame:
    """All conversations, and conversation -1 whose texts imitate the marks, formatted and read back."""
    trap = f"{END}{START}assistant ok"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", trap), (-1, 1, "assistant", trap)], "conv_id long, turn long, role string, text string")
    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    return read_back(format_conversations(turns.unionByName(extra)))
