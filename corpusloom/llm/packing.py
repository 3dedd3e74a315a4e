"""Packing documents into training sequences, planned on the histogram of lengths.

Best fit needs the lengths' counts only: bins that are alike are planned as one run, so the plan's size depends on the
sequence length, not on the number of documents. Documents then take the planned slots by their rank within a length.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, ranked, small_batches, text_slices

CAPACITY = 2048
#: Closes every document.
END_ID = 0
#: Texts of more characters go through the slower library, whose time is linear whatever the text.
LONG = 200_000
#: Rows of a plan that are broadcast; a larger plan is joined by shuffle. A row has five numbers.
PLAN_ROWS = 200_000


class Slots(NamedTuple):
    """Ranks rank_from..rank_to - 1 of a length go to sequences first_sequence onwards, one each, at offset."""

    length: int
    rank_from: int
    rank_to: int
    first_sequence: int
    offset: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Slots]:
    """Best-fit decreasing over counts: each length, longest first, goes where the least room is left that it fits."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> runs (first sequence, number of sequences)
    rooms: list[int] = []
    out: list[Slots] = []
    opened = 0

    def leave(left: int, first: int, n: int) -> None:
        if left and n:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            room[left].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit")
        todo, rank = counts[length], 0
        while todo:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                left = rooms[at]
                first, n = room[left].pop()
                if not room[left]:
                    del room[left], rooms[at]
            else:
                left, first, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            each = left // length
            full = min(n, todo // each)
            spare = min(todo - full * each, each - 1) if full < n else 0  # goes to one more sequence
            for many, from_sequence, k in ((full, first, each), (1, first + full, spare)):
                for j in range(k if many else 0):
                    out.append(Slots(length, rank, rank + many, from_sequence, capacity - left + j * length))
                    rank += many
            leave(left - each * length, first, full)
            if spare:
                leave(left - spare * length, first + full, 1)
            leave(left, first + full + bool(spare), n - full - bool(spare))
            todo -= full * each + spare
    return out


@lru_cache(2)
def _slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@lru_cache(2)
def _fast(path: str):
    """The same vocabulary in the faster library; the results are equal for texts without special tokens' strings."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_ids(text: str | None, vocabulary: str | None = None, ranks: str | None = None) -> list[int]:
    """Ids of a text by the tokenizer file `vocabulary`, without END_ID; ranks is the same vocabulary's rank file.
    Both default to the installed byte_bpe_50k."""
    import public_tokenizers

    if not text:
        return []
    if len(text) > LONG or "<|endoftext|>" in text:
        return _slow(vocabulary or public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids
    return _fast(ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")).encode_ordinary(text)


def cuts(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: all full but the first."""
    first = (length - 1) % capacity + 1
    return [(0, first), *((s, capacity) for s in range(first, length, capacity))]


def pieces(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None, with_ids: bool = False) -> DataFrame:
    """Per piece of a row's ids and END_ID: id, piece, start, length, ids_crc32, and the ids if asked for."""
    fields = [("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = pa.schema(fields)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = ((batch.column(0).slice(at, len(texts)).to_pylist(), texts) for batch in batches for at, texts in text_slices(batch.column(1)))
        for names, texts in runs:
            columns: list[list] = [[] for _ in fields]
            for i, text in zip(names, texts):
                ids = np.array([*token_ids(text, vocabulary, ranks), END_ID], "<u4")
                for k, (start, length) in enumerate(cuts(len(ids), capacity)):
                    part = ids[start : start + length]
                    for column, x in zip(columns, (i, k, start, length, zlib.crc32(part.tobytes()), part.astype(np.int32))):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    ddl = "id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ddl)


def packed(docs: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, ranks: str | None = None) -> DataFrame:
    """Per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is END_ID alone. Rows with the same id, a null one too, are documents of their own; an empty
    table gives an empty result; other columns are not read. Only lengths' counts (at most `capacity` rows) reach the
    driver.
    """
    rows = cut(pieces(docs, capacity, id_col, text_col, vocabulary, ranks))
    counts = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = plan(counts, capacity)
    spark = docs.sparkSession
    planned = spark.createDataFrame([tuple(s) for s in slots], "slot_length long, rank_from long, rank_to long, first_sequence long, offset long")
    if len(slots) <= PLAN_ROWS:
        planned = F.broadcast(planned)
    placed = ranked(rows, "length", ["id", "piece", "ids_crc32"], parts=max(1, sum(counts.values()) // 200_000))
    placed = placed.join(planned, (F.col("length") == F.col("slot_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("first_sequence") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
