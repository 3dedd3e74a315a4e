"""Benchmark decontamination: word n-grams of test items seed alignments with training texts, and Smith-Waterman
local alignment of words scores them, so that edited and paraphrased copies are found as well as exact ones. Every
n-gram is a seed, however many documents hold it: one copy may stand in any number of them. Items of fewer words than
a seed are found where their words stand as they are.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. The benchmark is taken in blocks of
bounded size, each of which every task holds; documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import PLAIN, held_by_all, mix, small_batches, stream, text_slices, word_hashes

GRAM = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: Share of an item's best possible score from which a document holds it.
LEAST = 0.4
#: Items and characters of a block of the benchmark that tasks hold at once; a larger benchmark takes several passes.
ITEMS, ITEM_CHARS = 20_000, 16_000_000


class Items(NamedTuple):
    """A block of items: ids, words of each, their n-grams in order with item and place, and for each number of words
    below GRAM the hashes, in order, and numbers of the items that have so many."""

    ids: list
    words: list[np.ndarray]
    grams: np.ndarray
    item: np.ndarray
    place: np.ndarray
    short: dict[int, tuple[np.ndarray, np.ndarray]]


def grams_of(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Hashes of the `size` words from each place."""
    n = max(0, len(words) - size + 1)
    with np.errstate(over="ignore"):
        return mix(sum((words[k : k + n] * w for k, w in enumerate(stream(size, 10 + size) | np.uint64(1))), np.zeros(n, np.uint64)))


def _texts(texts: list[str | None]) -> Iterator[np.ndarray]:
    for _, _, words, bounds in word_hashes(texts, PLAIN):
        for a, b in zip(bounds[:-1], bounds[1:]):
            yield words[a:b]


def items(ids: list, texts: list[str | None]) -> Items:
    words = list(_texts(texts))
    grams = [grams_of(w) for w in words]
    item = np.repeat(np.arange(len(words)), [len(g) for g in grams])
    flat = np.concatenate(grams) if grams else np.empty(0, np.uint64)
    place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
    order = np.argsort(flat, kind="stable")
    short = {}
    for size in range(1, GRAM):
        if some := [i for i, w in enumerate(words) if len(w) == size]:
            own = np.concatenate([grams_of(words[i], size) for i in some])
            short[size] = np.sort(own), np.array(some)[np.argsort(own, kind="stable")]
    return Items(ids, words, flat[order], item[order], place[order], short)


def _found(sorted_grams: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Places in grams of those that occur."""
    if not len(sorted_grams) or not len(grams):
        return np.empty(0, np.int64)
    return np.flatnonzero(sorted_grams[np.minimum(np.searchsorted(sorted_grams, grams), len(sorted_grams) - 1)] == grams)


def aligned(item: np.ndarray, window: np.ndarray) -> tuple[int, int]:
    """Best local alignment score of two word sequences, and the place in the window where it ends."""
    ramp = np.arange(len(window) + 1, dtype=np.int64) * -GAP
    row, best, end = np.zeros(len(window) + 1, np.int64), 0, 0
    for word in item:
        step = np.maximum(row[:-1] + np.where(window == word, MATCH, MISMATCH), row[1:] + GAP)
        row = np.concatenate((np.zeros(1, np.int64), np.maximum(step, 0)))
        row = np.maximum.accumulate(row + ramp) - ramp  # gaps along the window
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def matches(words: np.ndarray, block: Items, least: float = LEAST) -> Iterator[tuple[int, float, int]]:
    """(item number, score, word where the alignment ends) of the items that a text holds, best place of each."""
    for size, (own, which) in block.short.items():
        grams = grams_of(words, size)
        distinct, at = np.unique(grams[_found(own, grams)], return_index=True)
        places = _found(own, grams)[at]
        for gram, place in zip(distinct, places):
            for k in range(np.searchsorted(own, gram), np.searchsorted(own, gram, "right")):
                yield int(which[k]), 1.0, int(place + size)
    grams = grams_of(words)
    hits = _found(block.grams, grams)
    if not len(hits):
        return
    first = np.searchsorted(block.grams, grams[hits])
    count = np.searchsorted(block.grams, grams[hits], "right") - first
    entry = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
    which, begin = block.item[entry], np.repeat(hits, count) - block.place[entry]  # where the item would begin
    order = np.lexsort((begin, which))
    which, begin = which[order], begin[order]
    starts = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1], [True])))
    for a, b in zip(starts[:-1], starts[1:]):
        item = block.words[which[a]]
        room, best = len(item) // 3 + 2, (0.0, 0)
        cuts = [a, *(a + 1 + np.flatnonzero(np.diff(begin[a:b]) > room)), b]
        for x, y in zip(cuts[:-1], cuts[1:]):
            low, high = max(0, begin[x] - room), min(len(words), begin[y - 1] + len(item) + room)
            window = words[low:high]
            # The score is at most MATCH for each word of the item that occurs in the window.
            if MATCH * np.isin(item, window).sum() < least * MATCH * len(item):
                continue
            score, end = aligned(item, window)
            best = max(best, (score / (MATCH * len(item)), int(low + end)))
        if best[0] >= least:
            yield int(which[a]), best[0], best[1]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    ids: list = []
    texts: list[str] = []
    size = 0
    for row in benchmark.select(item_col, text_col).filter(F.col(text_col).isNotNull()).toLocalIterator():
        ids.append(row[0])
        texts.append(row[1])
        size += len(row[1])
        if len(ids) >= ITEMS or size >= ITEM_CHARS:
            yield items(ids, texts)
            ids, texts, size = [], [], 0
    if ids:
        yield items(ids, texts)


def _held(rows: DataFrame, benchmark: DataFrame, item_col: str, item_text_col: str) -> Iterator:
    """Broadcast blocks of the benchmark; each is bounded by ITEMS and ITEM_CHARS."""
    for block in _blocks(benchmark.select(F.col(item_col).cast("long").alias("item"), F.col(item_text_col).cast("string").alias("text")), "item", "text"):
        yield held_by_all(rows.sparkSession, block)


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST) -> DataFrame:
    """(id, item id, score, end) for each row of docs and item that it holds: score is the alignment's share of the
    best possible, end the word of the text after it.

    Null and empty texts hold nothing, and items without words are never held. An item of fewer than GRAM words is held
    where they stand one after another. Of equally good places the first one counts. Texts of any length are searched
    whole. Repeated rows and items are reported as often as they come, null ids as null; other columns are not read.
    """
    rows = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = pa.schema([("doc", pa.int64()), ("item", pa.int64()), ("score", pa.float64()), ("end", pa.int64())])
    out = docs.sparkSession.createDataFrame([], "doc long, item long, score double, end long")
    for held in _held(rows, benchmark, item_col, item_text_col):

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            runs = ((batch.column(0).slice(at, len(texts)).to_pylist(), texts) for batch in batches for at, texts in text_slices(batch.column(1)))
            for ids, texts in runs:
                found = [(i, block.ids[k], s, e) for i, words in zip(ids, _texts(texts)) for k, s, e in matches(words, block, least)]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found), schema.types)], schema=schema)

        out = out.unionByName(rows.mapInArrow(run, "doc long, item long, score double, end long"))
    return out.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "score", "end")


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: float = LEAST, shortest: int = GRAM) -> DataFrame:
    """The rows of docs whose text holds no item, with all their columns; nothing is shuffled. Items of fewer than
    `shortest` words do not count here, as such words stand in clean texts too (contaminated() reports them)."""
    out = small_batches(docs)
    for held in _held(docs, benchmark, item_col, item_text_col):

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            block = held.value
            for batch in batches:
                texts = batch.column(batch.schema.names.index(text_col))
                ok = [all(len(block.words[k]) < shortest for k, _, _ in matches(words, block, least)) for _, some in text_slices(texts) for words in _texts(some)]
                yield batch.filter(pa.array(ok, pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
