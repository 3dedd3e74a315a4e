"""Perplexity by an interpolated modified Kneser-Ney bigram model (Chen and Goodman, 1999).

Counting is Spark's: tasks emit sorted, pre-added blobs of counts, a shuffle brings a shard's blobs together, and each
shard becomes one file of sorted hash arrays in the shared folder. Workers map these files into memory and look words
and bigrams up by binary search; nothing of the model passes the driver but a few totals. Words are 64-bit hashes in
the unigram files (counts are exact but for hash collisions, 2e-20 for each pair of words) and 40 bits of these in
bigrams. Contexts that hold more than 1/HOT of all tokens are dealt over all shards, so no shard is hot.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterable, Iterator
from typing import NamedTuple
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import kept, mix, new_folder, small_batches, text_slices, word_hashes

#: Tokens counted at once by a task, and tokens for each shard.
BUFFER, PER_SHARD = 1_200_000, 1_500_000
#: Bytes of text that are looked up together: a word of all of them is looked up once.
RUN = 1 << 20
#: 2 ** MOST_BITS shards at most, so they grow beyond 1e11 tokens (some 500 GB of text); partitions that make them.
MOST_BITS, MOST_PARTS = 16, 20_000
#: A context of at least 1/HOT of all tokens is dealt over all shards; at most HOT contexts are.
HOT = 512
#: Training leaves out ids of this remainder by MODULUS.
MODULUS, HELD_OUT = 7, 2

END = np.uint64(0x5EEDFACE12345677)
BEGIN = np.uint64(0x1DEA5DEADBEEF771) >> np.uint64(24)
_LOW = np.uint64((1 << 40) - 1)
U64 = np.uint64


def _ids(hashes: np.ndarray) -> np.ndarray:
    return hashes >> U64(24)


def _tokens(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first, last, token hashes, contexts, bounds) of runs of texts: a text's words and END, after BEGIN."""
    for first, last, words, bounds in word_hashes(texts, chunk=RUN):
        n = len(bounds) - 1
        tokens = np.insert(words, bounds[1:], END)
        bounds = bounds + np.arange(n + 1)
        contexts = np.empty(len(tokens), U64)
        contexts[1:] = _ids(tokens[:-1])
        contexts[bounds[:-1]] = BEGIN
        yield first, last, tokens, contexts, bounds


def _added(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and their counts' sums."""
    if counts is None:
        keys = np.sort(keys)
        at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
        return keys[at], np.diff(np.append(at, len(keys)))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], (np.add.reduceat(counts[order].astype(np.int64), at) if len(at) else np.empty(0, np.int64))


class Layout(NamedTuple):
    """How words and bigrams are dealt over shards: 2 ** bits shards, and the hot contexts in order."""

    bits: int
    hot: np.ndarray

    def of_words(self, ids: np.ndarray) -> np.ndarray:
        return (ids >> U64(40 - self.bits)).astype(np.int64)

    def keys(self, contexts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Sorting keys of bigrams whose leading bits are the shard: those of the context's hash, or for hot contexts
        of the bigram's."""
        pair = mix(mix(contexts + U64(1)) + ids)
        lead = np.where(self.is_hot(contexts), pair * U64(0x9E3779B97F4A7C15), mix(contexts + U64(3)))
        rest = U64(64 - self.bits)
        return (lead >> rest << rest) | (pair >> U64(self.bits))

    def is_hot(self, contexts: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(contexts), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, contexts), len(self.hot) - 1)] == contexts

    def of_keys(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(64 - self.bits)).astype(np.int64)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, behind their sizes in bytes."""
    return b"".join([np.array([len(arrays), *(a.nbytes for a in arrays)], "<u8").tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpacked(raw: bytes | np.ndarray, kinds: tuple) -> list[np.ndarray]:
    raw = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else raw
    sizes = raw[8 : 8 + 8 * len(kinds)].view("<u8").tolist()
    at, out = 8 + 8 * len(kinds), []
    for size, kind in zip(sizes, kinds):
        part = raw[at : at + size]
        out.append(part.view(kind) if part.ctypes.data % np.dtype(kind).itemsize == 0 else part.copy().view(kind))
        at += size
    return out


def _narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts in one byte each, and places and values of those from 255."""
    large = np.flatnonzero(counts >= 255)
    return np.minimum(counts, 255).astype(np.uint8), large.astype(np.uint32), counts[large].astype(np.uint64)


def _wide(narrow: np.ndarray, at: np.ndarray, large: np.ndarray) -> np.ndarray:
    counts = narrow.astype(np.int64)
    counts[at] = large
    return counts


_COUNTS = (np.uint8, np.uint32, np.uint64)
_PAIRS = (np.uint64, np.uint32, np.uint32, np.uint8, *_COUNTS)
_WORDS = (np.uint64, *_COUNTS)
_BLOB = pa.schema([("kind", pa.string()), ("shard", pa.int32()), ("blob", pa.binary())])
BLOB = "kind string, shard int, blob binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _BLOB.types)], schema=_BLOB)


def _buffered(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Tokens and contexts of about BUFFER tokens at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0
    runs = (run for batch in batches for _, texts in text_slices(batch.column(0)) for run in _tokens(texts))
    for _, _, tokens, contexts, _ in runs:
        held.append((tokens, contexts))
        n += len(tokens)
        if n >= BUFFER:
            yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            held, n = [], 0
    if held:
        yield np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])


def _common(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Contexts that are common in a buffer with their counts, and the buffer's tokens under -1."""
    for tokens, contexts in _buffered(batches):
        ids, counts = _added(contexts)
        common = counts * HOT * 2 >= len(tokens)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[common].astype(np.int64), -1)), pa.array(np.append(counts[common], len(tokens)))], names=["id", "n"])


def _count(layout: Layout):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blobs of bigrams, grouped by context, and of words, for each shard."""
        for tokens, contexts in _buffered(batches):
            words, n = _added(tokens)
            shards = np.searchsorted(layout.of_words(_ids(words)), np.arange(2**layout.bits + 1))
            out = [("w", s, _packed(words[a:b], *_narrow(n[a:b]))) for s, (a, b) in enumerate(zip(shards[:-1], shards[1:])) if b > a]
            before, at = np.unique(contexts, return_inverse=True)
            pairs, n = _added((at.astype(U64) << U64(40)) | _ids(tokens))
            context, ids = (pairs >> U64(40)).astype(np.int64), pairs & _LOW
            shard = layout.of_keys(layout.keys(before[context], ids))
            order = np.argsort(shard, kind="stable")
            context, ids, n = context[order], ids[order], n[order]
            edges = np.searchsorted(shard[order], np.arange(2**layout.bits + 1))
            for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
                if b > a:
                    own, each = _added(context[a:b])
                    out.append(("b", s, _packed(before[own], each.astype(np.uint32), ids[a:b].astype(np.uint32), (ids[a:b] >> U64(32)).astype(np.uint8), *_narrow(n[a:b]))))
                if len(out) >= 64:
                    yield _rows(out)
                    out = []
            if out:
                yield _rows(out)

    return run


def _by_shard(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, list[bytes]]]:
    at, held = None, []
    for batch in batches:
        for kind, shard, blob in zip(*(c.to_pylist() for c in batch.columns)):
            if (kind, shard) != at:
                if held:
                    yield *at, held
                at, held = (kind, shard), []
            held.append(blob)
    if held:
        yield *at, held


def _save(folder: str, name: str, raw: bytes) -> None:
    """A file of the model appears whole or not at all, whatever becomes of the task; another attempt's is the same."""
    part = os.path.join(folder, f".{name}-{uuid.uuid4().hex}")
    with open(part, "wb") as f:
        f.write(raw)
    os.replace(part, os.path.join(folder, name))


def _spectrum(counts: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(counts, 5), minlength=6)[1:5].astype(np.int64)


def _add_pairs(layout: Layout, folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's bigrams become a file; on go how many contexts each word has here (c), hot contexts' sums (h) and
        how many bigrams occur once to four times, and in all (s). Words' counts (w) are added and go on."""
        for kind, shard, blobs in _by_shard(batches):
            if kind == "w":
                parts = [_unpacked(b, _WORDS) for b in blobs]
                words, n = _added(np.concatenate([p[0] for p in parts]), np.concatenate([_wide(*p[1:]) for p in parts]))
                yield _rows([("w", shard, _packed(words, *_narrow(n)))])
                continue
            parts = [_unpacked(b, _PAIRS) for b in blobs]
            before, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            at = np.repeat(at, np.concatenate([p[1] for p in parts])).astype(U64)
            ids = np.concatenate([p[2] for p in parts]).astype(U64) | np.concatenate([p[3] for p in parts]).astype(U64) << U64(32)
            pairs, n = _added((at << U64(40)) | ids, np.concatenate([_wide(*p[4:]) for p in parts]))
            del parts, at, ids
            context, ids = (pairs >> U64(40)).astype(np.int64), pairs & _LOW
            keys = layout.keys(before[context], ids)
            order = np.argsort(keys)
            total = np.bincount(context, n, len(before)).astype(np.uint64)
            kinds = [np.bincount(context, (n == k) if k < 3 else (n >= 3), len(before)).astype(np.uint32) for k in (1, 2, 3)]
            hot = layout.is_hot(before)
            _save(folder, f"pairs-{shard}", _packed(keys[order], *_narrow(n[order]), before[~hot], total[~hot], *(k[~hot] for k in kinds)))
            out = [("h", 0, _packed(before[hot], total[hot], *(k[hot].astype(np.uint64) for k in kinds))), ("s", 0, _packed(np.append(_spectrum(n), len(n))))]
            words, n = _added(ids)
            edges = np.searchsorted(layout.of_words(words), np.arange(2**layout.bits + 1))
            out += [("c", s, _packed((words[a:b]).astype(np.uint32), (words[a:b] >> U64(32)).astype(np.uint8), *_narrow(n[a:b]))) for s, (a, b) in enumerate(zip(edges[:-1], edges[1:])) if b > a]
            yield _rows(out)

    return run


def _add_words(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A shard's words with their counts and their numbers of contexts become a file; on go tokens and words, and
        how many words have one to four contexts, and the contexts in all (s)."""
        held: dict[int, list] = {}
        for kind, shard, blobs in _by_shard(batches):
            mine = held.setdefault(shard, [])
            if kind == "c":  # sorted before w
                parts = [_unpacked(b, (np.uint32, np.uint8, *_COUNTS)) for b in blobs]
                ids = np.concatenate([p[0] for p in parts]).astype(U64) | np.concatenate([p[1] for p in parts]).astype(U64) << U64(32)
                mine += _added(ids, np.concatenate([_wide(*p[2:]) for p in parts]))
                continue
            words, *n = _unpacked(blobs[0], _WORDS)
            n = _wide(*n)
            ids, contexts = held.pop(shard)
            of = contexts[np.searchsorted(ids, _ids(words))]
            _save(folder, f"words-{shard}", _packed(words, n.astype(np.uint64), of.astype(np.uint32)))
            yield _rows([("s", 0, _packed(np.array([n.sum(), len(words), *_spectrum(of), of.sum()], np.int64)))])

    return run


def discounts(n: np.ndarray) -> np.ndarray:
    """What counts of 1, 2 and from 3 lose, from how many occur once to four times; in small samples within bounds."""
    n1, n2, n3, n4 = (max(float(x), 0.5) for x in n[:4])
    y = n1 / (n1 + 2 * n2)
    raw = np.array([1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3])
    return np.clip(raw, [0.1, 0.2, 0.3], [0.95, 1.9, 2.8])


class Model(NamedTuple):
    """folder: of the files; pair_discounts, word_discounts: for counts 1, 2, 3 and more; the rest are totals."""

    folder: str
    layout: Layout
    tokens: int
    words: int
    contexts: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    left_over: float
    hot: tuple

    def _file(self, name: str, kinds: tuple) -> list[np.ndarray] | None:
        """Arrays of a mapped file, opened once in a worker."""
        path = os.path.join(self.folder, name)
        if path not in _OPEN:
            if len(_OPEN) > 20_000:
                _OPEN.clear()
            _OPEN[path] = _unpacked(np.memmap(path, np.uint8, "r"), kinds) if os.path.exists(path) else None
        return _OPEN[path]

    def _each(self, shards: np.ndarray) -> Iterator[tuple[int, int, int]]:
        edges = np.flatnonzero(np.concatenate(([True], shards[1:] != shards[:-1], [True]))) if len(shards) else []
        for a, b in zip(edges[:-1], edges[1:]):
            yield int(shards[a]), a, b

    def of_words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count and probability without context of each of sorted distinct words."""
        count, contexts = np.zeros(len(hashes), np.int64), np.zeros(len(hashes), np.int64)
        for shard, a, b in self._each(self.layout.of_words(_ids(hashes))):
            if held := self._file(f"words-{shard}", (np.uint64, np.uint64, np.uint32)):
                at = np.minimum(np.searchsorted(held[0], hashes[a:b]), len(held[0]) - 1)
                found = held[0][at] == hashes[a:b]
                count[a:b][found] = held[1][at[found]]
                contexts[a:b][found] = held[2][at[found]]
        less = np.where(contexts > 0, self.word_discounts[np.clip(contexts, 1, 3) - 1], 0)
        return count, (contexts - less) / max(1, self.contexts) + self.left_over / (self.words + 1)

    def of_pairs(self, contexts: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each bigram: the share of its own discounted count, and the context's weight of what has none."""
        own, weight = np.zeros(len(tokens)), np.ones(len(tokens))
        before, at = np.unique(contexts, return_inverse=True)
        total, left = np.zeros(len(before)), np.ones(len(before))

        def enter(to: np.ndarray, held: list[np.ndarray], pick: np.ndarray) -> None:
            sums = held[1][pick].astype(float)
            total[to] = sums
            left[to] = sum(d * held[2 + k][pick] for k, d in enumerate(self.pair_discounts)) / sums

        lead = mix(before + U64(3)) >> U64(64 - self.layout.bits)
        order = np.argsort(lead, kind="stable")
        for shard, a, b in self._each(lead[order].astype(np.int64)):
            if held := self._file(f"pairs-{shard}", _SHARD):
                mine = order[a:b]
                if len(held[4]):
                    to = np.minimum(np.searchsorted(held[4], before[mine]), len(held[4]) - 1)
                    found = held[4][to] == before[mine]
                    enter(mine[found], held[4:], to[found])
        if len(self.hot[0]):
            to = np.minimum(np.searchsorted(self.hot[0], before), len(self.hot[0]) - 1)
            found = np.flatnonzero(self.hot[0][to] == before)
            enter(found, self.hot, to[found])
        keys = self.layout.keys(contexts, _ids(tokens))
        distinct, back = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(distinct), np.int64)
        for shard, a, b in self._each(self.layout.of_keys(distinct)):
            if held := self._file(f"pairs-{shard}", _SHARD):
                to = np.minimum(np.searchsorted(held[0], distinct[a:b]), len(held[0]) - 1)
                n = np.where(held[0][to] == distinct[a:b], held[1][to], 0).astype(np.int64)
                large = np.flatnonzero(n == 255)
                n[large] = held[3][np.searchsorted(held[2], to[large])]
                counts[a:b] = n
        counts = counts[back]
        seen = (counts > 0) & (total[at] > 0)
        own[seen] = (counts[seen] - self.pair_discounts[np.minimum(counts[seen], 3) - 1]) / total[at][seen]
        weight = left[at]
        return own, weight

    def score(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Tokens, known tokens, base score and score of runs of texts in order."""
        for _, _, tokens, contexts, bounds in _tokens(texts):
            words, at = np.unique(tokens, return_inverse=True)
            count, alone = self.of_words(words)
            base = np.log10((count + 1) / (self.tokens + self.words + 1))[at]
            own, weight = self.of_pairs(contexts, tokens)
            score = np.log10(own + weight * alone[at])
            add = lambda x: np.add.reduceat(x, bounds[:-1])  # noqa: E731  every text has END at least
            yield np.diff(bounds), add((count[at] > 0).astype(np.int64)), add(base), add(score)


_OPEN: dict[str, list[np.ndarray] | None] = {}
_SHARD = (np.uint64, *_COUNTS, np.uint64, np.uint64, np.uint32, np.uint32, np.uint32)


def _local(path: str) -> str:
    """A folder's path in the file system. The method maps files into memory, so the shared folder has to be mounted."""
    url = urlparse(path)
    if url.scheme not in ("", "file"):
        raise ValueError(f"the model's folder has to be mounted on all workers, {path} is not a path of a file system")
    return url.path


def train(docs: DataFrame, text_col: str = "text") -> Model:
    """Counts all rows of docs (null: empty text) and leaves the model in the shared folder."""
    spark = docs.sparkSession
    folder = _local(new_folder(spark, "language-model"))
    os.makedirs(folder)
    texts = small_batches(docs).select(F.col(text_col).cast("string").alias("text"))
    # At most 2 * HOT rows leave a buffer; of their sums those of at least half of 1/HOT, so at most 2 * HOT, arrive.
    sums = texts.mapInArrow(_common, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    common = {r["id"]: r["n"] for r in sums.orderBy(F.desc("n")).limit(2 * HOT + 1).collect()}
    tokens = common.pop(-1, 0)
    hot = np.array(sorted(i for i, n in common.items() if n * HOT >= tokens), U64)
    layout = Layout(min(MOST_BITS, max(2, (tokens // PER_SHARD).bit_length())), hot)
    parts = min(2**layout.bits, MOST_PARTS)
    blobs = texts.mapInArrow(_count(layout), BLOB)
    added = blobs.repartition(parts, "kind", "shard").sortWithinPartitions("kind", "shard").mapInArrow(_add_pairs(layout, folder), BLOB)
    added = kept(added, "language-model-counts")
    words = added.filter("kind in ('c', 'w')").repartition(parts, "shard").sortWithinPartitions("shard", "kind").mapInArrow(_add_words(folder), BLOB)
    # Sums of fixed size: one row for each shard, of at most 12 KB for hot contexts and 56 bytes else.
    of_words = [_unpacked(bytes(r["blob"]), (np.int64,))[0] for r in words.collect()]
    of_pairs = [_unpacked(bytes(r["blob"]), (np.int64,))[0] for r in added.filter("kind = 's'").select("blob").collect()]
    of_hot = [_unpacked(bytes(r["blob"]), (np.uint64,) * 5) for r in added.filter("kind = 'h'").select("blob").toLocalIterator()]
    n_tokens, n_words, *spectrum, contexts = np.sum(of_words, axis=0).tolist() if of_words else [0] * 7
    pair = discounts(np.sum(of_pairs, axis=0) if of_pairs else np.zeros(5))
    word = discounts(np.array(spectrum))
    many = n_words - spectrum[0] - spectrum[1]
    left_over = float(word @ np.array([spectrum[0], spectrum[1], many])) / contexts if contexts else 1.0
    sums = [np.zeros(len(hot), np.uint64) for _ in range(4)]
    for ids, *values in of_hot:
        for s, v in zip(sums, values):
            np.add.at(s, np.searchsorted(hot, ids), v)
    present = sums[0] > 0
    return Model(folder, layout, n_tokens, n_words, contexts, pair, word, left_over, (hot[present], *(s[present] for s in sums)))


def scored(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score (log10 probability of the whole text)."""
    schema = pa.schema([("id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                runs = (x for _, texts in text_slices(batch.column(1)) for x in model.score(texts))
                n, known, base, score = (np.concatenate(x) for x in zip(*runs))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.tokens)), pa.array(base), pa.array(score)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(run, "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)


def digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Trains on the rows whose crc32(id as text) mod 7 is not 2 and scores all. A null id counts as an empty text and
    is trained on; null and empty texts have the end token alone; repeated rows count as often as they come; other
    columns are not read; an empty table gives an empty result."""
    held_out = (F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % MODULUS) == HELD_OUT
    out = scored(docs, train(docs.filter(~held_out), text_col), id_col, text_col)
    return out.select(id_col, held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
