"""Toxicity by bags of subwords: a word is the mean of its character n-grams' vectors plus, if training met it often
in toxic texts, a vector of its own; a window is the mean of its words, and a linear softmax over that mean tells toxic windows. Vectors and
softmax are trained jointly in numpy.

A text is as toxic as its worst window (an extension of the averaged bag: over a whole text, one insult among a
thousand words would be averaged away). Labels are of texts, so
windows of toxic texts count as toxic if they hold a word that is far more common in toxic texts; windows of clean
texts are drawn at random and, as training goes on, where the model errs. Half of the words are replaced by misspelt
variants, which have no vector of their own, so that n-grams have to carry the meaning. As all is linear up to the
maximum, scoring needs one number for each n-gram bucket and each known word.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import pickle
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import CHUNK, mix, small_batches, stream, text_slices, word_hashes

BUCKETS_LOG2 = 18
DIM = 12
GRAMS = (3, 4, 5, 6)
#: Words in a window.
WINDOW = 3
#: Bound of the labelled sample that the classifier is fitted on: so many texts of either label, and further clean ones
#: whose words are counted; chosen by a hash of the id over all labelled rows. Texts enter whole as long as the average
#: has at most SAMPLE_CHARS characters; beyond that the longest enter as pieces of PIECE characters from all over them.
SAMPLE, MORE_CLEAN = 800, 6000
SAMPLE_CHARS = 6_000
PIECE = 500
#: Log odds from which a word tells toxic texts, where REJECT lies between the labels, and the share of clean labels
#: that may be doubted.
TELLING, MARGIN, DOUBTFUL = 2.3, 0.3, 0.015
#: Share of words that training takes for words never seen.
UNSEEN = 0.3
REJECT = 0.7

_VALUES = stream(256, 21)
_SEEDS = stream(16, 22)
_ODD = np.uint64(0xD1342543DE82EF95)
#: Bytes that words consist of: letters, digits and all of non-ASCII; the others part words.
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyz0123456789") + list(range(128, 256))] = True


def features(buf: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, word) of each n-gram, and hashes and starts of the words, of lower-cased bytes."""
    b = np.frombuffer(b" " + buf + b" " * max(GRAMS), np.uint8)
    letter = _LETTER[b]
    b = np.where(letter, b, np.uint8(32))
    edge = np.flatnonzero(letter[1:] != letter[:-1]) + 1
    start, end = edge[0::2], edge[1::2]
    word = np.cumsum(np.concatenate(([False], letter[1:] & ~letter[:-1])), dtype=np.int32) - np.int32(1)
    run = np.zeros(len(b), np.int32)  # letters from here to the end of the word
    if len(start):
        at = np.flatnonzero(letter)
        run[at] = end[word[at]] - at
    value, shift = _VALUES[b], np.uint64(64 - BUCKETS_LOG2)
    buckets, words = [], []
    hashes = np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        n = len(b) - max(GRAMS)
        h = np.zeros(n, np.uint64)
        for size in range(1, max(GRAMS) + 1):
            h = h * _ODD + value[size - 1 : size - 1 + n]
            if size in GRAMS:  # all but the first and the last byte are letters of one word
                p = np.flatnonzero(run[1 : n + 1] >= size - 2)
                buckets.append((mix(h[p] + _SEEDS[size]) >> shift).astype(np.int32))
                words.append(word[p + 1])
        if len(start):
            powers = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(b), _ODD, np.uint64))))
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * powers[: len(b)], dtype=np.uint64)))
            down = np.multiply.accumulate(np.concatenate(([np.uint64(1)], np.full(len(b), pow(int(_ODD), -1, 1 << 64), np.uint64))))
            hashes = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    return np.concatenate(buckets), np.concatenate(words), hashes, start - 1


class Model(NamedTuple):
    """bucket: logit of each n-gram bucket; known, own: hashes of known words in order, and their own logits; bias: of a
    window; empty: of a text without words; a, b: from a text's worst window to its logit."""

    bucket: np.ndarray
    known: np.ndarray
    own: np.ndarray
    bias: float
    empty: float
    a: float
    b: float

    def word_logits(self, buf: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Logit and start of each word."""
        bucket, word, hashes, start = features(buf)
        logit = np.bincount(word, self.bucket[bucket], len(start)) / np.maximum(np.bincount(word, minlength=len(start)), 1)
        if len(self.known) and len(start):
            at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
            logit += np.where(self.known[at] == hashes, self.own[at], 0)
        return logit, start

    def worst(self, texts: list[str | None]) -> np.ndarray:
        """Logit of the worst window of each text; of a window without words if it has none."""
        out = np.full(len(texts), self.empty)
        at = 0
        while at < len(texts):
            parts, size = [], 0
            for t in texts[at:]:
                parts.append((t or "").encode("utf-8", "surrogatepass").lower())
                size += len(parts[-1]) + 1
                if size > CHUNK // 2:
                    break
            if len(parts) == 1 and size > CHUNK:
                out[at] = self._worst_of_long(parts[0])
            else:
                logit, start = self.word_logits(b" ".join(parts))
                bounds = np.searchsorted(start, np.cumsum([0] + [len(p) + 1 for p in parts]))
                out[at : at + len(parts)] = self._windows(logit, bounds)
            at += len(parts)
        return out

    def _windows(self, logit: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0.0], np.cumsum(logit)))
        out = np.full(len(bounds) - 1, self.empty)
        size = np.diff(bounds)
        short = (size > 0) & (size <= WINDOW)
        out[short] = self.bias + (total[bounds[1:]] - total[bounds[:-1]])[short] / size[short]
        full = np.flatnonzero(size > WINDOW)
        if len(full):
            windows = np.concatenate((total[WINDOW:] - total[:-WINDOW], np.zeros(1)))
            pairs = np.stack((bounds[full], bounds[full + 1] - WINDOW + 1), 1).ravel()
            out[full] = self.bias + np.maximum.reduceat(windows, pairs)[0::2] / WINDOW
        return out

    def _worst_of_long(self, b: bytes) -> float:
        """A long text goes in blocks cut between words, each with the last words of the block before."""
        worst, at, carry = -np.inf, 0, np.empty(0)
        while at < len(b):
            end = min(len(b), at + CHUNK)
            if end < len(b):
                gaps = np.flatnonzero(~_LETTER[np.frombuffer(b, np.uint8, end - at, at)])
                end = at + int(gaps[-1]) + 1 if len(gaps) else end  # a word of over CHUNK bytes counts as several
            logit = np.concatenate((carry, self.word_logits(b[at:end])[0]))
            if len(logit):
                worst = max(worst, float(self._windows(logit, np.array([0, len(logit)]))[0]))
            carry, at = logit[-(WINDOW - 1) :], end
        return worst if np.isfinite(worst) else self.empty

    def score(self, texts: list[str | None]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.worst(texts) + self.b, -40, 40)))


#: What is returned without examples of both labels: every text scores 0.5 or less alike.
def _constant(rate: float) -> Model:
    p = min(max(rate, 0.01), 0.5)
    return Model(np.zeros(1 << BUCKETS_LOG2), np.empty(0, np.uint64), np.empty(0), 0.0, 0.0, 0.0, float(np.log(p / (1 - p))))


def _misspelt(word: str, rng: np.random.Generator) -> str:
    if len(word) < 4:
        return word
    i, kind = int(rng.integers(1, len(word) - 1)), int(rng.integers(5))
    return {0: word[:i] + word[i + 1 :], 1: word[:i] + word[i] + word[i:], 2: word[: i - 1] + word[i] + word[i - 1] + word[i + 1 :], 3: word[:i] + "*01345x"[int(rng.integers(7))].replace("*", "") + word[i + 1 :]}.get(kind, word[:i] + chr(97 + int(rng.integers(26))) + word[i + 1 :])


def _flat(text: str) -> str:
    """The words of a text, a space between."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass").lower(), np.uint8)
    return np.where(_LETTER[b], b, np.uint8(32)).tobytes().decode("utf-8", "replace")


def _word_features(words: Iterable[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram buckets of the words one after another, how many each word has, and the words' hashes; block by block, as
    features takes some hundred bytes for each of the text."""
    buckets, per, hashes = [np.empty(0, np.int32)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    words = iter(words)
    while some := list(islice(words, 4096)):
        bucket, word, own, start = features(" ".join(some).encode("utf-8", "surrogatepass"))
        if len(start) != len(some):
            raise AssertionError("words and features do not agree")
        buckets.append(bucket[np.argsort(word, kind="stable")])
        per.append(np.bincount(word, minlength=len(start)))
        hashes.append(own)
    return np.concatenate(buckets), np.concatenate(per), np.concatenate(hashes)


def _give_back() -> None:
    """Returns freed memory to the system where the C library can; else a worker keeps it while others need it."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _once(texts: list[str]) -> list[int]:
    """Places of texts of which no earlier one is a near copy, by eight minima of their words' hashes; else the words of
    a copied toxic text would count as common in toxic texts."""
    seen: list[dict[int, int]] = [{} for _ in range(8)]
    out, at = [], 0
    for _, _, words, bounds in word_hashes(texts):
        for a, b in zip(bounds[:-1], bounds[1:]):
            least = [int(mix(words[a:b] ^ seed).min()) for seed in _SEEDS[:8]] if b > a else [-1] * 8
            shared = Counter(s[m] for s, m in zip(seen, least) if m in s)
            if not shared or shared.most_common(1)[0][1] < 4:
                out.append(at)
                for s, m in zip(seen, least):
                    s.setdefault(m, at)
            at += 1
    return out


def fit(texts: list[str], labels: np.ndarray, more_clean: Iterable[str] = (), rounds: int = 160, seed: int = 5) -> Model:
    """The model of labelled texts, by Adagrad on windows drawn anew in each round. The further clean texts only tell
    which words are common in toxic texts by chance; they are gone through once and not held."""
    if not len(labels) or labels.min() == labels.max():
        return _constant(float(np.mean(labels)) if len(labels) else 0.01)
    rng = np.random.default_rng(seed)
    single = _once(texts)
    texts, labels = [texts[i] for i in single], labels[single]
    # Words by number, each with its features; the second half are misspelt variants of the first.
    numbers: dict[str, int] = {}
    docs = []
    for t in texts:
        docs.append(np.array([numbers.setdefault(w, len(numbers)) for w in _flat(t).split(" ") if w], np.int32))
    kept = [i for i, d in enumerate(docs) if len(d)]
    docs, labels = [docs[i] for i in kept], labels[kept]
    if not len(docs) or labels.min() == labels.max():
        return _constant(float(np.mean(labels)) if len(labels) else 0.01)
    vocabulary = list(numbers)
    n_words = len(vocabulary)
    bucket, per, hashes = _word_features(chain(vocabulary, (_misspelt(w, rng) for w in vocabulary)))
    hashes = hashes[:n_words]
    first = np.concatenate(([0], np.cumsum(per)))
    used = np.flatnonzero(np.bincount(bucket, minlength=1 << BUCKETS_LOG2))  # only buckets that occur have to be trained
    place = np.zeros(1 << BUCKETS_LOG2, np.int32)
    place[used] = np.arange(len(used))
    local = place[bucket]
    del bucket, numbers

    flat_words, bounds = np.concatenate(docs), np.concatenate(([0], np.cumsum([len(d) for d in docs])))
    doc_of = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(bounds))
    room = np.minimum(WINDOW, bounds[doc_of + 1] - np.arange(len(flat_words))).astype(np.int8)  # a window ends with its text
    del docs
    once = np.unique(doc_of.astype(np.int64) * n_words + flat_words)
    in_texts = [np.bincount((once % n_words)[labels[once // n_words] == k], minlength=n_words) for k in (0, 1)]
    doubtful = {w: i for i, w in enumerate(vocabulary) if in_texts[1][i] >= 3 and in_texts[0][i] < in_texts[1][i]}
    n_more = 0
    for t in more_clean:
        n_more += 1
        for w in doubtful.keys() & set(_flat(t).split(" ")):
            in_texts[0][doubtful[w]] += 1
    odds = np.log((in_texts[1] + 0.5) / ((labels == 1).sum() + 1)) - np.log((in_texts[0] + 0.5) / ((labels == 0).sum() + n_more + 1))
    # Also, the count has to be less likely by chance than one in all words tried (a likelihood ratio test).
    both = in_texts[0] + in_texts[1]
    share_toxic = (labels == 1).sum() / (len(labels) + n_more)
    ratio = sum(k * np.log(np.maximum(k, 1e-9) / np.maximum(both * q, 1e-9)) for k, q in ((in_texts[1], share_toxic), (in_texts[0], 1 - share_toxic)))
    telling = (odds > TELLING) & (ratio > np.log(n_words) + 2)

    def around(at: np.ndarray) -> np.ndarray:
        """A window that holds the word at each place, drawn among those there are."""
        back = rng.integers(0, WINDOW, len(at))
        return np.clip(at - back, bounds[doc_of[at]], np.maximum(bounds[doc_of[at]], bounds[doc_of[at] + 1] - WINDOW))

    bad = np.flatnonzero(telling[flat_words] & (labels[doc_of] == 1))
    # A fifth of the clean texts only tells, at the end, how toxic texts look that were not learnt from.
    unlearnt = (labels == 0) & (rng.random(len(labels)) < 0.2)
    clean = np.flatnonzero(((labels[doc_of] == 0) & ~unlearnt[doc_of]) | ((labels[doc_of] == 1) & (odds[flat_words] < 0)))
    if not len(bad) or not len(clean):
        return _constant(float(np.mean(labels)))
    untold = (labels[doc_of] == 1) & ~np.isin(doc_of, doc_of[bad])
    told, hard = bad, np.empty(0, np.int64)
    tells = np.flatnonzero(telling)
    tells_at = np.cumsum(telling) - 1  # place of a telling word among them
    vectors, own = rng.normal(0, 0.3, (len(used), DIM)), np.zeros((len(tells), DIM))
    theta = np.stack((-np.ones(DIM), np.ones(DIM))) * rng.normal(0, 0.5, DIM)
    bias = np.zeros(2)
    held = [np.full(x.shape, 1e-6) for x in (vectors, theta, bias, own)]

    def word_logits() -> np.ndarray:
        """Of the words, then of their variants."""
        of_bucket, logit = vectors @ (theta[1] - theta[0]), np.empty(2 * n_words)
        for a in range(0, 2 * n_words, 16384):
            some = first[a : a + 16385]
            logit[a : a + 16384] = np.add.reduceat(of_bucket[local[some[0] : some[-1]]], some[:-1] - some[0])
        logit /= per
        logit[tells] += own @ (theta[1] - theta[0])
        return logit

    def worst_clean(each: int) -> np.ndarray:
        """The windows of each clean text that look most toxic, as they are or misspelt."""
        of_word = word_logits()
        of_word = np.maximum(of_word[:n_words], of_word[n_words:])
        total = np.concatenate(([0.0], np.cumsum(of_word[flat_words])))
        at = np.flatnonzero((labels[doc_of] == 0) & ~unlearnt[doc_of])
        s = (total[at + room[at]] - total[at]) / room[at]
        top = np.lexsort((-s, doc_of[at]))
        d = doc_of[at][top]
        rank = np.arange(len(d)) - np.searchsorted(d, d)
        return at[top[rank < each]]

    # First the words that tell a text's label choose the windows; from then on clean windows are also chosen where
    # the model errs.
    for step in range(rounds):
        if step % 20 == 19:
            hard = np.concatenate((hard, worst_clean(3)))[-20_000:]
            if step > 40 and untold.any():  # the worst word of toxic texts without a telling one
                of_word = word_logits()[flat_words]
                at = np.flatnonzero(untold)
                at = at[np.lexsort((-of_word[at], doc_of[at]))]
                bad = np.concatenate((told, at[np.concatenate(([True], np.diff(doc_of[at]) > 0))]))
        some_bad = around(rng.choice(bad, 1500))
        some_clean = np.concatenate((around(rng.choice(clean, 2500)), rng.choice(hard, 2000) if len(hard) else hard))
        some_clean = some_clean[~np.any(telling[flat_words[np.minimum(some_clean[:, None] + np.arange(WINDOW), len(flat_words) - 1)]], axis=1) | (labels[doc_of[some_clean]] == 0)]
        chosen = np.concatenate((some_bad, some_clean))
        y = np.concatenate((np.ones(len(some_bad), np.int64), np.zeros(len(some_clean), np.int64)))
        inside = np.arange(WINDOW)[None, :] < room[chosen][:, None]
        words = flat_words[np.minimum(chosen[:, None] + np.arange(WINDOW), len(flat_words) - 1)]
        words = words + n_words * (rng.random(words.shape) < 0.5)
        distinct, at = np.unique(words[inside], return_inverse=True)
        sizes = per[distinct]
        ends = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        ids = local[np.repeat(first[distinct] - ends, sizes) + np.arange(sizes.sum())]
        named = np.flatnonzero((distinct < n_words) & telling[distinct % n_words])
        of_word = np.add.reduceat(vectors[ids], ends) / sizes[:, None]
        mine = tells_at[distinct[named]]
        of_word[named] += own[mine]
        row = np.repeat(np.arange(len(chosen)), inside.sum(1))
        part = 1 / inside.sum(1)
        # Some words count as never seen, so that such words do not look toxic.
        known = (rng.random(len(at)) >= UNSEEN) | telling[distinct[at] % n_words]
        x = np.stack([np.bincount(row, of_word[at, k] * known, len(chosen)) for k in range(DIM)], 1) * part[:, None]
        z = x @ theta.T + bias
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= np.where(y == 1, 0.5 / len(some_bad), 0.5 / max(1, len(some_clean)))[:, None]
        grad_x = (p @ theta) * part[:, None]
        grad_word = np.stack([np.bincount(at, grad_x[row, k] * known, len(distinct)) for k in range(DIM)], 1)
        held[3][mine] += grad_word[named] ** 2
        own[mine] -= 0.15 * grad_word[named] / np.sqrt(held[3][mine])
        grad_word /= sizes[:, None]
        touched, to = np.unique(ids, return_inverse=True)
        spread = np.repeat(np.arange(len(distinct)), sizes)
        grad = np.stack([np.bincount(to, grad_word[spread, k], len(touched)) for k in range(DIM)], 1)
        seen = held[0][touched] + grad * grad
        held[0][touched] = seen
        vectors[touched] -= 0.15 * grad / np.sqrt(seen)
        for value, grad, seen in ((theta, p.T @ x, held[1]), (bias, p.sum(0), held[2])):
            seen += grad * grad
            value -= 0.15 * grad / np.sqrt(seen)

    logit = np.zeros(1 << BUCKETS_LOG2)
    logit[used] = vectors @ (theta[1] - theta[0])
    order = np.argsort(hashes[tells])
    words_own = hashes[tells][order], (own @ (theta[1] - theta[0]))[order]
    model = Model(logit, *words_own, float(bias[1] - bias[0]), float(bias[1] - bias[0]), 1.0, 0.0)
    del vectors, own, held, local, doc_of, room, clean, once  # scoring takes memory of its own
    # From the worst window to the text: a logistic curve that has REJECT a little above nearly all clean texts.
    s = model.worst([texts[i] for i in kept])
    low = max(np.quantile(s[labels == 0], 1 - DOUBTFUL), np.quantile(s[unlearnt], 0.97) if unlearnt.any() else -np.inf)
    gap = max(np.quantile(s[labels == 1], 0.5) - low, 0.5)
    a = 6 / gap
    return Model(logit, *words_own, model.bias, float(np.median(s[labels == 0])), float(a), float(np.log(REJECT / (1 - REJECT)) - a * (low + MARGIN * gap)))


def remainder(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % n


def trained(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, more: int = MORE_CLEAN) -> Model:
    """Fits on at most `sample` texts of either label, and `more` clean ones for the counts of words, of ids whose remainder by 3 is not 1. Rows without a label, id
    or text are left out; of several labels of an id the largest counts."""
    usable = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isin(0, 1)).filter(remainder(id_col, 3) != 1)
    usable = usable.groupBy(id_col).agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64(id_col, F.lit(9))
    some = usable.filter("toxic = 1").orderBy(order).limit(2 * sample).unionByName(usable.filter("toxic = 0").orderBy(order).limit(2 * sample + more))
    texts = small_batches(docs).select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).filter(F.col("_text").isNotNull())
    rows = texts.join(F.broadcast(some), id_col)  # broadcast: at most so many rows
    parts = []
    for toxic, n in ((1, sample), (0, sample + more)):
        chosen = rows.filter(F.col("toxic") == toxic).withColumn("_order", order).orderBy("_order", F.xxhash64("_text")).limit(n)
        lengths = [x[0] for x in chosen.select(F.length("_text")).collect()]
        parts.append(chosen.select("toxic", "_order", pieces("_text", even_cap(lengths, n * SAMPLE_CHARS)).alias("_text")))
    # The sample is bounded and learnt from in one task, which another executor repeats if this one is lost.
    together = parts[0].unionByName(parts[1]).coalesce(1).sortWithinPartitions(F.desc("toxic"), "_order", F.xxhash64("_text")).select("toxic", "_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = ((y, t) for batch in batches for at, some in text_slices(batch.column(1)) for y, t in zip(batch.column(0).slice(at, len(some)).to_pylist(), some))
        taken: list[tuple[int, str]] = []
        clean = 0
        for y, t in found:
            taken.append((y, t))
            clean += y == 0
            if clean == sample:
                break
        model = fit([t for _, t in taken], np.array([y for y, _ in taken], np.int64), (t for _, t in found))
        del taken
        _give_back()
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    said = together.mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(said[0].model)) if said else _constant(0.01)


def even_cap(lengths: list[int], room: int) -> int:
    """The largest length to which texts have to be shortened, so that all of them together take at most `room`."""
    left = sorted(lengths)
    for i, n in enumerate(left):
        if n * (len(left) - i) > room:
            return room // (len(left) - i)
        room -= n
    return max(lengths, default=0)


def pieces(col: str, cap: int) -> Column:
    """The text, or if it has more than cap characters, pieces of it from its begin to its end at even distances, of
    about cap characters together and without the words that their ends cut."""
    n = max(2, cap // PIECE)
    begin = lambda i: F.floor(i * (F.length(col) - PIECE) / (n - 1)) + 1
    piece = lambda i: F.regexp_replace(F.substr(col, begin(i).cast("int"), F.lit(PIECE)), r"^\S*\s|\s\S*$", "")
    return F.when(F.length(col) <= cap, F.col(col)).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), piece), " "))


def scored(docs: DataFrame, model: Model, text_col: str = "text", score: str = "score") -> DataFrame:
    """docs with the score of each whole text, 0 to 1; null and empty texts score as a text without words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index(text_col))
            found = [model.score(texts) for _, texts in text_slices(column)]
            yield batch.append_column(score, pa.array(np.concatenate(found or [np.empty(0)]), pa.float64()))

    from pyspark.sql.types import DoubleType, StructField, StructType

    return small_batches(docs).mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def digest(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, held_out, score, predicted. Every row is scored, repeated rows and null ids too; columns besides id
    and text are not read, and only the text enters the score."""
    model = trained(docs, labels, id_col, text_col)
    rows = scored(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), model, "_text")
    return rows.select(F.col("_id").alias(id_col), (remainder("_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= REJECT).cast("int").alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose text scores below REJECT."""
    score = "_toxicity"
    while score in docs.columns:
        score += "_"
    return scored(docs, trained(docs, labels, id_col, text_col), text_col, score).filter(F.col(score) < REJECT).drop(score)
