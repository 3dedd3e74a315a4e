"""Operators whose rule is sequential: ordered rows streamed through a task, or grouped pandas where state is richer. All work
within a key (a recording, a speaker), never over the whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from corpusloom.operators import ranks
from corpusloom.session import cut


def streamed(df: DataFrame, key: str, order: list[str], step: Callable[[object, tuple], tuple[object, tuple]], start: object, columns: list[str], schema: str) -> DataFrame:
    """Rows of each key in order go through step(state, row) -> (state, row out); row has the values of `columns`. Only
    the state is held, so a key of any size streams through its task in constant memory."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = run  # no key yet
        state: object = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for k, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if k != at:
                    at, state = k, start
                state, made = step(state, tuple(row))
                out.append((k, *made))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.repartition(key).sortWithinPartitions(key, *order).select(key, *columns).mapInArrow(run, schema)


def groups_by_duration(df: DataFrame, key: str, order: str, duration: str, most: float, name: str = "part") -> DataFrame:
    """Numbers consecutive rows of a key so that a new part begins once the last one has more than `most` in all."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        part, used = state
        if used > most:
            part, used = part + 1, 0.0
        return (part, used + float(row[1] or 0)), (row[0], part)

    types = dict(df.dtypes)
    return streamed(df, key, [order], step, (0, 0.0), [order, duration], f"{key} {types[key]}, {order} {types[order]}, {name} bigint")


#: Draws that a task folds at once.
BLOCK = 100_000


def next_starts(sizes: np.ndarray, bins: int, least: int, most: int) -> np.ndarray:
    """For a batch begun at each row, the row after the one that closes it. A batch is closed by the row that takes it
    beyond bins if it has at least `least` rows, or that is its most-th; one that the rows end is closed after `most`."""
    sums = np.concatenate(([0], np.cumsum(sizes)))
    out, at = np.arange(len(sizes)) + most, np.arange(len(sizes))
    for n in range(most - 1, max(1, least) - 1, -1):
        fit = at[: max(0, len(at) - n + 1)]
        full = fit[sums[fit + n] - sums[fit] > bins]
        out[full] = full + n
    return out


def batches_of_draws(df: DataFrame, order: str, size: str, bins: int, least: int, most: int) -> DataFrame:
    """df with batch_id: batches of next_starts over all rows in order, which counts them from 0. No task holds more
    than a block of rows. Where a block's first batch begins, `most` places can be; tasks tell for each how many batches
    begin in the block and where the next block's first one does, the driver follows these from block to block, and
    rows are then numbered block by block."""
    if most > BLOCK:
        raise ValueError(f"a batch of {most} rows is longer than a block of {BLOCK}")
    block, place = F.floor(F.col(order) / BLOCK), F.col(order) % BLOCK
    rows = cut(df.withColumn("_block", block))
    # The first rows of a block close the last batch of the one before.
    seen = rows.select(F.explode(F.when((place < most) & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))).alias("_block"), order, F.col(size).cast("bigint").alias(size))

    def ways(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        b = int(pdf["_block"].iloc[0])
        rows_, after = int((pdf[order] < (b + 1) * BLOCK).sum()), next_starts(_whole(pdf[size]), bins, least, most).tolist()
        n, last = [0] * (rows_ + most), list(range(rows_ + most))
        for i in range(rows_ - 1, -1, -1):
            n[i], last[i] = n[after[i]] + 1, last[after[i]]
        return pd.DataFrame({"b": [b], "n": [n[:most]], "next": [[x - rows_ for x in last[:most]]]})

    first, at, batch = {}, 0, 0
    for r in seen.groupBy("_block").applyInPandas(ways, "b bigint, n array<bigint>, next array<bigint>").orderBy("b").toLocalIterator():
        first[r.b] = at, batch
        at, batch = r.next[at], batch + r.n[at]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        at, batch = first[int(pdf["_block"].iloc[0])]
        after, begins = next_starts(_whole(pdf[size]), bins, least, most).tolist(), np.zeros(len(pdf), np.int64)
        while at < len(pdf):
            begins[at], at = 1, after[at]
        return pdf.drop(columns="_block").assign(batch_id=batch - 1 + np.cumsum(begins))

    schema = StructType([*df.schema.fields, StructField("batch_id", LongType())])
    return rows.groupBy("_block").applyInPandas(fold, schema)


def _whole(sizes: pd.Series) -> np.ndarray:
    if sizes.isna().any():
        raise ValueError("a row has no size")
    return sizes.to_numpy(np.int64)


def long_form(df: DataFrame, key: str, start: str, end: str, text: str, longest: float) -> DataFrame:
    """Consecutive utterances of a recording joined greedily into stretches of at most `longest`; an utterance that is
    longer itself is left out. prev_text is the text of the stretch before, <na> for the first and after a gap that an
    utterance left out has made."""

    def step(state: tuple, row: tuple) -> tuple[tuple, tuple]:
        stretch, first, fresh = state
        s, e, t = row
        if e - s > longest:
            return (stretch, None, True), (s, e, t, None, fresh)
        if first is None or e - first > longest:
            stretch, first = stretch + 1, s
            return (stretch, first, False), (s, e, t, stretch, fresh)
        return (stretch, first, False), (s, e, t, stretch, False)

    types = dict(df.dtypes)
    schema = f"{key} {types[key]}, {start} {types[start]}, {end} {types[end]}, {text} string, _stretch bigint, _fresh boolean"
    rows = streamed(df, key, [start, end], step, (-1, None, True), [start, end, text], schema).filter("_stretch IS NOT NULL")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(start, end, text))), lambda x: x[text]), " ")  # of one stretch
    whole = rows.groupBy(key, "_stretch").agg(F.min(start).alias(start), F.max(end).alias(end), said.alias(text), F.bool_or("_fresh").alias("_fresh"))
    before = F.lag(text).over(Window.partitionBy(key).orderBy("_stretch"))
    return whole.withColumn("prev_text", F.when(F.col("_fresh"), "<na>").otherwise(before)).drop("_stretch", "_fresh")


def looked_up(df: DataFrame, key: str, tokens: str, words: DataFrame, token: str, word: str, end: str = "<eos>", unknown: str = "<unk>") -> DataFrame:
    """(key, text): tokens of each row by a table of words, unknown ones by a mark, without the end mark."""
    t = df.select(key, F.posexplode(tokens).alias("_pos", "_token")).filter(F.col("_token") != end)
    j = t.join(words.select(F.col(token).alias("_token"), F.col(word).alias("_word")), "_token", "left")
    said = F.transform(F.array_sort(F.collect_list(F.struct("_pos", F.coalesce("_word", F.lit(unknown)).alias("w")))), lambda x: x["w"])
    return j.groupBy(key).agg(F.array_join(said, " ").alias("text"))


def aligned_counts(ref: list, hyp: list) -> tuple[int, int, int, int]:
    """(hits, substitutions, deletions, insertions) of an alignment with the fewest errors, and of these with the most
    hits."""
    row = [(j, 0, 0, j) for j in range(len(hyp) + 1)]  # (errors, -hits, deletions, insertions)
    for i, a in enumerate(ref, 1):
        new = [(i, 0, i, 0)]
        for j, b in enumerate(hyp, 1):
            e, h, d, n = row[j - 1]
            both = (e, h - 1, d, n) if a == b else (e + 1, h, d, n)
            e, h, d, n = row[j]
            gone = (e + 1, h, d + 1, n)
            e, h, d, n = new[-1]
            new.append(min(both, gone, (e + 1, h, d, n + 1)))
        row = new
    errors, hits, deletions, insertions = row[-1]
    return -hits, errors - deletions - insertions, deletions, insertions


def edit_counts(ref: Column, hyp: Column) -> Column:
    """struct(hits, substitutions, deletions, insertions) of two word arrays."""

    def run(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([aligned_counts(list(r), list(h)) for r, h in zip(refs, hyps)], columns=["hits", "substitutions", "deletions", "insertions"])

    return F.pandas_udf(run, "hits bigint, substitutions bigint, deletions bigint, insertions bigint")(ref, hyp)


def evenly_spread(keys: DataFrame, order: str, n: int) -> DataFrame:
    """n of the rows in order, as even as can be by halving: the first half of the rows, rounded down, gives half of n,
    rounded down, and so on. The places depend on the numbers of rows alone, so they are worked out once and joined
    with the rows' ranks."""
    total = keys.count()
    if n > total:
        raise ValueError(f"{n} of {total} rows cannot be had")
    places: list[tuple[int]] = []
    todo = [(0, total, n)] if n else []
    while todo:
        first, rows, need = todo.pop()
        if rows == 1:
            places.append((first,))
            continue
        half = rows // 2
        todo += [x for x in ((first, half, need // 2), (first + half, rows - half, need - need // 2)) if x[2]]
    chosen = keys.sparkSession.createDataFrame(places, "_r bigint")
    return ranks.numbered(keys, [order], "_r").join(chosen, "_r", "left_semi").drop("_r")


def balanced_groups(sizes: list[tuple[str, int]], parts: int) -> dict[str, int]:
    """Whole groups, in order, dealt to parts of like numbers of groups; then a group at the end of a part goes to the
    part beside it as long as that makes the two more alike. sizes is one entry a group (speakers), not a row."""
    if len(sizes) < parts:
        raise ValueError(f"{len(sizes)} groups cannot fill {parts} parts")
    held: list[list[tuple[str, int]]] = [[] for _ in range(parts)]
    for i, x in enumerate(sizes):
        held[i * parts // len(sizes)].append(x)
    load = [sum(n for _, n in p) for p in held]

    def moves(a: int, b: int, n: int) -> bool:
        if abs((load[b] + n) - (load[a] - n)) >= abs(load[b] - load[a]):
            return False
        load[a], load[b] = load[a] - n, load[b] + n
        return True

    moved = True
    while moved:
        moved = False
        for p in range(parts):
            if p + 1 < parts and held[p] and moves(p, p + 1, held[p][-1][1]):
                held[p + 1].insert(0, held[p].pop())
                moved = True
            if p and held[p] and moves(p, p - 1, held[p][0][1]):
                held[p - 1].append(held[p].pop(0))
                moved = True
    return {name: p for p, groups in enumerate(held) for name, _ in groups}


def groups_for_size(sizes: DataFrame, group: str, n: str, share: float, most: int = 2_000_000) -> DataFrame:
    """(group, split = 'dev') of groups that together come as near to the share of all rows as can be had; of equally
    near totals the smaller, and of several ways the one that a search in order of names meets first. sizes has a row a
    group. Totals are searched exactly up to `most`; beyond, sizes are rounded to a grid of so many steps."""
    rows = sorted((r[0], int(r[1])) for r in sizes.select(group, n).collect())
    total = sum(x for _, x in rows)
    target, grid = round(total * share), max(1, -(-total // most))
    way: dict[int, tuple[int, int] | None] = {0: None}  # reached total: (the group added last, the total before)
    for i, (_, x) in enumerate(rows):
        x = round(x / grid)
        for t in [t for t in way if t + x <= 2 * target // grid + 1]:
            way.setdefault(t + x, (i, t))
    at: int = min(way, key=lambda t: (abs(t * grid - target), t))
    chosen: list[tuple[str]] = []
    while (step := way[at]) is not None:
        chosen.append((rows[step[0]][0], "dev"))
        at = step[1]
    return sizes.sparkSession.createDataFrame(chosen, f"{group} {dict(sizes.dtypes)[group]}, split string")


def least_assignment(cost: np.ndarray) -> list[int]:
    """Column of each row so that the summed cost is least (Kuhn-Munkres, in the cube of the size). rows <= columns."""
    n, m = cost.shape
    u, v, match, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], at, least, used = i, 0, np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while match[at]:
            used[at] = True
            row = match[at]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = ~used[1:] & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], at
            free = np.flatnonzero(~used[1:]) + 1
            to = free[np.argmin(least[free])]
            step = least[to]
            u[match[used]] += step
            v[used] -= step
            least[~used] -= step
            at = to
        while at:
            match[at], at = match[way[at]], way[at]
    out = [0] * n
    for j in range(1, m + 1):
        if match[j]:
            out[match[j] - 1] = j - 1
    return out


def least_permutation(df: DataFrame, utt: str, ref: str, hyp: str, errors: str, words: str) -> DataFrame:
    """(utt, errors, words): of any number of speakers' references and hypotheses (rows utt, ref, hyp, errors and the
    reference's words for each pair), the fewest errors that an assignment of hypotheses to references has. A pair that
    is not there cannot be assigned."""

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        refs, hyps = sorted(pdf[ref].unique()), sorted(pdf[hyp].unique())
        cost = np.full((len(refs), len(hyps)), 1e12)
        cost[pdf[ref].map(refs.index), pdf[hyp].map(hyps.index)] = pdf[errors]
        flat = cost if len(refs) <= len(hyps) else cost.T
        total = sum(flat[i, j] for i, j in enumerate(least_assignment(flat)))
        return pd.DataFrame({utt: [pdf[utt].iloc[0]], "errors": [int(total)], "words": [int(pdf.groupby(ref)[words].first().sum())]})

    return df.select(utt, ref, hyp, errors, words).groupBy(utt).applyInPandas(best, f"{utt} {dict(df.dtypes)[utt]}, errors bigint, words bigint")


def warped(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Dynamic time warping of two sequences of vectors: the path of least summed distance."""
    d = np.sqrt(((a[:, None, :] - b[None, :, :]) ** 2).sum(2))
    cost = np.full((len(a) + 1, len(b) + 1), np.inf)
    cost[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            cost[i + 1, j + 1] = d[i, j] + min(cost[i, j], cost[i, j + 1], cost[i + 1, j])
    i, j, path = len(a), len(b), []
    while i and j:
        path.append((i - 1, j - 1))
        i, j = min(((i - 1, j - 1), (i - 1, j), (i, j - 1)), key=lambda p: cost[p])
    return path[::-1]


def warped_scores(ref: Column, hyp: Column) -> Column:
    """Of two signals as frames (a pitch in Hz, 0 without a voice, then cepstral coefficients), after warping by the
    coefficients: f0_rmse of the logarithms of the pitch where both have a voice, mcd in decibels, vuv the share of
    frames of which one alone has a voice, and semitones the share of voiced frames that are the same semitone. Null
    where no frame counts."""

    def run(refs: pd.Series, hyps: pd.Series) -> pd.DataFrame:
        out = []
        for r, h in zip(refs, hyps):
            a, b = (np.array([np.asarray(f, float) for f in x]) for x in (r, h))
            if not len(a) or not len(b):
                out.append((None,) * 4)
                continue
            path = np.array(warped(a[:, 1:], b[:, 1:]))
            a, b = a[path[:, 0]], b[path[:, 1]]
            voiced = (a[:, 0] > 0) & (b[:, 0] > 0)
            mcd = float(np.mean(10 / np.log(10) * np.sqrt(2 * ((a[:, 1:] - b[:, 1:]) ** 2).sum(1))))
            f0 = float(np.sqrt(np.mean((np.log(a[voiced, 0]) - np.log(b[voiced, 0])) ** 2))) if voiced.any() else None
            note = lambda x: np.rint(69 + 12 * np.log2(x / 440))
            same = float(np.mean(note(a[voiced, 0]) == note(b[voiced, 0]))) if voiced.any() else None
            out.append((f0, mcd, float(np.mean((a[:, 0] > 0) != (b[:, 0] > 0))), same))
        return pd.DataFrame(out, columns=["f0_rmse", "mcd", "vuv", "semitones"])

    return F.pandas_udf(run, "f0_rmse double, mcd double, vuv double, semitones double")(ref, hyp)


def spectrogram(samples: Column, width: int = 16, hop: int = 8) -> Column:
    """Magnitudes of the Fourier transform of Hann-windowed frames, frame by frame; no frame of too short a signal."""

    def frames(xs: pd.Series) -> pd.Series:
        window = np.hanning(width + 1)[:-1]
        out = []
        for x in xs:
            x = np.asarray(x, float)
            n = max(0, (len(x) - width) // hop + 1)
            out.append([np.abs(np.fft.rfft(x[i * hop : i * hop + width] * window)).tolist() for i in range(n)])
        return pd.Series(out)

    return F.pandas_udf(frames, "array<array<double>>")(samples)


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Number, mean and sample covariance of vectors of one length. Each task adds its vectors up and emits a matrix's
    worth of sums, which are added up again before they reach the driver."""
    x = df.select(F.col(vector).cast("array<double>").alias("x")).filter("x IS NOT NULL")

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, None
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                part = np.concatenate((np.ones((len(part), 1)), part), 1)
                total = part.T @ part if total is None else total + part.T @ part
        if total is not None:
            n = len(total)
            i, j = np.divmod(np.arange(n * n), n)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    found = x.mapInArrow(sums, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    if not found:
        raise ValueError("there are no vectors")
    n = max(r.i for r in found) + 1
    both = np.zeros((n, n))
    for r in found:
        both[r.i, r.j] = r.v
    rows, mean = int(both[0, 0]), both[0, 1:] / both[0, 0]
    return rows, mean, (both[1:, 1:] - rows * np.outer(mean, mean)) / max(1, rows - 1)


def frechet_distance(a: DataFrame, b: DataFrame, vector: str) -> float:
    """Distance of two sets of vectors as normal distributions."""
    (_, m1, c1), (_, m2, c2) = moments(a, vector), moments(b, vector)
    values, vectors = np.linalg.eigh(c1)
    root = vectors @ np.diag(np.sqrt(np.clip(values, 0, None))) @ vectors.T
    both = np.sqrt(np.clip(np.linalg.eigvalsh(root @ c2 @ root), 0, None)).sum()
    return float(((m1 - m2) ** 2).sum() + np.trace(c1) + np.trace(c2) - 2 * both)


def principal_axes(df: DataFrame, vector: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, axes): the n directions of most variance, as columns; each with its largest part positive."""
    _, mean, covariance = moments(df, vector)
    _, vectors = np.linalg.eigh(covariance)
    axes = vectors[:, ::-1][:, :n]
    return mean, axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])


def projected(vector: Column, mean: np.ndarray, axes: np.ndarray) -> Column:
    """Vectors along principal axes."""

    def run(xs: pd.Series) -> pd.Series:
        x = np.array([np.asarray(v, float) for v in xs]).reshape(len(xs), -1)
        return pd.Series(((x - mean) @ axes).tolist(), dtype=object)

    return F.pandas_udf(run, "array<double>")(vector)
