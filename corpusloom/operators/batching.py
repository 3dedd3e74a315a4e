"""Batches of samples by length, as relations (batch_id, pos, key), over the whole table.

What a batch holds depends on the sorted lengths alone. So batches are planned on the lengths' counts (as many numbers
as there are different lengths, whatever the number of rows), by arithmetic for all rows of a length at once; rows then
take their places by their rank in order of length and key. No task holds more than its slice of the rows, and results
are those of going through all rows one by one.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import keyed, ranks
from corpusloom.session import cut

#: Lengths of a plan up to which it is broadcast; a longer plan is joined by shuffle.
BROADCAST_LENGTHS = 200_000


def even(df: DataFrame, order: list[str | Column], size: int, drop_last: bool = False) -> DataFrame:
    """Batches of near equal size: n = max(rows // size, 1) batches, batch i has rows i * rows // n on. With drop_last
    all have the size and the tail goes."""
    rows = df.count()
    ranked, r = ranks.numbered(df, order, "_r"), F.col("_r")
    if drop_last:
        return ranked.withColumns({"batch_id": F.floor(r / size), "pos": r % size}).filter(F.col("batch_id") < rows // size).drop("_r")
    n = max(rows // size, 1)
    batch = F.floor(((r + 1) * n - 1) / rows)
    return ranked.withColumns({"batch_id": batch, "pos": r - F.floor(batch * rows / n)}).drop("_r")


# --- plans: lists of [size of a batch, how many such batches follow each other], shortest rows first


def _closed(out: list[list[int]], size: int, n: int = 1) -> None:
    if n:
        if out and out[-1][0] == size:
            out[-1][1] += n
        else:
            out.append([size, n])


def plan_bins(counts: dict[int, int], bins: int, least: int = 1, padding: bool = True) -> list[list[int]]:
    """A row is added, and the batch is closed if it then takes more than bins (rows times the longest, or the sum
    without padding) and has at least `least` rows: the row that overflows stays in."""
    out: list[list[int]] = []
    n = total = 0
    for length, left in sorted(counts.items()):
        while left:
            room = bins - (0 if padding else total)
            over = max(0, room // length + 1) if length else left + n + 1  # rows of this length that are too much
            need = max(1, max(over, least) - n if padding else max(over, least - n))
            if need > left:
                n, total, left = n + left, total + left * length, 0
            elif n:
                _closed(out, n + need)
                n, total, left = 0, 0, left - need
            else:
                _closed(out, need, left // need)
                n = total = 0
                n, total, left = left % need, left % need * length, 0
    _closed(out, n, int(n > 0))
    return out


def plan_buckets(counts: dict[int, int], tokens: int) -> list[list[int]]:
    """A row that would make a bucket's padded size exceed tokens begins a new bucket."""
    out: list[list[int]] = []
    n = 0
    for length, left in sorted(counts.items()):
        most = max(1, tokens // length) if length else n + left
        more = min(left, max(0, most - n))
        if n and more < left:
            _closed(out, n + more)
            n, left = 0, left - more
        if n:
            n += left
        elif left:
            full = (left - 1) // most  # the last one stays open
            _closed(out, most, full)
            n = left - full * most
    _closed(out, n, int(n > 0))
    return out


def plan_folds(counts: dict[int, int], size: int, fold: int, least: int = 1) -> list[list[int]]:
    """Batches whose first row, of length l, allows max(least, size // (1 + l // fold)) rows."""
    out: list[list[int]] = []
    n = allowed = 0
    for length, left in sorted(counts.items()):
        more = min(left, allowed - n)
        n, left = n + more, left - more
        if left:
            _closed(out, n, int(n > 0))
            allowed = max(least, size // (1 + length // fold))
            full = (left - 1) // allowed
            _closed(out, allowed, full)
            n = left - full * allowed
    _closed(out, n, int(n > 0))
    return out


def spread_tail(sizes: list[list[int]], least: int, offset: int = 1) -> list[list[int]]:
    """If the last batch has fewer than `least` rows, they go one each to the batches before, counted back from the
    last one (offset 1) or from the one before it (offset 2); beyond the first batch it goes on with the last."""
    batches = sum(n for _, n in sizes)
    if batches < 2 or sizes[-1][0] >= least:
        return sizes
    rest = sizes[-1][0]
    batches -= 1
    tail: list[int] = []  # the batches that may get a row, last first
    out = [list(s) for s in sizes]
    out[-1][1] -= 1
    while out and len(tail) < min(batches, rest + offset):
        if not out[-1][1]:
            out.pop()
            continue
        out[-1][1] -= 1
        tail.append(out[-1][0])
    out = [s for s in out if s[1]]
    for i in range(rest):
        tail[(i % batches + offset - 1) % batches] += 1
    for size in reversed(tail):
        _closed(out, size)
    return out


class Part(NamedTuple):
    """Rows of places first..last - 1 in order of length and key: batch onwards, so many rows each."""

    first: int
    last: int
    batch: int
    size: int


def _parts(sizes: list[list[int]]) -> Iterator[Part]:
    at = batch = 0
    for size, n in sizes:
        yield Part(at, at + size * n, batch, size)
        at, batch = at + size * n, batch + n


def _by_length(counts: dict[int, int], parts: Iterable[Part]) -> Iterator[tuple[int, list[Part]]]:
    """The parts in which the rows of each length are, in order."""
    parts = list(parts)
    at = k = 0
    for length, n in sorted(counts.items()):
        while k < len(parts) and parts[k].last <= at:
            k += 1
        end, mine = k, []
        while end < len(parts) and parts[end].first < at + n:
            mine.append(parts[end])
            end += 1
        yield length, mine
        at += n


def _counts(df: DataFrame, length: str) -> dict[int, int]:
    """How many rows have each length: as many numbers as there are different lengths."""
    return {int(r[0]): r[1] for r in df.groupBy(F.col(length).cast("bigint")).agg(F.count("*")).collect()}


def _placed(df: DataFrame, key: str, length: str, of_length: Iterable[tuple[int, list[Part]]], batch: str = "batch_id") -> DataFrame:
    """df with batch and pos by a plan."""
    rows = [(n, [tuple(p) for p in mine]) for n, mine in of_length]
    plan = df.sparkSession.createDataFrame(rows, "_length bigint, _parts array<struct<first:bigint,last:bigint,batch:bigint,size:bigint>>")
    if len(rows) <= BROADCAST_LENGTHS:
        plan = F.broadcast(plan)
    ranked = ranks.numbered(df, [F.col(length).cast("bigint"), key], "_r")
    r = F.col("_r")
    mine = F.filter("_parts", lambda p: (p["first"] <= r) & (r < p["last"]))[0]
    found = ranked.join(plan, F.col(length).cast("bigint") == F.col("_length")).withColumn("_mine", mine)
    at = r - F.col("_mine.first")
    return found.withColumns({batch: F.col("_mine.batch") + F.floor(at / F.col("_mine.size")), "pos": at % F.col("_mine.size")}).drop("_r", "_length", "_parts", "_mine")


def by_bins(df: DataFrame, key: str, length: str, bins: int, least: int = 1, padding: bool = True) -> DataFrame:
    """Batches of plan_bins; a last one of fewer than `least` rows is spread over those before."""
    counts = _counts(df, length)
    return _placed(df, key, length, _by_length(counts, _parts(spread_tail(plan_bins(counts, bins, least, padding), least))))


def by_buckets(df: DataFrame, key: str, length: str, tokens: int) -> DataFrame:
    """Buckets of plan_buckets; rows longer than tokens are left out."""
    fit = df.filter(F.col(length) <= tokens)
    counts = _counts(fit, length)
    return _placed(fit, key, length, _by_length(counts, _parts(plan_buckets(counts, tokens))))


def by_folds(df: DataFrame, key: str, length: str, size: int, fold: int, least: int = 1) -> DataFrame:
    """Batches of plan_folds; a last one of fewer than `least` rows is spread over those before, from the last but one
    on."""
    counts = _counts(df, length)
    return _placed(df, key, length, _by_length(counts, _parts(spread_tail(plan_folds(counts, size, fold, least), least, 2))))


# --- balanced and weighted batches


def category_balanced(df: DataFrame, key: str, category: str, size: int, seed: int = 0) -> DataFrame:
    """df with batch_id and pos: batches of `size` with as many rows of each category as fit, size // categories + 1
    (one if there are no fewer categories than that). Rows of a category go in a fixed shuffle; batches that the
    categories left cannot fill are not made."""
    categories = df.select(category).distinct().count()
    each = 1 if categories >= size else size // max(1, categories) + 1
    order = keyed.hashed_order(key, seed)
    dealt = keyed.within_group(df, category, [order, key], "_r").withColumn("batch_id", F.floor(F.col("_r") / each)).drop("_r", "_size")
    w = Window.partitionBy("batch_id")  # of at most categories * each rows
    placed = dealt.withColumns({"pos": (F.row_number().over(w.orderBy(order, key)) - 1).cast("bigint"), "_n": F.count("*").over(w)})
    return placed.filter((F.col("_n") >= size) & (F.col("pos") < size)).drop("_n")


def power_draws(df: DataFrame, key: str, group: list[str], weights: DataFrame, draws: int, seed: int = 0, others: Sequence[str] = ()) -> DataFrame:
    """(draw, group..., key, others...): `draws` draws of a group by its weight p (weights: group..., p; few rows, adding up to
    1), each taking the group's next row in a fixed shuffle, from the first again after the last."""
    rows = sorted(map(tuple, weights.select(*group, "p").collect()))
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / 2**32
    ends = list(accumulate(r[-1] for r in rows))
    chosen = F.lit(len(rows) - 1)
    for i in range(len(rows) - 2, -1, -1):
        chosen = F.when(u < ends[i], F.lit(i)).otherwise(chosen)
    drawn = df.sparkSession.range(draws).select(F.col("id").alias("draw")).withColumn("_g", chosen)
    drawn = keyed.within_group(drawn, "_g", ["draw"], "_nth").drop("_size")
    named = df.sparkSession.createDataFrame([(i, *r[:-1]) for i, r in enumerate(rows)], "_g int, " + ", ".join(f"{g} {dict(df.dtypes)[g]}" for g in group))
    pool = df.join(F.broadcast(named), group).select("_g", key, *group, *others)
    pool = keyed.within_group(pool, "_g", [keyed.hashed_order(key, seed), key], "_place")
    sizes = pool.select(F.col("_g").alias("_of"), F.col("_size")).distinct()
    turn = drawn.join(F.broadcast(sizes), F.col("_g") == F.col("_of")).withColumn("_place", F.col("_nth") % F.col("_size")).select("draw", "_g", "_place")
    return turn.join(pool.drop("_size"), ["_g", "_place"]).select("draw", *group, key, *others)


# --- packing

#: Fixed value: a bin that is so full is shut.
FULL = 0.995


def plan_best_fit(counts: dict[int, int], capacity: int, full: float = FULL) -> dict[int, list[Part]]:
    """Best fit, longest rows first, on counts: each goes where the least room is left that it fits, and a bin that is
    `full` is shut. Bins that are alike are filled as one run. Parts of each length; first and last count its rows."""
    shut = int((1 - full) * capacity)
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first bin, how many)
    rooms: list[int] = []
    out: dict[int, list[Part]] = {}
    bins = 0

    def leave(left: int, first: int, n: int) -> None:
        if n and left > shut:
            if left not in room:
                room[left] = []
                insort(rooms, left)
            insort(room[left], (first, n))

    for length in sorted(counts, reverse=True):
        if not 0 <= length <= capacity:
            raise ValueError(f"length {length} does not fit")
        todo, done, mine = counts[length], 0, out.setdefault(length, [])
        while todo:
            at = bisect_left(rooms, length)
            fresh = at == len(rooms)
            left = capacity if fresh else rooms[at]
            each = max(1, min(left // length, -(-(left - shut) // length))) if length else todo
            if fresh:
                first, n = bins, -(-todo // each)
                bins += n
            else:
                first, n = room[left].pop(0)  # of equal bins the earliest
                if not room[left]:
                    del room[left], rooms[at]
            filled = min(n, todo // each)
            if filled:
                mine.append(Part(done, done + filled * each, first, each))
                leave(left - each * length, first, filled)
                done, todo = done + filled * each, todo - filled * each
            spare = todo if filled < n and todo < each else 0  # goes to one more bin
            if spare:
                mine.append(Part(done, done + spare, first + filled, spare))
                leave(left - spare * length, first + filled, 1)
                done, todo = done + spare, 0
            if not fresh:
                leave(left, first + filled + bool(spare), n - filled - bool(spare))
    return out


def packed(df: DataFrame, key: str, length: str, capacity: int) -> DataFrame:
    """df with bin_id by best fit over the whole table; rows longer than the capacity are left out."""
    fit = df.filter(F.col(length).between(0, capacity))
    counts = _counts(fit, length)
    plan = plan_best_fit(counts, capacity)
    at, shifted = 0, []
    for n in sorted(counts):
        shifted.append((n, [Part(at + p.first, at + p.last, p.batch, p.size) for p in plan[n]]))
        at += counts[n]
    return _placed(fit, key, length, shifted, "bin_id").drop("pos")


def fitted(lengths: Iterable[int], capacity: int, full: float = FULL) -> list[int]:
    """Bin of each length in the order given, each into the bin with the least room that it fits."""
    shut = int((1 - full) * capacity)
    room: list[tuple[int, int]] = []
    out: list[int] = []
    bins = 0
    for n in lengths:
        at = bisect_left(room, (n, -1))
        left, b = room.pop(at) if at < len(room) else (capacity, bins)
        bins += b == bins
        out.append(b)
        if left - n > shut:
            insort(room, (left - n, b))
    return out


def mixed_order(lengths: list[int], shuffled: list, strata: int = 64) -> list[int]:
    """Places of rows in turn from strata of length: the longest, the shortest, the second longest and so on, each in
    the order of `shuffled`. lengths are in order."""
    n = len(lengths)
    strata = min(strata, n)
    of = [[] for _ in range(strata)]
    for i in range(n):
        of[i * strata // n].append(i)
    for s in of:
        s.sort(key=lambda i: shuffled[i])
    turn = [of[-1 - k // 2] if k % 2 == 0 else of[k // 2] for k in range(strata)]
    return [s[i] for i in range(max(map(len, turn), default=0)) for s in turn if i < len(s)]


def packed_mixed(df: DataFrame, key: str, length: str, capacity: int, per_shard: int = 100_000) -> DataFrame:
    """(bin_id, key, length): bins that mix long and short rows. Shards of about per_shard rows are packed one by one
    in the mixed order; bins that are not full are opened, and their rows packed again in fewer shards, until one shard
    holds them or hardly any bin gets full. Rows longer than the capacity are left out."""
    rows = df.select(F.col(key).cast("bigint").alias(key), F.col(length).cast("bigint").alias(length)).filter(F.col(length).between(0, capacity))
    schema = f"bin_id string, {key} bigint, {length} bigint, used bigint"

    def packer(stage: int):
        def pack(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values([length, key]).reset_index(drop=True)
            turn = mixed_order(pdf[length].tolist(), pdf["_h"].tolist())
            pdf = pdf.iloc[turn].reset_index(drop=True)
            bins = pd.Series(fitted(pdf[length].tolist(), capacity))
            used = pdf[length].groupby(bins).transform("sum")
            return pd.DataFrame({"bin_id": [f"{stage}-{pdf['_shard'].iloc[0]}-{b}" for b in bins], key: pdf[key], length: pdf[length], "used": used})

        return pack

    done, stage = None, 0
    left = rows.count()
    while True:
        shards = max(1, -(-left // per_shard))
        dealt = rows.withColumns({"_h": F.md5(F.col(key).cast("string")), "_shard": F.pmod(F.xxhash64(key, F.lit(stage)), F.lit(shards))})
        now = dealt.groupBy("_shard").applyInPandas(packer(stage), schema)
        if shards > 1:
            now = cut(now)
        full = F.col("used") >= int(FULL * capacity)
        rest = now.filter(~full).count() if shards > 1 else 0
        if shards == 1 or rest > 0.9 * left:
            now = now.drop("used")
            return now if done is None else done.unionByName(now)
        part = now.filter(full).drop("used")
        done = part if done is None else done.unionByName(part)
        rows, left, stage = now.filter(~full).select(key, length), rest, stage + 1
