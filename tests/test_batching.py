"""Batches and bins against going through all rows one by one."""

import hashlib
import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import batching, ranks, sequential
from corpusloom.plans import registry


def one_by_one(lengths, closes_after):
    """Sizes of batches of which closes_after(rows so far) says whether they end there."""
    out, now = [], []
    for n in lengths:
        now.append(n)
        if closes_after(now):
            out.append(len(now))
            now = []
    return out + [len(now)] * bool(now)


def buckets(lengths, tokens):
    out, n = [], 0
    for x in lengths:
        if n and x * (n + 1) > tokens:
            out.append(n)
            n = 0
        n += 1
    return out + [n] * bool(n)


def folds(lengths, size, fold, least):
    out, at = [], 0
    while at < len(lengths):
        out.append(min(len(lengths) - at, max(least, size // (1 + lengths[at] // fold))))
        at += out[-1]
    return out


def spread(sizes, least, offset):
    sizes = list(sizes)
    if len(sizes) > 1 and sizes[-1] < least:
        for i in range(sizes.pop()):
            sizes[(-(i % len(sizes)) - offset) % len(sizes)] += 1
    return sizes


def best_fit(lengths, capacity):
    shut, active, bins = int((1 - 0.995) * capacity), [], []
    for n in sorted(lengths, reverse=True):
        fits = [x for x in active if x[0] >= n]
        left, b = min(fits) if fits else (capacity, len(bins))
        if fits:
            active.remove((left, b))
        else:
            bins.append([])
        bins[b].append(n)
        if left - n > shut:
            active.append((left - n, b))
    return sorted(sorted(b) for b in bins)


def each(plan):
    return [size for size, n in plan for _ in range(n)]


@pytest.mark.parametrize("seed", range(40))
def test_plans(seed):
    rnd = random.Random(seed)
    for _ in range(25):
        lengths = sorted(rnd.choice([0, 1, 2, 3, 5, 8, 13, 40, 100, rnd.randrange(200)]) for _ in range(rnd.randrange(1, 80)))
        counts, bins, least = Counter(lengths), rnd.randrange(1, 400), rnd.randrange(1, 6)
        for padding in (True, False):
            want = one_by_one(lengths, lambda now: (len(now) * now[-1] if padding else sum(now)) > bins and len(now) >= least)  # noqa: B023
            plan = batching.plan_bins(counts, bins, least, padding)
            assert each(plan) == want and each(batching.spread_tail(plan, least)) == spread(want, least, 1)
        assert each(batching.plan_buckets(counts, bins)) == buckets(lengths, bins)
        size, fold = rnd.randrange(1, 30), rnd.randrange(1, 50)
        plan = batching.plan_folds(counts, size, fold, least)
        assert each(plan) == folds(lengths, size, fold, least) and each(batching.spread_tail(plan, least, 2)) == spread(folds(lengths, size, fold, least), least, 2)
        capacity, found = rnd.choice([200, 400, 1000, 4000]), defaultdict(list)
        for n, parts in batching.plan_best_fit(counts, capacity).items():
            assert [p.first for p in parts] == [0, *(p.last for p in parts[:-1])] and parts[-1].last == counts[n]
            for p in parts:
                for r in range(p.first, p.last):
                    found[p.batch + (r - p.first) // p.size].append(n)
        assert sorted(sorted(b) for b in found.values()) == best_fit(lengths, capacity)


@pytest.fixture
def rows(spark):
    rnd = random.Random(5)
    return [(i, rnd.choice([3, 7, 7, 7, rnd.randrange(300)])) for i in range(400)]


def batches_of(df, batch="batch_id"):
    got = defaultdict(list)
    for r in df.orderBy("n", "id").collect():
        got[r[batch]].append((r.n, r.id))
    return [got[k] for k in sorted(got)]


def cut_up(rows, sizes):
    rows, at, out = sorted((n, i) for i, n in rows), 0, []
    for s in sizes:
        out.append(rows[at : at + s])
        at += s
    return out


def test_batches_of_a_table(spark, rows, monkeypatch):
    monkeypatch.setattr(ranks, "PER_SLICE", 30)
    df, lengths = spark.createDataFrame(rows, "id long, n long"), sorted(n for _, n in rows)
    want = spread(one_by_one(lengths, lambda now: len(now) * now[-1] > 900 and len(now) >= 4), 4, 1)
    assert batches_of(batching.by_bins(df, "id", "n", 900, 4)) == cut_up(rows, want)
    assert batches_of(batching.by_buckets(df, "id", "n", 600)) == cut_up(rows, buckets(lengths, 600))
    assert batches_of(batching.by_folds(df, "id", "n", 40, 20, 3)) == cut_up(rows, spread(folds(lengths, 40, 20, 3), 3, 2))
    monkeypatch.setattr(batching, "BROADCAST_LENGTHS", 0)
    assert sorted(sorted(n for n, _ in b) for b in batches_of(batching.packed(df, "id", "n", 500), "bin_id")) == best_fit(lengths, 500)
    short = batching.by_buckets(df, "id", "n", 100)
    assert {r.id for r in short.collect()} == {i for i, n in rows if n <= 100}
    assert batching.by_bins(df.limit(0), "id", "n", 10).count() == 0 and batching.packed(df.limit(0), "id", "n", 10).count() == 0


def test_mixed_bins(spark, rows):
    df = spark.createDataFrame(rows, "id long, n long")
    for per_shard in (1000, 50):
        got = batching.packed_mixed(df, "id", "n", 900, per_shard).collect()
        used = Counter()
        for r in got:
            used[r.bin_id] += r.n
        assert sorted((r.id, r.n) for r in got) == sorted(rows) and max(used.values()) <= 900
        assert len(used) <= 1.1 * sum(n for _, n in rows) / 900 + 2
    assert batching.packed_mixed(df.limit(0), "id", "n", 10).count() == 0


def test_mixed_order():
    assert batching.mixed_order(list(range(10)), list(range(10)), 5) == [8, 0, 6, 2, 4, 9, 1, 7, 3, 5]
    assert batching.fitted([5, 9, 4, 1, 1], 10) == [0, 1, 0, 0, 1]


def test_places_and_running_sums(spark, rows, monkeypatch):
    df = spark.createDataFrame([*rows, (None, 3), (None, None)], "id long, n long")
    want = [(r, i) for r, i in enumerate(sorted([n, i] for i, n in rows))]
    for per in (10_000, 25, 2):
        monkeypatch.setattr(ranks, "PER_SLICE", per)
        got = ranks.numbered(df.dropna(), ["n", "id"]).orderBy("place").collect()
        assert [(r.place, [r.n, r.id]) for r in got] == want
        sums = ranks.running(df, ["id", "n"], df.n.isNotNull().cast("int") * 2, "s").orderBy("s").collect()
        assert sorted(r.s for r in sums) == [0, *range(2, 2 * 401 + 1, 2)] and sums[0].id is None
    for n, k in ((10, 3), (2, 5), (9, 3)):
        got = Counter(r.c for r in spark.range(n).withColumn("c", ranks.chunk(F.col("id"), n, k)).collect())
        assert [got[i] for i in range(k)] == [n // k + (i < n % k) for i in range(k)]


def test_packing_queries(spark, small):
    """The queries over whole tables, against packing row by row."""
    docs = [(r.doc_id, r.n_chars) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = registry.queries()["B10_best_fit"](spark, small).collect()
    bins = defaultdict(list)
    for r in found:
        bins[r.bin_id].append(r.n_chars)
    assert sorted((r.doc_id, r.n_chars) for r in found) == sorted((i, n) for i, n in docs if n <= 20000)
    assert sorted(sorted(b) for b in bins.values()) == best_fit([n for _, n in docs if n <= 20000], 20000)

    def mixed(rows, capacity):
        """Strata in turn, then the fullest bin that has room, one by one."""
        rows = sorted(rows, key=lambda x: (x[1], x[0]))
        k = min(64, len(rows))
        strata = [sorted((x for i, x in enumerate(rows) if i * k // len(rows) == s), key=lambda x: hashlib.md5(str(x[0]).encode()).hexdigest()) for s in range(k)]
        turn, a, b = [], 0, k - 1
        while a <= b:
            turn += [strata[b]] + ([strata[a]] if a != b else [])
            a, b = a + 1, b - 1
        held = []
        for i in range(max(map(len, turn))):
            for s in turn:
                if i < len(s):
                    room = [(capacity - sum(x for _, x in h), j) for j, h in enumerate(held)]
                    room = [x for x in room if x[0] >= s[i][1] and x[0] > int((1 - 0.995) * capacity)]
                    if room:
                        held[min(room)[1]].append(s[i])
                    else:
                        held.append([s[i]])
        return sorted(sorted(h) for h in held)

    for name, capacity in (("B11_diverse_packing", 20000), ("B12_sharded_packing", 30000)):
        found, held = registry.queries()[name](spark, small).collect(), defaultdict(list)
        for r in found:
            held[r.bin_id].append((r.doc_id, r.n_chars))
        assert sorted(map(sorted, held.values())) == mixed([x for x in docs if x[1] <= capacity], capacity)  # one shard each here


def test_balanced_groups_end_where_no_move_helps():
    rnd = random.Random(2)
    for _ in range(50):
        sizes = [(f"s{i:02}", rnd.randrange(1, 50)) for i in range(rnd.randrange(4, 20))]
        got = sequential.balanced_groups(sizes, 4)
        parts = [[n for name, n in sizes if got[name] == p] for p in range(4)]
        assert sum(parts, []) == [n for _, n in sizes]  # whole and in order
        for a, b in zip(parts[:-1], parts[1:]):
            gap = abs(sum(a) - sum(b))
            assert not a or abs((sum(b) + a[-1]) - (sum(a) - a[-1])) >= gap
            assert not b or abs((sum(a) + b[0]) - (sum(b) - b[0])) >= gap
    assert sequential.balanced_groups([("a", 1), ("b", 9), ("c", 1), ("d", 1)], 2) == {"a": 0, "b": 0, "c": 1, "d": 1}


def test_groups_for_a_size(spark, small):
    rnd = random.Random(3)
    for _ in range(4):
        sizes = [(f"g{i}", rnd.randrange(1, 40)) for i in range(9)]
        total = sum(n for _, n in sizes)
        subsets = [sum(n for k, (_, n) in enumerate(sizes) if m >> k & 1) for m in range(1 << len(sizes))]
        got = {r.g for r in sequential.groups_for_size(spark.createDataFrame(sizes, "g string, n long"), "g", "n", 0.3).collect()}
        assert abs(sum(n for g, n in sizes if g in got) - round(0.3 * total)) == min(abs(s - round(0.3 * total)) for s in subsets)
    rows = registry.queries()["R23_group_split_to_size"](spark, small).collect()
    groups = Counter((r.grp, r.split) for r in rows)
    assert len({g for g, _ in groups}) == len(groups) and len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    sizes, want = [n for _, n in groups.items()], round(0.1 * len(rows))
    reached = {0}
    for n in sizes:
        reached |= {t + n for t in reached}
    assert abs(sum(n for (_, s), n in groups.items() if s == "dev") - want) == min(abs(t - want) for t in reached)


def test_least_assignment():
    rng = np.random.default_rng(0)
    for n, m in ((1, 1), (2, 2), (3, 5), (5, 5), (6, 7)):
        for _ in range(20):
            cost = rng.integers(0, 20, (n, m)).astype(float)
            got = sequential.least_assignment(cost)
            assert len(set(got)) == n and sum(cost[i, j] for i, j in enumerate(got)) == min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))


@pytest.mark.parametrize("seed", range(4))
def test_batches_of_draws_run_on_over_blocks(spark, monkeypatch, seed):
    random = np.random.default_rng(seed)
    bins, least, most, n = [(30, 2, 5), (9, 1, 40), (10**9, 3, 7), (0, 4, 4)][seed] + ([101, 250, 140, 7][seed],)
    sizes = random.integers(0, [20, 3, 9, 5][seed], n).tolist()
    want, batch, held, total = [], 0, 0, 0
    for x in sizes:
        want.append(batch)
        held, total = held + 1, total + x
        if total > bins and held >= least or held >= most:
            batch, held, total = batch + 1, 0, 0
    monkeypatch.setattr(sequential, "BLOCK", [10, 50, 7, 100][seed])
    df = spark.createDataFrame(list(enumerate(sizes)), "draw long, n int").repartition(3)
    got = sequential.batches_of_draws(df, "draw", "n", bins, least, most).orderBy("draw").collect()
    assert [(r.draw, r.n, r.batch_id) for r in got] == list(zip(range(n), sizes, want))
