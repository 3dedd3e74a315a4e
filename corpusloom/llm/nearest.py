"""Approximate nearest neighbours by multi-probe p-stable hashing (Datar et al., 2004; Lv et al., 2007).

A table's bucket is where random projections, in steps of a width, fall. A query visits its own bucket in each table and
then perturbed ones, those first whose boundaries are nearest: the order of perturbations is worked out once on the
boundaries' expected distances and applied to each query's sorted boundaries. Rows that any table proposes are ranked by
their exact distance.

Buckets are a table: each row goes to the cells of its TABLES buckets, each query to the cells of the buckets it visits,
a cell being a share of all buckets, and only what meets in a bucket is compared. A cell with many rows or queries (a hot
bucket) is dealt over as many tasks as it needs. How many projections, how wide a step and how many probes are needed is
fitted on a bounded sample, with the sample's true neighbours; the index holds every row.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import kept, stream

TABLES = 6
#: What a fit chooses from: projections of a table, width in parts of the distance to the last neighbour, most probes.
FUNCTIONS, WIDTHS, MOST_PROBES = (4, 8, 12, 16, 20), (1.0, 2.0, 4.0), 1024
#: The fit's sample: queries, whose true neighbours are looked up in all rows, and rows, which tell how many are met;
#: and the share of the true neighbours that has to be found.
FIT_QUERIES, FIT_ROWS, FIT_RECALL = 64, 4096, 0.97
NEIGHBOURS = 10
#: Entries of the index in a cell, cells at most (their counts reach the driver), and rows and queries of a cell that
#: one task compares; a task holds the queries, and CHUNK rows at once.
CELL, CELLS, ROWS, BLOCK, CHUNK = 25_000, 100_000, 50_000, 1024, 1024


def perturbations(functions: int, probes: int) -> list[list[int]]:
    """The first `probes` sets of boundary ranks (0 nearest) in order of expected squared distance, the empty one
    first. Ranks r and 2 * functions - 1 - r are the two sides of one function and never both moved."""
    k = functions
    near = [(j * (j + 1)) / (4 * (k + 1) * (k + 2)) for j in range(1, k + 1)]
    far = [1 - (2 * k + 1 - j) / (k + 1) + ((2 * k + 1 - j) * (2 * k + 2 - j)) / (4 * (k + 1) * (k + 2)) for j in range(k + 1, 2 * k + 1)]
    cost = near + far
    out: list[list[int]] = [[]]
    heap = [(cost[0], (0,))]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if all(2 * k - 1 - r not in ranks for r in ranks):
            out.append(list(ranks))
        if (last := ranks[-1]) + 1 < 2 * k:
            heapq.heappush(heap, (score + cost[last + 1], (*ranks, last + 1)))
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], (*ranks[:-1], last + 1)))
    return out


class Hashes(NamedTuple):
    """directions: dim x functions; offsets and width of their steps; odd: weights that make a key of a table's steps;
    salts: what tells the tables' keys apart."""

    directions: np.ndarray
    offsets: np.ndarray
    odd: np.ndarray
    salts: np.ndarray
    width: float
    probes: int

    def _key(self, steps: np.ndarray) -> np.ndarray:
        """Bucket keys: rows x tables, of steps rows x tables x functions."""
        with np.errstate(over="ignore"):
            return np.sum(steps.astype(np.int64).view(np.uint64) * self.odd, axis=2, dtype=np.uint64) + self.salts

    def _placed(self, vectors: np.ndarray) -> np.ndarray:
        # A step so far out that 64 bits cannot count it is held at the end.
        return np.clip(vectors @ self.directions / self.width + self.offsets, -1e18, 1e18).reshape(len(vectors), len(self.salts), len(self.odd))

    def buckets(self, vectors: np.ndarray) -> np.ndarray:
        return self._key(np.floor(self._placed(vectors)))

    def probed(self, vectors: np.ndarray) -> np.ndarray:
        """Keys of the buckets that queries visit, in order: rows x tables x probes."""
        place = self._placed(vectors)
        step = np.floor(place)
        below = place - step
        k = step.shape[2]
        order = np.argsort(np.concatenate((below, 1 - below), axis=2), axis=2, kind="stable")  # of the boundaries, nearest first
        own = self._key(step)
        sets = perturbations(k, self.probes)
        out = np.empty((*own.shape, len(sets)), np.uint64)
        with np.errstate(over="ignore"):
            moved = np.concatenate((-self.odd.view(np.int64), self.odd.view(np.int64))).view(np.uint64)
            for i, ranks in enumerate(sets):
                out[:, :, i] = own + sum((moved[order[:, :, r]] for r in ranks), np.uint64(0))
        return out


def hashes(dim: int, width: float, functions: int, probes: int, tables: int = TABLES, seed: int = 6) -> Hashes:
    rng = np.random.default_rng(seed)
    n = tables * functions
    return Hashes(rng.normal(size=(dim, n)), rng.random(n), rng.integers(1, 1 << 62, functions).astype(np.uint64) * np.uint64(2) + np.uint64(1), stream(tables, 17), width, probes)


def fitted(queries: np.ndarray, true: list[np.ndarray], rows: np.ndarray, total: int, tables: int = TABLES, target: float = FIT_RECALL) -> Hashes:
    """The cheapest hashes by which the sample queries find `target` of their true neighbours (vectors). rows: a sample
    of all `total` rows. Cost: entries met by a query, and what its probes cost."""
    far = [float(np.sqrt(((t - q) ** 2).sum(1).max())) for q, t in zip(queries, true) if len(t)]
    spread = float(np.median(far)) if far else 0.0
    scale = spread or float(np.mean(far or [0])) or float(np.sqrt((queries**2).sum(1).mean()))
    of = np.repeat(np.arange(len(queries)), [len(t) for t in true])
    near = np.concatenate([t for t in true if len(t)]) if len(of) else queries[:0]
    best: tuple[float, Hashes | None] = (np.inf, None)
    for functions in FUNCTIONS:
        for w in WIDTHS:
            h = hashes(queries.shape[1], w * scale, functions, MOST_PROBES, tables)
            probed = h.probed(queries)
            # The probe at which each true neighbour is met first, over all tables.
            same = probed[of] == h.buckets(near)[:, :, None]
            first = np.where(same.any(2), same.argmax(2), MOST_PROBES).min(1) if len(of) else np.zeros(1)
            first = np.sort(first)
            need = int(first[min(len(first) - 1, int(np.ceil(target * len(first))) - 1)]) + 1
            if need > probed.shape[2]:
                continue
            h = h._replace(probes=need)
            keys, met = h.buckets(rows), 0
            for t in range(tables):
                own = np.sort(keys[:, t])
                visited = probed[:, t, :need]
                met += int((np.searchsorted(own, visited, "right") - np.searchsorted(own, visited)).sum())
            cost = met / len(queries) / max(1, len(rows)) * total + 4.0 * tables * need
            if cost < best[0]:
                best = (cost, h)
    # Steps wider than all vectors put everything in few buckets, which any recall allows.
    return best[1] or hashes(queries.shape[1], 8 * scale * max(1.0, float(np.sqrt((rows**2).sum(1).max(initial=0))) / scale), FUNCTIONS[0], 64, tables)


class Queries(NamedTuple):
    ids: np.ndarray
    keys: np.ndarray
    vectors: np.ndarray
    squares: np.ndarray
    visited: np.ndarray  # the buckets visited, sorted
    of: np.ndarray  # the queries that visit them


def proposed(q: Queries, buckets: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Which rows a query's probes meet: queries x rows. buckets: those of the rows, row: whose they are."""
    out = np.zeros((len(q.ids), rows), bool)
    first, last = np.searchsorted(q.visited, buckets), np.searchsorted(q.visited, buckets, "right")
    n = last - first
    at = np.repeat(first - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    out[q.of[at], np.repeat(row, n)] = True
    return out


def distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Euclidean distances of pairs of rows in double precision."""
    return np.sqrt(((q - x) ** 2).sum(1))


def _nearest(q: Queries, can: np.ndarray, rows: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(query keys, row keys, row ids, distances): at least the k nearest rows of each query that it can have. Few
    pairs are ranked one by one, many by a matrix product first."""
    can &= q.ids[:, None] != ids[None, :]
    squares = (x**2).sum(1)
    slack = 1e-9 * (q.squares + squares.max())
    if np.count_nonzero(can) * 16 > can.size and len(rows) > k and np.isfinite(slack).all():
        rough = q.squares[:, None] + squares[None, :] - 2 * q.vectors @ x.T
        rough[~can] = np.inf
        # Rounding may change the order of near ties, so a little more than the k-th is kept.
        bound = np.partition(rough, k - 1, axis=1)[:, k - 1]
        can &= rough <= (bound + slack)[:, None]
    i, j = np.nonzero(can)
    return q.keys[i], rows[j], ids[j], distances(q.vectors[i], x[j])


def _least(parts: list[tuple], k: int) -> tuple[np.ndarray, ...]:
    """The k nearest rows of each query, each row once."""
    query, row, own, score = (np.concatenate([p[i] for p in parts]) for i in range(4))
    order = np.lexsort((row, own, score, query))
    query, row, own, score = query[order], row[order], own[order], score[order]
    new = np.concatenate(([True], (query[1:] != query[:-1]) | (row[1:] != row[:-1]))) if len(query) else np.zeros(0, bool)
    query, row, own, score = query[new], row[new], own[new], score[new]
    rank = np.arange(len(query)) - np.searchsorted(query, query)
    return tuple(c[rank < k] for c in (query, row, own, score))


def _vectors(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


_MET = "query long, row long, vec_id long, score double"
_MET_SCHEMA = pa.schema([("query", pa.int64()), ("row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _compared(k: int):
    """Streams blocks (cell, i, j), a block's queries first, then its rows in chunks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple | None = None
        q: Queries | None = None
        held: list[tuple] = []
        best: list[tuple] = []

        def queries() -> Queries:
            keys, ids, vectors, visited, n = (np.concatenate([h[i] for h in held]) for i in range(5))
            order = np.argsort(visited, kind="stable")
            return Queries(ids, keys, vectors, (vectors**2).sum(1), visited[order], np.repeat(np.arange(len(ids)), n)[order])

        for batch in batches:
            if not batch.num_rows:
                continue
            block = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)  # cell, i, j, row or not
            edges = [0, *(np.flatnonzero(np.any(block[1:] != block[:-1], axis=1)) + 1), batch.num_rows]
            for a, b in zip(edges[:-1], edges[1:]):
                if tuple(block[a, :3]) != at:
                    if best:
                        yield pa.RecordBatch.from_arrays([pa.array(c) for c in _least(best, k)], schema=_MET_SCHEMA)
                    at, q, held, best = tuple(block[a, :3]), None, [], []
                for lo in range(a, b, CHUNK):
                    part = batch.slice(lo, min(CHUNK, b - lo))
                    keys, ids = part.column(4).to_numpy(), part.column(5).to_numpy()
                    lists = part.column(7)
                    met, n = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
                    if not block[a, 3]:
                        held.append((keys, ids, _vectors(part.column(6)), met, n))
                        continue
                    if not held:
                        continue  # no query visits these
                    q = q or queries()
                    can = proposed(q, met, np.repeat(np.arange(len(keys)), n), len(keys))
                    best.append(_nearest(q, can, keys, ids, _vectors(part.column(6)), k))
                    if sum(len(x[0]) for x in best) > 8 * k * len(q.ids):
                        best = [_least(best, k)]
        if best:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in _least(best, k)], schema=_MET_SCHEMA)

    return run


def _visits(h: Hashes | None, vectors: np.ndarray, row: bool) -> np.ndarray:
    """Buckets of rows or of queries: one list each. Without hashes all meet in one bucket."""
    if h is None:
        return np.zeros((len(vectors), 1), np.uint64)
    return h.buckets(vectors) if row else h.probed(vectors).reshape(len(vectors), -1)


def _in_cells(rows: DataFrame, h: Hashes | None, cells: int, row: bool, slices: np.ndarray | None, copies: np.ndarray | None) -> DataFrame:
    """rows (key, id, vector) once in each cell of their buckets: (cell, own, copy, key, id, vector, buckets), dealt over
    the cell's own slices and copied for each of the other side's; without slices only the counts (cell, n)."""
    vector = rows.schema["vector"].dataType.simpleString()

    def cell_of(visited: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((visited * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(cells)

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, numbers, cells, first and last place of the buckets in the flat list below) in chunks."""
        size = CHUNK if row else 64
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, min(size, batch.num_rows - at))
                visited = _visits(h, _vectors(part.column(2)), row)
                who, cell = np.repeat(np.arange(len(visited)), visited.shape[1]), cell_of(visited).ravel().astype(np.int64)
                order = np.lexsort((cell, who))
                who, cell = who[order], cell[order]
                first = np.flatnonzero(np.concatenate(([True], (who[1:] != who[:-1]) | (cell[1:] != cell[:-1]))))
                yield part, who[first], cell[first], np.concatenate((first, [len(who)])), visited.ravel()[order]

    def counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(cells, np.int64)
        for _, _, cell, _, _ in each(batches):
            n += np.bincount(cell, minlength=cells)
        seen = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(n[seen], pa.int64())], names=["cell", "n"])

    def dealt(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, who, cell, bounds, visited in each(batches):
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(visited.view(np.int64)))
            meets = copies[cell] > 0  # nothing to compare with elsewhere
            with np.errstate(over="ignore"):
                dealt_by = (part.column(0).to_numpy().astype(np.uint64) * np.uint64(0xD1342543DE82EF95)) >> np.uint64(33)
            own = (dealt_by[who] % np.maximum(slices[cell], 1).astype(np.uint64)).astype(np.int64)
            for copy in range(int(copies[cell].max(initial=0))):
                some = np.flatnonzero(meets & (copies[cell] > copy))
                at = pa.array(who[some])
                yield pa.RecordBatch.from_arrays([pa.array(cell[some]), pa.array(own[some]), pa.array(np.full(len(some), copy)), part.column(0).take(at), part.column(1).take(at), part.column(2).take(at), lists.take(pa.array(some))], names=["cell", "own", "copy", "key", "id", "vector", "buckets"])

    if slices is None:
        return rows.mapInArrow(counts, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    return rows.mapInArrow(dealt, f"cell long, own long, copy long, key long, id long, vector {vector}, buckets array<long>")


def _met(rows: DataFrame, queries: DataFrame, h: Hashes | None, cells: int, k: int) -> DataFrame:
    """(query, row, vec_id, score): of each query the nearest rows of the buckets it visits, k of each block at least."""

    def counted(side: DataFrame, row: bool) -> np.ndarray:
        n = np.zeros(cells, np.int64)
        for r in _in_cells(side, h, cells, row, None, None).collect():  # at most CELLS rows
            n[r.cell] = r.n
        return n

    of_rows, of_queries = -(-counted(rows, True) // ROWS), -(-counted(queries, False) // BLOCK)
    order = ["cell", "i", "j", "late", "key", "id", "vector", "buckets"]
    left = _in_cells(queries, h, cells, False, of_queries, of_rows).withColumnsRenamed({"own": "j", "copy": "i"}).withColumn("late", F.lit(0).cast("long"))
    right = _in_cells(rows, h, cells, True, of_rows, of_queries).withColumnsRenamed({"own": "i", "copy": "j"}).withColumn("late", F.lit(1).cast("long"))
    both = left.select(order).unionByName(right.select(order))
    return both.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "late").mapInArrow(_compared(k), _MET)


def _best(met: DataFrame, k: int) -> DataFrame:
    """The k nearest rows of each query, each row once."""
    w = Window.partitionBy("query").orderBy("score", "vec_id", "row")
    return met.distinct().withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and vector of the rows that take part: id and vector not null, no null or non-finite component, not all 0."""
    kind = "array<float>" if dict(rows.dtypes)[vector_col] == "array<float>" else "array<double>"
    vector = F.col(vector_col).cast(kind)
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return rows.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).filter(F.col("id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists("vector", lambda x: x != 0))


def _sampled(rows: DataFrame, n: int) -> list:
    """n rows by a hash of what they hold: the same ones whatever the partitions."""
    return rows.orderBy(F.xxhash64("id", "vector"), "id", "key").limit(n).collect()


def _fit(rows: DataFrame, queries: DataFrame, total: int, k: int) -> Hashes:
    some = _sampled(queries, FIT_QUERIES)
    spark = rows.sparkSession
    sample = spark.createDataFrame([(r.key, r.id, r.vector) for r in some], queries.schema)
    true = _best(_met(rows, sample, None, 1, k), k).select("query", F.col("row").alias("key")).join(rows, "key").collect()
    by: dict[int, list] = {}
    for r in true:  # at most k for each sample query
        by.setdefault(r.query, []).append(r.vector)
    vectors = np.array([r.vector for r in some], float)
    return fitted(vectors, [np.array(by.get(r.key, []), float).reshape(-1, vectors.shape[1]) for r in some], np.array([r.vector for r in _sampled(rows, FIT_ROWS)], float), total)


def _of_length(rows: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The search among vectors of one length: (query, rank, vec_id, score)."""
    total = rows.count()
    h = _fit(rows, queries, total, k)
    cells = int(min(CELLS, max(1, TABLES * total // CELL)))
    found = kept(_best(_met(rows, queries, h, cells, k), k).drop("row"), "nearest")
    full = found.groupBy("query").agg(F.count("*").alias("n")).filter(F.col("n") >= k)
    few = kept(queries.join(full, F.col("key") == F.col("query"), "left_anti"), "few")
    if few.isEmpty():
        return found
    # An exact way for queries whose buckets hold too few rows.
    exact = _best(_met(rows, few, None, 1, k), k).drop("row")
    return found.join(few.select(F.col("key").alias("query")), "query", "left_anti").unionByName(exact)


def search(rows: DataFrame, queries: DataFrame, k: int = NEIGHBOURS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query, other than those of its own id.

    Rows whose vector is null, zero or has a null or non-finite component take no part, nor do null ids. Vectors are
    searched among those of their own length. Ties go to the smaller id. A query whose buckets hold fewer rows than k is
    held against all rows, so it gets k if there are as many. Repeated rows are rows of their own; a query that comes
    twice with one vector is one query, with several vectors one for each, under one query_id. Other columns are not
    read; without queries the result is empty. Results do not depend on partitions.
    """
    asked = kept(_usable(queries, id_col, vector_col).dropDuplicates(["id", "vector"]).withColumn("key", F.monotonically_increasing_id()).select("key", "id", "vector"), "queries")
    index = kept(_usable(rows, id_col, vector_col).withColumn("key", F.monotonically_increasing_id()).select("key", "id", "vector"), "vectors")
    size: Column = F.size("vector")
    out = None
    for (n,) in sorted(asked.select(size).distinct().collect()):  # lengths of vectors, few in any table
        part = _of_length(index.filter(size == n), asked.filter(size == n), k)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    named = asked.select(F.col("key").alias("query"), F.col("id").alias("query_id"))
    return out.join(named, "query").select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def digest(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The search for the rows whose id is divisible by 100, against all rows."""
    return search(rows, rows.filter(F.col(id_col) % 100 == 0), NEIGHBOURS, id_col, vector_col)
