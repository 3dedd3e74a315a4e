"""Near duplicates by circulant MinHash (Li and Li, 2022): banding proposes, exact Jaccard on full sets decides.

1. A pass over the texts gives each document the size of its set of five-word shingles, a 128-bit hash of the set, and
   a signature. One permutation (of the shingle hashes, cut to POSITIONS) is followed by a second, a table whose
   circular shifts give all COORDINATES; ROWS coordinates make a band.
2. Documents with equal sets become one class, so exact copies cost nothing later.
3. In each bucket of a band, every class is paired with the smallest one; pairs are confirmed on the full sets.
4. All classes that share a bucket but are not known to be connected are compared, in blocks around the bucket's
   largest component, so that no link between components is missed. Blocks hold sketches first; only classes with a
   partner that the sketch allows bring their texts. No table of pairs is made, and connected classes are not compared.
5. Components of the confirmed links, then back to documents.

A pair at the threshold shares a band but for (1 - 0.75 ** ROWS) ** BANDS = 2e-5 of cases. Set sizes and a sketch, two
bits of each of SKETCHED coordinates, rule out pairs that cannot reach the threshold inside the joins (a pair at the
threshold is ruled out in 1e-6 of cases), so that texts which only share a passage cost no text comparison.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, filtered_to, kept, mix, small_batches, stream, text_slices, word_hashes
from corpusloom.llm.components import components

WORDS, PERCENT = 5, 75
POSITIONS = 1 << 20
ROWS, BANDS = 5, 40
COORDINATES = ROWS * BANDS
#: Two sets at the threshold agree in 156 of 192 sketched coordinates on average, with a deviation of 5.4.
SKETCHED, LEAST_AGREEING = 192, 130
SKETCH = tuple(f"s{i}" for i in range(SKETCHED // 32))
#: Members compared with one hub in one task.
PER_HUB = 256
#: Members on either side of a block, and members of a group beyond which it is parted by set sizes.
BLOCK, BANDED = 256, 1024
#: Stands for a null id inside; the largest, so it never names a component that has another id.
NO_ID = (1 << 63) - 1


@lru_cache(1)
def _second() -> np.ndarray:
    """The second permutation, twice in a row, so that each circular shift is a slice."""
    p = np.argsort(stream(POSITIONS, 7), kind="stable").astype(np.uint32)
    return np.concatenate((p, p[:COORDINATES]))


def shingles(words: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a run of word_hashes."""
    weights = stream(WORDS, 3) | np.uint64(1)
    with np.errstate(over="ignore"):
        n = max(0, len(words) - WORDS + 1)
        total = np.zeros(n, np.uint64)
        for i in range(WORDS):
            total += words[i : i + n] * weights[i]
        all_of = mix(total)
        for a, b in zip(bounds[:-1], bounds[1:]):
            if b - a >= WORDS:
                yield np.unique(all_of[a : b - WORDS + 1])
            elif b > a:
                yield mix(np.sum(words[a:b] * weights[: b - a], dtype=np.uint64, keepdims=True) + np.uint64(b - a))
            else:
                yield np.empty(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """COORDINATES minima for each set that is not empty."""
    position = (mix(np.concatenate(sets) + np.uint64(11)) >> np.uint64(64 - 20)).astype(np.intp)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    second, out = _second(), np.empty((len(sets), COORDINATES), np.uint32)
    for k in range(COORDINATES):
        out[:, k] = np.minimum.reduceat(second[k : k + POSITIONS].take(position), starts)
    return out


_SKETCHED = "id long, n long, h1 long, h2 long, " + ", ".join(f"{x} long" for x in SKETCH) + ", bands array<long>"
_SCHEMA = pa.schema([("id", pa.int64()), ("n", pa.int64()), *((x, pa.int64()) for x in ("h1", "h2", *SKETCH)), ("bands", pa.list_(pa.int64()))])


def _sketched(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    weights = stream(ROWS, 5) | np.uint64(1)
    labels = stream(BANDS, 6)
    for batch in batches:
        for at, texts in text_slices(batch.column(1)):
            ids = batch.column(0).slice(at, len(texts))
            for first, last, words, bounds in word_hashes(texts):
                sets = list(shingles(words, bounds))
                n = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(n)
                columns = {x: np.zeros(len(sets), np.int64) for x in ("h1", "h2", *SKETCH)}
                bands: list = [[]] * len(sets)
                if len(full):
                    with np.errstate(over="ignore"):
                        held = [sets[i] for i in full]
                        flat, starts = np.concatenate(held), np.cumsum([0] + [len(s) for s in held[:-1]])
                        for name, seed in (("h1", 0x51), ("h2", 0x52)):
                            columns[name][full] = mix(np.add.reduceat(mix(flat + np.uint64(seed << 40)), starts)).view(np.int64)
                        sig = signatures(held).astype(np.uint64)
                        two = (mix(sig[:, :SKETCHED]) & np.uint64(3)).reshape(len(held), len(SKETCH), 32) << np.arange(0, 64, 2, dtype=np.uint64)
                        for name, value in zip(SKETCH, np.bitwise_or.reduce(two, axis=2).T):
                            columns[name][full] = value.view(np.int64)
                        keys = mix(np.sum(mix(sig + np.uint64(1)).reshape(len(held), BANDS, ROWS) * weights, axis=2, dtype=np.uint64) ^ labels).view(np.int64)
                    for i, row in zip(full, keys):
                        bands[i] = row
                yield pa.RecordBatch.from_arrays([ids.slice(first, last - first), pa.array(n), *(pa.array(columns[x]) for x in ("h1", "h2", *SKETCH)), pa.array(bands, pa.list_(pa.int64()))], schema=_SCHEMA)


def _possible(a: str, b: str) -> Column:
    """Whether two sketched classes can be similar enough, by set sizes and sketches."""
    c = lambda t, x: F.col(f"{t}.{x}")
    sizes = (c(a, "n") * 100 >= c(b, "n") * PERCENT) & (c(b, "n") * 100 >= c(a, "n") * PERCENT)
    differing = sum((F.bit_count((x := c(a, k).bitwiseXOR(c(b, k))).bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))) for k in SKETCH), F.lit(0))
    return sizes & (differing <= SKETCHED - LEAST_AGREEING)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets are alike enough: 100 * |A & B| >= PERCENT * |A | B|."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small)) if len(small) else 0
    return both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both)


def _alike(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (hub, salt, member, text) with a hub's own rows first: the pairs whose full sets are similar enough."""
    at, hubs = None, []
    for batch in batches:
        hub, salt, member = (batch.column(i).to_numpy() for i in range(3))
        found_a, found_b = [], []
        runs = ((at + first, words, bounds) for at, texts in text_slices(batch.column(3)) for first, _, words, bounds in word_hashes(texts))
        for first, words, bounds in runs:
            for i, own in enumerate(shingles(words, bounds), first):
                if (hub[i], salt[i]) != at:
                    at, hubs = (hub[i], salt[i]), []
                if member[i] == hub[i]:
                    hubs.append(own)
                    continue
                for other in hubs:
                    if similar(own, other):
                        found_a.append(member[i])
                        found_b.append(hub[i])
                        break
        yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], names=["a", "b"])


def confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, hub) whose texts' full sets are similar enough, as (a, b). texts: id, text. A hub with many
    partners is dealt over tasks in parts of PER_HUB, each with the hub's text."""
    pairs = cut(pairs)
    texts = filtered_to(texts, pairs.select(F.explode(F.array("a", "hub")).alias("id")), "id")
    parts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PER_HUB).alias("_parts"))
    dealt = pairs.join(parts, "hub").select("hub", F.pmod(F.xxhash64("a"), "_parts").cast("int").alias("salt"), F.col("a").alias("id"))
    wanted = dealt.unionByName(dealt.select("hub", "salt", F.col("hub").alias("id")).distinct())
    rows = wanted.join(texts, "id").select("hub", "salt", F.col("id").alias("member"), "text", (F.col("id") != F.col("hub")).alias("_late"))
    return rows.repartition("hub", "salt").sortWithinPartitions("hub", "salt", "_late").select("hub", "salt", "member", "text").mapInArrow(_alike, "a long, b long")


def _membership(shared: DataFrame, tied: DataFrame) -> DataFrame:
    """The buckets' members with their component so far."""
    return shared.join(tied.select(F.col("a").alias("id"), F.col("b").alias("_comp")), "id", "left").withColumn("comp", F.coalesce("_comp", "id")).drop("_comp")


def _towards_least(links: DataFrame) -> DataFrame:
    """(a, b): for each linked class the least class two steps of smallest partners away. Parts of one component may
    still bear different names; that costs comparisons later, not links."""
    step = links.groupBy("a").agg(F.min("b").alias("b"))
    then = step.select(F.col("a").alias("b"), F.col("b").alias("c"))
    return cut(step.join(then, "b", "left").select("a", F.coalesce("c", "b").alias("b")))


def _largest(members: DataFrame) -> DataFrame:
    """Of each bucket with several components: key, and the component with most members (group)."""
    parts = members.groupBy("key", "comp").agg(F.count("*").alias("size"))
    return parts.groupBy("key").agg(F.max_by("comp", F.struct("size", "comp")).alias("group"), F.count("*").alias("parts")).filter("parts > 1").drop("parts")


def _in_bands(members: DataFrame) -> DataFrame:
    """Members of groups of more than BANDED by their set sizes, as cells of a group: a size is in one band, a band is in
    two cells, and sets that can be similar are in one band or in neighbouring ones, so they share the cell of the larger
    one. Smaller groups are one cell, -1."""
    sizes = members.groupBy("group").agg(F.count("*").alias("_all"))
    # A band is a little wider than the ratio of sizes that can be similar, so rounding does not part two of them.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1.005 * 100 / PERCENT)).cast("int")
    banded = members.join(sizes, "group").withColumn("band", F.when(F.col("_all") > BANDED, band).otherwise(-1))
    cells = F.when(F.col("band") < 0, F.array(F.lit(-1))).otherwise(F.array(F.col("band"), F.col("band") + 1))
    return banded.drop("_all").withColumn("cell", F.explode(cells))


def _blocks(members: DataFrame, *more: str) -> DataFrame:
    """Members of groups' cells dealt into blocks of at most about BLOCK strays (left) against BLOCK members (right),
    sorted by block. A cell that fits one block has all its members on the right, strays marked; one without strays has
    nothing to compare."""
    members = _in_bands(members)
    strays = F.sum(F.col("stray").cast("int"))
    sizes = members.groupBy("group", "cell").agg(F.ceil(strays / BLOCK).cast("int").alias("_s"), F.ceil(F.count("*") / BLOCK).cast("int").alias("_a")).filter("_s > 0")
    sized = members.join(sizes, ["group", "cell"])
    single = (F.col("_s") <= 1) & (F.col("_a") <= 1)
    own = lambda n, seed: F.pmod(F.xxhash64("id", F.lit(seed)), F.greatest(F.col(n), F.lit(1))).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    row = ["group", "cell", "_i", "_j", "left", "id", "comp", "stray", "n", "band", *SKETCH, *more]
    right = sized.withColumns({"_j": own("_a", 1), "left": F.lit(False)}).withColumn("_i", every("_s"))
    left = sized.filter(F.col("stray") & ~single).withColumns({"_i": own("_s", 2), "left": F.lit(True)}).withColumn("_j", every("_a"))
    both = right.select(row).unionByName(left.select(row))
    return both.repartition("group", "cell", "_i", "_j").sortWithinPartitions("group", "cell", "_i", "_j", "id", "left")


def _each_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(i).to_numpy() for i in range(4)], 1)
        edges = [0, *(np.flatnonzero(np.any(keys[1:] != keys[:-1], axis=1)) + 1), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and any(held[-1].column(i)[0] != batch.column(i)[a] for i in range(4)):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _meeting(block: pa.Table) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """Row numbers of the pairs in a block, stray first, that sizes and sketches allow; and the block's columns."""
    col = {x: block.column(x).to_numpy() for x in ("id", "comp", "n", "left", "stray", "band")}
    cell = block.column("cell")[0].as_py()
    larger = col["band"] == cell  # of a pair, one at least: both in the band before meet in the cell before
    sketch = np.stack([block.column(x).to_numpy() for x in SKETCH], 1).view(np.uint64)
    right = np.flatnonzero(~col["left"])
    left = np.flatnonzero(col["left"]) if col["left"].any() else right[col["stray"][right]]
    found = []
    for at in range(0, len(left), 64):
        a = left[at : at + 64]
        n_a, n_b = col["n"][a][:, None], col["n"][right][None, :]
        ok = (col["comp"][a][:, None] != col["comp"][right][None, :]) & (100 * n_a >= PERCENT * n_b) & (100 * n_b >= PERCENT * n_a)
        ok &= larger[a][:, None] | larger[right][None, :]
        i, j = np.nonzero(ok & (~col["stray"][right][None, :] | (col["id"][a][:, None] < col["id"][right][None, :])))
        x = sketch[a[i]] ^ sketch[right[j]]
        agree = SKETCHED - np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum(1)
        found.append((a[i][agree >= LEAST_AGREEING], right[j][agree >= LEAST_AGREEING]))
    empty = np.empty(0, np.int64)
    return np.concatenate([f[0] for f in found] or [empty]), np.concatenate([f[1] for f in found] or [empty]), col


def _sketches_meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The members of each block that have a partner."""
    for block in _each_block(batches):
        a, b, col = _meeting(block)
        ids = np.unique(np.concatenate((col["id"][a], col["id"][b])))
        if len(ids):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block.column(0)[0].as_py())), pa.array(ids)], names=["group", "id"])


def _texts_meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Confirmed links of each block, as few as connect the same components."""
    for block in _each_block(batches):
        left, right, col = _meeting(block)
        needed = np.unique(np.concatenate((left, right)))
        texts = block.column("text").take(pa.array(needed)).to_pylist()
        sets = dict(zip(needed, (own for _, _, words, bounds in word_hashes(texts) for own in shingles(words, bounds))))
        root: dict[int, int] = {}

        def of(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        links = []
        for i, j in zip(left, right):
            x, y = of(col["comp"][i]), of(col["comp"][j])
            if x != y and similar(sets[i], sets[j]):
                root[x] = y
                links.append((col["id"][i], col["id"][j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, kept.

    Texts are linked if 100 * |A & B| >= 75 * |A | B| for their sets of five-word shingles (words between white space
    U+0009-U+000D and U+0020, A-Z lower-cased); a text of fewer words is one shingle; without words it has an empty
    set and is linked with nothing. component_id is the smallest id that links lead to; kept marks the row that bears
    it. Rows with one id are one node. Rows with null ids are one node too, named by null if it is alone. Other columns
    are not read; an empty table gives an empty result.
    """
    source = small_batches(docs).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("id"), F.col(text_col).cast("string").alias("text"))
    sketch = kept(source.mapInArrow(_sketched, _SKETCHED), "sketch")
    some = sketch.filter("n > 0")
    classes = some.groupBy("h1", "h2").agg(F.min("id").alias("rep"))
    named = cut(some.select("id", "h1", "h2").join(classes, ["h1", "h2"]).select("id", "rep"))
    same = named.filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    reps = some.join(named.filter("id = rep").select("id").distinct(), "id").dropDuplicates(["h1", "h2"])
    banded = reps.select("id", F.explode("bands").alias("key"))
    hubs = banded.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("_max")).filter("hub < _max").drop("_max")
    shared = kept(banded.join(hubs, "key").join(reps.select("id", "n", *SKETCH), "id"), "buckets")

    hub_of = shared.filter("id = hub").select("key", "n", *SKETCH, "hub")
    stars = shared.filter("id <> hub").drop("hub").alias("a").join(hub_of.alias("b"), (F.col("a.key") == F.col("b.key")) & _possible("a", "b"))
    links = cut(confirmed(stars.select(F.col("a.id").alias("a"), "hub").distinct(), source))
    members = _membership(shared, _towards_least(links))
    largest = _largest(members)
    apart = members.join(largest, "key").withColumn("stray", F.col("comp") != F.col("group"))
    apart = kept(apart.select("group", "id", "comp", "stray", "n", *SKETCH).dropDuplicates(["group", "id"]), "apart")
    near = cut(_blocks(apart).mapInArrow(_sketches_meet, "group long, id long").distinct())
    close = _blocks(apart.join(near, ["group", "id"]).join(filtered_to(source, near.select("id"), "id"), "id"), "text")
    more = cut(close.mapInArrow(_texts_meet, "a long, b long"))

    final = components(links.unionByName(more).unionByName(same))
    out = sketch.select("id", "n").join(final.select(F.col("a").alias("id"), F.col("b").alias("_comp")), "id", "left")
    named_back = lambda c: F.when(F.col(c) == NO_ID, F.lit(None)).otherwise(F.col(c))
    return out.withColumn("_comp", F.coalesce("_comp", "id")).select(named_back("id").cast("long").alias(id_col), F.col("n").alias("n_shingles"), named_back("_comp").cast("long").alias("component_id"), (F.col("id") == F.col("_comp")).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, that of the smallest id; null ids come last, and of rows with one id any
    stays. Rows with one id, null too, are rows of their own here; texts without words all stay."""
    number = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    own, row = "_own", "_row"  # names that docs does not have
    while own in docs.columns or row in docs.columns:
        own, row = own + "_", row + "_"
    ids = docs.select(number.alias(own))
    if not ids.groupBy(own).count().filter("count > 1").head(1):
        keep = near_duplicates(docs, id_col, text_col).filter("kept").select(F.col(id_col).alias(own)).distinct()
        return docs.join(keep, F.col(id_col).eqNullSafe(F.col(own)), "left_semi")
    rows = kept(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = near_duplicates(rows, row, text_col).select(row, "component_id")
    keep = groups.join(rows.select(row, number.alias(own)), row).groupBy("component_id").agg(F.min(F.struct(own, row)).alias("least"))
    return rows.join(keep.select(F.col("least")[row].alias(row)), row, "left_semi").select(*docs.columns)
