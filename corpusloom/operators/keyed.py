"""Operators on keyed relations: filters by key, joins with checks, deduplication, integrity, splits and samples.

Order that decides a result is always an explicit column. Nothing is broadcast by hint: sizes are left to the engine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.operators import ranks
from corpusloom.session import cut


def keep_keys(df: DataFrame, keys: DataFrame, on: str, exclude: bool = False) -> DataFrame:
    """Rows whose key is (not) among the keys."""
    return df.join(keys.select(on), on, "left_anti" if exclude else "left_semi")


def common_keys(frames: list[DataFrame], on: str) -> DataFrame:
    """Keys that every frame has."""
    out = frames[0].select(on).distinct()
    for f in frames[1:]:
        out = out.join(f.select(on), on, "left_semi")
    return out


def lockstep(a: DataFrame, b: DataFrame, on: str) -> DataFrame:
    """Inner join of two frames that must have the same keys; the query fails if they do not."""
    j = a.withColumn("_a", F.lit(1)).join(b.withColumn("_b", F.lit(1)), on, "full_outer")
    one_sided = F.col("_a").isNull() | F.col("_b").isNull()
    return j.filter(F.when(one_sided, F.raise_error(F.concat(F.lit("key on one side only: "), F.col(on).cast("string"))).cast("boolean")).otherwise(True)).drop("_a", "_b")


def lookup(df: DataFrame, dim: DataFrame, on: str, value: str, default: Column) -> DataFrame:
    """Left join of one column with a default for keys that the dimension lacks."""
    return df.join(dim.select(on, value), on, "left").withColumn(value, F.coalesce(F.col(value), default))


def first_by(df: DataFrame, key: list[str] | str, order: list[str | Column], last: bool = False) -> DataFrame:
    """One row a key: the first (last) in order."""
    key = [key] if isinstance(key, str) else key
    by = [F.desc(c) if isinstance(c, str) else c.desc() for c in order] if last else order
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).filter("_rn = 1").drop("_rn")


def suffixed_repeats(df: DataFrame, key: str, order: str) -> DataFrame:
    """The i-th repeat of a key, counted from 0, is renamed key.i for i > 0."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return df.withColumn("_i", n).withColumn(key, F.when(F.col("_i") == 0, F.col(key)).otherwise(F.concat_ws(".", F.col(key), F.col("_i").cast("string")))).drop("_i")


def round_robin(df: DataFrame, order: str, n: int, name: str = "split") -> DataFrame:
    """Rows dealt to n splits in turn."""
    return ranks.numbered(df, [order], name).withColumn(name, F.col(name) % n)


def even_chunks(df: DataFrame, order: str, n: int, name: str = "split") -> DataFrame:
    """n consecutive chunks, counted from 1; the first ones have the remainder."""
    return ranks.numbered(df, [order], name).withColumn(name, ranks.chunk(F.col(name), df.count(), n) + 1)


def strided_per_group(df: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """n rows a group, evenly apart: with the largest stride s such that n * s rows are there; all rows of a smaller
    group."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("_rn", F.row_number().over(w.orderBy(order)) - 1).withColumn("_s", F.greatest(F.lit(1), F.floor(F.count("*").over(w) / n)))
    return ranked.filter((F.col("_rn") % F.col("_s") == 0) & (F.col("_rn") < n * F.col("_s"))).drop("_rn", "_s")


def groups_until(df: DataFrame, group: str, n: int) -> DataFrame:
    """Groups in order of name until they have n rows together; the group that reaches n is the last."""
    sizes = df.groupBy(group).agg(F.count("*").alias("rows"))
    return ranks.running(sizes, [group], F.col("rows"), "before").withColumn("before", F.col("before") - F.col("rows")).filter(F.col("before") < n)


def hashed_order(key: str, seed: int) -> Column:
    """A fixed shuffle: rows ordered by it come in pseudo-random order whatever the partitions, and in any engine that
    has MD5."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def shuffled(df: DataFrame, key: str, seed: int, name: str = "place") -> DataFrame:
    """Adds each row's place, from 0, in a fixed shuffle by key."""
    return ranks.numbered(df, [hashed_order(key, seed), key], name)


def within_group(df: DataFrame, group: str, order: list[str | Column], name: str = "rank") -> DataFrame:
    """Adds each row's place, from 0, within its group, and the group's size as _size; no task holds a whole group."""
    placed = ranks.numbered(df, [group, *order], name)
    sizes = df.groupBy(F.col(group).alias("_group")).agg(F.count("*").alias("_size"))
    first = ranks.running(sizes, ["_group"], F.col("_size"), "_end").select("_group", "_size", (F.col("_end") - F.col("_size")).alias("_first"))
    return placed.join(first, F.col(group).eqNullSafe(F.col("_group"))).withColumn(name, F.col(name) - F.col("_first")).drop("_group", "_first")


#: Tokens that every task knows, the most common ones; the others' occurrences are moved to meet their counts. Distinct
#: tokens that a task counts before it gives their counts on. Texts that it takes apart at once.
COMMON, HELD, AT_ONCE = 400_000, 200_000, 200


def unknown_tokens(df: DataFrame, key: str, text: str, tokens: Callable[[str], list[str]], least: int) -> DataFrame:
    """(key, tokens, unknown): how many tokens each key's texts have and how many of them come fewer than `least` times
    in all. Tasks count tokens before they are shuffled, and of the occurrences only those of tokens that are not among
    the COMMON most common ones are."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter[str] = Counter()
        for batch in batches:
            for t in batch.column(0):
                if t.is_valid:
                    n.update(tokens(t.as_py()))
                if len(n) > HELD:
                    yield pa.RecordBatch.from_pydict({"_tok": list(n), "_n": list(n.values())})
                    n.clear()
        yield pa.RecordBatch.from_pydict({"_tok": pa.array(n, pa.string()), "_n": pa.array(n.values(), pa.int64())})

    counts = cut(df.select(text).mapInArrow(count, "_tok string, _n bigint").groupBy("_tok").agg(F.sum("_n").alias("_n")))
    top = counts.filter(F.col("_n") >= least).orderBy(F.desc("_n"), "_tok").limit(COMMON)
    known = df.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in top.select("_tok").collect()))

    def others(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = known.value
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                keys, texts = batch.slice(i, AT_ONCE).columns
                said = [tokens(t) if t is not None else [] for t in texts.to_pylist()]
                rest = pa.array([[w for w in words if w not in common] for words in said], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([keys, pa.array(map(len, said), pa.int64()), rest], names=[key, "tokens", "_rest"])

    held = cut(df.select(key, text).mapInArrow(others, f"{key} {dict(df.dtypes)[key]}, tokens bigint, _rest array<string>")).filter("tokens > 0")
    rare = counts.filter(F.col("_n") < least).select("_tok")
    met = held.select(key, F.explode("_rest").alias("_tok")).join(rare, "_tok", "left_semi")
    none = F.lit(0).cast("bigint")
    parts = held.select(key, "tokens", none.alias("unknown")).unionByName(met.select(key, none.alias("tokens"), F.lit(1).cast("bigint").alias("unknown")))
    return parts.groupBy(key).agg(F.sum("tokens").alias("tokens"), F.sum("unknown").alias("unknown"))


#: Multiplier and modulus of the sequence that thins out duplicates.
MULTIPLIER, MODULUS = 103349, 71147


def duplicate_cap(df: DataFrame, text: str, order: str, most: int) -> DataFrame:
    """Rows whose text comes fewer than `most` times stay; of the others each stays with probability most / count, by
    a fixed linear congruential sequence that advances over those rows in order."""
    common = df.groupBy(F.col(text).alias("_text")).agg(F.count("*").alias("_n")).filter(F.col("_n") >= most)
    same = F.col(text).eqNullSafe(F.col("_text"))
    over = ranks.numbered(cut(df.join(common, same).drop("_text")), [order], "_j")
    drawn = over.filter((F.col("_j") + 1) * MULTIPLIER % MODULUS < most * MODULUS / F.col("_n")).drop("_n", "_j")
    return df.join(common.drop("_n"), same, "left_anti").unionByName(drawn)


def trials(df: DataFrame, key: str, group: str, enrols: Column, targets: int, others: int, seed: int = 0) -> DataFrame:
    """(enroll, test, target): for each row that enrols, `targets` trials against its own group, the next ones in a fixed
    shuffle, and `others` against the other groups, evenly apart from a fixed place on; and one trial for each row that
    has none by then, against the enrolled rows in turn. No pairs of rows are made but these. Groups are whole numbers or
    texts; where a group or the others are too few, a row has fewer trials."""
    total = df.count()
    shuffled_ = [hashed_order(key, seed), key]
    e = within_group(df.select(key, group, enrols.alias("_enrols")), group, shuffled_, "_r")
    e = cut(ranks.numbered(e, [group, *shuffled_], "_place"))
    each = e.filter("_enrols").select(F.col(key).alias("enroll"), F.col(group).alias("_g"), "_r", "_size", "_place")
    own = each.select("enroll", "_g", "_size", F.explode(F.sequence(F.lit(1), F.lit(targets))).alias("_j"), "_r").filter("_j < _size")
    own = own.select("enroll", "_g", ((F.col("_r") + F.col("_j")) % F.col("_size")).alias("_r")).join(e.select(F.col(group).alias("_g"), "_r", F.col(key).alias("test")), ["_g", "_r"])
    rest = F.lit(total) - F.col("_size")
    start = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("enroll").cast("string"), F.lit("!"))), 1, 8), 16, 10).cast("bigint")
    far = each.withColumns({"_first": F.col("_place") - F.col("_r"), "_rest": F.greatest(rest, F.lit(1)), "_j": F.explode(F.sequence(F.lit(0), F.lit(others - 1)))}).filter(F.col("_j") < rest)
    at = (start % F.col("_rest") + F.col("_j") * F.greatest(F.floor(F.col("_rest") / others), F.lit(1))) % F.col("_rest")
    far = far.withColumn("_at", at).select("enroll", F.when(F.col("_at") < F.col("_first"), F.col("_at")).otherwise(F.col("_at") + F.col("_size")).alias("_place")).join(e.select("_place", F.col(key).alias("test")), "_place")
    found = own.select("enroll", "test").unionByName(far.select("enroll", "test"))
    used = found.select(F.explode(F.array("enroll", "test")).alias(key)).distinct()
    left = ranks.numbered(e.select(key).join(used, key, "left_anti"), [key], "_k")
    enrolled = e.filter("_enrols").select(F.col(key).alias("enroll"))
    turn = ranks.numbered(enrolled, ["enroll"], "_k")
    covering = left.select(F.col(key).alias("test"), (F.col("_k") % max(1, enrolled.count())).alias("_k")).join(turn, "_k").select("enroll", "test")
    label = e.select(F.col(key).alias("_key"), F.col(group).alias("_of"))
    both = found.unionByName(covering).join(label.withColumnsRenamed({"_key": "enroll", "_of": "_a"}), "enroll").join(label.withColumnsRenamed({"_key": "test", "_of": "_b"}), "test")
    return both.select("enroll", "test", (F.col("_a") == F.col("_b")).cast("int").alias("target"))


def integrity(rows: DataFrame, groups: DataFrame, key: str, group: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose group exists, and groups that still have rows: one pass each settles it, as filtering rows by group
    cannot strand another row."""
    kept = rows.join(groups.select(group), group, "left_semi")
    return kept, groups.join(kept.select(group), group, "left_semi")
