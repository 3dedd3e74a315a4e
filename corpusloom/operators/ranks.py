"""Places and running sums over a whole table without a window over all rows: rows are dealt to slices that follow the
order, slices are added up, and only what lies before a slice is carried over to its rows."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a slice, slices at most, and rows that are looked at for each bound between slices.
PER_SLICE, MOST_SLICES, LOOKED_AT = 100_000, 1000, 32
#: Bounds up to which a row's slice is found by compiled conditions.
COMPILED = 128


def _columns(order: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def _slice(df: DataFrame, order: list[Column]) -> Column:
    """The number of a row's slice. Bounds come from rows with the least hashes, so they depend on the rows alone."""
    n = min(MOST_SLICES, -(-df.count() // PER_SLICE))
    if n <= 1:
        return F.lit(0)
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(order)])
    some = df.select(key.alias("k")).orderBy(F.xxhash64("k")).limit(n * LOOKED_AT)
    types = [f.dataType for f in some.schema["k"].dataType.fields]
    bounds = [r.k for r in some.orderBy("k").collect()][LOOKED_AT - 1 :: LOOKED_AT][: n - 1]
    fixed = [F.struct(*[F.lit(v).cast(t).alias(f"k{i}") for i, (v, t) in enumerate(zip(b, types))]) for b in bounds]
    return _compiled(key, fixed) if len(bounds) <= COMPILED else _interpreted(key, fixed)


def _compiled(key: Column, bounds: list[Column]) -> Column:
    """How many bounds are below the key, as nested conditions."""

    def between(first: int, last: int) -> Column:
        if first == last:
            return F.lit(first)
        half = (first + last) // 2
        return F.when(key <= bounds[half], between(first, half)).otherwise(between(half + 1, last))

    return between(0, len(bounds))


def _interpreted(key: Column, bounds: list[Column]) -> Column:
    """The same by halving over one constant array: conditions for each bound would outgrow what the engine compiles."""
    held = F.array(*bounds)
    state = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(x: Column, _: Column) -> Column:
        mid = F.floor((x["lo"] + x["hi"]) / 2).cast("int")
        down = F.struct(x["lo"].alias("lo"), mid.alias("hi"))
        return F.when(x["lo"] >= x["hi"], x).when(key <= F.get(held, mid), down).otherwise(F.struct((mid + 1).alias("lo"), x["hi"].alias("hi")))

    return F.aggregate(F.array(*[F.lit(0)] * len(bounds).bit_length()), state, halve, lambda x: x["lo"])


def running_all(df: DataFrame, order: Sequence[str | Column], values: dict[str, Column]) -> DataFrame:
    """Adds, for each name, the sum of its value (whole numbers, no nulls) over all rows up to this one in ascending
    order. Rows that tie in the order come in any order."""
    order, names = _columns(order), list(values)
    sliced = df.withColumns({**{f"_value{i}": values[n].cast("bigint") for i, n in enumerate(names)}, "_slice": _slice(df, order)})
    sums = {r["_slice"]: r for r in sliced.groupBy("_slice").agg(*[F.sum(f"_value{i}").alias(f"n{i}") for i in range(len(names))]).collect()}  # a row a slice
    w = Window.partitionBy("_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for i, name in enumerate(names):
        before = list(accumulate((sums[k][f"n{i}"] if k in sums else 0 for k in range(max(sums, default=0) + 1)), initial=0))
        carried = F.array(*[F.lit(b).cast("bigint") for b in before])[F.col("_slice")]
        out[name] = F.sum(f"_value{i}").over(w) + carried
    return sliced.withColumns(out).drop(*[f"_value{i}" for i in range(len(names))], "_slice")


def running(df: DataFrame, order: Sequence[str | Column], value: Column, name: str) -> DataFrame:
    """The same of one value."""
    return running_all(df, order, {name: value})


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """Adds each row's place in ascending order, from 0."""
    return running(df, order, F.lit(1), name).withColumn(name, F.col(name) - 1)


def chunk(place: Column, rows: int, n: int) -> Column:
    """Which of n consecutive chunks of near equal size a place is in, from 0; the first ones have the remainder."""
    size, larger = rows // n, rows % n
    late = larger * (size + 1)
    return F.when(place < late, F.floor(place / (size + 1))).otherwise(larger + F.floor((place - late) / max(1, size))).cast("bigint")
