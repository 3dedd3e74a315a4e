"""Ordered scans: runs, chunks, windows over time, segments, turns of activity; each within a partition of its key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(df: DataFrame, key: str, order: str, value: str, name: str = "island") -> DataFrame:
    """Numbers runs of equal neighbouring values of a key from 0."""
    w = Window.partitionBy(key).orderBy(order)
    new = F.when(F.lag(value).over(w).eqNullSafe(F.col(value)), 0).otherwise(1)
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1).drop("_new")


def chunks(values: Column, width: int, step: int) -> Column:
    """All full windows of an array, step apart; the tail is left out. Too short an array has none."""
    n = F.floor((F.size(values) - width) / step).cast("int") + 1
    full = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.slice(values, i * step + 1, width))
    return F.when(F.size(values) >= width, full).otherwise(F.array().cast("array<array<bigint>>"))


def padded_segments(df: DataFrame, key: str, start: str, end: str, pad: float, limit: str) -> DataFrame:
    """Segments widened by pad within 0 and the limit; neighbours that then overlap meet in the middle."""
    w = Window.partitionBy(key).orderBy(F.col(start) + F.col(end), start)
    wide = df.withColumns({"_s": F.greatest(F.lit(0.0), F.col(start) - pad), "_e": F.least(F.col(limit).cast("double"), F.col(end) + pad)})
    after, before = F.lead("_s").over(w), F.lag("_e").over(w)
    met = wide.withColumns({"_n": after, "_p": before})
    return met.withColumns({"new_start": F.when(F.col("_p") > F.col("_s"), (F.col("_p") + F.col("_s")) / 2).otherwise(F.col("_s")), "new_end": F.when(F.col("_n") < F.col("_e"), (F.col("_n") + F.col("_e")) / 2).otherwise(F.col("_e"))}).drop("_s", "_e", "_n", "_p")


def without_contained(df: DataFrame, key: str, start: str, end: str) -> DataFrame:
    """Intervals that no earlier interval of the key covers."""
    w = Window.partitionBy(key).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("_m", F.max(end).over(w)).filter(F.col("_m").isNull() | (F.col("_m") < F.col(end))).drop("_m")


def sessions(df: DataFrame, key: str, order: str, gap: float, name: str = "session") -> DataFrame:
    """Numbers the runs of a key's rows that are less than gap apart."""
    w = Window.partitionBy(key).orderBy(order)
    far = F.coalesce((F.col(order) - F.lag(order).over(w) >= gap).cast("int"), F.lit(0))
    return df.withColumn("_far", far).withColumn(name, F.sum("_far").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def deltas(df: DataFrame, key: str, order: str, value: str, width: int = 2, name: str = "delta") -> DataFrame:
    """Regression slope over width neighbours on each side, the ends repeated."""
    w = Window.partitionBy(key).orderBy(order)
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first(value).over(whole), F.last(value).over(whole)
    total = sum(i * (F.coalesce(F.lead(value, i).over(w), last) - F.coalesce(F.lag(value, i).over(w), first)) for i in range(1, width + 1))
    return df.withColumn(name, total / (2 * sum(i * i for i in range(1, width + 1))))


def first_mismatch(notes: DataFrame, key: str, order: str, syllable: str, phone: str, phone_of: Callable[[Column], Column], slur: str = "—") -> DataFrame:
    """(key, notes, mismatch): walking the notes of a key in order, the first place whose phone is not its syllable's;
    a slur takes the phone of the last syllable before it. Null if all agree."""
    w = Window.partitionBy(key).orderBy(order)
    own = F.when(F.col(syllable) != slur, phone_of(F.col(syllable)))
    want = F.coalesce(own, F.last(own, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    wrong = notes.withColumn("_wrong", ~F.col(phone).eqNullSafe(want))
    return wrong.groupBy(key).agg(F.count("*").alias("notes"), F.min(F.when(F.col("_wrong"), F.col(order))).cast("bigint").alias("mismatch"))


def real_time_factors(lines: DataFrame, frame: float = 0.01) -> DataFrame:
    """(log, busy_us, parts, rtf) of log lines (column value: dec.NAME.log:time number text): each line that states a
    speech length begins a part, the next line of its log ends it; the parts' time in all, and over that of their frames."""
    part = lambda i: F.regexp_extract("value", r"^dec\.([^:]*)\.log:(\S+ \S+) (\d+) (.*)$", i)
    rows = lines.select(part(1).alias("log"), F.unix_micros(F.to_timestamp(part(2), "yyyy-MM-dd HH:mm:ss,SSSSSS")).alias("at"), part(3).cast("bigint").alias("number"), F.try_to_number(F.regexp_extract("value", r"speech length: (\d+)", 1), F.lit("999999999999")).cast("bigint").alias("frames"))
    w = Window.partitionBy("log").orderBy("at", "number")
    ended = rows.withColumn("end", F.lead("at").over(w)).filter("frames IS NOT NULL AND end IS NOT NULL")
    busy = F.sum(F.col("end") - F.col("at"))
    return ended.groupBy("log").agg(busy.alias("busy_us"), F.count("*").alias("parts"), (busy / (F.sum("frames") * frame * 1e6)).alias("rtf"))
