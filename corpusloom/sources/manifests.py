"""Keyed text manifests: one record a line, a key first. Readers turn lines (column value) into typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]+"


def lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def _trimmed(value: Column) -> Column:
    return F.regexp_replace(value, r"^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$", "")


def _records(rows: DataFrame) -> DataFrame:
    """key and rest; blank lines are no records, a bare key has the rest ''."""
    parts = F.split(_trimmed(F.col("value")), SPACE, 2)
    return rows.select(parts[0].alias("key"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("rest")).filter("key <> ''")


def unique(df: DataFrame, key: str = "key") -> DataFrame:
    """The same rows; the query fails if a key comes twice."""
    n = F.count("*").over(Window.partitionBy(key))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.concat(F.lit("duplicated key "), F.col(key))).cast("boolean")).otherwise(True)).drop("_n")


def two_columns(rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(key, value), restricted to the keys asked for."""
    out = _records(rows).withColumnRenamed("rest", "value")
    return unique(out if keys is None else out.join(keys.select("key"), "key", "left_semi"))


def multi_columns(rows: DataFrame) -> DataFrame:
    """(key, values): a bare key has the one value ''."""
    return unique(_records(rows).select("key", F.split("rest", SPACE).alias("values"), F.col("rest").alias("unsplit")))


def numbers(rows: DataFrame, kind: str = "text_int") -> DataFrame:
    """(key, sequence) of integers or doubles, apart by white space (text_*) or commas (csv_*). Other text fails."""
    shape, _, type_ = kind.partition("_")
    sep = {"text": SPACE, "csv": ","}[shape]
    to = {"int": "bigint", "float": "double"}[type_]
    return unique(_records(rows).select("key", F.transform(F.split("rest", sep), lambda x: F.trim(x).cast(to)).alias("sequence")))


def labels(rows: DataFrame) -> DataFrame:
    """(key, labels): triples of start, end and phone, kept as text."""
    parts = F.split("rest", SPACE)
    triples = F.transform(F.sequence(F.lit(0), F.floor(F.size(parts) / 3).cast("int") - 1), lambda i: F.struct(F.get(parts, 3 * i).alias("st"), F.get(parts, 3 * i + 1).alias("et"), F.get(parts, 3 * i + 2).alias("phone")))
    return unique(_records(rows).select("key", triples.alias("labels")))


def rttm(rows: DataFrame) -> DataFrame:
    """(key, speaker, start, end) of the SPEAKER lines of nine fields."""
    f = F.split("value", " ")
    checked = F.when((F.size(f) != 9) & f[0].isin("SPEAKER", "END"), F.raise_error("nine fields are needed").cast("boolean")).otherwise(f[0] == "SPEAKER")
    return rows.filter(checked).select(f[1].alias("key"), f[7].alias("speaker"), f[3].cast("bigint").alias("start"), f[4].cast("bigint").alias("end"))


def vad(rows: DataFrame) -> DataFrame:
    """(key, spans): start:end pairs in seconds."""
    span = lambda x: F.struct(F.split(x, ":")[0].cast("double").alias("start"), F.split(x, ":")[1].cast("double").alias("end"))
    return unique(_records(rows).select("key", F.transform(F.split("rest", SPACE), span).alias("spans")))


def json_texts(rows: DataFrame) -> DataFrame:
    """(id, text) of JSON lines; lines without either are skipped."""
    o = F.from_json("value", "id string, text string", {"mode": "PERMISSIVE"})
    return rows.select(o.alias("o")).select("o.id", "o.text").filter("id IS NOT NULL AND text IS NOT NULL")


def write_manifest(df: DataFrame, path: str, key: str = "key", value: str = "value") -> None:
    df.select(F.concat_ws(" ", key, value)).write.text(path)


def key_mismatch(a: DataFrame, b: DataFrame, key: str = "key") -> DataFrame:
    """Keys that only one of two manifests has, with the side."""
    j = a.select(key).withColumn("_a", F.lit(1)).join(b.select(key).withColumn("_b", F.lit(1)), key, "full_outer")
    return j.filter("_a IS NULL OR _b IS NULL").select(key, F.when(F.col("_b").isNull(), "left").otherwise("right").alias("side"))
