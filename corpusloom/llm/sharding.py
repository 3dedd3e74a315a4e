"""Sharding by jump consistent hashing (Lamping and Veach, 2014): a key's shard needs no table of shards, and when
shards are appended only the share of keys that the new shards are due moves, into them alone."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import cut, ranked

#: Bytes that a row takes in a shard besides its text.
ROW_BYTES = 16


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each 64-bit key: every key jumps ahead through the shard counts at which it would have moved."""
    if shards < 1:
        raise ValueError("at least one shard is needed")
    state = keys.astype(np.uint64)
    at, ahead = np.full(len(state), -1, np.int64), np.zeros(len(state), np.int64)
    moving = np.arange(len(state))
    with np.errstate(over="ignore"):
        while len(moving):
            at[moving] = ahead[moving]
            state[moving] = state[moving] * np.uint64(2862933555777941757) + np.uint64(1)
            draw = (state[moving] >> np.uint64(33)).astype(np.float64) + 1
            ahead[moving] = np.floor((at[moving] + 1) * (float(1 << 31) / draw)).astype(np.int64)
            moving = moving[ahead[moving] < shards]
    return at


def shard_of(key: Column, shards: int) -> Column:
    """Shard of a key of any type; equal keys, nulls included, share a shard."""

    @F.pandas_udf("int")
    def of(hashes: pd.Series) -> pd.Series:
        return pd.Series(jump(hashes.to_numpy(np.int64).view(np.uint64), shards).astype(np.int32))

    return of(F.xxhash64(key))


def assign(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, size, text_crc32, law, shard, slot, grown_shard.

    The law is `key`: id and shard count alone decide the shard, grown_shard is the shard among one more. slot numbers
    a shard's rows from 0 without gaps, in an order that depends on the rows alone. A null text has no bytes (size is
    ROW_BYTES, checksum 0); a null id is a key of its own; rows with the same id share a shard and have slots of their
    own; an empty table gives an empty result; other columns are not read. Only these narrow columns are shuffled.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("_id"), (F.octet_length(text) + ROW_BYTES).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    rows = cut(rows.withColumns({"shard": shard_of(F.col("_id"), shards), "grown_shard": shard_of(F.col("_id"), shards + 1)}))
    out = ranked(rows, "shard", ["_id", "size", "text_crc32"], "slot")
    return out.select(F.col("_id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")


def write(docs: DataFrame, path: str, shards: int, id_col: str = "doc_id") -> None:
    """Writes the rows whole under path/shard=N/, one folder a shard; tasks split a shard further, so none is hot."""
    docs.withColumn("shard", shard_of(F.col(id_col), shards)).write.partitionBy("shard").parquet(path)
