"""What the training-data operators share: table access, shared storage, hashing of words, ranks without hot groups."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.session import shared_dir

#: White space that separates words: space and U+0009 to U+000D.
SPACES = bytes([9, 10, 11, 12, 13, 32])
#: Bytes of text hashed at once; bounds the memory of a Python worker.
CHUNK = 1 << 18
#: Rows and bytes of a batch that goes to a Python worker, and bytes of text that a worker turns into strings at once.
BATCH_ROWS, BATCH_BYTES, SLICE_BYTES = 2000, 8 << 20, 2 << 20

_ODD = 0x9E3779B97F4A7C13
_MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small_batches(df: DataFrame) -> DataFrame:
    """df; its session sends Python workers batches of at most BATCH_ROWS rows and about BATCH_BYTES bytes from now on,
    which bounds what executors hold beside their heap. Settings that are smaller already stay."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        now = df.sparkSession.conf.get(key, str((1 << 31) - 2)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            df.sparkSession.conf.set(key, str(most))
    return df


def text_slices(column: pa.Array, rows: int = 1000) -> Iterator[tuple[int, list[str | None]]]:
    """(place of the first, texts) of runs of a text column, of at most `rows` texts and about SLICE_BYTES bytes; a
    longer text is a run of its own."""
    sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at, n = 0, len(column)
    while at < n:
        total = np.cumsum(sizes[at : at + rows], dtype=np.int64)
        end = at + max(1, int(np.searchsorted(total, SLICE_BYTES, "right")))
        yield at, column.slice(at, end - at).to_pylist()
        at = end


#: Folders and broadcasts made so far that release() has not taken away.
_SCRATCH: list = []


def new_folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


def held_by_all(spark: SparkSession, value: object) -> Broadcast:
    """A broadcast that release() knows of."""
    out = spark.sparkContext.broadcast(value)
    _SCRATCH.append(out)
    return out


def mark() -> int:
    """What release() needs to take away what is made from now on."""
    return len(_SCRATCH)


def release(spark: SparkSession, since: int = 0, but: Iterable[str] = ()) -> None:
    """Deletes the folders and broadcasts made since mark() gave `since`, but for the folders named. To be called only
    when every result that was built on them has been written or is no longer wanted."""
    some, _SCRATCH[since:] = _SCRATCH[since:], [p for p in _SCRATCH[since:] if isinstance(p, str) and p in set(but)]
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    for x in some:
        if isinstance(x, Broadcast):
            x.destroy()
        elif x not in set(but):
            path = hadoop(x)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The same rows read from the shared checkpoint folder: lineage ends here and survives lost executors."""
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    file = out._jdf.queryExecution().analyzed().rdd().getCheckpointFile()
    if file.isDefined():
        _SCRATCH.append(file.get())
    return out


def kept(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, for wide rows of which later steps read few columns."""
    return written(df, new_folder(df.sparkSession, name))


def written(df: DataFrame, path: str) -> DataFrame:
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random 64-bit words that depend on the seed alone."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(2)
def _tables(chunk: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Values of bytes, powers of an odd number and of its inverse, and which bytes separate words."""
    n = chunk + 1
    up, down = np.full(n, _ODD, np.uint64), np.full(n, pow(_ODD, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    apart = np.zeros(256, bool)
    apart[list(SPACES)] = True
    return stream(256, 1), np.multiply.accumulate(up), np.multiply.accumulate(down), apart


def _hashed(buf: bytes, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes and word starts of at most `chunk` bytes."""
    value, up, down, apart = _tables(chunk)
    b = np.frombuffer(buf, np.uint8)
    gap = np.concatenate(([True], apart[b], [True]))
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64), start
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value[b] * up[: len(b)], dtype=np.uint64)))
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


#: Lower-cases A-Z and turns all ASCII but letters and digits into spaces, for words without punctuation.
PLAIN = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_hashes(texts: list[str | None], spelling: bytes = _LOWER, chunk: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first, last, hashes, bounds) for runs of texts: 64-bit hashes of their words, after each byte's change by
    `spelling`, where
    text first + i has the words bounds[i]:bounds[i + 1]. A run has about `chunk` bytes, CHUNK by default; a longer text
    is hashed in pieces cut at white space, and a word of more bytes by Python."""
    chunk = chunk or CHUNK
    with np.errstate(over="ignore"):
        at = 0
        while at < len(texts):
            parts, size, end = [], 0, at
            while end < len(texts) and (not parts or size < chunk):
                parts.append((texts[end] or "").encode("utf-8", "surrogatepass").translate(spelling))
                size += len(parts[-1]) + 1
                if size > chunk and len(parts) > 1:
                    parts.pop()
                    break
                end += 1
            if len(parts) == 1 and len(parts[0]) >= chunk:
                h = np.concatenate(list(_pieces(parts[0], chunk)))
                yield at, end, h, np.array([0, len(h)])
            else:
                h, start = _hashed(b" ".join(parts), chunk)
                offsets = np.cumsum([0] + [len(p) + 1 for p in parts])
                yield at, end, h, np.searchsorted(start, offsets)
            at = end


def _pieces(b: bytes, chunk: int) -> Iterator[np.ndarray]:
    """Hashes of the words of a text of any length."""
    value, up, down, apart = _tables(chunk)
    at = 0
    while at < len(b):
        end = min(len(b), at + chunk)
        if end < len(b):
            near = np.flatnonzero(apart[np.frombuffer(b, np.uint8, end - at, at)])
            if len(near):
                end = at + int(near[-1]) + 1
            else:  # one word of more than a chunk: the same sum, block by block
                total, power, done = 0, 1, at
                while done < len(b):
                    block = np.frombuffer(b, np.uint8, min(chunk, len(b) - done), done)
                    stop = np.flatnonzero(apart[block])
                    block = block[: stop[0]] if len(stop) else block
                    total = (total + power * int(np.sum(value[block] * up[: len(block)], dtype=np.uint64))) & _MASK
                    power, done = power * int(up[len(block) - 1]) * _ODD & _MASK if len(block) else power, done + len(block)
                    if len(stop):
                        break
                yield mix(np.array([(total + done - at) & _MASK], np.uint64))
                at = done
                continue
        yield _hashed(b[at:end], chunk)[0]
        at = end


#: 64-bit words of a set_filter at most (8 MB); beyond about 8 million ids it lets more rows pass, never fewer.
FILTER_WORDS = 1 << 20


def filtered_to(df: DataFrame, ids: DataFrame, col: str) -> DataFrame:
    """df without most of the rows whose id (a long) is not among ids (column `id`): a Bloom filter of bounded size,
    so that a join after it shuffles little else than what it needs. All rows with an id among ids stay."""
    bits = ids.select(F.explode(F.array(*[F.xxhash64("id", F.lit(k)) for k in (1, 2, 3)])).alias("h"))
    words = bits.groupBy(F.pmod(F.shiftright("h", 6), F.lit(FILTER_WORDS)).cast("int").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(h, 64) AS int)))").alias("bits"))
    found = words.toArrow()  # at most FILTER_WORDS rows
    mask = np.zeros(FILTER_WORDS, np.int64)
    mask[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    while len(mask) > max(64, 16 * len(found)):  # few ids need few words
        mask = mask[: len(mask) // 2] | mask[len(mask) // 2 :]
    held = held_by_all(df.sparkSession, mask)

    def passes(a: pd.Series, b: pd.Series, c: pd.Series) -> pd.Series:
        ok = np.ones(len(a), bool)
        for h in (a, b, c):
            h = h.to_numpy(np.int64)
            ok &= (held.value[(h >> 6) % len(held.value)] >> (h % 64)) & 1 == 1
        return pd.Series(ok)

    return df.filter(F.pandas_udf(passes, "boolean")(*[F.xxhash64(col, F.lit(k)) for k in (1, 2, 3)]))


def ranked(df: DataFrame, key: str, order: list[str], rank: str = "rank", per_group: int = 200_000, parts: int | None = None) -> DataFrame:
    """Adds rank: 0, 1, ... within the rows of a key, without gaps, so that no task has to hold a whole key.

    Rows of a key are dealt over `parts` slices by a hash of the order columns; slices are counted, the counts' running
    sum gives each slice its first rank, and a window numbers the rows of a slice. Equal rows share a slice and take
    its ranks in any order, which cannot be told apart. df is read twice and should be cut before.
    """
    if parts is None:
        parts = max(1, -(-df.count() // per_group))
    sliced = df.withColumn("_slice", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    from pyspark.sql import Window as W

    counts = sliced.groupBy(key, "_slice").agg(F.count("*").alias("_n"))
    first = counts.select(F.col(key).alias("_key"), F.col("_slice").alias("_of"), (F.sum("_n").over(W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, 0)) - F.col("_n")).alias("_first"))
    numbered = sliced.withColumn("_at", F.row_number().over(W.partitionBy(key, "_slice").orderBy(*order)) - 1)
    return numbered.join(first, (F.col(key) == F.col("_key")) & (F.col("_slice") == F.col("_of"))).withColumn(rank, F.col("_first") + F.col("_at")).drop("_key", "_of", "_slice", "_first", "_at", "_n")
