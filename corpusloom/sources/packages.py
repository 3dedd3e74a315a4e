"""Packed and registered sources: typed artifacts, tar and zip archives, registries of datasets, cut manifests, indexed
matrix archives and MIDI scores. Whatever is read or written goes through Spark's sources, in any store Spark reaches."""

from __future__ import annotations

import io
import json
import os
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, NumericType, StructType

from corpusloom.sources import binary, manifests

# --- artifacts


def artifact(df: DataFrame, column: str, kind: str | None = None, rate: int = 16000) -> tuple[str, Column]:
    """(kind, content) of a column as it is kept: arrays of numbers as npy (or wav, if asked for), structs, maps and
    everything else as json. A bare array of anything else is refused, as nothing says how to read it again."""
    t = df.schema[column].dataType
    numbers = isinstance(t, ArrayType) and isinstance(t.elementType, NumericType)
    if kind is None:
        if isinstance(t, ArrayType) and not numbers:
            raise ValueError(f"{column} is a list; put it into a struct")
        kind = "npy" if numbers else "json"
    if kind == "npy":
        return kind, binary.npy_bytes(F.col(column))
    if kind == "wav":
        return kind, binary.wav_bytes(F.col(column), rate)
    if kind != "json":
        raise ValueError(f"no artifact is of kind {kind!r}")
    held = F.col(column) if isinstance(t, (StructType, MapType)) else F.struct(F.col(column).alias("value"))
    return kind, F.to_json(held).cast("binary")


def write_artifacts(df: DataFrame, key: str, path: str, kinds: dict[str, str] | None = None) -> DataFrame:
    """Writes every column but the key as artifacts (key, field, kind, content) and gives them back as they were
    written. Nulls have no artifact."""
    parts = []
    for column in df.columns:
        if column != key:
            kind, content = artifact(df, column, (kinds or {}).get(column))
            parts.append(F.when(F.col(column).isNotNull(), F.struct(F.lit(column).alias("field"), F.lit(kind).alias("kind"), content.alias("content"))))
    rows = df.select(F.col(key).cast("string").alias("key"), F.explode(F.filter(F.array(*parts), lambda x: x.isNotNull())).alias("a")).select("key", "a.*")
    rows.write.partitionBy("kind").parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path)


# --- archives


def packed(df: DataFrame, name: str, content: str, kind: str = "tar") -> DataFrame:
    """Archives (column content) of files named and filled by two columns, one a batch of rows."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = io.BytesIO()
            if kind == "zip":
                with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
                    for n, c in zip(pdf[name], pdf[content]):
                        z.writestr(zipfile.ZipInfo(n), bytes(c))
            else:
                with tarfile.open(fileobj=held, mode="w") as t:
                    for n, c in zip(pdf[name], pdf[content]):
                        info = tarfile.TarInfo(n)
                        info.size = len(c)
                        t.addfile(info, io.BytesIO(bytes(c)))
            yield pd.DataFrame({"content": [held.getvalue()]})

    return df.select(F.col(name).cast("string").alias(name), F.col(content).cast("binary").alias(content)).mapInPandas(write, "content binary")


def members(archives: DataFrame) -> DataFrame:
    """(name, content) of every file in tar archives, compressed or not, and zip archives (column content)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for c in pdf["content"]:
                raw, rows = io.BytesIO(bytes(c)), []
                if zipfile.is_zipfile(raw):
                    with zipfile.ZipFile(raw) as z:
                        rows = [(i.filename, z.read(i)) for i in z.infolist() if not i.is_dir()]
                else:
                    raw.seek(0)
                    with tarfile.open(fileobj=raw) as t:
                        rows = [(m.name, t.extractfile(m).read()) for m in t if m.isfile()]
                yield pd.DataFrame(rows, columns=["name", "content"])

    return archives.select("content").mapInPandas(read, "name string, content binary")


# --- registries

#: Names the registry files, apart by colons; a later file replaces what an earlier one says of a name.
REGISTRY = "CORPUSLOOM_DATASETS"


def registry(spark: SparkSession, paths: list[str] | None = None) -> dict[str, str]:
    """Paths of datasets by name, from YAML files of the form {name: {path: ...}}; entries without a path do not count.
    Files come from the argument or from the environment."""
    import yaml

    named = [p.strip() for p in os.environ.get(REGISTRY, "").split(":") if p.strip()] if paths is None else paths
    out: dict[str, str] = {}
    for p in named:
        for row in spark.read.text(p, wholetext=True).collect():  # a few lines a dataset
            said = yaml.safe_load(row.value) or {}
            out |= {name: str(x["path"]) for name, x in said.items() if isinstance(x, dict) and "path" in x}
    return out


# --- cuts and indexed archives

_CUT = "id string, start double, duration double, channel string, recording struct<id:string,sampling_rate:int,duration:double,sources:array<struct<type:string,channels:array<int>,source:string>>>"
_RECORDING = "id string, sampling_rate int, duration double, sources array<struct<type:string,channels:array<int>,source:string>>"


def cuts(rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """(id, source, start, end, rate) of a cut manifest's JSON lines (column value), restricted to the keys asked for."""
    c = rows.select(F.from_json("value", _CUT).alias("c")).select("c.*").filter("id IS NOT NULL")
    out = c.select("id", F.col("recording.sources")[0]["source"].alias("source"), F.coalesce("start", F.lit(0.0)).alias("start"), (F.coalesce("start", F.lit(0.0)) + F.col("duration")).alias("end"), F.col("recording.sampling_rate").alias("rate"))
    return out if keys is None else out.join(keys.select(F.col("key").alias("id")), "id", "left_semi")


def recordings(rows: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """The same of a recording manifest: whole recordings."""
    c = rows.select(F.from_json("value", _RECORDING).alias("c")).select("c.*").filter("id IS NOT NULL")
    out = c.select("id", F.col("sources")[0]["source"].alias("source"), F.lit(0.0).alias("start"), F.col("duration").alias("end"), F.col("sampling_rate").alias("rate"))
    return out if keys is None else out.join(keys.select(F.col("key").alias("id")), "id", "left_semi")


def sound_of(ranges: DataFrame, files: DataFrame) -> DataFrame:
    """ranges (id, source, start, end) with the samples of each from the files (key, content) that they name: only the
    range leaves a file."""

    def run(contents: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([binary.read_range(bytes(c), s, e)[2] for c, s, e in zip(contents, starts, ends)], dtype=object)

    j = ranges.join(files.select(F.col("key").alias("source"), "content"), "source")
    return j.withColumn("samples", F.pandas_udf(run, "array<int>")("content", "start", "end")).drop("content")


def archive_index(rows: DataFrame) -> DataFrame:
    """(key, archive, offset) of index lines: a key, then an archive's path and a byte after a colon."""
    return manifests.two_columns(rows).select("key", F.regexp_extract("value", r"^(.*):(\d+)$", 1).alias("archive"), F.regexp_extract("value", r"^(.*):(\d+)$", 2).cast("bigint").alias("offset"))


#: Matrices that are read out of an archive at once.
READ = 1000


def matrices_at(index: DataFrame, archives: DataFrame) -> DataFrame:
    """(key, shape, values) of the matrices that an index (key, archive, offset) points to in archives (archive,
    content). An archive meets all its lines at once, so its content is moved once, however many they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # one archive's content and lines
                content, lines = batch.column(0)[i].as_py(), batch.column(1)[i].values
                keys, offsets = lines.field("key"), lines.field("offset").to_pylist()
                for first in range(0, len(offsets), READ):
                    found = [binary.matrix_at(content, o)[0] for o in offsets[first : first + READ]]
                    shapes = pa.array([m.shape for m in found], pa.list_(pa.int64()))
                    values = pa.array([m.ravel().astype(float) for m in found], pa.list_(pa.float64()))
                    yield pa.RecordBatch.from_arrays([keys.slice(first, READ), shapes, values], names=["key", "shape", "values"])

    lines = index.groupBy("archive").agg(F.collect_list(F.struct("key", "offset")).alias("lines"))  # as long as an index file
    return lines.join(archives, "archive").select("content", "lines").mapInArrow(run, "key string, shape array<bigint>, values array<double>")


def arrays_of(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(key, shape, values) of the files of a kind (npy, wav, ark) under a path. HDF5 needs a library that is not there."""
    if kind == "hdf5":
        raise ValueError("HDF5 files need the library h5py")
    if kind == "ark":
        return binary.archive_rows(binary.files(spark, path, "*.ark"))
    files = binary.files(spark, path, f"*.{kind}")
    if kind == "npy":
        return files.select("key", binary.npy_values(F.col("content")).alias("a")).select("key", "a.shape", "a.values")
    if kind == "wav":
        w = files.select("key", binary.wav_samples(F.col("content")).alias("w"))
        return w.select("key", F.array((F.size("w.samples") / F.col("w.channels")).cast("bigint"), F.col("w.channels").cast("bigint")).alias("shape"), F.col("w.samples").cast("array<double>").alias("values"))
    raise ValueError(f"no reader is of kind {kind!r}")


# --- MIDI


def _variable(n: int) -> bytes:
    out = [n & 0x7F]
    while n := n >> 7:
        out.append(n & 0x7F | 0x80)
    return bytes(reversed(out))


def midi_bytes(tempo: int, notes: list[tuple[float, float, str, int]], division: int = 480) -> bytes:
    """A MIDI file of one track: notes (start, end in seconds, lyric, pitch), one after another."""
    ticks = lambda s: round(s * tempo / 60 * division)
    events: list[tuple[int, int, bytes]] = []
    for start, end, lyric, pitch in notes:
        text = lyric.encode()
        events += [(ticks(start), 1, b"\xff\x05" + _variable(len(text)) + text), (ticks(start), 2, bytes((0x90, pitch, 64))), (ticks(end), 0, bytes((0x80, pitch, 0)))]
    track, at = b"\x00\xff\x51\x03" + (60_000_000 // tempo).to_bytes(3, "big"), 0
    for when, _, raw in sorted(events):
        track += _variable(when - at) + raw
        at = when
    track += b"\x00\xff\x2f\x00"
    return b"MThd" + struct.pack(">IHHH", 6, 0, 1, division) + b"MTrk" + struct.pack(">I", len(track)) + track


def midi_notes(content: bytes) -> tuple[int, list[tuple[float, float, str, int]]]:
    """Tempo (beats a minute, the first) and notes of all tracks, by start; changes of tempo count from where they are."""
    if content[:4] != b"MThd":
        raise ValueError("this is no MIDI file")
    size, _, _, division = struct.unpack_from(">IHHH", content, 4)
    at, raw, tempos = 8 + size, [], []
    while at + 8 <= len(content):
        kind, size = content[at : at + 4], struct.unpack_from(">I", content, at + 4)[0]
        p, end, now, status, lyric, held = at + 8, at + 8 + size, 0, 0, "", {}
        at = end
        if kind != b"MTrk":
            continue

        def number(p: int) -> tuple[int, int]:
            n = 0
            while True:
                n, more, p = n << 7 | content[p] & 0x7F, content[p] & 0x80, p + 1
                if not more:
                    return n, p

        while p < end:
            delta, p = number(p)
            now += delta
            if content[p] & 0x80:
                status, p = content[p], p + 1
            if status == 0xFF:
                meta, p = content[p], p + 1
                n, p = number(p)
                if meta == 0x51:
                    tempos.append((now, int.from_bytes(content[p : p + n], "big")))
                elif meta == 0x05:
                    lyric = content[p : p + n].decode("utf-8", "replace")
                p += n
            elif status in (0xF0, 0xF7):
                n, p = number(p)
                p += n
            else:
                first = content[p]
                second = content[p + 1] if status & 0xF0 not in (0xC0, 0xD0) else 0
                p += 1 if status & 0xF0 in (0xC0, 0xD0) else 2
                if status & 0xF0 == 0x90 and second:
                    held[first] = (now, lyric)
                    lyric = ""
                elif status & 0xF0 in (0x80, 0x90) and first in held:
                    begin, said = held.pop(first)
                    raw.append((begin, now, said, first))
    tempos = sorted(tempos) or [(0, 500_000)]
    if tempos[0][0]:
        tempos.insert(0, (0, 500_000))

    def seconds(tick: int) -> float:
        total = 0.0
        for (a, per), (b, _) in zip(tempos, [*tempos[1:], (tick, 0)]):
            if a >= tick:
                break
            total += (min(b, tick) - a) * per / 1e6 / division
        return total

    return round(60_000_000 / tempos[0][1]), sorted((seconds(a), seconds(b), t, n) for a, b, t, n in raw)


def score_of_midi(content: Column) -> Column:
    """Tempo and notes of a MIDI file, as binary.score_of_json gives them."""

    def read(xs: pa.Array) -> pa.Array:
        return pa.array((json.dumps(dict(zip(("tempo", "note"), midi_notes(x.as_py())))) for x in xs), pa.string())

    return binary.score_of_json(F.arrow_udf(read, "string")(content))


def midi_of(tempo: int, notes: Column) -> Column:
    """MIDI files of arrays of (start, end, lyric, pitch). One file's notes at a time are Python's, not a batch's."""

    def write(xs: pa.Array) -> pa.Array:
        return pa.array((midi_bytes(tempo, [(n["start"], n["end"], n["lyric"], n["pitch"]) for n in x.as_py()]) for x in xs), pa.binary())

    return F.arrow_udf(write, "binary")(notes)

