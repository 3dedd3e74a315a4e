"""Structured Streaming: chunked streams with carried state, endpointing, chained streams, and event-time windows."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from corpusloom.session import shared_dir


def rechunked(chunks: DataFrame, width: int, hop: int) -> DataFrame:
    """Streams of sample chunks (key, seq, samples, is_final) as frames (key, frame, total): samples wait in the key's
    state until a window is full, what overlaps stays for the next window, and the final chunk flushes the rest and resets the key.
    Chunks of a key arrive in order of seq within a micro-batch and between them."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, frame = state.get if state.exists else ([], 0)
        kept, out, final = list(kept), [], False
        rows = pd.concat(list(batches)).sort_values("seq")
        for samples, last in zip(rows["samples"], rows["is_final"]):
            kept, final = kept + [float(x) for x in samples], False
            while len(kept) >= width:
                out.append((key[0], frame, sum(kept[:width])))
                kept, frame = kept[hop:], frame + 1
            if last:
                if kept:
                    out.append((key[0], frame, sum(kept)))
                kept, frame, final = [], 0, True
        if final:
            state.remove()
        else:
            state.update((kept, frame))
        yield pd.DataFrame(out, columns=["key", "frame", "total"])

    return chunks.groupBy("key").applyInPandasWithState(run, "key string, frame long, total double", "kept array<double>, frame long", "append", GroupStateTimeout.NoTimeout)


def endpoints(frames: DataFrame, opens: int = 3, closes: int = 1, window: int = 4, least: int = 2, most: int = 50) -> DataFrame:
    """Speech segments of streams of frames (key, seq, speech): over the last `window` frames, more than `opens` speech
    frames open a segment, `closes` or fewer close it; segments of fewer than `least` or more than `most` frames are
    not reported, and what they held stays in the buffer with the next one."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, is_open, first, held = state.get if state.exists else ([], False, 0, 0)
        recent, out = list(recent), []
        for seq, speech in pd.concat(list(batches)).sort_values("seq")[["seq", "speech"]].itertuples(index=False):
            recent = (recent + [int(speech)])[-window:]
            if not is_open and sum(recent) > opens:
                is_open, first = True, (first if held else int(seq) - len(recent) + 1)
                held += len(recent)
            elif is_open:
                held += 1
                if sum(recent) <= closes:
                    is_open = False
                    if least <= held <= most:
                        out.append((key[0], first, int(seq), held))
                        held = 0
        state.update((recent, is_open, first, held))
        yield pd.DataFrame(out, columns=["key", "first", "last", "frames"])

    return frames.groupBy("key").applyInPandasWithState(run, "key string, first long, last long, frames long", "recent array<int>, is_open boolean, first long, held long", "append", GroupStateTimeout.NoTimeout)


def overlap_added(chunks: DataFrame, hop: int, ramp: list[float]) -> DataFrame:
    """Streams of sample chunks (key, seq, samples, is_final) through frames of len(ramp) samples every hop, each
    weighted by ramp and added where they overlap: (key, at, value) of every sample, as soon as no further frame
    reaches it. Samples that do not fill a frame, and open sums, wait in the key's state; the final chunk flushes the
    sums and resets the key, and what has not filled a frame goes."""
    width = len(ramp)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, sums, at = state.get if state.exists else ([], [0.0] * (width - hop), 0)
        kept, sums, out, final = list(kept), list(sums), [], False
        rows = pd.concat(list(batches)).sort_values("seq")
        for samples, last in zip(rows["samples"], rows["is_final"]):
            kept, final = kept + [float(x) for x in samples], False
            while len(kept) >= width:
                sums = [a + x * r for a, x, r in zip(sums + [0.0] * hop, kept, ramp)]
                out += [(key[0], at + i, v) for i, v in enumerate(sums[:hop])]
                kept, sums, at = kept[hop:], sums[hop:], at + hop
            if last:
                out += [(key[0], at + i, v) for i, v in enumerate(sums)]
                kept, sums, at, final = [], [0.0] * (width - hop), 0, True
        if final:
            state.remove()
        else:
            state.update((kept, sums, at))
        yield pd.DataFrame(out, columns=["key", "at", "value"])

    return chunks.groupBy("key").applyInPandasWithState(run, "key string, at long, value double", "kept array<double>, sums array<double>, at long", "append", GroupStateTimeout.NoTimeout)


def waiting(words: DataFrame, lead: int) -> DataFrame:
    """Streams of words (key, seq, word, is_final) through an agent that stays `lead` words behind: once it has read so
    many, it writes a word for each that it reads, and the rest when the stream ends. (key, place, word, read): what it
    writes, and how many words it had read by then."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, read, place = state.get if state.exists else ([], 0, 0)
        held, out, final = list(held), [], False
        rows = pd.concat(list(batches)).sort_values("seq")
        for word, last in zip(rows["word"], rows["is_final"]):
            held, read, final = [*held, word], read + 1, bool(last)
            while held and (final or len(held) >= lead):
                out.append((key[0], place, held.pop(0), read))
                place += 1
            if final:
                held, read, place = [], 0, 0
        if final:
            state.remove()
        else:
            state.update((held, read, place))
        yield pd.DataFrame(out, columns=["key", "place", "word", "read"])

    return words.groupBy("key").applyInPandasWithState(run, "key string, place long, word string, read long", "held array<string>, read long, place long", "append", GroupStateTimeout.NoTimeout)


def dealt(stream: DataFrame, number: str, workers: int) -> DataFrame:
    """A stream with the worker that each row goes to: its number modulo the workers."""
    return stream.withColumn("worker", F.pmod(F.col(number), F.lit(workers)).cast("bigint"))


def chained(*streams: DataFrame) -> DataFrame:
    """Streams of one schema as one."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """An addition: counts in event-time windows, closed when the watermark has passed them."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"))


def from_table(df: DataFrame, key: str) -> tuple[DataFrame, str]:
    """A stream of the rows of df by way of files in the shared folder, rows of a key together; and a folder for what
    the stream needs besides."""
    base = f"{shared_dir(df.sparkSession)}/stream-{uuid.uuid4().hex}"
    df.repartition(key).write.parquet(f"{base}/in")
    return df.sparkSession.readStream.schema(df.schema).parquet(f"{base}/in"), base


def drained(spark: SparkSession, stream: DataFrame, base: str) -> DataFrame:
    """Runs a stream over all that is there now; its results go to files in the folder, from which they are read."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
