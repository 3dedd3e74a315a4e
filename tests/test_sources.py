"""Binary sources, streams and sequential operators on hand-made rows."""

import tracemalloc

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import sequential
from corpusloom.plans import metric_queries
from corpusloom.sources import binary, manifests, packages
from corpusloom.streaming import stateful


def test_sound_files(spark, tmp_path):
    raw = spark.createDataFrame([("a", list(range(400)))], "key string, x array<int>").select(binary.wav_bytes(F.col("x"), 8000, 2).alias("w")).first().w
    (tmp_path / "a.wav").write_bytes(bytes(raw))
    r = binary.files(spark, str(tmp_path), "*.wav").select("key", binary.wav_samples(F.col("content"), 0.01).alias("w")).first()
    assert (r.key, r.w.rate, r.w.channels, r.w.samples) == ("a", 8000, 2, list(range(160, 400)))


@pytest.mark.parametrize("name", ["S9_sound_ranges", "S18_cut_manifest"])
def test_sounds_of_large_samples(spark, tmp_path, name):
    from corpusloom.plans import registry

    ids = [5, 32_200, 70_000, 2_000_000]  # the second one's samples pass 16 bits within the sound
    spark.createDataFrame([(c, t) for c in ids for t in (0, 1)], "conv_id long, turn long").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = sorted((r["first"], r["length"]) for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert rows == ([(320 + c + t, 160) for c in ids for t in (0, 1)] if name == "S9_sound_ranges" else [(160 + c, 80) for c in ids])


def test_samples_that_do_not_fit(spark):
    df = spark.createDataFrame([([0, 1 << 15],)], "x array<int>")
    with pytest.raises(Exception, match="do not fit 16 bits"):
        df.select(binary.wav_bytes(F.col("x"))).collect()
    w = df.select(binary.wav_samples(binary.wav_bytes(F.col("x"), bits=32)).alias("w")).first().w
    assert w.samples == [0, 1 << 15]


def test_archives_of_matrices_and_vectors():
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    raw = binary.archive_bytes([("u1", m), ("u2", m + 1)])
    got = binary.archive_matrices(raw)
    assert [k for k, _ in got] == ["u1", "u2"] and (got[1][1] == m + 1).all()


def test_music_scores(spark):
    note = '<note><pitch><step>C</step><alter>1</alter><octave>4</octave></pitch><duration>2</duration>{}<lyric><text>la</text></lyric></note>'
    xml = f'<score-partwise><part><measure><attributes><divisions>2</divisions></attributes><sound tempo="60"/>{note.format("<tie type=\'start\'/>")}{note.format("<tie type=\'stop\'/>")}<note><rest/><duration>2</duration></note></measure></part></score-partwise>'
    s = spark.createDataFrame([(xml,)], "x string").select(binary.score_of_xml(F.col("x")).alias("s")).first().s
    assert s.tempo == 60 and [tuple(n) for n in s.notes] == [(0.0, 2.0, "la", 61)]


def test_manifests_go_out_and_come_back(spark, tmp_path):
    df = spark.createDataFrame([("a", "x y"), ("b", "z")], "key string, value string")
    manifests.write_manifest(df, str(tmp_path / "m"))
    back = manifests.two_columns(manifests.lines(spark, str(tmp_path / "m")))
    assert sorted(map(tuple, back.collect())) == [("a", "x y"), ("b", "z")]


def test_evenly_spread_places(spark):
    df = spark.range(10)
    for n in (0, 1, 3, 9, 10):
        assert sequential.evenly_spread(df, "id", n).count() == n


def test_carried_samples_over_micro_batches(spark, tmp_path):
    rows = [("a", i, [float(i)] * 3, i == 4) for i in range(5)]
    for i, r in enumerate(rows):
        spark.createDataFrame([r], "key string, seq long, samples array<double>, is_final boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, samples array<double>, is_final boolean").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = stateful.drained(spark, stateful.rechunked(stream, 4, 4), str(tmp_path)).orderBy("frame").collect()
    assert [r.frame for r in got] == [0, 1, 2, 3] and sum(r.total for r in got) == 30.0


def test_watermarked_windows(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'a' AS event_type UNION ALL SELECT timestamp'2024-01-01 05:00:00', 'a'").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(str(tmp_path / "in"))
    got = stateful.drained(spark, stateful.windowed_counts(stream), str(tmp_path)).collect()
    assert [(r.event_type, r.n) for r in got] == [("a", 1)]


def test_rows_are_spread_over_the_whole_table(spark, tmp_path):
    from corpusloom.plans import registry

    spark.range(5000, 9000).selectExpr("id * 3 AS doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["O3_evenly_spread"](spark, str(tmp_path)).collect()
    assert len(got) == 100 and [sum(15000 + q * 3000 <= r.doc_id < 18000 + q * 3000 for r in got) for q in range(4)] == [25] * 4


def test_cohorts_of_several_blocks(spark, tmp_path, monkeypatch):
    from corpusloom.plans import metric_queries

    x = np.random.default_rng(4).normal(size=(80, 6))
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(metric_queries, "COHORT", 3)
    got = {r.vec_id: (r.m, r.s) for r in metric_queries._cohort_stats(spark, str(tmp_path), k=5).collect()}
    assert set(got) == set(range(80))
    for i, (m, s) in got.items():
        best = np.sort(-np.linalg.norm(x[::5] - x[i], axis=1))[-5:]
        assert np.allclose((m, s), (best.mean(), best.std(ddof=1)))


def test_scores_of_a_cohort_hold_the_best_alone():
    x = np.random.default_rng(5).normal(size=(1000, 8)).round(1)
    x[40:90] = x[3]  # more copies than are kept
    for block in (x[:900], x[:4]):
        before = [np.array([-0.1, -9.0])] * len(x)
        tracemalloc.start()
        got = metric_queries._best_scores(pd.Series(list(x)), pd.Series(before), block, 5)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 5_000_000  # all scores would be 7 MB
        for v, best in zip(x, got):
            assert np.array_equal(best, np.sort(np.concatenate((before[0], -np.sqrt(((block - v) ** 2).sum(1)))))[::-1][:5])


def test_archives_of_files(spark, tmp_path):
    rows = [(f"d/{i}.txt", bytes([i]) * i) for i in range(20)]
    df = spark.createDataFrame(rows, "name string, content binary")
    for kind in ("tar", "zip"):
        got = packages.members(packages.packed(df, "name", "content", kind)).collect()
        assert sorted((r.name, bytes(r.content)) for r in got) == sorted(rows)
    raw = packages.packed(df.coalesce(1), "name", "content").first().content
    (tmp_path / "a.tar").write_bytes(bytes(raw))
    assert packages.members(binary.files(spark, str(tmp_path), "*.tar")).count() == 20


def test_an_archive_is_moved_once_for_all_its_lines(spark):
    n = 2500  # as many copies of the archive would be 1.7 GB
    raw, offsets = binary.archive_of([(f"u{i}", np.full((8, 8), i)) for i in range(n)])
    archives = spark.createDataFrame([("a", raw)], "archive string, content binary")
    index = spark.createDataFrame([(f"u{i} a:{at}",) for i, at in enumerate(offsets)], "value string")
    got = packages.matrices_at(packages.archive_index(index), archives)
    assert sorted((r.key, r.shape, set(r["values"])) for r in got.collect()) == sorted((f"u{i}", [8, 8], {float(i)}) for i in range(n))
    assert "collect_list" in got._jdf.queryExecution().optimizedPlan().toString()  # lines meet before they meet the content


def test_artifacts_of_every_kind(spark, tmp_path):
    df = spark.createDataFrame([(1, [1.5, 2.0], ("x", 3), "t", [4, -5], None), (2, None, None, None, [6], ["z"])], "k long, a array<double>, s struct<p:string,q:int>, t string, w array<int>, l array<string>")
    got = packages.write_artifacts(df.drop("l"), "k", str(tmp_path / "out"), {"w": "wav"}).collect()
    assert sorted((r.key, r.field, r.kind) for r in got) == [("1", "a", "npy"), ("1", "s", "json"), ("1", "t", "json"), ("1", "w", "wav"), ("2", "w", "wav")]
    by = {(r.key, r.field): bytes(r.content) for r in got}
    assert by["1", "s"] == b'{"p":"x","q":3}' and by["1", "t"] == b'{"value":"t"}' and binary.read_range(by["1", "w"]) == (16000, 1, [4, -5])
    with pytest.raises(ValueError, match="list"):
        packages.artifact(df, "l")


def test_registries(spark, tmp_path, monkeypatch):
    (tmp_path / "a.yaml").write_text("one: {path: /x}\ntwo: {path: /y, kind: z}\nthree: 5\n")
    (tmp_path / "b.yaml").write_text("two: {path: /w}\nfour: {other: 1}\n")
    monkeypatch.setenv(packages.REGISTRY, f"{tmp_path}/a.yaml: {tmp_path}/b.yaml:")
    assert packages.registry(spark) == {"one": "/x", "two": "/w"} and packages.registry(spark, []) == {}


def test_files_of_a_kind(spark, tmp_path):
    m = np.arange(6, dtype="<f4").reshape(2, 3)
    (tmp_path / "m.ark").write_bytes(binary.archive_bytes([("u1", m), ("u2", m + 1)]))
    np.save(tmp_path / "n.npy", m)
    got = {r.key: (r.shape, r["values"]) for r in packages.arrays_of(spark, str(tmp_path), "ark").collect()}
    assert got == {"u1": ([2, 3], m.ravel().tolist()), "u2": ([2, 3], (m + 1).ravel().tolist())}
    (r,) = packages.arrays_of(spark, str(tmp_path), "npy").collect()
    assert (r.key, r.shape, r["values"]) == ("n", [2, 3], m.ravel().tolist())
    for kind in ("hdf5", "other"):
        with pytest.raises(ValueError):
            packages.arrays_of(spark, str(tmp_path), kind)


def test_recordings(spark):
    line = '{"id": "r1", "sampling_rate": 8000, "duration": 1.5, "sources": [{"type": "file", "channels": [0], "source": "a/r1.wav"}]}'
    rows = spark.createDataFrame([(line,), ("no json",)], "value string")
    assert [tuple(r) for r in packages.recordings(rows).collect()] == [("r1", "a/r1.wav", 0.0, 1.5, 8000)]
    assert packages.recordings(rows, spark.createDataFrame([("r2",)], "key string")).count() == 0


def test_midi(spark):
    notes = [(0.0, 0.5, "do", 60), (0.5, 1.25, "ré", 62), (2.0, 2.5, "", 64)]
    raw = packages.midi_bytes(120, notes)
    assert packages.midi_notes(raw) == (120, notes)
    # Two tracks, running status, a note that ends by velocity 0, and a change of tempo at the second beat.
    tempo = b"\x00\xff\x51\x03\x07\xa1\x20" + b"\x60\xff\x51\x03\x0f\x42\x40" + b"\x00\xff\x2f\x00"
    track = b"\x00\x90\x3c\x40" + b"\x81\x40\x3c\x00" + b"\x00\xff\x2f\x00"
    chunk = lambda t: b"MTrk" + len(t).to_bytes(4, "big") + t
    raw = b"MThd\x00\x00\x00\x06\x00\x01\x00\x02\x00\x60" + chunk(tempo) + chunk(track)
    assert packages.midi_notes(raw) == (120, [(0.0, 0.5 + 1.0, "", 60)])
    with pytest.raises(ValueError):
        packages.midi_notes(b"RIFF")


def test_midi_files_take_the_notes_of_one_at_a_time(spark, monkeypatch):
    made = []
    monkeypatch.setattr(packages.F, "arrow_udf", lambda f, t, real=F.arrow_udf: made.append(f) or real(f, t))
    packages.score_of_midi(packages.midi_of(120, F.col("notes")))
    write, read = made
    notes = [{"start": i * 0.5, "end": i * 0.5 + 0.5, "lyric": f"l{i}", "pitch": 60 + i % 12} for i in range(100)]
    held = pa.array([notes] * 500)
    tracemalloc.start()
    files = write(held)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 5_000_000  # the notes of all would be over 15 MB
    assert [packages.midi_notes(f.as_py()) for f in files[:2]] == [(120, [tuple(n.values()) for n in notes])] * 2
    assert len(set(read(files).to_pylist())) == 1
