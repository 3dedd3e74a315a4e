"""Operators on hand-made rows with known results."""

import math
import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import jobs, keyed, metrics, ranks, scans, sequential
from corpusloom.sources import manifests


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order or df.columns).collect()]


def test_two_columns_with_a_bare_key(spark):
    got = manifests.two_columns(lines(spark, "  rec7\tmics/left 7.flac  ", "rec9", " ", "rec8 x"))
    assert rows(got) == [("rec7", "mics/left 7.flac"), ("rec8", "x"), ("rec9", "")]


def test_duplicate_keys_fail(spark):
    with pytest.raises(Exception, match="duplicated key rec7"):
        manifests.two_columns(lines(spark, "rec7 one", "rec8 two", "rec7 one")).collect()


def test_multi_columns(spark):
    got = manifests.multi_columns(lines(spark, "s1 north  south east", "s2", "s3 west"))
    assert [(r.key, r["values"]) for r in got.orderBy("key").collect()] == [("s1", ["north", "south", "east"]), ("s2", [""]), ("s3", ["west"])]


def test_numbers_and_what_is_none(spark):
    assert rows(manifests.numbers(lines(spark, "u 17,-4", "v 9"), "csv_int")) == [("u", [17, -4]), ("v", [9])]
    assert rows(manifests.numbers(lines(spark, "u 2.5 1e3"), "text_float")) == [("u", [2.5, 1000.0])]
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        manifests.numbers(lines(spark, "u 8 eight"), "text_int").collect()


def test_label_triples(spark):
    got = manifests.labels(lines(spark, "song 0 0.25 do 0.25 2 re 2 2.75 mi")).first().labels
    assert [tuple(x) for x in got] == [("0", "0.25", "do"), ("0.25", "2", "re"), ("2", "2.75", "mi")]


def test_lockstep_fails_on_a_one_sided_key(spark):
    a, b = spark.createDataFrame([(1, 2)], "k int, x int"), spark.createDataFrame([(2, 3)], "k int, y int")
    with pytest.raises(Exception, match="key on one side only"):
        keyed.lockstep(a, b, "k").collect()


@pytest.mark.parametrize("scores,labels,eer", [([3.0, 5.0, 4.0, 9.0, 8.0], [0, 0, 0, 1, 1], 0.0), ([6.0, 5.0, 1.0], [0, 0, 1], 100.0), ([1.0, 2.0, 3.0, 4.0], [0, 1, 0, 1], 50.0)])
def test_equal_error_rate(spark, scores, labels, eer):
    df = spark.createDataFrame(list(zip(scores, labels)), "score double, label int")
    assert math.isclose(metrics.equal_error_rate(df, "score", "label").first().eer, eer, abs_tol=1e-9)


def test_min_cost_of_separable_scores(spark):
    df = spark.createDataFrame([(1.0, 1), (0.0, 0), (0.9, 1), (0.1, 0)], "score double, label int")
    assert metrics.min_cost(df, "score", "label").first().min_dcf == 0.0


def test_word_errors(spark):
    df = spark.createDataFrame([("hello world", "hello word"), ("foo", "foo"), ("", "a"), ("é b c", "b c d")], "ref string, hyp string")
    got = [r.errors for r in metrics.word_error_counts(df, "ref", "hyp").collect()]
    assert got == [1, 0, 1, 2]


def test_characters_of_any_plane(spark, tmp_path):
    from corpusloom.plans import registry

    ids = [0, 1499, 0xFEFF - 0x4E00, 45_567, 45_568, 89_999, 559_999]  # the last three are beyond U+FFFF
    spark.createDataFrame(list(enumerate([*ids, 0xD800 - 0x4E00, 0x110000 - 0x4E00])), "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.c for r in registry.queries()["R26_id_characters"](spark, str(tmp_path)).collect()}
    assert got == dict(enumerate([*(chr(19968 + i) for i in ids), None, None]))


def test_tokens_of_blank_texts(spark):
    df = spark.createDataFrame([("",), ("  ",), (" a  b",)], "t string")
    assert [r[0] for r in df.select(T.words(F.col("t"))).collect()] == [[], [], ["a", "b"]]


def test_punctuation(spark):
    df = spark.createDataFrame([("a$b+c-d…é don't <space> x",)], "t string")
    assert df.select(T.without_punctuation(F.col("t"))).first()[0] == "abcdé don't <space> x"


def test_contained_intervals(spark):
    df = spark.createDataFrame([(1, 0.0, 5.0), (1, 1.0, 4.0), (1, 4.5, 9.0), (1, 5.0, 8.0), (1, 8.0, 12.0)], "k int, s double, e double")
    assert rows(scans.without_contained(df, "k", "s", "e").select("s", "e")) == [(0.0, 5.0), (4.5, 9.0), (8.0, 12.0)]


def test_chunks_and_short_arrays(spark):
    df = spark.createDataFrame([([0, 1, 2, 3, 4, 5, 6, 7],), ([8, 9],)], "x array<bigint>")
    assert [r[0] for r in df.select(scans.chunks(F.col("x"), 3, 2)).collect()] == [[[0, 1, 2], [2, 3, 4], [4, 5, 6]], []]


def test_duplicate_cap_keeps_rare_texts(spark):
    df = spark.createDataFrame([(i, "a" if i < 50 else f"b{i}") for i in range(60)], "id int, t string")
    kept = [r.id for r in keyed.duplicate_cap(df, "t", "id", 5).collect()]
    assert set(range(50, 60)) <= set(kept) and 0 < len([i for i in kept if i < 50]) < 25


def test_duplicate_cap_follows_its_sequence(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PER_SLICE", 7)
    df = spark.createDataFrame([(i, "ab"[i % 2] if i < 40 else f"c{i}") for i in range(60)], "id int, t string")
    kept = sorted(r.id for r in keyed.duplicate_cap(df, "t", "id", 5).collect())
    assert kept == [i for i in range(60) if i >= 40 or (i + 1) * 103349 % 71147 < 5 * 71147 / 20]


@pytest.mark.parametrize("text", ["", " ", "\n \n", "a", " a", "a\n", "\n a  b\n\nc ", "a\tb c\u00a0d"])
def test_split_words(spark, text):
    assert sorted(T.split_words(text)) == sorted(re.split("[ \n]+", text))
    assert sorted(T.split_words(text)) == sorted(spark.createDataFrame([(text,)], "t string").select(F.split("t", "[ \n]+")).first()[0])


def test_unknown_tokens(spark, monkeypatch):
    rows = [(1, "a b a "), (2, "a b c"), (2, "c"), (3, None), (5, "d"), (None, "a  d")]
    df = spark.createDataFrame(rows, "k long, t string")
    for common, held in ((0, 1), (1, 2), (50, 50)):
        monkeypatch.setattr(keyed, "COMMON", common)
        monkeypatch.setattr(keyed, "HELD", held)
        got = keyed.unknown_tokens(df, "k", "t", T.split_words, 3)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, 4, 2), (2, 4, 3), (5, 1, 1), (None, 2, 1)], key=str)
    assert "regexp" not in (plan := got._jdf.queryExecution().optimizedPlan().toString()) and "split" not in plan  # no row a word there


def test_trials(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3] if i < 30 else "d") for i in range(31)], "id long, spk string")
    got = [tuple(r) for r in keyed.trials(df, "id", "spk", F.col("id") % 4 == 0, 3, 5, seed=1).collect()]
    spk = {r.id: r.spk for r in df.collect()}
    enrolled = [i for i in range(31) if i % 4 == 0]
    assert len(set(got)) == len(got) and all(e % 4 == 0 and e != t and y == (spk[e] == spk[t]) for e, t, y in got)
    for e in enrolled:
        assert sum(1 for x, _, y in got if x == e and y) >= 3 and sum(1 for x, _, y in got if x == e and not y) >= 5
    assert {x for e, t, _ in got for x in (e, t)} == set(range(31))


def test_groups_of_any_size_are_numbered(spark, monkeypatch):
    monkeypatch.setattr(ranks, "PER_SLICE", 9)
    df = spark.createDataFrame([(i, None if i % 5 == 0 else i % 2) for i in range(50)], "id long, g int")
    got = keyed.within_group(df, "g", ["id"], "r").collect()
    for g in (None, 0, 1):
        mine = sorted((r.id, r.r) for r in got if r.g == g)
        assert [r for _, r in mine] == list(range(len(mine))) and all(r._size == len(mine) for r in got if r.g == g)


def test_streamed_rows_keep_their_order(spark):
    df = spark.createDataFrame([("ab"[i % 2], i, 4.0 if i % 3 else None) for i in range(30)], "k string, i int, d double")
    got = sequential.groups_by_duration(df.repartition(5), "k", "i", "d", 10).collect()
    for k in "ab":
        part = used = 0
        for r in sorted((r for r in got if r.k == k), key=lambda r: r.i):
            if used > 10:
                part, used = part + 1, 0
            used += 4 if r.i % 3 else 0
            assert r.part == part


def test_the_rest_stands_without_the_optional_subpackage(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op') or k == 'pipeline' for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})


def test_user_code_on_samples(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(2500)], "k long, t string")
    one = jobs.each_sample(df, "k", lambda k, r: {"k": k, "n": len(r["t"])}, "k long, n int")
    assert {(r.k, r.n) for r in one.collect()} == {(i, len(f"t{i}")) for i in range(2500)}
    many = jobs.each_sample(df, "k", lambda k, r: None if k % 2 else ({"k": k, "n": j} for j in range(k % 3)), "k long, n int")
    assert many.count() == sum(i % 3 for i in range(0, 2500, 2))
    for f, says in ((lambda k, r: {"other": 1}, "no \\['other'\\]"), (lambda k, r: {"n": "x"}, None)):
        with pytest.raises(Exception, match=says):
            jobs.each_sample(df, "k", f, "k long, n int").collect()
    both = jobs.transformed(df, None, lambda d: d.filter("k < 10"), lambda d: d.withColumn("u", F.upper("t")))
    assert {r.u for r in both.collect()} == {f"T{i}" for i in range(10)}


def test_jobs_and_measures(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3) for i in range(30)], "k long, g long")
    got = jobs.map_merge(df, "k", lambda k, r: {"g": r["g"], "x": float(k)}, "g long, x double", str(tmp_path / "out"), lambda d: d.groupBy("g").agg(F.sum("x").alias("x")))
    assert {r.g: r.x for r in got.collect()} == {g: float(sum(range(g, 30, 3))) for g in range(3)}
    m = jobs.measured({"size": lambda d: d.agg(F.count("*").alias("n"), F.max("k").alias("top"))}, {"a": df, "b": df.filter("k < 5")})
    assert sorted(map(tuple, m.collect())) == [("size", "a", "n", 30.0), ("size", "a", "top", 29.0), ("size", "b", "n", 5.0), ("size", "b", "top", 4.0)]


def test_datasets_that_build_themselves(spark, tmp_path):
    class Numbers:
        def __init__(self, works=True):
            self.source, self.works, self.calls = False, works, []

        def is_source_prepared(self):
            return self.source

        def prepare_source(self):
            self.calls.append("prepare")
            self.source = self.works

        def is_built(self):
            return (tmp_path / "t").exists()

        def build(self, spark):
            self.calls.append("build")
            spark.range(5).write.parquet(self.path())

        def path(self):
            return str(tmp_path / "t")

    with pytest.raises(RuntimeError):
        jobs.built(spark, Numbers(works=False))
    n = Numbers()
    assert jobs.built(spark, n).count() == jobs.built(spark, n).count() == 5 and n.calls == ["prepare", "build"]


def test_things_named_in_a_configuration():
    made = jobs.from_config({"a": {"_target_": "datetime.date", "year": 2020, "month": 1, "day": 2}, "b": [1, {"c": 2}]}, ("datetime",))
    assert str(made["a"]) == "2020-01-02" and made["b"] == [1, {"c": 2}]
    with pytest.raises(ValueError, match="not under"):
        jobs.from_config({"_target_": "os.system", "command": "true"}, ("datetime",))
