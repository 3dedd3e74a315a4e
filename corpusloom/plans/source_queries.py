"""Queries of the manifest readers, on lines made of table rows."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import cleaners
from corpusloom.functions import text as T
from corpusloom.operators import keyed
from corpusloom.plans.registry import query
from corpusloom.session import shared_dir, table
from corpusloom.sources import binary, manifests, packages


def _lines(spark: SparkSession, sf_dir: str, name: str, *parts) -> DataFrame:
    return table(spark, sf_dir, name).select(F.concat(*[F.lit(p) if isinstance(p, str) and p[:1] != "$" else F.col(p[1:]).cast("string") for p in parts]).alias("value"))


@query("S1_two_columns", "SELECT 'utt' || doc_id AS key, CASE WHEN doc_id % 5 = 0 THEN '' ELSE source || ' ' || lang END AS value FROM documents WHERE doc_id % 2 = 0")
def two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.concat(F.lit("utt"), "doc_id", F.when(F.expr("doc_id % 5 = 0"), "").otherwise(F.concat(F.lit("  "), "source", F.lit(" "), "lang"))).alias("value"))
    keys = docs.filter("doc_id % 2 = 0").select(F.concat(F.lit("utt"), "doc_id").alias("key"))
    return manifests.two_columns(rows, keys)


@query("S2_multi_columns", "SELECT 'utt' || doc_id AS key, source || '|' || lang AS values, source || ' ' || lang AS unsplit FROM documents")
def multi_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.multi_columns(_lines(spark, sf_dir, "documents", "utt", "$doc_id", " ", "$source", " ", "$lang")).withColumn("values", F.array_join("values", "|"))


@query("S3_number_sequences", "SELECT 'o' || o_orderkey AS key, o_custkey || ',' || (round_even(o_totalprice, 0)::INTEGER) AS sequence FROM orders")
def number_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select(F.concat(F.lit("o"), "o_orderkey", F.lit(" "), "o_custkey", F.lit(","), F.rint("o_totalprice").cast("int")).alias("value"))
    return manifests.numbers(rows, "csv_int").select("key", F.array_join(F.col("sequence").cast("array<string>"), ",").alias("sequence"))


@query("S4_label_triples", "SELECT 'e' || event_id AS key, '0.5/1.2/' || event_type || ';1.2/1.5/' || user_id AS labels FROM events")
def label_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("e"), "event_id", F.lit(" 0.5 1.2 "), "event_type", F.lit(" 1.2 1.5 "), F.col("user_id").cast("string")).alias("value"))
    flat = F.array_join(F.transform("labels", lambda x: F.concat_ws("/", x["st"], x["et"], x["phone"])), ";")
    return manifests.labels(rows).select("key", flat.alias("labels"))


@query("S6_rttm", "SELECT 'c' || conv_id AS key, role AS speaker, turn * 100 AS start, turn * 100 + 50 AS \"end\" FROM conversations")
def rttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("SPEAKER c"), "conv_id", F.lit(" 1 "), (F.col("turn") * 100).cast("string"), F.lit(" "), (F.col("turn") * 100 + 50).cast("string"), F.lit(" <NA> <NA> "), "role", F.lit(" <NA>")).alias("value"))
    return manifests.rttm(rows)


@query("S7_vad", "SELECT 'c' || conv_id || '-' || turn AS key, 2::BIGINT AS n_spans, (0.75 + 1 + conv_id + turn)::DOUBLE AS seconds FROM conversations")
def vad(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn", F.lit(" 0.5:1.25 2.0:"), (F.col("conv_id") + F.col("turn") + 3).cast("string")).alias("value"))
    seconds = F.aggregate("spans", F.lit(0.0), lambda a, x: a + x["end"] - x["start"])
    return manifests.vad(rows).select("key", F.size("spans").cast("bigint").alias("n_spans"), seconds.alias("seconds"))


@query("S13_key_mismatch", "SELECT coalesce(a.doc_id, b.doc_id) AS key, CASE WHEN b.doc_id IS NULL THEN 'left' ELSE 'right' END AS side FROM documents a FULL OUTER JOIN labels b ON a.doc_id = b.doc_id WHERE a.doc_id IS NULL OR b.doc_id IS NULL")
def key_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").alias("key")
    return manifests.key_mismatch(table(spark, sf_dir, "documents").select(key), table(spark, sf_dir, "labels").select(key))


@query("S15_manifest_semi_scan", "SELECT doc_id, n_chars FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) v USING (doc_id)")
def manifest_semi_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")


@query("S16_json_texts", "SELECT doc_id::VARCHAR AS id, text FROM documents WHERE doc_id % 3 <> 0")
def json_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = F.struct(F.col("doc_id").cast("string").alias("id"), F.when(F.expr("doc_id % 3 <> 0"), F.col("text")).alias("text"))
    return manifests.json_texts(table(spark, sf_dir, "documents").select(F.to_json(named).alias("value")))


@query(
    "S17_dialogues",
    "SELECT conv_id, count(*)::BIGINT AS messages, bool_and(role IN ('user', 'assistant', 'system') AND text IS NOT NULL) AS valid, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id",
)
def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dialogues as ordered messages, and whether each has a known role and a text."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    d = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(m.alias("messages"))
    valid = F.forall("messages", lambda x: x["role"].isin("user", "assistant", "system") & x["text"].isNotNull())
    return d.select("conv_id", F.size("messages").cast("bigint").alias("messages"), valid.alias("valid"), F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"))


@query("S12_synthetic_arrays", "SELECT doc_id, n AS length, list_sum(list_transform(range(0, n), lambda i: ('0x' || substr(md5('42:' || doc_id || ':' || i), 1, 8))::BIGINT))::BIGINT AS total FROM (SELECT doc_id, n_chars % 50 + 1 AS n FROM documents)")
def synthetic_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrays of the lengths that a shape table states, with values of a seeded generator; as floats they are over
    2 ** 32, here they are added up."""
    rows = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 50 + 1).alias("n"))
    x = rows.select("doc_id", "n", binary.synthetic(F.col("doc_id"), F.col("n"), 42).alias("x"))
    total = F.aggregate("x", F.lit(0).cast("bigint"), lambda a, v: a + F.rint(v * 2.0**32).cast("bigint"))
    return x.select("doc_id", F.size("x").cast("bigint").alias("length"), total.alias("total"))


@query("S8_arrays", "SELECT vec_id::VARCHAR AS key, '8,8' AS shape, array_to_string(list_transform(embedding, lambda x: round_even(x::DOUBLE * 1e6, 0)::BIGINT), ',') AS ppm FROM embeddings")
def arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as matrices in array files and back."""
    x = F.col("embedding").cast("array<double>")
    square = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(x, i * 8 + 1, F.lit(8)))
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("key"), binary.npy_values(binary.npy_matrix_bytes(square)).alias("a"))
    return e.select("key", F.array_join(F.col("a.shape").cast("array<string>"), ",").alias("shape"), _ppm("a.values"))


@query("S9_sound_ranges", "SELECT conv_id, turn, 16000 AS rate, 160::BIGINT AS length, (320 + conv_id + turn)::INTEGER AS first, (479 + conv_id + turn)::INTEGER AS last FROM conversations")
def sound_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From 0.02 to 0.03 seconds of sounds of 32 bits whose samples count up."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: (i + F.col("conv_id") + F.col("turn")).cast("int")).alias("x"))
    w = c.select("conv_id", "turn", binary.wav_samples(binary.wav_bytes(F.col("x"), bits=32), 0.02, 0.03).alias("w"))
    return w.select("conv_id", "turn", "w.rate", F.size("w.samples").cast("bigint").alias("length"), F.col("w.samples")[0].alias("first"), F.element_at("w.samples", -1).alias("last"))


@query("S10_stacked_channels", "SELECT item_id, length(text)::BIGINT AS frames, (length(text) - length(text) // 2)::BIGINT AS missing FROM benchmark")
def stacked_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.length("text")
    ones = lambda k: F.transform(F.sequence(F.lit(1), k), lambda i: i.cast("double"))
    s = table(spark, sf_dir, "benchmark").select("item_id", binary.stacked(F.array(ones(n), ones(F.floor(n / 2).cast("int")))).alias("s"))
    return s.select("item_id", F.size("s").cast("bigint").alias("frames"), F.size(F.filter("s", lambda x: F.isnan(x[1]))).cast("bigint").alias("missing"))


@query("S11_scores", "SELECT user_id, 120 AS tempo, count(*)::BIGINT AS notes, max(60 + event_id % 12)::INTEGER AS top, sum(60 + event_id % 12)::BIGINT AS pitches FROM events GROUP BY user_id")
def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    note = F.concat(F.lit("[0.0, 0.5, \"la\", "), (F.col("event_id") % 12 + 60).cast("string"), F.lit("]"))
    j = e.groupBy("user_id").agg(F.concat(F.lit('{"tempo": 120, "note": ['), F.array_join(F.collect_list(note), ","), F.lit("]}")).alias("j"))
    s = j.select("user_id", binary.score_of_json(F.col("j")).alias("s"))
    pitches = F.transform("s.notes", lambda n: n["pitch"])
    return s.select("user_id", "s.tempo", F.size("s.notes").cast("bigint").alias("notes"), F.array_max(pitches).alias("top"), F.aggregate(pitches, F.lit(0).cast("bigint"), lambda a, p: a + p).alias("pitches"))


def _archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as matrices in archives, one a batch of rows: (archive, content, lines), a line for each key and the byte
    of its matrix."""

    def write(batches):
        for pdf in batches:
            rows = [(str(i), np.reshape(v, (8, 8))) for i, v in zip(pdf["vec_id"], pdf["embedding"])]
            if rows:
                name, (content, offsets) = f"a-{rows[0][0]}", binary.archive_of(rows)
                yield pd.DataFrame({"archive": [name], "content": [content], "lines": [[f"{k} {name}:{at}" for (k, _), at in zip(rows, offsets)]]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(write, "archive string, content binary, lines array<string>")


def _ppm(values: str) -> Column:
    return F.array_join(F.transform(values, lambda v: F.rint(v * 1e6).cast("bigint").cast("string")), ",").alias("ppm")


_VECTORS_SQL = "SELECT vec_id::VARCHAR AS key, '8,8' AS shape, array_to_string(list_transform(embedding, lambda x: round_even(x::DOUBLE * 1e6, 0)::BIGINT), ',') AS ppm FROM embeddings"


@query("S14_matrix_archives", _VECTORS_SQL)
def matrix_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as matrices in archives, and back."""
    m = binary.archive_rows(_archives(spark, sf_dir))
    return m.select("key", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), _ppm("values"))


@query("S18_indexed_archives", _VECTORS_SQL)
def indexed_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same matrices, each by its line in an index: archive and byte."""
    a = _archives(spark, sf_dir)
    index = a.select(F.explode("lines").alias("value"))
    m = packages.matrices_at(packages.archive_index(index), a.select("archive", "content"))
    return m.select("key", F.array_join(F.col("shape").cast("array<string>"), ",").alias("shape"), _ppm("values"))


@query("S18_cut_manifest", "SELECT 'cut' || conv_id || '-' || turn AS id, (160 + conv_id)::INTEGER AS first, 80::BIGINT AS length FROM conversations WHERE turn % 2 = 0")
def cut_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cuts of five milliseconds out of sounds of 32 bits whose samples count up, those of even turns."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    source = F.struct(F.lit("file").alias("type"), F.array(F.lit(0)).alias("channels"), F.concat(F.lit("r"), "conv_id").alias("source"))
    recording = F.struct(F.concat(F.lit("r"), "conv_id").alias("id"), F.lit(16000).alias("sampling_rate"), F.lit(0.0625).alias("duration"), F.array(source).alias("sources"))
    named = F.concat(F.lit("cut"), "conv_id", F.lit("-"), "turn")
    rows = c.select(F.to_json(F.struct(named.alias("id"), F.lit(0.01).alias("start"), F.lit(0.005).alias("duration"), recording.alias("recording"))).alias("value"))
    sounds = c.select("conv_id").distinct().select(F.concat(F.lit("r"), "conv_id").alias("key"), binary.wav_bytes(F.transform(F.sequence(F.lit(0), F.lit(999)), lambda i: (i + F.col("conv_id")).cast("int")), bits=32).alias("content"))
    s = packages.sound_of(packages.cuts(rows, c.filter("turn % 2 = 0").select(named.alias("key"))), sounds)
    return s.select("id", F.col("samples")[0].alias("first"), F.size("samples").cast("bigint").alias("length"))


@query("S19_converted_files", _VECTORS_SQL)
def converted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives read, written again as array files, and read."""
    m = binary.archive_rows(_archives(spark, sf_dir))
    square = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice("values", i * 8 + 1, F.lit(8)))
    a = m.select("key", binary.npy_values(binary.npy_matrix_bytes(square)).alias("a"))
    return a.select("key", F.array_join(F.col("a.shape").cast("array<string>"), ",").alias("shape"), _ppm("a.values"))


@query("S20_artifacts", "SELECT vec_id::VARCHAR AS key, 'embedding' AS field, 'npy' AS kind, array_to_string(list_transform(embedding, lambda x: round_even(x::DOUBLE * 1e6, 0)::BIGINT), ',') AS said FROM embeddings UNION ALL SELECT vec_id::VARCHAR, 'label', 'json', '{\"value\":' || label || '}' FROM embeddings UNION ALL SELECT vec_id::VARCHAR, 'meta', 'json', '{\"id\":' || vec_id || ',\"label\":' || label || '}' FROM embeddings")
def artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several types written to one typed sink and read again: arrays as array files, others as JSON."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", F.struct(F.col("vec_id").alias("id"), "label").alias("meta"))
    a = packages.write_artifacts(e, "vec_id", f"{shared_dir(spark)}/artifacts-{uuid.uuid4().hex}")
    arrays_ = a.filter("kind = 'npy'").select("key", "field", "kind", binary.npy_values(F.col("content")).alias("a")).select("key", "field", "kind", _ppm("a.values").alias("said"))
    return arrays_.unionByName(a.filter("kind = 'json'").select("key", "field", "kind", F.col("content").cast("string").alias("said")))


@query("S21_packed_texts", "SELECT 'docs/' || doc_id || '.txt' AS name, text FROM documents")
def packed_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as files in archives, half of them tar and half zip, and out of them."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("docs/"), "doc_id", F.lit(".txt")).alias("name"), F.col("text").cast("binary").alias("content"))
    tars, zips = (packages.packed(d.filter(F.col("doc_id") % 2 == k), "name", "content", kind) for k, kind in ((0, "tar"), (1, "zip")))
    return packages.members(tars.unionByName(zips)).select("name", F.col("content").cast("string").alias("text"))


@query("S5_random_lines", "SELECT doc_id, text FROM documents ORDER BY md5('11:' || doc_id), doc_id LIMIT 20")
def random_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twenty lines in a fixed shuffle, whatever their keys: a sample of a stated size."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").orderBy(keyed.hashed_order("doc_id", 11), "doc_id").limit(20)


@query("S22_dataset_registry", "SELECT 'docs' AS dataset, count(*)::BIGINT AS rows FROM benchmark UNION ALL SELECT 'labels', count(*) FROM labels UNION ALL SELECT 'events', count(*) FROM events")
def dataset_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets named in two YAML files; the later file replaces a name of the earlier one."""
    base = f"{shared_dir(spark)}/registry-{uuid.uuid4().hex}"
    path = lambda name: f"{{path: '{sf_dir.rstrip('/')}/{name}.parquet'}}"
    for i, text in enumerate((f"docs: {path('documents')}\nlabels: {path('labels')}\nold: {{note: none}}\n", f"docs: {path('benchmark')}\nevents: {path('events')}\n")):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.text(f"{base}/{i}.yaml")
    known = packages.registry(spark, [f"{base}/0.yaml", f"{base}/1.yaml"])
    counts = [spark.read.parquet(p).agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows") for name, p in sorted(known.items())]
    return reduce(DataFrame.unionByName, counts)


@query("F6_sentence_pieces")
def sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subword pieces by a model file, and the text that they make; tests hold them against the library."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    b = table(spark, sf_dir, "benchmark").select("item_id", "text", cleaners.tokens(F.col("text"), "bpe", model).alias("pieces"))
    return b.withColumn("back", cleaners.text_of_pieces(F.col("pieces"), model))


@query("M3_token_error_rate")
def token_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error rate of subword tokens of texts against the same with every seventh word left out, and of all texts; tests
    hold it against plain alignments."""
    import public_tokenizers

    model = public_tokenizers.path("piece_bpe_32k.model")
    w = F.split("text", "[ \n]+")
    hyp = F.array_join(F.filter(w, lambda x, i: (i + 1) % 7 != 0), " ")
    b = table(spark, sf_dir, "benchmark").select("item_id", cleaners.tokens(F.col("text"), "bpe", model).alias("r"), cleaners.tokens(hyp, "bpe", model).alias("h"))
    e = b.select("item_id", T.word_errors(F.col("r"), F.col("h")).cast("bigint").alias("errors"), F.size("r").cast("bigint").alias("tokens"))
    whole = e.agg(F.lit(None).cast("bigint").alias("item_id"), F.sum("errors").alias("errors"), F.sum("tokens").alias("tokens"))
    return e.unionByName(whole).withColumn("ter", F.round(F.col("errors") / F.col("tokens") * 100, 2))


@query("S11_midi_scores", "SELECT user_id, 120 AS tempo, count(*)::BIGINT AS notes, sum(60 + event_id % 12)::BIGINT AS pitches, string_agg('l' || event_id, ' ' ORDER BY event_id) AS lyrics, round_even(count(*) * 0.5, 3) AS seconds FROM events GROUP BY user_id")
def midi_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's events as notes of a MIDI file, one after another, and back."""
    e = keyed.within_group(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", ["event_id"], "r")
    note = F.struct((F.col("r") * 0.5).alias("start"), (F.col("r") * 0.5 + 0.5).alias("end"), F.concat(F.lit("l"), "event_id").alias("lyric"), (F.col("event_id") % 12 + 60).cast("int").alias("pitch"))
    m = e.groupBy("user_id").agg(F.array_sort(F.collect_list(note)).alias("notes")).select("user_id", packages.score_of_midi(packages.midi_of(120, F.col("notes"))).alias("s"))
    total = F.aggregate("s.notes", F.lit(0).cast("bigint"), lambda a, n: a + n["pitch"])
    return m.select("user_id", "s.tempo", F.size("s.notes").cast("bigint").alias("notes"), total.alias("pitches"), F.array_join(F.transform("s.notes", lambda n: n["lyric"]), " ").alias("lyrics"), F.round(F.array_max(F.transform("s.notes", lambda n: n["end"])), 3).alias("seconds"))


@query("S15_range_fetch", "SELECT doc_id, (doc_id % 7 * 16 + doc_id % 100)::INTEGER AS first, (n_chars % 5 + 1) * 16 AS length FROM documents SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) v USING (doc_id)")
def range_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the rows that a list of valid ids keeps, a range of a sound each, by start and end in the manifest."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars").join(table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id"), "doc_id", "left_semi")
    start = F.col("doc_id") % 7 * 0.001 + 0.00001
    ranges = d.select(F.col("doc_id").alias("id"), "n_chars", F.col("doc_id").cast("string").alias("source"), start.alias("start"), (start + (F.col("n_chars") % 5 + 1) * 0.001).alias("end"))
    sounds = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("key"), binary.wav_bytes(F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: (i + F.col("doc_id") % 100).cast("int"))).alias("content"))
    s = packages.sound_of(ranges, sounds)
    return s.select(F.col("id").alias("doc_id"), F.col("samples")[0].alias("first"), F.size("samples").cast("bigint").alias("length"))
