"""Queries of metrics, vector functions and recipe operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import keyed, metrics, ranks
from corpusloom.plans.aggregate_queries import LABELS_SQL, SCORES_SQL, label_pairs, scores
from corpusloom.plans.registry import query
from corpusloom.session import shared_dir, table

# A hypothesis is its reference with every seventh word left out.
_PAIRS_SQL = """SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda w: w <> '') AS r, list_filter(list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda w: w <> ''), lambda w, i: i % 7 <> 0) AS h FROM benchmark"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda x: x != "")
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(w, " ").alias("ref"), F.array_join(F.filter(w, lambda x, i: (i + 1) % 7 != 0), " ").alias("hyp"))


@query("M1_word_errors", f"SELECT item_id, (len(r) - len(h))::BIGINT AS errors, len(r)::BIGINT AS ref_words FROM ({_PAIRS_SQL})")
def word_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.word_error_counts(_pairs(spark, sf_dir), "ref", "hyp").select("item_id", "errors", "ref_words")


@query("M1_word_error_rate", f"SELECT round(sum(len(r) - len(h)) / sum(len(r))::DOUBLE * 100, 2) AS wer FROM ({_PAIRS_SQL})")
def word_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.word_error_rate(_pairs(spark, sf_dir), "ref", "hyp")


@query("M2_char_errors", "SELECT c_custkey, levenshtein(lower(c_name), lower(c_mktsegment))::BIGINT AS errors, length(c_name)::BIGINT AS ref_chars FROM customer")
def char_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.char_error_counts(table(spark, sf_dir, "customer"), "c_name", "c_mktsegment").select("c_custkey", "errors", "ref_chars")


@query("M5_equal_error_rate", f"""
WITH g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM ({SCORES_SQL}) GROUP BY score), c AS (SELECT score, sum(p) OVER w AS tps, sum(q) OVER w AS fps, sum(p) OVER () AS p, sum(q) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC)),
b AS (SELECT *, lead(tps) OVER w - 2 * tps + coalesce(lag(tps) OVER w, 0) AS bt, lead(fps) OVER w - 2 * fps + coalesce(lag(fps) OVER w, 0) AS bf FROM c WINDOW w AS (ORDER BY score DESC)),
r AS (SELECT 1 - tps / p::DOUBLE AS fnr, fps / n::DOUBLE AS fpr FROM b WHERE bt IS NULL OR bt <> 0 OR bf <> 0 UNION ALL SELECT 1, 0)
SELECT greatest(fnr, fpr) * 100 AS eer FROM r ORDER BY abs(fnr - fpr), fpr LIMIT 1""")
def equal_error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.equal_error_rate(scores(spark, sf_dir), "score", "label")


@query("M6_min_dcf", f"""
WITH g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM ({SCORES_SQL}) GROUP BY score), c AS (SELECT 1 - sum(p) OVER w / sum(p) OVER ()::DOUBLE AS fnr, sum(q) OVER w / sum(q) OVER ()::DOUBLE AS fpr FROM g WINDOW w AS (ORDER BY score DESC))
SELECT least(min(fnr * 0.05 + fpr * (1 - 0.05)), 0.05) / 0.05 AS min_dcf FROM c""")
def min_dcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.min_cost(scores(spark, sf_dir), "score", "label")


@query("M9_accuracy", f"SELECT 1 - sum((t <> p)::INT) / count(*)::DOUBLE AS accuracy FROM ({LABELS_SQL})")
def accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label_pairs(spark, sf_dir).agg((1 - F.count_if(F.col("t") != F.col("p")) / F.count("*")).alias("accuracy"))


@query("M10_language_id", f"""
WITH c AS ({LABELS_SQL}), k AS (SELECT DISTINCT t AS k FROM c), x AS (SELECT k, count(*) FILTER (WHERE t = k AND p = k)::DOUBLE AS tp, count(*) FILTER (WHERE p = k)::DOUBLE AS np, count(*) FILTER (WHERE t = k)::DOUBLE AS nt FROM c CROSS JOIN k GROUP BY k)
SELECT sum(tp / np) / count(*) AS macro_p, sum(tp / nt) / count(*) AS macro_r, sum(tp) / sum(nt) AS micro FROM x""")
def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision and recall averaged over the target classes, and micro accuracy."""
    n = label_pairs(spark, sf_dir).groupBy("t", "p").agg(F.count("*").alias("n"))
    t = n.groupBy(F.col("t").alias("k")).agg(F.sum("n").alias("nt"), F.sum(F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)).alias("tp"))
    x = t.join(n.groupBy(F.col("p").alias("k")).agg(F.sum("n").alias("np")), "k", "left")
    return x.agg((F.sum(F.col("tp") / F.col("np")) / F.count("*")).alias("macro_p"), (F.sum(F.col("tp") / F.col("nt")) / F.count("*")).alias("macro_r"), (F.sum("tp") / F.sum("nt")).alias("micro"))


@query("M11_average_precision", f"""
WITH s AS (SELECT event_id % 5 AS k, score, label FROM ({SCORES_SQL})), g AS (SELECT k, score, sum(label) AS p, count(*) AS n FROM s GROUP BY 1, 2), c AS (SELECT *, sum(p) OVER w AS tps, sum(n) OVER w AS seen FROM g WINDOW w AS (PARTITION BY k ORDER BY score DESC))
SELECT k, sum(p * tps / seen::DOUBLE) / sum(p) AS ap FROM c GROUP BY k""")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scores(spark, sf_dir).withColumn("k", F.col("event_id") % 5), "score", "label", "k")


@query("M11_area_under_curve", f"""
WITH s AS (SELECT event_id % 5 AS k, score, label FROM ({SCORES_SQL})), g AS (SELECT k, score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY 1, 2), c AS (SELECT *, sum(q) OVER (PARTITION BY k ORDER BY score) - q AS below FROM g)
SELECT k, sum(p * (below + q / 2)) / (sum(p) * sum(q)) AS auc FROM c GROUP BY k""")
def area_under_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.area_under_curve(scores(spark, sf_dir).withColumn("k", F.col("event_id") % 5), "score", "label", "k")


@query("M15_token_accuracy", "SELECT item_id, len(list_filter(list_zip(string_split(text, ''), string_split(substr(text, 2), '')), lambda x: x[1] = x[2]))::BIGINT AS same, length(text)::BIGINT AS n FROM benchmark")
def token_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that equal the next one: a prediction that lags by one."""
    a, b = F.split("text", ""), F.split(F.expr("substring(text, 2)"), "")
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return table(spark, sf_dir, "benchmark").select("item_id", F.size(same).cast("bigint").alias("same"), F.length("text").cast("bigint").alias("n"))


@query("M16_positional_accuracy", "SELECT count(*) FILTER (WHERE d.lang = e.lang)::BIGINT AS same, count(*)::BIGINT AS n FROM (SELECT lang, row_number() OVER (ORDER BY doc_id) AS r FROM documents) d JOIN (SELECT lang, row_number() OVER (ORDER BY doc_id DESC) AS r FROM documents) e USING (r)")
def positional_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows compared by place, from either end; a shorter side would end it."""
    d = ranks.numbered(table(spark, sf_dir, "documents").select("doc_id", "lang"), ["doc_id"])
    last = d.agg(F.max("place").alias("last"))
    b = d.crossJoin(F.broadcast(last)).select(F.col("lang").alias("other"), (F.col("last") - F.col("place")).alias("place"))
    return d.join(b, "place").agg(F.count_if(F.col("lang") == F.col("other")).alias("same"), F.count("*").alias("n"))


@query("M20_metric_table", f"SELECT 'accuracy' AS metric, 'labels' AS test_set, 1 - sum((t <> p)::INT) / count(*)::DOUBLE AS value FROM ({LABELS_SQL}) UNION ALL SELECT 'rows', 'labels', count(*)::DOUBLE FROM labels")
def metric_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = accuracy(spark, sf_dir).select(F.lit("accuracy").alias("metric"), F.lit("labels").alias("test_set"), F.col("accuracy").alias("value"))
    return a.unionByName(table(spark, sf_dir, "labels").agg(F.count("*").cast("double").alias("value")).select(F.lit("rows").alias("metric"), F.lit("labels").alias("test_set"), "value"))


# --- vectors


@query("N1_global_normalise", """
WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim FROM embeddings), s AS (SELECT dim, avg(x) AS m, sqrt(greatest(sum(x * x) / count(*) - avg(x) * avg(x), 1e-20)) AS sd FROM x GROUP BY dim)
SELECT vec_id, dim, round_even((x - m) / sd * 1e6, 0)::BIGINT AS z_ppm FROM x JOIN s USING (dim)""")
def global_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats of all rows applied to each; the stats have one row a dimension."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    m = F.avg("x")
    s = x.groupBy("dim").agg(m.alias("m"), F.sqrt(F.greatest(F.sum(F.col("x") * F.col("x")) / F.count("*") - m * m, F.lit(1e-20))).alias("sd"))
    return x.join(s, "dim").select("vec_id", "dim", F.rint((F.col("x") - F.col("m")) / F.col("sd") * 1e6).cast("bigint").alias("z_ppm"))


@query("N2_row_normalise", "SELECT vec_id, dim, x - avg(x) OVER (PARTITION BY vec_id) AS centred FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim FROM embeddings)")
def row_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    mean = F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x")
    return e.select("vec_id", F.posexplode(F.transform("x", lambda v: v - mean)).alias("dim", "centred"))


@query("N3_group_normalise", """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim FROM embeddings)
SELECT vec_id, dim, round_even((x - avg(x) OVER w) / greatest(sqrt(avg(x * x) OVER w - avg(x) OVER w * avg(x) OVER w), 1e-10) * 1e6, 0)::BIGINT AS z_ppm FROM x WINDOW w AS (PARTITION BY label, dim)""")
def group_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    m = F.avg("x")
    s = x.groupBy("label", "dim").agg(m.alias("m"), F.greatest(F.sqrt(F.avg(F.col("x") * F.col("x")) - m * m), F.lit(1e-10)).alias("sd"))
    return x.join(s, ["label", "dim"]).select("vec_id", "dim", F.rint((F.col("x") - F.col("m")) / F.col("sd") * 1e6).cast("bigint").alias("z_ppm"))


_TRIALS_SQL = "SELECT a.vec_id AS enr, b.vec_id AS tst, (a.label = b.label)::INTEGER AS target, -sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id * 7 + 1) % 500"


def trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials as pairs of ids, both joined with their vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"), "label")
    a = e.select(F.col("vec_id").alias("enr"), F.col("x").alias("xa"), F.col("label").alias("la"), ((F.col("vec_id") * 7 + 1) % 500).alias("tst"))
    b = e.select(F.col("vec_id").alias("tst"), F.col("x").alias("xb"), F.col("label").alias("lb"))
    return a.join(b, "tst").select("enr", "tst", (F.col("la") == F.col("lb")).cast("int").alias("target"), (-metrics.distance(F.col("xa"), F.col("xb"))).alias("score"))


@query("J8_trial_scores", f"SELECT enr, tst, target, round_even(score * 1e6, 0)::BIGINT AS score_ppm FROM ({_TRIALS_SQL})")
def trial_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trials(spark, sf_dir).select("enr", "tst", "target", F.rint(F.col("score") * 1e6).cast("bigint").alias("score_ppm"))


@query("N4_unit_vectors", "SELECT vec_id, round_even(embedding[1]::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * 1e6, 0)::BIGINT AS first_ppm FROM embeddings")
def unit_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", metrics.unit(F.col("embedding").cast("array<double>")).alias("u"))
    return e.select("vec_id", F.rint(F.col("u")[0] * 1e6).cast("bigint").alias("first_ppm"))


@query("N5_parsers", "SELECT p_partkey, try_cast(regexp_extract(p_type || p_size, '[0-9]+$') AS INTEGER) AS size, try_cast(p_brand AS DOUBLE) AS none FROM part")
def parsers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What cannot be read as a number is null."""
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.regexp_extract(F.concat("p_type", "p_size"), "[0-9]+$", 0).try_cast("int").alias("size"), F.col("p_brand").try_cast("double").alias("none"))


_COHORT_SQL = "WITH q AS (SELECT * FROM embeddings), c AS (SELECT * FROM embeddings WHERE label % 5 = 0), s AS (SELECT q.vec_id, c.vec_id AS other, -sqrt(list_sum(list_transform(list_zip(q.embedding, c.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) * (p[1]::DOUBLE - p[2]::DOUBLE)))) AS s FROM q CROSS JOIN c), t AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, other) AS r FROM s)"


#: Vectors of a cohort that a task holds at once; a larger cohort is scored block by block.
COHORT = 10_000
#: Rows that are scored against a block at once.
AT_ONCE = 128


def _cohort_blocks(cohort: DataFrame) -> Iterator[np.ndarray]:
    block: list = []
    for row in cohort.select("embedding").toLocalIterator():
        block.append(row[0])
        if len(block) == COHORT:
            yield np.array(block, float)
            block = []
    if block:
        yield np.array(block, float)


def _best_scores(vectors: pd.Series, best: pd.Series, block: np.ndarray, k: int) -> pd.Series:
    """The k best of each row's best scores so far and those against a block."""
    out: list[np.ndarray] = []
    for i in range(0, len(vectors), AT_ONCE):
        x = np.array([np.asarray(v, float) for v in vectors[i : i + AT_ONCE]])
        for b, d in zip(best[i : i + AT_ONCE], metrics.near_distances(x, block, k)):
            out.append(np.sort(np.concatenate((np.asarray(b, float), -d)))[::-1][:k].copy())  # a view would hold all scores
    return pd.Series(out, dtype=object)


def _cohort_stats(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    """(vec_id, m, s): mean and sample deviation of each vector's k best scores against the cohort, which is every fifth
    label's vectors. A row keeps the k best scores of the blocks so far, which are written between blocks, so that a task
    holds one block and the scores of AT_ONCE rows against it only."""
    e = table(spark, sf_dir, "embeddings")
    out = e.select("vec_id", "embedding", F.array().cast("array<double>").alias("best"))

    def merge(held: Broadcast) -> Callable[[pd.Series, pd.Series], pd.Series]:
        return lambda vectors, best: _best_scores(vectors, best, held.value, k)

    folder = f"{shared_dir(spark)}/cohort-{uuid.uuid4().hex}"
    held = None
    for i, block in enumerate(_cohort_blocks(e.filter("label % 5 = 0"))):
        if held is not None:
            out.write.parquet(f"{folder}/{i}")
            out = spark.read.schema(out.schema).parquet(f"{folder}/{i}")
            held.unpersist()
        held = spark.sparkContext.broadcast(block)
        out = out.withColumn("best", F.pandas_udf(merge(held), "array<double>")("embedding", "best"))

    def stats(best: pd.Series) -> pd.DataFrame:
        x = [np.asarray(b, float) for b in best]
        return pd.DataFrame({"m": [b.mean() for b in x], "s": [b.std(ddof=1) for b in x]})

    return out.filter(F.size("best") > 0).select("vec_id", F.pandas_udf(stats, "m double, s double")("best").alias("x")).select("vec_id", "x.m", "x.s")


@query("J9_top_cohort", f"{_COHORT_SQL} SELECT vec_id, round_even(avg(s) * 1e6, 0)::BIGINT AS mean_ppm, round_even(stddev_samp(s) * 1e6, 0)::BIGINT AS std_ppm FROM t WHERE r <= 20 GROUP BY vec_id")
def top_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ppm = lambda c: F.rint(F.col(c) * 1e6).cast("bigint")
    return _cohort_stats(spark, sf_dir).select("vec_id", ppm("m").alias("mean_ppm"), ppm("s").alias("std_ppm"))


@query("M8_score_norm", f"{_COHORT_SQL}, n AS (SELECT vec_id, avg(s) AS m, stddev_samp(s) AS sd FROM t WHERE r <= 20 GROUP BY vec_id) SELECT vec_id, round_even((-1.0 - m) / sd * 1000, 0)::BIGINT AS z FROM n")
def score_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A score less its cohort's mean, over its deviation."""
    return _cohort_stats(spark, sf_dir).select("vec_id", F.rint((F.lit(-1.0) - F.col("m")) / F.col("s") * 1000).cast("bigint").alias("z"))


# --- times


@query("D1_time_difference", "SELECT event_id, epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM events")
def time_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-01")))).alias("us"))


@query("D2_durations", "SELECT doc_id, (n_chars + 1.5)::DOUBLE * 0.01::DOUBLE AS dur FROM documents")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", ((F.col("n_chars") + F.lit(1.5).cast("double")) * 0.01).alias("dur"))


# --- recipes


@query("R9_majority", """
WITH v AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), r AS (SELECT *, rank() OVER (PARTITION BY source ORDER BY n DESC) AS k FROM v WHERE n >= 1)
SELECT source, CASE WHEN count(*) = 1 THEN min(lang) ELSE '-1' END AS vote FROM r WHERE k = 1 GROUP BY source""")
def majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.count("*").alias("n"))
    top = v.withColumn("k", F.rank().over(Window.partitionBy("source").orderBy(F.desc("n")))).filter("k = 1")
    return top.groupBy("source").agg(F.when(F.count("*") == 1, F.min("lang")).otherwise("-1").alias("vote"))


@query("R10_group_majority", "SELECT source, CASE WHEN sum(quality) * 2 >= count(*) THEN 1 ELSE 0 END AS vote FROM documents JOIN labels USING (doc_id) GROUP BY source")
def group_majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return j.groupBy("source").agg((F.sum("quality") * 2 >= F.count("*")).cast("int").alias("vote"))


_UTTERANCES = "SELECT doc_id, lang, lower(u) AS r, regexp_replace(lower(u), '[aeiou]', '', 'g') AS h FROM (SELECT doc_id, lang, unnest(regexp_extract_all(replace(text, chr(10), ' '), '.{1,120}')) AS u FROM documents)"


@query("R14_macro_by_group", f"""
WITH u AS (SELECT lang, avg(levenshtein(r, h) / length(r)::DOUBLE) AS m FROM ({_UTTERANCES}) WHERE r <> '' GROUP BY lang)
SELECT avg(m) AS macro, stddev_samp(m) AS std, (SELECT sum(m) FROM (SELECT m FROM u ORDER BY m DESC LIMIT 15)) / 15 AS worst FROM u""")
def macro_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Character error rate: mean over a language's utterances (stretches of 120 characters), then over languages, their
    deviation, and the worst 15 over 15, however many there are. Empty references do not count."""
    u = table(spark, sf_dir, "documents").select("lang", F.explode(F.regexp_extract_all(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit(".{1,120}"), F.lit(0))).alias("u"))
    u = u.select("lang", F.lower("u").alias("r")).filter("r <> ''").withColumn("h", F.regexp_replace("r", "[aeiou]", ""))
    return metrics.macro_error_rate(u.select("lang", T.letter_errors(F.col("r"), F.col("h")).alias("errors"), F.length("r").alias("n")), "lang", "errors", "n")


@query("R15_macro_f1", f"WITH c AS ({LABELS_SQL}), k AS (SELECT t AS k FROM c UNION SELECT p FROM c), f AS (SELECT k, 2.0 * count(*) FILTER (WHERE t = k AND p = k) / (count(*) FILTER (WHERE t = k) + count(*) FILTER (WHERE p = k)) AS f1 FROM c CROSS JOIN k GROUP BY k) SELECT avg(f1) AS macro_f1 FROM f")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.macro_f1(label_pairs(spark, sf_dir), "t", "p")


@query("R16_entities", """
WITH e AS (SELECT conv_id, role, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i, turn FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, w ORDER BY turn, i) AS k FROM e), c AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS a, count(*) FILTER (WHERE role = 'assistant') AS b FROM n GROUP BY conv_id),
s AS (SELECT conv_id, count(*) AS shared FROM (SELECT conv_id, w, k FROM n WHERE role = 'user' INTERSECT SELECT conv_id, w, k FROM n WHERE role = 'assistant') GROUP BY conv_id)
SELECT conv_id, coalesce(shared, 0)::BIGINT AS shared, a::BIGINT AS wanted, b::BIGINT AS found, CASE WHEN a + b > 0 THEN 2.0::DOUBLE * coalesce(shared, 0) / (a + b) END AS f1 FROM c LEFT JOIN s USING (conv_id)""")
def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities of two sides that match with their occurrence numbers, of each dialogue."""
    e = table(spark, sf_dir, "conversations").select("conv_id", "role", "turn", F.posexplode(F.split("text", " ")).alias("i", "w"))
    n = e.withColumn("k", F.row_number().over(Window.partitionBy("conv_id", "role", "w").orderBy("turn", "i")))
    sides = n.groupBy("conv_id", "w", "k").agg(F.count_if(F.col("role") == "user").alias("a"), F.count_if(F.col("role") == "assistant").alias("b"))
    c = sides.groupBy("conv_id").agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("wanted"), F.sum("b").alias("found"))
    both = F.col("wanted") + F.col("found")
    return c.withColumn("f1", F.when(both > 0, F.lit(2.0) * F.col("shared") / both))


@query("R18_labelled_pairs", "SELECT count(*)::BIGINT AS pairs, count(*) FILTER (WHERE a.label = b.label)::BIGINT AS same FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id")
def labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many unordered pairs there are and how many share a label: from counts, without a pair."""
    n = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    pairs = lambda c: F.floor(c * (c - 1) / 2)
    return n.agg(pairs(F.sum("n")).alias("pairs"), F.sum(pairs(F.col("n"))).alias("same"))


_TRIALS = """
WITH e AS (SELECT vec_id, label, label * 2 + CASE WHEN vec_id % 3 = 0 THEN 0 ELSE 1 END AS side, row_number() OVER (PARTITION BY label ORDER BY md5('5:' || vec_id), vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS size, row_number() OVER (ORDER BY label, md5('5:' || vec_id), vec_id) - 1 AS place, count(*) OVER () AS n FROM embeddings),
p AS (SELECT vec_id, label, r, size, place, n, j FROM e, (SELECT unnest([1, 2, 3]) AS j) WHERE vec_id % 3 = 0),
t AS (SELECT p.vec_id AS enroll, o.vec_id AS test FROM p JOIN e o ON o.label = p.label AND o.r = (p.r + p.j) % p.size WHERE p.j < p.size),
x AS (SELECT vec_id, place - r AS first, size, (('0x' || substr(md5('5:' || vec_id || '!'), 1, 8))::BIGINT % greatest(n - size, 1) + (j - 1) * greatest((n - size) // 3, 1)) % greatest(n - size, 1) AS i, n - size AS others, j FROM p),
f AS (SELECT x.vec_id AS enroll, o.vec_id AS test FROM x JOIN e o ON o.place = CASE WHEN x.i < x.first THEN x.i ELSE x.i + x.size END WHERE x.j <= x.others),
u AS (SELECT enroll, test FROM t UNION ALL SELECT enroll, test FROM f), left_out AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e WHERE vec_id NOT IN (SELECT enroll FROM u UNION SELECT test FROM u)),
en AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k, count(*) OVER () AS n FROM e WHERE vec_id % 3 = 0), every AS (SELECT enroll, test FROM u UNION ALL SELECT en.vec_id, l.vec_id FROM left_out l JOIN en ON en.k = l.k % en.n)
SELECT enroll, test, (a.label = b.label)::INT AS target FROM every JOIN embeddings a ON a.vec_id = enroll JOIN embeddings b ON b.vec_id = test"""


@query("R19_trial_cover", _TRIALS)
def trial_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials of every third vector as enrolment: three against its own speaker, three against others, and one for each
    vector that has none yet."""
    return keyed.trials(table(spark, sf_dir, "embeddings").select("vec_id", "label"), "vec_id", "label", F.col("vec_id") % 3 == 0, 3, 3, seed=5)


@query("R20_every_kth", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r FROM embeddings WHERE label <> 0) WHERE r % 3 = 0")
def every_kth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").filter("label <> 0").select("vec_id", "label")
    return e.withColumn("r", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).filter("r % 3 = 0").drop("r")


@query("R21_categories", "SELECT doc_id, CASE WHEN n_chars < 500 THEN 'short' WHEN n_chars < 3000 THEN 'middle' ELSE 'long' END AS category FROM documents")
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("n_chars") < 500, "short").when(F.col("n_chars") < 3000, "middle").otherwise("long").alias("category"))


@query("R22_scenarios", "SELECT event_id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 0 END AS label FROM events WHERE event_type IN ('click', 'error')")
def scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "error", 0)
    return table(spark, sf_dir, "events").select("event_id", label.alias("label")).filter("label IS NOT NULL")


@query("R24_replaced_rows", "SELECT coalesce(a.id, d.doc_id::VARCHAR) AS id, d.source FROM documents d LEFT JOIN (SELECT doc_id, doc_id || '-' || k AS id FROM documents, LATERAL (SELECT unnest(range(0, 2)) AS k) WHERE doc_id % 10 = 0) a USING (doc_id)")
def replaced_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows are replaced by several, the others stay."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    parts = d.filter("doc_id % 10 = 0").select("doc_id", F.array(F.concat("doc_id", F.lit("-0")), F.concat("doc_id", F.lit("-1"))).alias("ids"))
    return d.join(parts, "doc_id", "left").select(F.explode(F.coalesce("ids", F.array(F.col("doc_id").cast("string")))).alias("id"), "source")


@query("Z1_zipped_channels", "SELECT vec_id, 'sox -M a' || vec_id || '.wav b' || label || '.wav -c 2 -t wav - |' AS command FROM embeddings")
def zipped_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of single channels, key by key, as commands that make two channels of them."""
    e = table(spark, sf_dir, "embeddings")
    a, b = e.select("vec_id", F.concat(F.lit("a"), "vec_id", F.lit(".wav")).alias("a")), e.select("vec_id", F.concat(F.lit("b"), "label", F.lit(".wav")).alias("b"))
    return keyed.lockstep(a, b, "vec_id").select("vec_id", F.concat(F.lit("sox -M "), "a", F.lit(" "), "b", F.lit(" -c 2 -t wav - |")).alias("command"))


@query("Z4_speed_perturbation", "SELECT 'sp0.9-' || doc_id AS utt, printf('%.2f', (doc_id % 50) / 0.9) AS st, printf('%.2f', (doc_id % 50 + doc_id % 7) / 0.9) AS en FROM documents WHERE (doc_id % 50 + doc_id % 7) / 0.9 > (doc_id % 50) / 0.9 + 0.01")
def speed_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % 50 / 0.9).alias("s"), ((F.col("doc_id") % 50 + F.col("doc_id") % 7) / 0.9).alias("e"))
    return d.filter("e > s + 0.01D").select(F.concat(F.lit("sp0.9-"), "doc_id").alias("utt"), F.format_string("%.2f", "s").alias("st"), F.format_string("%.2f", "e").alias("en"))


@query("Z5_split_by_group", "SELECT d.doc_id, s.split FROM documents d JOIN (SELECT source, ntile(4) OVER (ORDER BY source)::INTEGER AS split FROM (SELECT DISTINCT source FROM documents)) s USING (source)")
def split_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(keyed.even_chunks(d.select("source").distinct(), "source", 4), "source").select("doc_id", "split")


@query("Z6_validation", "SELECT count(*) - count(DISTINCT doc_id) AS duplicated, (SELECT count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents))::BIGINT AS orphans, count(*) FILTER (WHERE text IS NULL OR text = '')::BIGINT AS blank FROM documents")
def validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    a = d.agg((F.count("*") - F.countDistinct("doc_id")).alias("duplicated"), F.count_if(F.col("text").isNull() | (F.col("text") == "")).alias("blank"))
    return a.crossJoin(table(spark, sf_dir, "labels").join(d.select("doc_id"), "doc_id", "left_anti").agg(F.count("*").alias("orphans")))


@query("Z8_whole_segments", "SELECT doc_id AS utt, doc_id AS reco, 0.0::DOUBLE AS st, n_chars * 0.01::DOUBLE AS en FROM documents")
def whole_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("utt"), F.col("doc_id").alias("reco"), F.lit(0.0).alias("st"), (F.col("n_chars") * 0.01).alias("en"))


_GRAMS = "WITH w AS (SELECT item_id, string_split_regex(text, '[ \\n]+') AS ws FROM benchmark), g AS (SELECT item_id, k, i AS pos, array_to_string(ws[i : i + k - 1], ' ') AS gram FROM w, (SELECT unnest([1, 2]) AS k), LATERAL (SELECT unnest(range(1, len(ws) - k + 2)) AS i))"


@query("Z9_self_bleu", f"""{_GRAMS}, c AS (SELECT item_id, k, gram, count(*) AS n FROM g GROUP BY 1, 2, 3), o AS (SELECT a.item_id, a.k, a.gram, a.n, coalesce(max(b.n), 0) AS most FROM c a LEFT JOIN c b ON a.gram = b.gram AND a.k = b.k AND a.item_id <> b.item_id GROUP BY 1, 2, 3, 4),
p AS (SELECT item_id, k, sum(least(n, most)) / sum(n)::DOUBLE AS p FROM o GROUP BY 1, 2)
SELECT item_id, sum(p) / 2 AS arithmetic, sqrt(CASE WHEN count(*) < 2 THEN 0 ELSE product(p) END) AS geometric FROM p GROUP BY item_id""")
def self_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text against all others: how many of its words and pairs another text has, by either mean."""
    return metrics.self_bleu(table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "[ \n]+").alias("ws")), "item_id", "ws", 2)


@query("Z9_auto_bleu", f"""{_GRAMS}, m AS (SELECT *, min(pos) OVER w AS a, max(pos) OVER w AS b FROM g WINDOW w AS (PARTITION BY item_id, k, gram)),
p AS (SELECT item_id, k, avg((pos - a >= k OR b - pos >= k)::INT) AS p FROM m GROUP BY 1, 2)
SELECT item_id, sum(p) / 2 AS arithmetic, sqrt(CASE WHEN count(*) < 2 THEN 0 ELSE product(p) END) AS geometric FROM p GROUP BY item_id""")
def auto_bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words and pairs of each text come again in it, apart from themselves."""
    return metrics.auto_bleu(table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "[ \n]+").alias("ws")), "item_id", "ws", 2)


@query("Z12_by_language", "SELECT lang, count(*)::BIGINT AS n, min(doc_id) AS first FROM documents GROUP BY lang")
def by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


@query("T5_bounded_history", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 4")
def bounded_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two pairs of turns of each dialogue."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return c.withColumn("r", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))).filter("r <= 4").drop("r")


@query("M4_aligned_inputs", "SELECT r.doc_id, r.lang AS ref, h.source AS hyp FROM documents r JOIN documents h USING (doc_id)")
def aligned_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References and hypotheses joined by id; an id on one side only fails the query."""
    d = table(spark, sf_dir, "documents")
    return keyed.lockstep(d.select("doc_id", F.col("lang").alias("ref")), d.select("doc_id", F.col("source").alias("hyp")), "doc_id")


@query("O18_category_weights", "SELECT doc_id, 1.0::DOUBLE / count(*) OVER (PARTITION BY source) AS weight FROM documents")
def category_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each row weighs one over its category's size; sizes are joined, so a large category is not gathered."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return d.join(d.groupBy("source").agg(F.count("*").alias("n")), "source").select("doc_id", (F.lit(1.0) / F.col("n")).alias("weight"))
