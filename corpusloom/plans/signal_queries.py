"""Queries on signals, models and whole-corpus scores. Vectors stand for short signals."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import cleaners
from corpusloom.operators import metrics, scans, sequential, signals
from corpusloom.plans.aggregate_queries import SCORES_SQL, scores
from corpusloom.plans.registry import query
from corpusloom.session import table

# A signal is an embedding; its estimate is the signal plus a tenth of the next component.
_SIGNALS_SQL = "SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS s, list_transform(embedding, lambda x, i: x::DOUBLE + 0.1 * coalesce(embedding[i + 1], 0)::DOUBLE) AS e FROM embeddings"


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("s"))
    return x.withColumn("e", F.transform("s", lambda v, i: v + 0.1 * F.coalesce(F.get("s", i + 1), F.lit(0.0))))


@query("M13_scale_invariant_ratio", f"""
WITH x AS ({_SIGNALS_SQL}), d AS (SELECT vec_id, s, e, list_sum(list_transform(list_zip(s, e), lambda p: p[1] * p[2])) / list_sum(list_transform(s, lambda v: v * v)) AS a FROM x)
SELECT vec_id, round_even(10 * log10(a * a * list_sum(list_transform(s, lambda v: v * v)) / list_sum(list_transform(list_zip(s, e), lambda p: (p[2] - a * p[1]) * (p[2] - a * p[1])))) * 1e6, 0)::BIGINT AS ratio_udb FROM d""")
def scale_invariant_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal to noise in decibels after the best scaling of the reference."""
    return _signals(spark, sf_dir).select("vec_id", F.rint(metrics.signal_ratio(F.col("s"), F.col("e")) * 1e6).cast("bigint").alias("ratio_udb"))


# Ratio of an estimate to a source: that of M13, of any two signals.
_RATIO = "(list_sum(list_transform(list_zip({s}, {e}), lambda p: p[1] * p[2])) / list_sum(list_transform({s}, lambda v: v * v)))"
_RATIO = "10 * log10(pow(" + _RATIO + ", 2) * list_sum(list_transform({s}, lambda v: v * v)) / list_sum(list_transform(list_zip({s}, {e}), lambda p: pow(p[2] - " + _RATIO + " * p[1], 2))))"


@query("Z10_permutation_scores", f"""
WITH x AS ({_SIGNALS_SQL}), p AS (SELECT a.vec_id, a.s AS s1, b.s AS s2, CASE WHEN a.vec_id % 4 = 0 THEN a.e ELSE b.e END AS e1, CASE WHEN a.vec_id % 4 = 0 THEN b.e ELSE a.e END AS e2 FROM x a JOIN x b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0),
r AS (SELECT vec_id, {_RATIO.format(s="s1", e="e1")} AS r11, {_RATIO.format(s="s2", e="e2")} AS r22, {_RATIO.format(s="s1", e="e2")} AS r12, {_RATIO.format(s="s2", e="e1")} AS r21 FROM p)
SELECT vec_id, r12 + r21 > r11 + r22 AS crossed, round_even(greatest(r12 + r21, r11 + r22) / 2 * 1e6, 0)::BIGINT AS mean_udb FROM r""")
def permutation_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources and two estimates in an order that is not known: the order of the larger mean ratio, and that."""
    x = _signals(spark, sf_dir)
    a, b = x.select("vec_id", F.col("s").alias("s1"), F.col("e").alias("a")).filter("vec_id % 2 = 0"), x.select((F.col("vec_id") - 1).alias("vec_id"), F.col("s").alias("s2"), F.col("e").alias("b"))
    even = F.col("vec_id") % 4 == 0
    p = a.join(b, "vec_id").withColumns({"e1": F.when(even, F.col("a")).otherwise(F.col("b")), "e2": F.when(even, F.col("b")).otherwise(F.col("a"))})
    same, crossed = (metrics.signal_ratio(F.col("s1"), F.col(p1)) + metrics.signal_ratio(F.col("s2"), F.col(p2)) for p1, p2 in (("e1", "e2"), ("e2", "e1")))
    return p.select("vec_id", (crossed > same).alias("crossed"), F.rint(F.greatest(same, crossed) / 2 * 1e6).cast("bigint").alias("mean_udb"))


@query("N7_volume_and_speed", "SELECT vec_id, array_to_string(list_transform(range(0, 32), lambda i: round_even(embedding[i * 2 + 1]::DOUBLE * 0.5 * 1e6, 0)::BIGINT), ',') AS ppm FROM embeddings")
def volume_and_speed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half as loud, and twice as fast."""
    y = signals.chained(F.col("s"), [lambda c: signals.volume(c, 0.5), lambda c: signals.speed(c, 2.0)])
    return _signals(spark, sf_dir).select("vec_id", F.array_join(F.transform(y, lambda v: F.rint(v * 1e6).cast("bigint").cast("string")), ",").alias("ppm"))


@query("N7_noise_and_rooms")
def noise_and_rooms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band of frequencies, the signal with another's as noise at ten decibels, and in a room; tests hold them
    against plain sums."""
    x = _signals(spark, sf_dir)
    room = F.array(*[F.lit(v) for v in (1.0, 0.0, 0.5, 0.25)])
    return x.select("vec_id", signals.band_pass(F.col("s"), 0.1, 0.3).alias("band"), signals.noisy(F.col("s"), F.reverse("s"), 10.0).alias("noisy"), signals.reverberated(F.col("s"), room).alias("room"))


@query("N8_masked_spans", "SELECT vec_id, array_to_string(list_transform(embedding, lambda x, i: CASE WHEN i > vec_id % 40 AND i <= vec_id % 40 + 16 THEN 0 ELSE round_even(x::DOUBLE * 1e6, 0)::BIGINT END), ',') AS ppm FROM embeddings")
def masked_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen samples from a place on are set to nothing."""
    at = F.col("vec_id") % 40
    y = F.transform("embedding", lambda x, i: F.when((i >= at) & (i < at + 16), F.lit(0.0)).otherwise(x.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(F.transform(y, lambda v: F.rint(v * 1e6).cast("bigint").cast("string")), ",").alias("ppm"))


@query("N8_channel", "SELECT vec_id, array_to_string(list_transform(range(0, 16), lambda i: round_even(embedding[i * 4 + 3]::DOUBLE * 1e6, 0)::BIGINT), ',') AS ppm FROM embeddings")
def one_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third of four channels of samples in turn."""
    y = signals.channel(F.col("s"), 2, 4)
    return _signals(spark, sf_dir).select("vec_id", F.array_join(F.transform(y, lambda v: F.rint(v * 1e6).cast("bigint").cast("string")), ",").alias("ppm"))


@query("N10_trained_clusters")
def trained_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means as the engine's library trains it: each row's cluster and its centre; tests hold it against the nearest
    of the centres, which are their clusters' means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    x = table(spark, sf_dir, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    model = KMeans(k=5, seed=1, maxIter=100, tol=1e-9).fit(x)
    centres = spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(model.clusterCenters())], "cluster int, centre array<double>")
    return model.transform(x).select("vec_id", F.col("prediction").alias("cluster")).join(F.broadcast(centres), "cluster")


@query("N10_principal_axes")
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors along their three axes of most variance; tests hold them against numpy."""
    e = table(spark, sf_dir, "embeddings")
    mean, axes = sequential.principal_axes(e, "embedding", 3)
    return e.select("vec_id", sequential.projected(F.col("embedding"), mean, axes).alias("axes"))


@query("M17_score_calibration")
def score_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities from scores and a further feature of each row by logistic regression; tests hold them against
    Newton's method."""
    x = scores(spark, sf_dir).select("event_id", "label", (F.col("score") / 10000.0).alias("score"), (F.col("event_id") % 40 / 40.0).alias("quality"))
    return metrics.logistic_scores(x, "label", ["score", "quality"]).select("event_id", "label", "calibrated")


@query("M18_bleu", """
WITH r AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda w: w <> '') AS r FROM benchmark), w AS (SELECT item_id, r, list_filter(r, lambda w, i: i % 7 <> 0) AS h FROM r), s AS (SELECT unnest([1, 2, 3, 4]) AS k),
a AS (SELECT item_id, k, array_to_string(r[i : i + k - 1], ' ') AS g, count(*) AS n FROM w, s, LATERAL (SELECT unnest(range(1, len(r) - k + 2)) AS i) GROUP BY 1, 2, 3), b AS (SELECT item_id, k, array_to_string(h[i : i + k - 1], ' ') AS g, count(*) AS n FROM w, s, LATERAL (SELECT unnest(range(1, len(h) - k + 2)) AS i) GROUP BY 1, 2, 3),
p AS (SELECT k, sum(least(b.n, coalesce(a.n, 0))) / sum(b.n)::DOUBLE AS p FROM b LEFT JOIN a USING (item_id, k, g) GROUP BY k), l AS (SELECT least(1, exp(1 - sum(len(r)) / sum(len(h))::DOUBLE)) AS brevity FROM w)
SELECT any_value(brevity) * exp(avg(ln(p))) AS bleu, max(p) FILTER (WHERE k = 1) AS p1, max(p) FILTER (WHERE k = 2) AS p2, max(p) FILTER (WHERE k = 3) AS p3, max(p) FILTER (WHERE k = 4) AS p4, any_value(brevity) AS brevity FROM p, l""")
def bleu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BLEU of hypotheses that lack every seventh word."""
    w = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda x: x != "")
    d = table(spark, sf_dir, "benchmark").select("item_id", w.alias("r"), F.filter(w, lambda x, i: (i + 1) % 7 != 0).alias("h"))
    return metrics.bleu(d, "r", "h", "item_id")


@query("M19_alignment_check", """
WITH w AS (SELECT item_id, unnest(string_split_regex(lower(text), '[ \\n]+')) AS word, generate_subscripts(string_split_regex(lower(text), '[ \\n]+'), 1) - 1 AS i FROM benchmark),
n AS (SELECT item_id, i, CASE WHEN i % 5 = 4 THEN '—' ELSE word END AS syllable, CASE WHEN (item_id + i) % 23 = 22 THEN 'x' WHEN i % 5 = 4 THEN lag(substr(word, length(word), 1)) OVER (PARTITION BY item_id ORDER BY i) ELSE substr(word, length(word), 1) END AS phone, lag(substr(word, length(word), 1)) OVER (PARTITION BY item_id ORDER BY i) AS before, substr(word, length(word), 1) AS own FROM w)
SELECT item_id, count(*)::BIGINT AS notes, min(i) FILTER (WHERE phone <> CASE WHEN syllable = '—' THEN before ELSE own END)::BIGINT AS mismatch FROM n GROUP BY item_id""")
def alignment_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes and phones side by side in order; a slur takes the phone before. The first place where they differ. A
    syllable's phone is its last letter here; every fifth note is a slur, and some phones are wrong."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(F.split(F.lower("text"), "[ \n]+")).alias("i", "word"))
    last = F.expr("substring(word, length(word), 1)")
    before = F.lag(last).over(Window.partitionBy("item_id").orderBy("i"))
    slur = F.col("i") % 5 == 4
    notes = b.select("item_id", "i", F.when(slur, "—").otherwise(F.col("word")).alias("syllable"), F.when((F.col("item_id") + F.col("i")) % 23 == 22, "x").when(slur, before).otherwise(last).alias("phone"))
    return scans.first_mismatch(notes, "item_id", "i", "syllable", "phone", lambda s: F.substring(s, -1, 1))


@query("R17_word_error_counts")
def word_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word errors of the whole corpus: hypotheses lack every seventh word, and every fifth of the rest is another;
    tests hold them against plain alignments."""
    w = F.filter(F.split("text", "[ \n]+"), lambda x: x != "")
    h = F.transform(F.filter(w, lambda x, i: (i + 1) % 7 != 0), lambda x, i: F.when(i % 5 == 4, F.lit("other")).otherwise(x))
    e = metrics.word_error_counts(table(spark, sf_dir, "benchmark").select(F.array_join(w, " ").alias("ref"), F.array_join(h, " ").alias("hyp")), "ref", "hyp")
    return e.agg(F.sum("errors").alias("errors"), F.sum("ref_words").alias("words"), F.round(F.sum("errors") / F.sum("ref_words") * 100, 2).alias("wer"))


@query("R27_score_report", f"SELECT label, count(*)::BIGINT AS n, avg(score) AS mean, stddev_pop(score) AS std FROM ({SCORES_SQL}) GROUP BY label")
def score_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of either label's scores."""
    return scores(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"))


@query("B14_padded_batch_list", "SELECT b::BIGINT AS slot, (CASE WHEN b < n THEN b ELSE n - 1 END)::BIGINT AS batch_id FROM (SELECT count(*) // 16 AS n FROM documents), LATERAL (SELECT unnest(range(0, ((n + 3) // 4) * 4)) AS b)")
def padded_batch_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of batches filled up to a multiple of four ranks with its last one."""
    n = table(spark, sf_dir, "documents").agg(F.floor(F.count("*") / 16).alias("n"))
    slots = n.select("n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") + 3) / 4) * 4 - 1)).alias("slot"))
    return slots.select("slot", F.least("slot", F.col("n") - 1).alias("batch_id"))


@query("F8_decomposed_letters", "SELECT doc_id, length(nfc_normalize(text))::BIGINT AS composed FROM documents")
def decomposed_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Letters taken apart and put together again."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: len(unicodedata.normalize("NFC", unicodedata.normalize("NFD", t))))

    return table(spark, sf_dir, "documents").select("doc_id", F.pandas_udf(run, "bigint")("text").alias("composed"))


@query("F9_word_pieces")
def word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a tokenizer file; tests hold them against the library."""
    import public_tokenizers

    return table(spark, sf_dir, "benchmark").select("item_id", "text", cleaners.tokens(F.col("text"), "whisper", public_tokenizers.path("byte_bpe_50k.json")).alias("tokens"))


