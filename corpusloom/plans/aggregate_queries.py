"""Queries of aggregates, windows and ordered scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import keyed, metrics, scans, sequential
from corpusloom.plans.registry import query
from corpusloom.session import table

# Words of a text, for both engines.
WORDS_SQL = r"SELECT doc_id, unnest(string_split_regex(text, '[ \n]+')) AS word, generate_subscripts(string_split_regex(text, '[ \n]+'), 1) AS pos FROM documents"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "[ \n]+")).alias("pos", "word"))
    return d.withColumn("pos", (F.col("pos") + 1).cast("bigint"))


@query("A1_collect_stats", "SELECT dim, count(*)::BIGINT AS n, sum(x) AS s, sum(x * x) AS ss FROM (SELECT unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim FROM embeddings) GROUP BY dim")
def collect_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count, sum and sum of squares for each dimension: mergeable by sums."""
    x = table(spark, sf_dir, "embeddings").select(F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return x.groupBy("dim").agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))


@query("A2_merged_stats", "SELECT label, count(*)::BIGINT AS n, sum(x)::BIGINT AS s, sum(x * x)::BIGINT AS ss FROM (SELECT label, round_even(unnest(embedding)::DOUBLE * 1000, 0)::BIGINT AS x FROM embeddings) GROUP BY label")
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stats of shards, then their sums."""
    x = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.explode("embedding").alias("x")).withColumn("x", F.rint(F.col("x").cast("double") * 1000).cast("bigint"))
    parts = x.groupBy("label", (F.col("vec_id") % 4).alias("shard")).agg(F.count("*").alias("n"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    return parts.groupBy("label").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))


@query("A3_sharded_lengths", "SELECT source, sum(n_chars)::BIGINT AS total, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def sharded_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").groupBy("source", (F.col("doc_id") % 8).alias("shard")).agg(F.sum("n_chars").alias("t"), F.min("n_chars").alias("a"), F.max("n_chars").alias("b"))
    return parts.groupBy("source").agg(F.sum("t").alias("total"), F.min("a").alias("least"), F.max("b").alias("most"))


@query("A5_combined_vocabulary", f"""
WITH w AS (SELECT word, doc_id % 2 AS split, count(*) AS n FROM ({WORDS_SQL}) WHERE word <> '' GROUP BY 1, 2)
SELECT '<blank>' AS token, NULL::BIGINT AS n, 0::BIGINT AS place UNION ALL SELECT '<unk>', NULL, 1
UNION ALL SELECT word, n, 1 + row_number() OVER (ORDER BY n DESC, word) FROM (SELECT word, sum(n)::BIGINT AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 500)""")
def combined_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 500 most frequent words of two splits together, after the extra symbols."""
    w = words(spark, sf_dir).filter("word <> ''")
    both = w.groupBy("word", (F.col("doc_id") % 2).alias("split")).agg(F.count("*").alias("n")).groupBy("word").agg(F.sum("n").alias("n"))
    top = both.orderBy(F.desc("n"), "word").limit(500).withColumn("place", (F.row_number().over(Window.orderBy(F.desc("n"), "word")) + 1).cast("bigint"))
    extra = spark.createDataFrame([("<blank>", None, 0), ("<unk>", None, 1)], "token string, n bigint, place bigint")
    return extra.unionByName(top.withColumnRenamed("word", "token"))


@query("A6_group_members", "SELECT source AS spk, string_agg(doc_id::VARCHAR, ' ' ORDER BY doc_id) AS utts FROM documents GROUP BY source")
def group_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "documents").groupBy("source").agg(F.array_sort(F.collect_list("doc_id")).alias("u"))
    return g.select(F.col("source").alias("spk"), F.array_join(F.col("u").cast("array<string>"), " ").alias("utts"))


@query("A7_members_to_rows", "SELECT doc_id::VARCHAR AS utt, source AS spk FROM documents")
def members_to_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_members(spark, sf_dir).select(F.explode(F.split("utts", " ")).alias("utt"), "spk")


@query("A8_means", """
WITH v AS (SELECT event_type, CASE WHEN event_id % 9 = 0 THEN 'NaN'::DOUBLE ELSE round_even(value, 0) END AS v, (event_id % 5)::DOUBLE AS w FROM events)
SELECT event_type, avg(v) FILTER (WHERE NOT isnan(v)) AS plain, sum(v * w) FILTER (WHERE isfinite(v)) / sum(w) FILTER (WHERE isfinite(v)) AS weighted FROM v GROUP BY event_type""")
def means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and weighted mean that skip what is not a number."""
    v = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_id") % 9 == 0, float("nan")).otherwise(F.rint("value")).alias("v"), (F.col("event_id") % 5).cast("double").alias("w"))
    ok = ~F.isnan("v") & (F.abs("v") != float("inf"))
    return v.groupBy("event_type").agg(F.avg(F.when(~F.isnan("v"), F.col("v"))).alias("plain"), (F.sum(F.when(ok, F.col("v") * F.col("w"))) / F.sum(F.when(ok, F.col("w")))).alias("weighted"))


@query("A9_error_rate", """
WITH p AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda w: w <> '') AS r FROM benchmark)
SELECT item_id % 5 AS test_set, sum(len(r) // 7) / sum(len(r))::DOUBLE AS rate, avg(len(r)) AS mean_words FROM p GROUP BY 1""")
def error_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of alignments over the words of their references, by test set; here every seventh word is deleted."""
    w = F.filter(F.split(F.lower("text"), "[ \n]+"), lambda x: x != "")
    b = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 5).alias("test_set"), sequential.edit_counts(w, F.filter(w, lambda x, i: (i + 1) % 7 != 0)).alias("c"), F.size(w).alias("n")).select("test_set", "n", "c.*")
    errors, words_ = F.sum(F.col("insertions") + F.col("deletions") + F.col("substitutions")), F.sum(F.col("hits") + F.col("deletions") + F.col("substitutions"))
    return b.groupBy("test_set").agg((errors / words_).alias("rate"), F.avg("n").alias("mean_words"))


@query("A10_duration_by_pair", "SELECT coalesce(l_returnflag, 'all') AS src, coalesce(l_linestatus, 'all') AS tgt, sum(l_quantity)::BIGINT AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def duration_by_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("bigint").alias("total"))
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("src"), F.coalesce("l_linestatus", F.lit("all")).alias("tgt"), "total")


LABELS_SQL = "SELECT doc_id, quality AS t, CASE WHEN doc_id % 4 = 0 THEN 1 - quality ELSE quality END AS p FROM labels"


def label_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").selectExpr("doc_id", "quality AS t", "if(doc_id % 4 = 0, 1 - quality, quality) AS p")


@query("A11_class_counts", f"""
WITH c AS ({LABELS_SQL}), k AS (SELECT DISTINCT t AS k FROM c)
SELECT k, count(*) FILTER (WHERE t = k AND p = k)::BIGINT AS tp, count(*) FILTER (WHERE t <> k AND p = k)::BIGINT AS fp, count(*) FILTER (WHERE t = k AND p <> k)::BIGINT AS fn FROM c CROSS JOIN k GROUP BY k""")
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each class: hits, false alarms and misses, from one table of counts."""
    n = label_pairs(spark, sf_dir).groupBy("t", "p").agg(F.count("*").alias("n"))
    both = F.explode(F.array(F.struct(F.col("t").alias("k"), F.lit(True).alias("of_t")), F.struct(F.col("p").alias("k"), F.lit(False).alias("of_t"))))
    e = n.select("n", (F.col("t") == F.col("p")).alias("hit"), both.alias("x")).select("n", "hit", "x.*")
    s = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return e.groupBy("k").agg(s(F.col("hit") & F.col("of_t")).alias("tp"), s(~F.col("hit") & ~F.col("of_t")).alias("fp"), s(~F.col("hit") & F.col("of_t")).alias("fn"))


@query("A12_mutual_information", """
WITH c AS (SELECT lang AS x, source AS y, count(*)::DOUBLE AS n FROM documents GROUP BY 1, 2), t AS (SELECT sum(n) AS n FROM c),
p AS (SELECT x, y, c.n / t.n AS pxy, sum(c.n) OVER (PARTITION BY x) / t.n AS px, sum(c.n) OVER (PARTITION BY y) / t.n AS py FROM c, t)
SELECT round_even(sum(pxy * ln(pxy / (px * py) + 1e-8)) * 1e6, 0)::BIGINT AS mi_ppm, round_even((SELECT sum(m) FROM (SELECT max(pxy) AS m FROM p GROUP BY y)) * 1e6, 0)::BIGINT AS purity_ppm FROM p""")
def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("x"), F.col("source").alias("y")).agg(F.count("*").cast("double").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    p = c.select("x", "y", (F.col("n") / total).alias("pxy"), (F.sum("n").over(Window.partitionBy("x")) / total).alias("px"), (F.sum("n").over(Window.partitionBy("y")) / total).alias("py"))
    best = p.withColumn("best", F.max("pxy").over(Window.partitionBy("y"))).withColumn("one", F.row_number().over(Window.partitionBy("y").orderBy("x")) == 1)
    ppm = lambda c: F.rint(c * 1e6).cast("bigint")
    return best.agg(ppm(F.sum(F.col("pxy") * F.log(F.col("pxy") / (F.col("px") * F.col("py")) + 1e-8))).alias("mi_ppm"), ppm(F.sum(F.when(F.col("one"), F.col("best")))).alias("purity_ppm"))


@query("A13_segment_length", "SELECT user_id, count(*)::DOUBLE / (1 + sum(CASE WHEN event_type <> prev THEN 1 ELSE 0 END)) AS mean FROM (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) GROUP BY user_id")
def segment_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("prev", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return e.groupBy("user_id").agg((F.count("*") / (F.count_if(F.col("event_type") != F.col("prev")) + 1)).alias("mean"))


@query("A14_centroids", "SELECT label, dim, avg(x) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS dim FROM embeddings) GROUP BY 1, 2")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    return x.groupBy("label", "dim").agg(F.avg("x").alias("mean"))


@query("A15_collapsed_scores", "SELECT o_custkey, avg(o_totalprice) AS score, arg_min(o_orderstatus, o_orderkey) AS label FROM orders GROUP BY o_custkey")
def collapsed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean score of a trial's parts, with the first part's label."""
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.avg("o_totalprice").alias("score"), F.min_by("o_orderstatus", "o_orderkey").alias("label"))


@query("A16_real_time_factor", "SELECT user_id, sum(epoch_us(b) - epoch_us(a))::BIGINT AS busy_us, count(*)::BIGINT AS parts, sum(epoch_us(b) - epoch_us(a)) / (sum(v) * 1e4)::DOUBLE AS rtf FROM (SELECT user_id, event_id % 1000 + 1 AS v, ts AS a, lead(ts) OVER w AS b, row_number() OVER w AS r FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE r % 2 = 1 AND b IS NOT NULL GROUP BY user_id")
def real_time_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start and end lines of decoders' logs, read by patterns, paired by order; the time between them, and over that of
    the frames (10 ms each) that the start lines name."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    place = F.row_number().over(w)
    said = F.when(place % 2 == 1, F.concat(F.lit("INFO: speech length: "), (F.col("event_id") % 1000 + 1).cast("string"))).otherwise("INFO: best hypo: x")
    lines = e.withColumn("said", said).select(F.concat(F.lit("dec."), "user_id", F.lit(".log:"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH:mm:ss,SSSSSS"), F.lit(" "), F.col("event_id").cast("string"), F.lit(" "), "said").alias("value"))
    return scans.real_time_factors(lines).select(F.col("log").cast("bigint").alias("user_id"), "busy_us", "parts", "rtf")


@query("A17_perplexity", "SELECT source, round_even(exp(sum(n_chars * 0.25) / sum(n_chars % 97 + n_chars)) * 1e6, 0)::BIGINT AS ppl_ppm FROM documents GROUP BY source")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.rint(F.exp(F.sum(F.col("n_chars") * 0.25) / F.sum(F.col("n_chars") % 97 + F.col("n_chars"))) * 1e6).cast("bigint").alias("ppl_ppm"))


@query("A18_mean_deviation", "SELECT o_orderstatus, avg(o_totalprice) AS mean, stddev_pop(o_totalprice) AS std FROM orders GROUP BY 1")
def mean_deviation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("mean"), F.stddev_pop("o_totalprice").alias("std"))


@query("A19_bitrate", "SELECT lang, avg(n_chars / (doc_id % 30 + 1)::DOUBLE * log2(1024)) AS bitrate FROM documents GROUP BY lang")
def bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.avg(F.col("n_chars") / (F.col("doc_id") % 30 + 1) * F.log2(F.lit(1024.0))).alias("bitrate"))


@query("A20_collapse_runs", "SELECT user_id, string_agg(event_type, ' ' ORDER BY ts, event_id) AS seq FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events) WHERE prev IS NULL OR prev <> event_type GROUP BY user_id")
def collapse_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "events").groupBy("user_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_id", "event_type"))), lambda x: x["event_type"]).alias("x"))
    kept = F.filter("x", lambda v, i: (i == 0) | (v != F.get(F.col("x"), i - 1)))
    return g.select("user_id", F.array_join(kept, " ").alias("seq"))


@query("A21_length_stats", "SELECT count(*)::BIGINT AS n, sum(n_chars)::BIGINT AS total, avg(n_chars) AS mean FROM documents")
def length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.avg("n_chars").alias("mean"))


@query("A22_mean_std_from_sums", "SELECT l_returnflag, s / n AS mean, sqrt(greatest(ss / n - (s / n) * (s / n), 1e-20)) AS std FROM (SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS s, sum(l_quantity * l_quantity) AS ss FROM lineitem GROUP BY 1)")
def mean_std_from_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("s"), F.sum(F.col("l_quantity") * F.col("l_quantity")).alias("ss"))
    mean = F.col("s") / F.col("n")
    return s.select("l_returnflag", mean.alias("mean"), F.sqrt(F.greatest(F.col("ss") / F.col("n") - mean * mean, F.lit(1e-20))).alias("std"))


@query("A23_token_offsets", "SELECT modality, n, coalesce(sum(n) OVER (ORDER BY modality ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS bias FROM (SELECT lang AS modality, count(DISTINCT source)::BIGINT AS n FROM documents GROUP BY lang)")
def token_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabularies of modalities one after another."""
    m = table(spark, sf_dir, "documents").groupBy(F.col("lang").alias("modality")).agg(F.countDistinct("source").alias("n"))
    return m.withColumn("bias", F.coalesce(F.sum("n").over(Window.orderBy("modality").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


# --- windows and ordered scans

SCORES_SQL = "SELECT event_id, round_even(value * 100, 0)::BIGINT AS score, CASE WHEN value + event_id % 40 > 60 THEN 1 ELSE 0 END AS label FROM events WHERE value IS NOT NULL"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", F.rint(F.col("value") * 100).cast("bigint").alias("score"), (F.col("value") + F.col("event_id") % 40 > 60).cast("int").alias("label"))


@query("W1_error_curve", f"""
WITH s AS ({SCORES_SQL}), g AS (SELECT score, sum(label) AS p, sum(1 - label) AS q FROM s GROUP BY score)
SELECT score, sum(p) OVER (ORDER BY score) / sum(p) OVER ()::DOUBLE AS fnr, 1 - sum(q) OVER (ORDER BY score) / sum(q) OVER ()::DOUBLE AS fpr FROM g""")
def error_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Miss and false-alarm rates at every threshold. Scores are added up first, so the running sums, which need one
    order, run over distinct scores alone."""
    c = metrics.detection_curve(scores(spark, sf_dir), "score", "label")
    below = lambda at, tps, p: (F.col(p) - F.col(tps) + F.col(at)) / F.col(p)  # noqa: E731  of the scores up to this one
    return c.select("score", below("at_p", "tps", "p").alias("fnr"), (1 - below("at_n", "fps", "n")).alias("fpr"))


@query("W2_merged_runs", "SELECT user_id, min(event_id) AS first_event, event_type, count(*)::BIGINT AS n, avg(value) AS mean FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM (SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, island, event_type")
def merged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("at", F.struct("ts", "event_id"))
    return scans.islands(e, "user_id", "at", "event_type").groupBy("user_id", "island", "event_type").agg(F.min("event_id").alias("first_event"), F.count("*").alias("n"), F.avg("value").alias("mean")).drop("island")


@query("W4_overlapping_chunks", """
WITH s AS (SELECT doc_id, range(0, (n_chars % 200)::BIGINT) AS xs FROM documents)
SELECT doc_id, i AS chunk, xs[i * 15 + 1] AS first, xs[i * 15 + 40] AS last FROM s, LATERAL (SELECT unnest(range(0, (len(xs) - 40) // 15 + 1)) AS i) WHERE len(xs) >= 40""")
def overlapping_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").filter("n_chars % 200 > 0").select("doc_id", F.sequence(F.lit(0).cast("bigint"), F.col("n_chars") % 200 - 1).alias("xs"))
    c = s.select("doc_id", F.posexplode(scans.chunks(F.col("xs"), 40, 15)).alias("chunk", "c"))
    return c.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("c")[0].alias("first"), F.element_at("c", -1).alias("last"))


@query("W6_rows_per_group", """
SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, greatest(1, count(*) OVER (PARTITION BY source) // 10) AS s FROM documents) WHERE r % s = 0 AND r < 10 * s""")
def rows_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.strided_per_group(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 10)


@query("W7_groups_until", "SELECT * FROM (SELECT source, n AS rows, coalesce(sum(n) OVER (ORDER BY source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM (SELECT source, count(*)::BIGINT AS n FROM documents GROUP BY source)) WHERE before < 300")
def groups_until(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.groups_until(table(spark, sf_dir, "documents"), "source", 300)


SEGMENTS_SQL = "SELECT conv_id, turn, (turn * 10)::DOUBLE AS st, (turn * 10 + 8 + conv_id % 3)::DOUBLE AS en, 200.0::DOUBLE AS dur FROM conversations"


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "double(turn * 10) AS st", "double(turn * 10 + 8 + conv_id % 3) AS en", "double(200) AS dur")


@query("W8_padded_segments", f"""
WITH w AS (SELECT *, greatest(0, st - 2) AS s, least(dur, en + 2) AS e FROM ({SEGMENTS_SQL})), n AS (SELECT *, lead(s) OVER o AS nx, lag(e) OVER o AS pv FROM w WINDOW o AS (PARTITION BY conv_id ORDER BY st + en, st))
SELECT conv_id, turn, CASE WHEN pv > s THEN (pv + s) / 2 ELSE s END AS new_start, CASE WHEN nx < e THEN (nx + e) / 2 ELSE e END AS new_end FROM n""")
def padded_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.padded_segments(segments(spark, sf_dir), "conv_id", "st", "en", 2.0, "dur").select("conv_id", "turn", "new_start", "new_end")


@query("W9_activity_turns", """
WITH a AS (SELECT vec_id, unnest(embedding) > 0 AS on_, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings), c AS (SELECT *, lag(on_) OVER w AS prev FROM a WINDOW w AS (PARTITION BY vec_id ORDER BY pos)),
i AS (SELECT *, sum(CASE WHEN prev IS NOT DISTINCT FROM on_ THEN 0 ELSE 1 END) OVER (PARTITION BY vec_id ORDER BY pos) AS island FROM c)
SELECT vec_id, min(pos)::INTEGER AS start, count(*)::BIGINT AS dur FROM i WHERE on_ GROUP BY vec_id, island""")
def activity_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "x")).withColumn("on", F.col("x") > 0)
    return scans.islands(a, "vec_id", "pos", "on").filter("on").groupBy("vec_id", "island").agg(F.min("pos").alias("start"), F.count("*").alias("dur")).drop("island")


@query("W10_label_aggregation", """
WITH f AS (SELECT vec_id, unnest(range(0, 8)) AS f, list_transform(embedding, lambda x: CASE WHEN x > 0 THEN 1 ELSE 0 END) AS b FROM embeddings)
SELECT vec_id, f, CASE WHEN list_sum(b[f * 8 + 1 : f * 8 + 8]) > 4 THEN 1 ELSE 0 END AS label FROM f""")
def label_aggregation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Majority of the labels under each window of eight."""
    ones = F.transform("embedding", lambda x: (x > 0).cast("int"))
    f = table(spark, sf_dir, "embeddings").select("vec_id", ones.alias("b"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("f"))
    return f.select("vec_id", F.col("f").cast("bigint").alias("f"), (F.aggregate(F.slice("b", F.col("f") * 8 + 1, F.lit(8)), F.lit(0), lambda a, x: a + x) > 4).cast("int").alias("label"))


@query("W11_mean_pooling", "SELECT vec_id, (pos // 4)::BIGINT AS frame, avg(x) AS mean FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) GROUP BY 1, 2")
def mean_pooling(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x"))
    return x.groupBy("vec_id", F.floor(F.col("pos") / 4).alias("frame")).agg(F.avg("x").alias("mean"))


@query("W12_deltas", """
WITH x AS (SELECT vec_id, round_even(unnest(embedding)::DOUBLE * 1000, 0) AS x, (generate_subscripts(embedding, 1) - 1)::INTEGER AS pos FROM embeddings)
SELECT vec_id, pos, ((coalesce(lead(x, 1) OVER w, last_value(x) OVER f) - coalesce(lag(x, 1) OVER w, first_value(x) OVER f)) + 2 * (coalesce(lead(x, 2) OVER w, last_value(x) OVER f) - coalesce(lag(x, 2) OVER w, first_value(x) OVER f))) / 10 AS delta
FROM x WINDOW w AS (PARTITION BY vec_id ORDER BY pos), f AS (PARTITION BY vec_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("pos", "x")).withColumn("x", F.rint(F.col("x") * 1000))
    return scans.deltas(x, "vec_id", "pos", "x").drop("x")


@query("W13_median_filter", "SELECT vec_id, i AS pos, list_sort(embedding[i : i + 4])[3] AS median FROM embeddings, LATERAL (SELECT unnest(range(1, 61)) AS i)")
def median_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(1), F.lit(60))).alias("i"))
    return e.select("vec_id", F.col("i").cast("bigint").alias("pos"), F.sort_array(F.slice("embedding", F.col("i"), F.lit(5)))[2].alias("median"))


@query("R6_time_frame", "SELECT user_id, event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)::BIGINT AS recent FROM events")
def time_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the day before each row, itself included."""
    e = table(spark, sf_dir, "events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    return e.select("user_id", "event_id", F.count("*").over(Window.partitionBy("user_id").orderBy("us").rangeBetween(-86400000000, 0)).alias("recent"))


@query("R7_without_contained", f"""
SELECT conv_id, turn FROM (SELECT *, max(b) OVER (PARTITION BY conv_id ORDER BY a, b DESC, turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM (SELECT conv_id, turn, turn * 10 AS a, turn * 10 + (turn * 37 + conv_id * 13) % 41 AS b FROM conversations)) WHERE m IS NULL OR m < b""")
def without_contained(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "conversations").selectExpr("conv_id", "turn", "turn * 10 AS a", "turn * 10 + (turn * 37 + conv_id * 13) % 41 AS b")
    return scans.without_contained(s, "conv_id", "a", "b").select("conv_id", "turn")


@query("R8_gap_merge", """
SELECT user_id, min(s)::BIGINT AS start_s, max(s)::BIGINT AS end_s, count(*)::BIGINT AS n FROM (SELECT *, sum(far) OVER (PARTITION BY user_id ORDER BY s, event_id) AS session FROM (SELECT user_id, event_id, epoch_us(ts) // 1000000 AS s, coalesce((epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= 43200)::INTEGER, 0) AS far FROM events)) GROUP BY user_id, session""")
def gap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.unix_seconds(F.col("ts").cast("timestamp")).alias("s"))
    return scans.sessions(e, "user_id", "s", 43200).groupBy("user_id", "session").agg(F.min("s").alias("start_s"), F.max("s").alias("end_s"), F.count("*").alias("n")).drop("session")
