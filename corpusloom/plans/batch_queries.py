"""Queries of batching and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import batching, ranks, sequential
from corpusloom.plans.registry import query
from corpusloom.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")


_EVEN = """
WITH r AS (SELECT doc_id, row_number() OVER (ORDER BY {order}) - 1 AS r, count(*) OVER () AS n FROM documents), b AS (SELECT *, greatest(n // 16, 1) AS k FROM r), c AS (SELECT *, ((r + 1) * k - 1) // n AS b FROM b)
SELECT doc_id, b::BIGINT AS batch_id, (r - b * n // k)::BIGINT AS pos FROM c"""


@query("B1_unsorted", _EVEN.format(order="doc_id"))
def unsorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.even(_docs(spark, sf_dir).select("doc_id"), ["doc_id"], 16)


@query("B1_unsorted_drop_last", "SELECT doc_id, (r // 16)::BIGINT AS batch_id, (r % 16)::BIGINT AS pos FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents) WHERE r // 16 < n // 16")
def unsorted_drop_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.even(_docs(spark, sf_dir).select("doc_id"), ["doc_id"], 16, drop_last=True)


@query("B2_sorted", _EVEN.format(order="n_chars, doc_id"))
def sorted_(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batching.even(_docs(spark, sf_dir).select("doc_id", "n_chars"), ["n_chars", "doc_id"], 16).drop("n_chars")


# Batches of a fold over all rows in order of length, {shut} closing the one before the row; a last batch of fewer than
# {least} rows is then spread over the others, counted back from the {offset}-th last.
_FOLDED = """
WITH RECURSIVE o AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS r FROM documents {where}),
f(r, batch, n, total, most) AS (SELECT r, 0::BIGINT, 1::BIGINT, n_chars, n_chars FROM o WHERE r = 0
UNION ALL SELECT o.r, f.batch + {shut}::INT, CASE WHEN {shut} THEN 1 ELSE f.n + 1 END, CASE WHEN {shut} THEN o.n_chars ELSE f.total + o.n_chars END, CASE WHEN {shut} THEN o.n_chars ELSE {most} END FROM f JOIN o ON o.r = f.r + 1),
s AS (SELECT batch, count(*) AS n FROM f GROUP BY batch), p AS (SELECT CASE WHEN count(*) > 1 AND arg_max(n, batch) < {least} THEN arg_max(n, batch) ELSE 0 END AS rest, CASE WHEN count(*) > 1 AND arg_max(n, batch) < {least} THEN count(*) - 1 ELSE count(*) END AS k FROM s),
t AS (SELECT batch, n + CASE WHEN rest > 0 THEN rest // k + ((((k - {offset} - batch) % k) + k) % k < rest % k)::INT ELSE 0 END AS n FROM s, p WHERE batch < k),
c AS (SELECT batch, n, sum(n) OVER (ORDER BY batch) - n AS first FROM t)
SELECT doc_id, batch AS batch_id, (r - first)::BIGINT AS pos FROM o JOIN c ON r >= first AND r < first + n"""


def _folded(shut: str, least: int = 1, offset: int = 1, most: str = "greatest(f.most, o.n_chars)", where: str = "") -> str:
    return _FOLDED.format(shut=shut, least=least, offset=offset, most=most, where=where)


def _batches(df: DataFrame) -> DataFrame:
    return df.select("doc_id", "batch_id", "pos")


@query("B4_length_bins", _folded("(f.n * f.most > 60000 AND f.n >= 6)", least=6))
def length_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(batching.by_bins(_docs(spark, sf_dir), "doc_id", "n_chars", 60000, 6))


@query("B5_element_bins", _folded("(f.total > 50000 AND f.n >= 4)", least=4))
def element_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without padding: elements in all."""
    return _batches(batching.by_bins(_docs(spark, sf_dir), "doc_id", "n_chars", 50000, 4, padding=False))


@query("B9_buckets", _folded("((f.n + 1) * greatest(f.most, o.n_chars) > 40000)", where="WHERE n_chars <= 40000"))
def buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _batches(batching.by_buckets(_docs(spark, sf_dir), "doc_id", "n_chars", 40000))


@query("B3_folds", _folded("(f.n >= greatest(3, 32 // (1 + f.most // 800)))", least=3, offset=2, most="f.most"))
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a batch allows 32 rows, fewer by its length; here its length is what is carried along."""
    return _batches(batching.by_folds(_docs(spark, sf_dir), "doc_id", "n_chars", 32, 800, 3))


@query("B13_spread_tail", """
WITH n AS (SELECT count(*) // 48 AS k, count(*) % 48 AS rest FROM documents), b AS (SELECT unnest(range(0, k)) AS batch, k, rest FROM n)
SELECT o AS offset_, batch::BIGINT AS batch_id, (48 + rest // k + ((((k - o - batch) % k) + k) % k < rest % k)::INT)::BIGINT AS n FROM b, (SELECT unnest([1, 2]) AS o)""")
def spread_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last batch, too small, go one each to the batches before, by either rule of where to begin."""
    d = _docs(spark, sf_dir)
    one = batching.by_bins(d.withColumn("one", F.lit(1)), "doc_id", "one", 47, 48)
    two = batching.by_folds(d, "doc_id", "n_chars", 48, 1 << 40, 48)
    sizes = lambda df, o: df.groupBy("batch_id").agg(F.count("*").alias("n")).select(F.lit(o).alias("offset_"), "batch_id", "n")
    return sizes(one, 1).unionByName(sizes(two, 2))


@query("B6_category_balanced", """
WITH k AS (SELECT count(DISTINCT lang) AS k FROM documents), r AS (SELECT doc_id, lang, md5('6:' || doc_id) AS h, row_number() OVER (PARTITION BY lang ORDER BY md5('6:' || doc_id), doc_id) - 1 AS r FROM documents),
b AS (SELECT doc_id, h, r // CASE WHEN k >= 16 THEN 1 ELSE 16 // k + 1 END AS batch_id FROM r, k), p AS (SELECT *, row_number() OVER (PARTITION BY batch_id ORDER BY h, doc_id) - 1 AS pos, count(*) OVER (PARTITION BY batch_id) AS n FROM b)
SELECT doc_id, batch_id::BIGINT AS batch_id, pos::BIGINT AS pos FROM p WHERE n >= 16 AND pos < 16""")
def category_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of sixteen with as many of each language as fit."""
    return _batches(batching.category_balanced(_docs(spark, sf_dir), "doc_id", "lang", 16, seed=6))


_POWER = "SELECT lang, pow(s / t, 0.5) / sum(pow(s / t, 0.5)) OVER () AS p FROM (SELECT lang, sum(n_chars)::DOUBLE AS s, sum(sum(n_chars)) OVER ()::DOUBLE AS t FROM documents GROUP BY lang)"
_DATASET_POWER = """
SELECT p.source, lang, pl / sum(pl) OVER (PARTITION BY p.source) * pd / t AS p FROM (SELECT *, pow(n / nd, 0.5) AS pl, pow(nd / m, 0.3) AS pd FROM (SELECT *, sum(n) OVER (PARTITION BY source) AS nd, sum(n) OVER () AS m FROM (SELECT source, lang, sum(n_chars)::DOUBLE AS n FROM documents GROUP BY 1, 2))) p,
(SELECT sum(pow(nd / m, 0.3)) AS t FROM (SELECT sum(n_chars)::DOUBLE AS nd, sum(sum(n_chars)) OVER ()::DOUBLE AS m FROM documents GROUP BY source))"""
# Draws of a group by its weight, and of its rows in turn.
_DRAWS = """
w AS (SELECT *, sum(p) OVER (ORDER BY {group}) AS up, count(*) OVER () - row_number() OVER (ORDER BY {group}) + 1 AS last FROM ({weights})), n AS (SELECT floor(floor(sum(n_chars) * 1.2) / avg(n_chars))::BIGINT AS n FROM documents),
u AS (SELECT i AS draw, ('0x' || substr(md5('{seed}:' || i), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM n, LATERAL (SELECT unnest(range(0, n)) AS i)),
g AS (SELECT draw, min(rank) AS rank FROM u JOIN (SELECT up, last, row_number() OVER (ORDER BY {group}) AS rank FROM w) ON u < up OR last = 1 GROUP BY draw),
named AS (SELECT *, row_number() OVER (ORDER BY {group}) AS rank FROM w), d AS (SELECT draw, {group}, row_number() OVER (PARTITION BY rank ORDER BY draw) - 1 AS nth FROM g JOIN named USING (rank)),
r AS (SELECT doc_id, n_chars, {group}, row_number() OVER (PARTITION BY {group} ORDER BY md5('{seed}:' || doc_id), doc_id) - 1 AS place, count(*) OVER (PARTITION BY {group}) AS size FROM documents),
drawn AS (SELECT draw, {group}, doc_id, n_chars FROM d JOIN r USING ({group}) WHERE place = nth % size)"""


def _draws(d: DataFrame) -> int:
    s = d.agg(F.floor(F.floor(F.sum("n_chars") * 1.2) / F.avg("n_chars")).cast("bigint").alias("n")).first()
    return int(s.n or 0)


def _power(d: DataFrame) -> DataFrame:
    s = d.groupBy("lang").agg(F.sum("n_chars").cast("double").alias("s"))
    p = s.withColumn("p", F.pow(F.col("s") / F.sum("s").over(Window.partitionBy()), F.lit(0.5)))  # a row a category
    return p.select("lang", (F.col("p") / F.sum("p").over(Window.partitionBy())).alias("p"))


@query("B7_category_power", f"""
WITH RECURSIVE {_DRAWS.format(group="lang", weights=_POWER, seed=7)},
f(draw, batch, n, total) AS (SELECT draw, 0::BIGINT, 1::BIGINT, n_chars::BIGINT FROM drawn WHERE draw = 0
UNION ALL SELECT o.draw, f.batch + (f.total > 50000 AND f.n >= 2 OR f.n >= 40)::INT, CASE WHEN f.total > 50000 AND f.n >= 2 OR f.n >= 40 THEN 1 ELSE f.n + 1 END, CASE WHEN f.total > 50000 AND f.n >= 2 OR f.n >= 40 THEN o.n_chars ELSE f.total + o.n_chars END FROM f JOIN drawn o ON o.draw = f.draw + 1)
SELECT draw, doc_id, batch AS batch_id FROM f JOIN drawn USING (draw)""")
def category_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn by their language's weight, a fifth more than there are, in batches of 50,000 characters over all draws
    in turn."""
    d = _docs(spark, sf_dir)
    drawn = batching.power_draws(d, "doc_id", ["lang"], _power(d), _draws(d), seed=7, others=["n_chars"])
    return sequential.batches_of_draws(drawn.select("draw", "doc_id", "n_chars"), "draw", "n_chars", 50000, 2, 40).select("draw", "doc_id", "batch_id")


@query("B8_dataset_power", f"WITH {_DRAWS.format(group='source, lang', weights=_DATASET_POWER, seed=8)} SELECT draw, source, lang, doc_id FROM drawn")
def dataset_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows drawn by their dataset's weight and their language's within it."""
    d = _docs(spark, sf_dir)
    c = d.groupBy("source", "lang").agg(F.sum("n_chars").cast("double").alias("n"))
    own, whole = Window.partitionBy("source"), Window.partitionBy()  # over categories, not rows
    c = c.withColumn("nd", F.sum("n").over(own)).withColumn("m", F.sum("n").over(whole))
    p = c.select("source", "lang", F.pow(F.col("n") / F.col("nd"), F.lit(0.5)).alias("pl"), F.pow(F.col("nd") / F.col("m"), F.lit(0.3)).alias("pd"))
    p = p.withColumn("one", F.col("pd") / F.count("*").over(own))
    weights = p.select("source", "lang", (F.col("pl") / F.sum("pl").over(own) * F.col("pd") / F.sum("one").over(whole)).alias("p"))
    return batching.power_draws(d, "doc_id", ["source", "lang"], weights, _draws(d), seed=8).select("draw", "source", "lang", "doc_id")


@query("B10_best_fit")
def best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best fit over the whole table; tests hold it against packing row by row."""
    return batching.packed(_docs(spark, sf_dir), "doc_id", "n_chars", 20000).select("bin_id", "doc_id", "n_chars")


@query("B11_diverse_packing")
def diverse_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins that mix long and short rows, over the whole table; tests hold it against packing row by row."""
    return batching.packed_mixed(_docs(spark, sf_dir), "doc_id", "n_chars", 20000)


@query("B12_sharded_packing")
def sharded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in shards of some hundred rows, what is not full being packed again."""
    return batching.packed_mixed(_docs(spark, sf_dir), "doc_id", "n_chars", 30000, per_shard=300)


@query("B15_epoch_windows", "SELECT doc_id, (r // 100)::BIGINT AS epoch, (r % 100)::BIGINT AS iter FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents)")
def epoch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("place")
    return ranks.numbered(_docs(spark, sf_dir).select("doc_id"), ["doc_id"]).select("doc_id", F.floor(r / 100).alias("epoch"), (r % 100).alias("iter"))


@query("B18_collate", """
WITH w AS (SELECT item_id, item_id // 8 AS batch, list_transform(string_split_regex(text, '[ \\n]+'), lambda x: length(x)) AS xs FROM benchmark), m AS (SELECT *, max(len(xs)) OVER (PARTITION BY batch) AS most FROM w)
SELECT item_id, batch, len(xs)::BIGINT AS length, array_to_string(list_concat(xs, list_transform(range(0, most - len(xs)), lambda i: -32768)), ',') AS padded FROM m""")
def collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of a batch padded on the right to its longest, with their lengths."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.expr("item_id div 8").alias("batch"), F.transform(F.split("text", "[ \n]+"), F.length).alias("xs"))
    most = F.max(F.size("xs")).over(Window.partitionBy("batch"))
    p = w.withColumn("most", most)
    padded = F.concat("xs", F.expr("array_repeat(-32768, most - size(xs))"))
    return p.select("item_id", "batch", F.size("xs").cast("bigint").alias("length"), F.array_join(padded.cast("array<string>"), ",").alias("padded"))
