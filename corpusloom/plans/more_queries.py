"""Further queries of batching, chunking, splits and chained sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators import keyed, scans, sequential, signals
from corpusloom.plans.registry import query
from corpusloom.session import table


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")


@query("W5_category_chunks", """
SELECT lang, count(*)::BIGINT AS chunks, sum(i * 20)::BIGINT AS starts FROM (SELECT lang, unnest(range(0, (n_chars % 300 - 50) // 20 + 1)) AS i FROM documents WHERE n_chars % 300 >= 50) GROUP BY lang""")
def category_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full windows of 50 every 20 of each sequence, pooled by category."""
    s = _docs(spark, sf_dir).filter("n_chars % 300 >= 50").select("lang", F.sequence(F.lit(0).cast("bigint"), F.col("n_chars") % 300 - 1).alias("xs"))
    c = s.select("lang", F.explode(scans.chunks(F.col("xs"), 50, 20)).alias("c"))
    return c.groupBy("lang").agg(F.count("*").alias("chunks"), F.sum(F.col("c")[0]).alias("starts"))


@query("B17_wrapped_epochs", "SELECT step, (step % n)::BIGINT AS place, (step // n)::BIGINT AS epoch FROM (SELECT unnest(range(0, 2500)) AS step), (SELECT count(*) AS n FROM documents)")
def wrapped_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Steps over a table that is gone through again and again."""
    n = F.col("n")
    s = spark.range(2500).select(F.col("id").alias("step")).crossJoin(_docs(spark, sf_dir).agg(F.count("*").alias("n")))
    return s.select("step", (F.col("step") % n).alias("place"), F.floor(F.col("step") / n).alias("epoch"))


@query("U9_chained_epochs", "SELECT epoch, count(*)::BIGINT AS n FROM (SELECT 0 AS epoch FROM documents UNION ALL SELECT 1 FROM documents UNION ALL SELECT 0 FROM benchmark UNION ALL SELECT 1 FROM benchmark) GROUP BY epoch")
def chained_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterators chained, once an epoch."""
    d = table(spark, sf_dir, "documents").select("doc_id").unionAll(table(spark, sf_dir, "benchmark").select("item_id"))
    return d.select(F.explode(F.array(F.lit(0), F.lit(1))).alias("epoch")).groupBy("epoch").agg(F.count("*").alias("n"))


@query("Z2_shapes", "SELECT vec_id::VARCHAR || ' 7,4' AS line FROM embeddings")
def shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shapes of feature matrices as a manifest's lines, of the matrices themselves."""
    m = signals.log_mel(sequential.spectrogram(F.col("embedding")), bands=4)
    size = F.concat(F.size("m").cast("string"), F.lit(","), F.size(F.col("m")[0]).cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", m.alias("m")).select(F.concat(F.col("vec_id").cast("string"), F.lit(" "), size).alias("line"))


@query("Z3_silence_trimming", """
WITH f AS (SELECT vec_id, unnest(range(0, 8)) AS i, embedding FROM embeddings), e AS (SELECT vec_id, i, list_max(list_transform(embedding[i * 8 + 1 : i * 8 + 8], lambda x: abs(x))) AS top FROM f)
SELECT vec_id, min(i)::BIGINT AS first, max(i)::BIGINT AS last FROM e WHERE top > 0.2 GROUP BY vec_id""")
def silence_trimming(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last frame of eight samples that is louder than a threshold."""
    f = table(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(7).cast("bigint"))).alias("i"), "embedding")
    top = F.array_max(F.transform(F.slice("embedding", (F.col("i") * 8 + 1).cast("int"), F.lit(8)), F.abs))
    return f.withColumn("top", top).filter("top > 0.2").groupBy("vec_id").agg(F.min("i").alias("first"), F.max("i").alias("last"))


@query("B16_shuffled_within", "SELECT doc_id, (doc_id // 16)::BIGINT AS batch_id, (row_number() OVER (PARTITION BY doc_id // 16 ORDER BY md5('16:' || doc_id), doc_id) - 1)::BIGINT AS pos FROM documents")
def shuffled_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch's rows in a fixed shuffle."""
    d = _docs(spark, sf_dir).withColumn("batch_id", F.floor(F.col("doc_id") / 16))
    w = Window.partitionBy("batch_id").orderBy(keyed.hashed_order("doc_id", 16), "doc_id")
    return d.select("doc_id", "batch_id", (F.row_number().over(w) - 1).cast("bigint").alias("pos"))


_CROPPED = "list_transform(embedding[(vec_id % 16 + 1)::INT : (vec_id % 16 + 48)::INT], lambda x: round_even(x::DOUBLE * 1e6, 0)::BIGINT)"


@query("B19_cropped_collate", f"SELECT vec_id, array_to_string({_CROPPED}, ',') AS frames, array_to_string(list_filter({_CROPPED}, lambda x, i: i % 4 = 1), ',') AS labels FROM embeddings")
def cropped_collate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """48 frames from a place on, and every fourth label."""
    crop = F.slice("embedding", (F.col("vec_id") % 16 + 1).cast("int"), F.lit(48))
    said = F.transform(crop, lambda x: F.rint(x.cast("double") * 1e6).cast("bigint").cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array_join(said, ",").alias("frames"), F.array_join(F.filter(said, lambda x, i: i % 4 == 0), ",").alias("labels"))


@query("R23_group_split_to_size")
def group_split_to_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole groups, here combinations of source and language, for a development set as near to a tenth of the rows as
    can be had; tests hold it against all subsets."""
    d = _docs(spark, sf_dir).withColumn("grp", F.concat_ws("/", "source", "lang"))
    chosen = sequential.groups_for_size(d.groupBy("grp").agg(F.count("*").alias("n")), "grp", "n", 0.1)
    return d.join(F.broadcast(chosen), "grp", "left").select("doc_id", "grp", F.coalesce("split", F.lit("train")).alias("split"))
