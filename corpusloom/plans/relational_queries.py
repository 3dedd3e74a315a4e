"""Queries of filters, joins, set operations, splits and samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import keyed, ranks
from corpusloom.plans.registry import query
from corpusloom.session import table

# --- projections and filters


@query("P1_apply_map", """
WITH w AS (SELECT doc_id, unnest(string_split(source || ' ' || lang || ' x', ' ')) AS tok, generate_subscripts(string_split(source || ' ' || lang || ' x', ' '), 1) AS pos FROM documents),
m(tok, seq) AS (VALUES ('en', 'e n'), ('fr', 'f r'), ('de', 'd e'), ('es', 'e s'))
SELECT doc_id, string_agg(coalesce(seq, w.tok), ' ' ORDER BY pos) AS mapped FROM w LEFT JOIN m ON w.tok = m.tok GROUP BY doc_id""")
def apply_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens replaced by token sequences; unknown tokens stay (permissive)."""
    words = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.concat_ws(" ", "source", "lang", F.lit("x")), " ")).alias("pos", "tok"))
    m = spark.createDataFrame([("en", "e n"), ("fr", "f r"), ("de", "d e"), ("es", "e s")], "tok string, seq string")
    j = words.join(m, "tok", "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("seq", "tok").alias("t")))).alias("x"))
    return j.select("doc_id", F.array_join(F.transform("x", lambda x: x["t"]), " ").alias("mapped"))


@query("P2_field_slice", "SELECT doc_id, array_to_string(string_split(text, ' ')[2:3], ' ') AS fields FROM documents")
def field_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field '2' selects two fields, the second and the third."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(F.slice(F.split("text", " "), 2, 2), " ").alias("fields"))


@query("P3_id_prefix", "SELECT 'p-' || doc_id || '-s' AS utt, 'p-' || source || '-s' AS spk FROM documents")
def id_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.concat(F.lit("p-"), F.col(c).cast("string"), F.lit("-s"))
    return table(spark, sf_dir, "documents").select(r("doc_id").alias("utt"), r("source").alias("spk"))


@query("P4_remove_long_short", "SELECT doc_id FROM documents WHERE n_chars > 100 AND n_chars < 4000 INTERSECT SELECT doc_id FROM (SELECT doc_id, len(string_split(text, ' ')) AS w FROM documents) WHERE w > 20 AND w < 600")
def remove_long_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    words = F.size(F.split("text", " "))
    return docs.filter("n_chars > 100 AND n_chars < 4000").select("doc_id").intersect(docs.filter((words > 20) & (words < 600)).select("doc_id"))


@query("P5_oversize", "SELECT doc_id, n_chars FROM documents WHERE n_chars <= 2000")
def oversize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").filter("n_chars <= 2000")


@query("P6_language_agreement", "SELECT doc_id FROM (SELECT doc_id, lang, CASE WHEN doc_id % 7 = 0 THEN 'en' ELSE lang END AS t, CASE WHEN doc_id % 3 = 0 THEN '<na>' ELSE lang END AS p, CASE WHEN doc_id % 11 = 0 THEN 'fr' ELSE lang END AS s FROM documents) WHERE lang = t AND t = (CASE WHEN p = '<na>' THEN lang ELSE p END) AND t = s")
def language_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").selectExpr("doc_id", "lang", "if(doc_id % 7 = 0, 'en', lang) AS t", "if(doc_id % 3 = 0, '<na>', lang) AS p", "if(doc_id % 11 = 0, 'fr', lang) AS s")
    return d.filter((F.col("lang") == F.col("t")) & (F.col("t") == F.when(F.col("p") == "<na>", F.col("lang")).otherwise(F.col("p"))) & (F.col("t") == F.col("s"))).select("doc_id")


@query("P7_quantile_filter", """
WITH o AS (SELECT l_orderkey, l_returnflag, list(l_quantity) AS xs FROM lineitem GROUP BY 1, 2),
q AS (SELECT l_returnflag, quantile_cont(l_quantity, 0.1) AS t FROM lineitem GROUP BY 1)
SELECT l_orderkey, l_returnflag, len(xs)::BIGINT AS n FROM o JOIN q USING (l_returnflag) WHERE list_min(xs) >= t""")
def quantile_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples all of whose scores reach their group's exact quantile."""
    items = table(spark, sf_dir, "lineitem")
    limits = items.groupBy("l_returnflag").agg(F.percentile("l_quantity", 0.1).alias("t"))
    samples = items.groupBy("l_orderkey", "l_returnflag").agg(F.min("l_quantity").alias("least"), F.count("*").alias("n"))
    return samples.join(limits, "l_returnflag").filter("least >= t").select("l_orderkey", "l_returnflag", "n")


@query("P8_invalid_symbols", "SELECT doc_id FROM documents WHERE NOT contains(text, '%%%') AND NOT contains(text, '|')")
def invalid_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").filter(~F.contains("text", F.lit("%%%")) & ~F.contains("text", F.lit("|"))).select("doc_id")


@query("P9_positive_duration", "SELECT event_id, value FROM events WHERE value > 0")
def positive_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value > 0").select("event_id", "value")


@query("P10_segment_validation", """
WITH s AS (SELECT doc_id, (doc_id % 50 - 5)::BIGINT AS st, (doc_id % 50 + doc_id % 400)::BIGINT AS en FROM documents), r AS (SELECT doc_id, n_chars // 10 AS dur FROM documents WHERE doc_id % 4 <> 0)
SELECT doc_id, st, least(en, dur) AS en FROM s JOIN r USING (doc_id) WHERE st >= 0 AND least(en, dur) > st""")
def segment_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments of known recordings, clamped to the recording's length, that are not empty."""
    d = table(spark, sf_dir, "documents")
    s = d.selectExpr("doc_id", "doc_id % 50 - 5 AS st", "doc_id % 50 + doc_id % 400 AS en")
    r = d.filter("doc_id % 4 <> 0").selectExpr("doc_id", "n_chars div 10 AS dur")
    return s.join(r, "doc_id").withColumn("en", F.least("en", "dur")).filter("st >= 0 AND en > st").select("doc_id", "st", "en")


@query("P11_vocabulary_filter", """
WITH w AS (SELECT doc_id, unnest(string_split_regex(text, '[ \\n]+')) AS tok, generate_subscripts(string_split_regex(text, '[ \\n]+'), 1) AS pos FROM documents),
v AS (SELECT tok FROM w GROUP BY tok HAVING count(*) >= 10)
SELECT doc_id, count(*)::BIGINT AS tokens, count(*) FILTER (WHERE v.tok IS NULL)::BIGINT AS unknown FROM w LEFT JOIN v ON w.tok = v.tok GROUP BY doc_id""")
def vocabulary_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens outside the vocabulary become <UNK>; counted for each document."""
    return keyed.unknown_tokens(table(spark, sf_dir, "documents"), "doc_id", "text", T.split_words, 10)


@query("P12_key_tokens", "SELECT c_custkey, array_to_string(list_filter(string_split(c_name || '#a#b', '#'), lambda x, i: i <> 2), '_') AS key FROM customer")
def key_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.filter(F.split(F.concat("c_name", F.lit("#a#b")), "#"), lambda x, i: i != 1)
    return table(spark, sf_dir, "customer").select("c_custkey", F.array_join(x, "_").alias("key"))


@query("P13_threshold", "SELECT vec_id, len(list_filter(embedding, lambda x: x > 0.1))::BIGINT AS active FROM embeddings")
def threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posteriors to 0 and 1 by a strict threshold; the ones are counted."""
    ones = F.transform("embedding", lambda x: (x > F.lit(0.1)).cast("int"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.aggregate(ones, F.lit(0).cast("bigint"), lambda a, x: a + x).alias("active"))


# --- joins


@query("J1_semi", "SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keep_keys(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("J1_anti", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keep_keys(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id", exclude=True)


@query("J2_many_way_semi", "SELECT l.quality AS split, d.doc_id FROM documents d JOIN labels l USING (doc_id)")
def many_way_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One manifest filtered into several splits at once; the split column can partition a write."""
    return table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("split")), "doc_id").select("split", "doc_id")


@query("J3_key_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels INTERSECT SELECT page_id FROM pages")
def key_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"))
    return keyed.common_keys([table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), pages], "doc_id")


@query("J4_lockstep", "SELECT a.doc_id, a.lang, b.n_chars FROM documents a JOIN documents b USING (doc_id)")
def lockstep(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return keyed.lockstep(d.select("doc_id", "lang"), d.select("doc_id", "n_chars"), "doc_id")


@query("J5_multi_reader", "SELECT d.doc_id, d.source, l.quality, p.url FROM documents d JOIN labels l USING (doc_id) JOIN pages p ON p.page_id = d.doc_id")
def multi_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc_id"), "url")
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").join(pages, "doc_id")


@query("J6_lookup_default", "SELECT d.doc_id, coalesce(s.sid, 0) AS sid FROM documents d LEFT JOIN (SELECT source, row_number() OVER (ORDER BY source) AS sid FROM (SELECT DISTINCT source FROM documents WHERE source < 'src5')) s USING (source)")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    sids = docs.filter("source < 'src5'").select("source").distinct()
    sids = ranks.numbered(sids, ["source"], "sid").withColumn("sid", F.col("sid") + 1)
    return keyed.lookup(docs, sids, "source", "sid", F.lit(0)).select("doc_id", "sid")


@query("J7_dimensions", "SELECT l_orderkey, l_linenumber, s_name, coalesce(n_name, '1') AS channel FROM lineitem JOIN supplier ON l_suppkey = s_suppkey LEFT JOIN nation ON s_nationkey = n_nationkey AND n_regionkey < 3")
def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fact with two dimensions; the second has a default. A missing supplier fails the query."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    j = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("s_suppkey")).join(s, "s_suppkey", "left").join(n, "s_nationkey", "left")
    name = F.when(F.col("s_name").isNull(), F.raise_error("no such supplier").cast("string")).otherwise(F.col("s_name"))
    return j.select("l_orderkey", "l_linenumber", name.alias("s_name"), F.coalesce("n_name", F.lit("1")).alias("channel"))


@query("J11_left_two_keys", "SELECT l_orderkey, l_linenumber, b.n AS peers FROM lineitem LEFT JOIN (SELECT l_suppkey, l_returnflag, count(*)::BIGINT AS n FROM lineitem WHERE l_quantity > 25 GROUP BY 1, 2) b USING (l_suppkey, l_returnflag)")
def left_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem")
    b = items.filter("l_quantity > 25").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("peers"))
    return items.join(b, ["l_suppkey", "l_returnflag"], "left").select("l_orderkey", "l_linenumber", "peers")


@query("J12_rounded_equality", "SELECT a.event_id, b.n FROM events a JOIN (SELECT round_even(value, 1) AS v, count(*)::BIGINT AS n FROM events WHERE event_id % 2 = 0 GROUP BY 1) b ON round_even(a.value, 1) = b.v WHERE a.event_id % 2 = 1")
def rounded_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.bround("value", 1).alias("v"))
    b = e.filter("event_id % 2 = 0").groupBy("v").agg(F.count("*").alias("n"))
    return e.filter("event_id % 2 = 1").join(b, "v").select("event_id", "n")


@query("J13_append_struct", "SELECT d.doc_id, ['text', 'label'] || [] AS names, d.n_chars + l.quality AS total FROM documents d JOIN labels l USING (doc_id)")
def append_struct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a common key, with one input struct appended to the other's list."""
    a = table(spark, sf_dir, "documents").select("doc_id", F.array(F.struct(F.lit("text").alias("name"), F.col("n_chars").alias("size"))).alias("input"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.array(F.struct(F.lit("label").alias("name"), F.col("quality").cast("bigint").alias("size"))).alias("more"))
    j = a.join(b, "doc_id").select("doc_id", F.concat("input", "more").alias("input"))
    return j.select("doc_id", F.transform("input", lambda x: x["name"]).alias("names"), F.aggregate("input", F.lit(0).cast("bigint"), lambda a, x: a + x["size"]).alias("total"))


@query("J14_integrity", "WITH k AS (SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)) SELECT c_custkey, (SELECT count(*) FROM k WHERE o_custkey = c_custkey)::BIGINT AS orders FROM customer WHERE c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM k)")
def integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    kept, groups = keyed.integrity(rows, table(spark, sf_dir, "customer").filter("c_acctbal > 0"), "o_orderkey", "c_custkey")
    return groups.select("c_custkey").join(kept.groupBy("c_custkey").agg(F.count("*").alias("orders")), "c_custkey")


@query("J15_disjoint", "SELECT count(*)::BIGINT AS shared FROM (SELECT DISTINCT source FROM documents WHERE source < 'src15') a JOIN (SELECT DISTINCT source FROM documents WHERE source >= 'src15') b USING (source)")
def disjoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").select("source").distinct()
    return s.filter("source < 'src15'").join(s.filter("source >= 'src15'"), "source", "left_semi").agg(F.count("*").alias("shared"))


@query("J16_in_domain", "SELECT doc_id FROM documents WHERE doc_id % 10 = 0 AND lang IN (SELECT lang FROM documents WHERE doc_id % 10 <> 0 AND n_chars > 3000)")
def in_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.filter("doc_id % 10 = 0").join(d.filter("doc_id % 10 <> 0 AND n_chars > 3000").select("lang"), "lang", "left_semi").select("doc_id")


# --- set operations


@query("U1_combine", "SELECT doc_id::VARCHAR AS utt, source AS spk FROM documents UNION ALL SELECT 'p' || page_id, 'web' FROM pages")
def combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources joined as they are, a missing column filled; duplicates stay."""
    a = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("utt"), F.col("source").alias("spk"))
    return a.unionByName(table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), "page_id").alias("utt"), F.lit("web").alias("spk")))


@query("U2_last_wins", "SELECT doc_id, coalesce(l.quality::BIGINT, d.n_chars) AS v FROM documents d LEFT JOIN labels l USING (doc_id)")
def last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("v"), F.lit(0).alias("src"))
    b = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("bigint").alias("v"), F.lit(1).alias("src"))
    return keyed.first_by(a.unionByName(b), "doc_id", ["src"], last=True).drop("src")


@query("U3_suffixed_repeats", "SELECT CASE WHEN i = 0 THEN source ELSE source || '.' || i END AS key, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents)")
def suffixed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.suffixed_repeats(table(spark, sf_dir, "documents").select(F.col("source").alias("key"), "doc_id"), "key", "doc_id")


@query("U4_intersect", "SELECT lang, source FROM documents WHERE doc_id % 3 = 0 INTERSECT SELECT lang, source FROM documents WHERE doc_id % 3 = 1")
def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("lang", "source", "doc_id")
    return d.filter("doc_id % 3 = 0").select("lang", "source").intersect(d.filter("doc_id % 3 = 1").select("lang", "source"))


@query("U5_keep_first", "SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.join(d.groupBy("text").agg(F.min("doc_id").alias("doc_id")).select("doc_id"), "doc_id", "left_semi").select("doc_id", "text")


@query("U6_concatenated_shards", "SELECT doc_id, ((doc_id % 4) * 1000000 + doc_id)::BIGINT AS place FROM documents")
def concatenated_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    shards = [d.filter(F.col("doc_id") % 4 == i).withColumn("place", F.lit(i) * 1000000 + F.col("doc_id")) for i in range(4)]
    return shards[0].unionByName(shards[1]).unionByName(shards[2]).unionByName(shards[3])


@query("U7_except", "SELECT doc_id, source FROM documents WHERE source NOT IN (SELECT source FROM documents WHERE doc_id < 5)")
def except_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return keyed.keep_keys(d, d.filter("doc_id < 5"), "source", exclude=True)


@query("U8_concatenated_datasets", "SELECT 0 AS dataset, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark")
def concatenated_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Datasets with one schema, one after another."""
    a = table(spark, sf_dir, "documents").select(F.lit(0).alias("dataset"), F.col("doc_id").alias("id"), "text")
    return a.unionByName(table(spark, sf_dir, "benchmark").select(F.lit(1).alias("dataset"), F.col("item_id").alias("id"), "text"))


# --- order, limits, samples, splits


@query("O1_sorted_unique", "SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def sorted_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.first_by(table(spark, sf_dir, "documents").select("source", "doc_id"), "source", ["doc_id"]).orderBy("source")


@query("O2_first_last", "SELECT 'first' AS side, doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 10) UNION ALL SELECT 'last', doc_id FROM (SELECT doc_id FROM documents ORDER BY doc_id DESC LIMIT 10)")
def first_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id")
    return d.orderBy("doc_id").limit(10).select(F.lit("first").alias("side"), "doc_id").unionByName(d.orderBy(F.desc("doc_id")).limit(10).select(F.lit("last").alias("side"), "doc_id"))


@query("O4_shortest", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars, doc_id LIMIT 50")
def shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "n_chars").orderBy("n_chars", "doc_id").limit(50)


@query("O5_listed_groups", "SELECT doc_id FROM documents WHERE source IN ('src1', 'src3')")
def listed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.keep_keys(table(spark, sf_dir, "documents"), spark.createDataFrame([("src1",), ("src3",)], "source string"), "source").select("doc_id")


@query("O6_fixed_shuffle", "SELECT doc_id, (row_number() OVER (ORDER BY md5('0:' || doc_id), doc_id) - 1)::BIGINT AS place FROM documents")
def fixed_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.shuffled(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 0)


@query("O7_group_split", "SELECT doc_id, CASE WHEN r <= n * 20 // 100 THEN 'cv' ELSE 'train' END AS split FROM documents JOIN (SELECT source, row_number() OVER (ORDER BY md5('1:' || source), source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents)) USING (source)")
def group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A share of the groups, truncated, is held out with all their rows."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    groups = d.select("source").distinct()
    held = keyed.shuffled(groups, "source", 1).filter(F.col("place") < groups.count() * 20 // 100).select("source", F.lit("cv").alias("split"))
    return d.join(held, "source", "left").select("doc_id", F.coalesce("split", F.lit("train")).alias("split"))


@query("O8_stratified_split", "SELECT doc_id, lang, CASE WHEN r <= n * 8 // 10 THEN 'train' ELSE 'dev' END AS split FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5('2:' || doc_id), doc_id) AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents)")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In each stratum eight tenths, in a fixed shuffle, are for training."""
    d = keyed.within_group(table(spark, sf_dir, "documents").select("lang", "doc_id"), "lang", [keyed.hashed_order("doc_id", 2), "doc_id"], "r")
    return d.select("doc_id", "lang", F.when(F.col("r") < F.floor(F.col("_size") * 8 / 10), "train").otherwise("dev").alias("split"))


@query("O9_even_chunks", "SELECT doc_id, ntile(7) OVER (ORDER BY doc_id)::INTEGER AS split FROM documents")
def even_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.even_chunks(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 7)


@query("O11_round_robin", "SELECT doc_id, ((row_number() OVER (ORDER BY doc_id) - 1) % 6)::INTEGER AS split FROM documents")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 6)


@query("O12_array_split", "SELECT source, ntile(4) OVER (ORDER BY source)::INTEGER AS split FROM (SELECT DISTINCT source FROM documents)")
def array_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.even_chunks(table(spark, sf_dir, "documents").select("source").distinct(), "source", 4)


@query("O13_resample", "SELECT doc_id, unnest(range(1, CASE WHEN r <= n * 5 // 10 THEN 4 ELSE 3 END))::INTEGER AS copy FROM (SELECT doc_id, row_number() OVER (ORDER BY md5('3:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)")
def resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By a factor of 2.5: every row twice, and half of the rows, in a fixed shuffle, once more."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    times = F.lit(2) + (F.col("place") < d.count() * 5 // 10).cast("int")
    return keyed.shuffled(d, "doc_id", 3).select("doc_id", F.explode(F.sequence(F.lit(1), times)).alias("copy"))


@query("O14_rank_shard", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r FROM documents) WHERE r % 8 = 3")
def rank_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.round_robin(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 8).filter("split = 3").select("doc_id")


@query("O15_cohort", "SELECT vec_id, label FROM (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY md5('4:' || vec_id), vec_id) AS r FROM embeddings) WHERE r <= 5")
def cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five of each speaker in a fixed shuffle."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    w = Window.partitionBy("label").orderBy(keyed.hashed_order("vec_id", 4), "vec_id")  # each task keeps five of a label
    return e.withColumn("r", F.row_number().over(w)).filter("r <= 5").drop("r")


@query("O16_n_best", "SELECT month, v FROM (SELECT month(o_orderdate)::INTEGER AS month, sum(round_even(o_totalprice * 100, 0)::BIGINT)::BIGINT AS v FROM orders GROUP BY 1) ORDER BY v, month LIMIT 3")
def n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The epochs with the least values; ties go to the earlier."""
    v = table(spark, sf_dir, "orders").groupBy(F.month("o_orderdate").alias("month")).agg(F.sum(F.rint(F.col("o_totalprice") * 100).cast("bigint")).alias("v"))
    return v.orderBy("v", "month").limit(3)


@query("O17_duplicate_cap", """
SELECT doc_id FROM (SELECT doc_id, n, (sum(CASE WHEN n >= 3 THEN 1 ELSE 0 END) OVER (ORDER BY doc_id) * 103349) % 71147 AS draw FROM (SELECT doc_id, count(*) OVER (PARTITION BY text) AS n FROM documents))
WHERE n < 3 OR draw < 3 * 71147 / n""")
def duplicate_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed.duplicate_cap(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", "doc_id", 3).select("doc_id")
