"""Queries on text: vocabulary, tokens, quality predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import cleaners
from corpusloom.functions import text as T
from corpusloom.operators import ranks
from corpusloom.plans.registry import query
from corpusloom.session import table


@query(
    "A4_vocabulary",
    """
    SELECT word, count(*)::BIGINT AS n FROM (
      SELECT unnest(string_split_regex(trim(regexp_replace(lower(text), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')), ' ')) AS word
      FROM documents WHERE text IS NOT NULL)
    WHERE word <> '' GROUP BY word HAVING count(*) > 1
    """,
)
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word counts with cutoff 1."""
    words = table(spark, sf_dir, "documents").select(F.explode(F.split(F.lower("text"), r"[ \t\n\r\f\x0B]+")).alias("word"))
    return words.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")).filter("n > 1")


def _docs(spark: SparkSession, sf_dir: str, *cols: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", *cols)


@query("F1_characters", "SELECT item_id, length(text)::BIGINT AS n, length(text) - length(replace(text, ' ', '')) AS spaces FROM benchmark")
def characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "benchmark").select("item_id", T.chars(F.col("text")).alias("c"))
    return t.select("item_id", F.size("c").cast("bigint").alias("n"), F.size(F.filter("c", lambda x: x == "<space>")).cast("bigint").alias("spaces"))


@query("F2_characters_back", "SELECT item_id, text FROM benchmark")
def characters_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", T.chars_to_text(T.chars(F.col("text"))).alias("text"))


@query("F3_words", "SELECT doc_id, len(list_filter(string_split_regex(text, '[ \\n]+'), lambda w: w <> ''))::BIGINT AS n FROM documents")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").select("doc_id", F.size(T.words(F.col("text"))).cast("bigint").alias("n"))


@query("F4_words_back", "SELECT doc_id, trim(regexp_replace(text, '[ \\n]+', ' ', 'g')) AS text FROM documents")
def words_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").select("doc_id", F.array_join(T.words(F.col("text")), " ").alias("text"))


@query("F10_token_ids", """
WITH v AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS id FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS word, count(*) AS n FROM benchmark GROUP BY 1) WHERE n >= 3)
SELECT item_id, sum(coalesce(id, 0))::BIGINT AS total, count(*) FILTER (WHERE id IS NULL)::BIGINT AS unknown FROM (SELECT item_id, unnest(string_split_regex(text, '[ \\n]+')) AS word FROM benchmark) LEFT JOIN v USING (word) GROUP BY item_id""")
def token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to ids, unknown words to 0."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.explode(F.split("text", "[ \n]+")).alias("word"))
    v = w.groupBy("word").agg(F.count("*").alias("n")).filter("n >= 3")
    v = ranks.numbered(v, [-F.col("n"), "word"], "id").withColumn("id", F.col("id") + 1)
    j = w.join(v.select("word", "id"), "word", "left")
    return j.groupBy("item_id").agg(F.sum(F.coalesce("id", F.lit(0))).alias("total"), F.count_if(F.col("id").isNull()).alias("unknown"))


@query("F13_no_punctuation", """SELECT doc_id, trim(regexp_replace(replace(regexp_replace(replace(CASE WHEN doc_id % 7 = 0 THEN text || ' <space>, end' ELSE text END, '<space>', chr(57344)), '[!-&(-/:-@[-`{-~]|[^\\P{P}'']', '', 'g'), chr(57344), '<space>'), ' +', ' ', 'g')) AS text FROM documents""")
def no_punctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some documents have the mark that has to stay."""
    t = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" <space>, end"))).otherwise(F.col("text"))
    return _docs(spark, sf_dir, "text").select("doc_id", T.without_punctuation(t).alias("text"))


@query("F14_character_ngrams", "SELECT item_id, ceil(length(text) / 3)::BIGINT AS n, substr(text, 4, 3) AS second FROM benchmark")
def character_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "benchmark").select("item_id", T.ngrams(F.col("text"), 3).alias("g"))
    return g.select("item_id", F.size("g").cast("bigint").alias("n"), F.get("g", F.lit(1)).alias("second"))


@query("F15_without_digits", "SELECT doc_id, regexp_replace(text, '[0-9]', '', 'g') AS text FROM documents")
def without_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").select("doc_id", F.regexp_replace("text", "[0-9]", "").alias("text"))


@query("F17_time_tokens", "SELECT event_id, '<' || printf('%.2f', round_even(value / 0.02, 0) * 0.02) || '>' AS token FROM events WHERE value IS NOT NULL")
def time_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value IS NOT NULL").select("event_id", T.time_token(F.col("value")).alias("token"))


@query("F18_uniform_timings", """
WITH w AS (SELECT item_id, string_split_regex(text, '[ \\n]+') AS ws, 100000 AS total FROM benchmark)
SELECT item_id, i AS pos, (total // len(ws)) * (i - 1) AS start_ms, ws[i] AS word FROM w, LATERAL (SELECT unnest(range(1, len(ws) + 1)) AS i)""")
def uniform_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a line spread evenly over its time."""
    w = table(spark, sf_dir, "benchmark").select("item_id", F.split("text", "[ \n]+").alias("ws"))
    e = w.select("item_id", F.size("ws").alias("n"), F.posexplode("ws").alias("p", "word"))
    return e.select("item_id", (F.col("p") + 1).cast("bigint").alias("pos"), (F.floor(F.lit(100000) / F.col("n")) * F.col("p")).cast("bigint").alias("start_ms"), "word")


@query("F19_stm_lines", "SELECT conv_id || ' 1 ' || role || ' ' || turn || ' ' || (turn + 1) || ' ' || length(text) AS line FROM conversations")
def stm_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.concat_ws(" ", "conv_id", F.lit("1"), "role", "turn", F.col("turn") + 1, F.length("text")).alias("line"))


@query("F21_interleave", "SELECT item_id, array_to_string(list_transform(range(1, length(text) - 9), lambda i: substr(text, i, 1) || substr(text, 10 + i, 1)), '') AS mixed FROM benchmark")
def interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two token streams, one token of each in turn, as long as both last."""
    whole = F.split("text", "")
    n = F.greatest(F.length("text") - 10, F.lit(0))
    z = F.zip_with(F.slice(whole, F.lit(1), n), F.slice(whole, F.lit(11), n), lambda a, b: F.concat(a, b))
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(z, "").alias("mixed"))


@query("F22_text_index", "SELECT item_id, coalesce(sum(strlen(text) + 1) OVER (ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at FROM benchmark")
def text_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte at which each line of a text file would begin."""
    size = F.octet_length("text") + 1
    b = ranks.running(table(spark, sf_dir, "benchmark").select("item_id", "text"), ["item_id"], size, "at")
    return b.select("item_id", (F.col("at") - size).alias("at"))


@query("F23_language_codes", "SELECT doc_id, CASE lang WHEN 'en' THEN 'eng' WHEN 'de' THEN 'deu' WHEN 'fr' THEN 'fra' ELSE lang END AS code FROM documents")
def language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for x in ("en", "eng", "de", "deu", "fr", "fra")])
    return _docs(spark, sf_dir, "lang").select("doc_id", F.coalesce(F.try_element_at(codes, F.col("lang")), F.col("lang")).alias("code"))


@query("F24_disambiguation", """
WITH l AS (SELECT p_partkey, string_split(p_type || ' ' || (p_size % 3), ' ') AS seq FROM part), p AS (SELECT DISTINCT array_to_string(seq[1:i], ' ') AS pre FROM l, LATERAL (SELECT unnest(range(1, len(seq))) AS i))
SELECT p_partkey, array_to_string(seq, ' ') || CASE WHEN n > 1 OR pre IS NOT NULL THEN ' #' || r ELSE '' END AS tokens FROM (SELECT p_partkey, seq, count(*) OVER (PARTITION BY array_to_string(seq, ' ')) AS n, row_number() OVER (PARTITION BY array_to_string(seq, ' ') ORDER BY p_partkey) AS r FROM l) LEFT JOIN p ON pre = array_to_string(seq, ' ')""")
def disambiguation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """#k after token sequences that are shared or begin another."""
    from pyspark.sql import Window

    seq = F.split(F.concat_ws(" ", "p_type", F.col("p_size") % 3), " ")
    lex = table(spark, sf_dir, "part").select("p_partkey", seq.alias("seq"), F.array_join(seq, " ").alias("key"))
    pre = lex.filter(F.size("seq") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.size("seq") - 1), lambda i: F.array_join(F.slice("seq", F.lit(1), i), " "))).alias("key")).distinct().withColumn("is_prefix", F.lit(True))
    w = Window.partitionBy("key")
    n = lex.withColumns({"n": F.count("*").over(w), "r": F.row_number().over(w.orderBy("p_partkey"))}).join(pre, "key", "left")
    mark = F.when((F.col("n") > 1) | F.coalesce("is_prefix", F.lit(False)), F.concat(F.lit(" #"), "r")).otherwise("")
    return n.select("p_partkey", F.concat("key", mark).alias("tokens"))


@query("R1_character_repeats", "SELECT doc_id FROM documents WHERE regexp_matches(lower(CASE WHEN doc_id % 50 = 0 THEN text || 'zzzzZZZZzzzz' ELSE text END), '" + "|".join(c + "{11,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789 ") + "|[.]{11,}|[!]{11,}|[$]{11,}|[%]{11,}|[#]{11,}|[&]{11,}|[*]{11,}|[-]{11,}|[=]{11,}|[_]{11,}|[|]{11,}')")
def character_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text").withColumn("text", F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("zzzzZZZZzzzz"))).otherwise(F.col("text")))
    return d.filter(T.repeats_character(F.col("text"))).select("doc_id")


# Documents, some with a run of six or five short words, one character over half of the text, or nothing.
_DOUBTFUL_SQL = "SELECT doc_id, text || CASE doc_id % 50 WHEN 1 THEN ' uh, Uh uh uh. uh uh!' WHEN 2 THEN ' uh uh uh uh uh' ELSE '' END AS text FROM documents WHERE doc_id % 50 NOT IN (3, 4) UNION ALL SELECT doc_id, CASE doc_id % 50 WHEN 3 THEN 'aBaBaBaBaB AAA' ELSE ' ' || chr(10) END FROM documents WHERE doc_id % 50 IN (3, 4)"


def _doubtful(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id") % 50
    more = F.when(k == 1, " uh, Uh uh uh. uh uh!").when(k == 2, " uh uh uh uh uh").otherwise("")
    return _docs(spark, sf_dir, "text").withColumn("text", F.when(k == 3, "aBaBaBaBaB AAA").when(k == 4, " \n").otherwise(F.concat("text", more)))


_WORD_RUNS = r"""w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[\s,;.!?]+')) AS word, generate_subscripts(string_split_regex(lower(text), '[\s,;.!?]+'), 1) AS pos FROM d),
i AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM (SELECT *, CASE WHEN lag(word) OVER (PARTITION BY doc_id ORDER BY pos) = word THEN 0 ELSE 1 END AS new FROM w)),
words AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, island, count(*) AS n FROM i WHERE length(word) BETWEEN 1 AND 3 GROUP BY 1, 2) WHERE n > 5)"""
_ONE_CHARACTER = r"""c AS (SELECT doc_id, unnest(string_split(regexp_replace(lower(text), '\s+', '', 'g'), '')) AS ch FROM d), counted AS (SELECT doc_id, ch, count(*) AS n FROM c WHERE ch <> '' GROUP BY 1, 2),
ratio AS (SELECT doc_id FROM (SELECT doc_id, max(n) / sum(n) AS top FROM counted GROUP BY doc_id) WHERE top > 0.5 UNION SELECT doc_id FROM d WHERE regexp_matches(text, '^\s*$'))"""


@query("R2_word_repeats", f"WITH d AS ({_DOUBTFUL_SQL}), {_WORD_RUNS} SELECT doc_id FROM words")
def word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with more than five equal words of at most three characters in a row."""
    return _doubtful(spark, sf_dir).filter(T.repeats_word(F.col("text"))).select("doc_id")


@query("R3_repetition_ratio", f"WITH d AS ({_DOUBTFUL_SQL}), {_ONE_CHARACTER} SELECT doc_id FROM ratio")
def repetition_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of which one character is over a half, and blank ones."""
    return _doubtful(spark, sf_dir).filter(T.one_character_over(F.col("text"))).select("doc_id")


@query("R4_digit_runs", r"SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]{15,}') OR regexp_matches(regexp_replace(text, '[,|''.]', '', 'g'), '[0-9]{15,}')")
def digit_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "text").filter(T.has_digit_run(F.col("text"))).select("doc_id")


@query("R5_quality", rf"""
WITH d AS ({_DOUBTFUL_SQL}), {_WORD_RUNS}, {_ONE_CHARACTER},
r AS (SELECT doc_id, unnest(string_split(lower(text), '')) AS ch, generate_subscripts(string_split(lower(text), ''), 1) AS pos FROM d), j AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, ch ORDER BY pos) AS island FROM r WHERE ch <> chr(10)),
runs AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, ch, island FROM j GROUP BY 1, 2, 3 HAVING count(*) > 10))
SELECT doc_id, doc_id IN (FROM words) OR doc_id IN (FROM ratio) OR doc_id IN (FROM runs) OR regexp_matches(text, '[0-9]{{15,}}') OR regexp_matches(regexp_replace(text, '[,|''.]', '', 'g'), '[0-9]{{15,}}') AS bad FROM d""")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _doubtful(spark, sf_dir).select("doc_id", T.not_fit(F.col("text")).alias("bad"))


@query("R11_collapse_token", "SELECT item_id, regexp_replace(text, '(the )+', 'the ', 'g') AS text FROM benchmark")
def collapse_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "(the )+", "the ").alias("text"))


@query("R12_plain_spaces", "SELECT doc_id, length(text)::BIGINT AS n FROM documents")
def plain_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir, "text").withColumn("text", F.replace("text", F.lit("the "), F.lit("the\u2009")))
    return d.select("doc_id", F.length(T.plain_spaces(F.col("text"))).cast("bigint").alias("n"))


@query("R13_tag_normalisation", "SELECT doc_id, regexp_replace(regexp_replace(lower(text), '[.,!?]', '', 'g'), '[%$#&*]+', '<noise>', 'g') AS text FROM documents")
def tag_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.regexp_replace(F.regexp_replace(F.lower("text"), "[.,!?]", ""), "[%$#&*]+", "<noise>")
    return table(spark, sf_dir, "documents").select("doc_id", t.alias("text"))


@query("R26_id_characters", "SELECT event_id, chr((19968 + user_id)::INTEGER) AS c FROM events")
def id_characters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids as characters from the CJK block on, whatever the plane; null for numbers that are none (surrogates, and
    beyond U+10FFFF)."""
    c = T.character(F.col("user_id") + 0x4E00)
    return table(spark, sf_dir, "events").select("event_id", c.alias("c"))


@query("Z7_text_checks", "SELECT count(*) FILTER (WHERE contains(text, '  '))::BIGINT AS double_spaces, count(*) FILTER (WHERE text <> trim(text, ' '))::BIGINT AS untrimmed, count(*) FILTER (WHERE contains(text, chr(9)))::BIGINT AS tabs FROM documents")
def text_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return _docs(spark, sf_dir, "text").agg(F.count_if(F.contains(t, F.lit("  "))).alias("double_spaces"), F.count_if(t != F.trim(t)).alias("untrimmed"), F.count_if(F.contains(t, F.lit("\t"))).alias("tabs"))


@query("Z11_result_lines", "SELECT event_type, count(*)::BIGINT AS n, sum(nullif(regexp_extract(props, '\"k\": ([0-9]+)', 1), '')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def result_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers picked out of log lines by a pattern."""
    k = F.try_to_number(F.regexp_extract("props", r'"k": ([0-9]+)', 1), F.lit("999999999")).cast("bigint")
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query("G1_json_objects", "SELECT doc_id, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS json FROM documents")
def json_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "lang", "source").select("doc_id", F.to_json(F.struct("lang", "source")).alias("json"))


@query("G2_json_fields", "SELECT event_id, (json_extract(props, '$.k'))::BIGINT AS k FROM events")
def json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("G3_map_inversion", "SELECT lang, list_sort(list(DISTINCT source)) AS sources FROM documents GROUP BY lang")
def map_inversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir, "lang", "source").groupBy("lang").agg(F.array_sort(F.collect_set("source")).alias("sources"))


@query("F7_lexicon_phones", "SELECT item_id, array_to_string(list_transform(list_filter(string_split_regex(lower(text), '[ \\n]+'), lambda w: w <> ''), lambda w: CASE w WHEN 'the' THEN 'DH AH' WHEN 'of' THEN 'AH V' WHEN 'der' THEN 'D EH R' ELSE '<unk>' END), ' ') AS phones FROM benchmark")
def lexicon_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phones of words by a lexicon; words that it lacks are marked."""
    lexicon = {"the": ["DH", "AH"], "of": ["AH", "V"], "der": ["D", "EH", "R"]}
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(cleaners.tokens(F.lower("text"), "phn", lexicon=lexicon), " ").alias("phones"))


@query("F8_jaso")
def jaso(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters taken apart into letters and marks; tests hold them against the Unicode tables."""
    return table(spark, sf_dir, "benchmark").select("item_id", "text", cleaners.tokens(F.concat("text", F.lit(" 한국")), "jaso").alias("tokens"))
