"""Evaluation metrics as aggregate queries."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import word_errors, words
from corpusloom.operators import ranks


def _or_dot(text: Column) -> Column:
    """Cleaned text; an empty one is a dot."""
    t = F.trim(F.lower(text))
    return F.when(t == "", ".").otherwise(t)


def word_error_counts(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Adds errors and ref_words of each pair."""
    r, h = words(_or_dot(F.col(ref))), words(_or_dot(F.col(hyp)))
    return df.withColumns({"errors": word_errors(r, h).cast("bigint"), "ref_words": F.size(r).cast("bigint")})


def word_error_rate(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """Errors over reference words, in per cent with two digits."""
    return word_error_counts(df, ref, hyp).agg(F.round(F.sum("errors") / F.sum("ref_words") * 100, 2).alias("wer"))


def char_error_counts(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    r, h = _or_dot(F.col(ref)), _or_dot(F.col(hyp))
    return df.withColumns({"errors": F.levenshtein(r, h).cast("bigint"), "ref_chars": F.length(r).cast("bigint")})


def detection_curve(df: DataFrame, score: str, label: str) -> DataFrame:
    """(score, at_p, at_n, tps, fps, p, n): at each distinct score, how many of either label have it, how many have at
    least it, and how many there are. Rows are added up by score before the running sums, which go slice by slice."""
    g = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("bigint")).alias("at_p"), F.sum(1 - F.col(label).cast("bigint")).alias("at_n"))
    whole = g.agg(F.sum("at_p").alias("p"), F.sum("at_n").alias("n"))
    return ranks.running_all(g, [-F.col("score")], {"tps": F.col("at_p"), "fps": F.col("at_n")}).crossJoin(F.broadcast(whole))  # broadcast: one row


def equal_error_rate(df: DataFrame, score: str, label: str) -> DataFrame:
    """Where misses and false alarms are nearest on the curve without its collinear points, the larger of both in per
    cent. A point bends the curve if the next one adds other numbers of either label; the last one stays too."""
    c = ranks.numbered(detection_curve(df, score, label), [-F.col("score")], "place")
    after = c.select((F.col("place") - 1).alias("place"), F.col("at_p").alias("next_p"), F.col("at_n").alias("next_n"))
    kept = c.join(after, "place", "left").filter(F.col("next_p").isNull() | (F.col("next_p") != F.col("at_p")) | (F.col("next_n") != F.col("at_n")))
    start = c.agg(F.max("p").alias("p"), F.max("n").alias("n")).select(F.lit(0).cast("bigint").alias("tps"), F.lit(0).cast("bigint").alias("fps"), "p", "n")
    rates = kept.select("tps", "fps", "p", "n").unionByName(start).select((1 - F.col("tps") / F.col("p")).alias("fnr"), (F.col("fps") / F.col("n")).alias("fpr"))
    best = F.min_by(F.greatest("fnr", "fpr"), F.struct(F.abs(F.col("fnr") - F.col("fpr")).alias("gap"), "fpr"))
    return rates.agg((best * 100).alias("eer"))


def min_cost(df: DataFrame, score: str, label: str, prior: float = 0.05, miss: float = 1.0, alarm: float = 1.0) -> DataFrame:
    """The least detection cost over all thresholds, over that of deciding without looking."""
    c = detection_curve(df, score, label)
    rates = c.select((1 - F.col("tps") / F.col("p")).alias("fnr"), (F.col("fps") / F.col("n")).alias("fpr"))
    cost = F.col("fnr") * miss * prior + F.col("fpr") * alarm * (1 - prior)
    return rates.agg((F.least(F.min(cost), F.lit(miss * prior)) / min(miss * prior, alarm * (1 - prior))).alias("min_dcf"))


def average_precision(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """Of each class: the mean over its positives of the precision at their score."""
    g = df.groupBy(by, score).agg(F.sum(label).alias("_p"), F.count("*").alias("_n"))
    w = Window.partitionBy(by).orderBy(F.desc(score))
    c = g.withColumns({"tps": F.sum("_p").over(w), "seen": F.sum("_n").over(w)})
    return c.groupBy(by).agg((F.sum(F.col("_p") * F.col("tps") / F.col("seen")) / F.sum("_p")).alias("ap"))


def area_under_curve(df: DataFrame, score: str, label: str, by: str) -> DataFrame:
    """Of each class: the chance that a positive scores above a negative, ties by half."""
    g = df.groupBy(by, score).agg(F.sum(label).alias("_p"), F.sum(1 - F.col(label)).alias("_q"))
    w = Window.partitionBy(by).orderBy(score)
    c = g.withColumn("below", F.sum("_q").over(w) - F.col("_q"))
    return c.groupBy(by).agg((F.sum(F.col("_p") * (F.col("below") + F.col("_q") / 2)) / (F.sum("_p") * F.sum("_q"))).alias("auc"))


def macro_f1(df: DataFrame, target: str, predicted: str) -> DataFrame:
    """Mean F1 over the classes that either side has."""
    n = df.groupBy(F.col(target).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    sides = n.select("n", F.explode(F.array(F.struct(F.col("t").alias("k"), F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0).alias("tp")), F.struct(F.col("p").alias("k"), F.lit(0).cast("bigint").alias("tp")))).alias("x")).select("n", "x.*")
    f1 = sides.groupBy("k").agg((2 * F.sum("tp") / F.sum("n")).alias("f1"))
    return f1.agg(F.avg("f1").alias("macro_f1"))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))


def unit(a: Column) -> Column:
    """An array of length 1."""
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))
    return F.transform(a, lambda x: x / norm)


def near_distances(rows: np.ndarray, others: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """For each row the distances to its k nearest of the others, and to some more where these are hardly farther. A
    product of matrices finds which they may be, with room for its rounding; distances are those of the differences."""
    a, b = (rows**2).sum(1)[:, None], (others**2).sum(1)
    squares = a + b - 2 * rows @ others.T
    far = np.zeros(squares.shape, bool)
    if len(b) > k:
        room = 1e-13 * rows.shape[1] * (a + b.max())
        far = squares > np.partition(squares, k - 1, axis=1)[:, k - 1 : k] + 2 * room  # never, where something is no number
    for row, out in zip(rows, far):
        yield np.sqrt(((others[~out] - row) ** 2).sum(1))


def macro_error_rate(df: DataFrame, group: str, errors: str, n: str, worst: int = 15) -> DataFrame:
    """(macro, std, worst): error rates averaged over a group's rows, then over groups, the groups' sample deviation, and
    the sum of the `worst` groups over that number, however many there are. Rows with n = 0 do not count."""
    u = df.filter(F.col(n) > 0).groupBy(group).agg(F.avg(F.col(errors) / F.col(n)).alias("m"))
    top = u.orderBy(F.desc("m")).limit(worst).agg((F.sum("m") / worst).alias("worst"))
    return u.agg(F.avg("m").alias("macro"), F.stddev_samp("m").alias("std")).crossJoin(top)


def ngrams(df: DataFrame, key: str, words_: str, most: int) -> DataFrame:
    """(key, k, pos, gram): the 1- to most-grams of word arrays, with places from 0."""
    def of(k: int) -> Column:
        starts = F.when(F.size(words_) >= k, F.sequence(F.lit(0), F.size(words_) - k)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.lit(k).alias("k"), i.alias("pos"), F.array_join(F.slice(words_, i + 1, F.lit(k)), " ").alias("gram")))

    each = [of(k) for k in range(1, most + 1)]
    return df.select(key, F.explode(F.concat(*each)).alias("g")).select(key, "g.*")


def _means(rates: DataFrame, key: str, most: int) -> DataFrame:
    """Arithmetic and geometric mean of the rates p of k = 1 to most; one that is not there counts as 0."""
    logs = F.when((F.count("p") == most) & (F.min("p") > 0), F.exp(F.sum(F.log("p")) / most)).otherwise(0.0)
    return rates.groupBy(key).agg((F.sum("p") / most).alias("arithmetic"), logs.alias("geometric"))


def self_bleu(df: DataFrame, key: str, words_: str, most: int = 2) -> DataFrame:
    """(key, arithmetic, geometric): how many of a text's n-grams another text has, each counted as often as the text has
    it that has it most. Only the two largest counts of an n-gram are kept, so a common one is not gathered."""
    c = ngrams(df, key, words_, most).groupBy(key, "k", "gram").agg(F.count("*").alias("n"))
    first = c.groupBy("k", "gram").agg(F.max(F.struct("n", key)).alias("top"))
    second = c.join(first, ["k", "gram"]).filter(F.col(key) != F.col(f"top.{key}")).groupBy("k", "gram").agg(F.max("n").alias("next"))
    j = c.join(first, ["k", "gram"]).join(second, ["k", "gram"], "left")
    other = F.when(F.col(key) == F.col(f"top.{key}"), F.coalesce("next", F.lit(0))).otherwise(F.col("top.n"))
    return _means(j.groupBy(key, "k").agg((F.sum(F.least("n", other)) / F.sum("n")).alias("p")), key, most)


def auto_bleu(df: DataFrame, key: str, words_: str, most: int = 2) -> DataFrame:
    """(key, arithmetic, geometric): the share of a text's n-grams that come again in it without overlap."""
    g = ngrams(df, key, words_, most)
    ends = g.groupBy(key, "k", "gram").agg(F.min("pos").alias("a"), F.max("pos").alias("b"))
    again = (F.col("pos") - F.col("a") >= F.col("k")) | (F.col("b") - F.col("pos") >= F.col("k"))
    return _means(g.join(ends, [key, "k", "gram"]).groupBy(key, "k").agg(F.avg(again.cast("int")).alias("p")), key, most)


def bleu(df: DataFrame, ref: str, hyp: str, key: str, most: int = 4) -> DataFrame:
    """(bleu, p1..p_most, brevity) of a corpus of word arrays with one reference each: clipped n-gram matches over all
    rows, their geometric mean, and the brevity penalty."""
    h = ngrams(df, key, hyp, most).groupBy(key, "k", "gram").agg(F.count("*").alias("nh"))
    r = ngrams(df, key, ref, most).groupBy(key, "k", "gram").agg(F.count("*").alias("nr"))
    m = h.join(r, [key, "k", "gram"], "left").agg(*[F.sum(F.when(F.col("k") == k, F.least("nh", F.coalesce("nr", F.lit(0)))).otherwise(0)).alias(f"m{k}") for k in range(1, most + 1)], *[F.sum(F.when(F.col("k") == k, F.col("nh")).otherwise(0)).alias(f"n{k}") for k in range(1, most + 1)])
    sizes = df.agg(F.sum(F.size(ref)).alias("rw"), F.sum(F.size(hyp)).alias("hw"))
    p = {k: F.when(F.col(f"n{k}") > 0, F.col(f"m{k}") / F.col(f"n{k}")).otherwise(0.0) for k in range(1, most + 1)}
    brevity = F.least(F.lit(1.0), F.exp(1 - F.col("rw") / F.col("hw")))
    mean = F.when(F.least(*p.values()) > 0, F.exp(sum((F.log(x) for x in p.values()), F.lit(0.0)) / most)).otherwise(0.0)
    return m.crossJoin(sizes).select((brevity * mean).alias("bleu"), *[x.alias(f"p{k}") for k, x in p.items()], brevity.alias("brevity"))


def logistic_scores(df: DataFrame, label: str, features: list[str], regularisation: float = 0.01, rounds: int = 100) -> DataFrame:
    """df with calibrated: the probability of label 1 by a logistic regression on the features."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = df.withColumns({"_label": F.col(label).cast("double"), "_features": array_to_vector(F.array(*[F.col(f).cast("double") for f in features]))})
    model = LogisticRegression(featuresCol="_features", labelCol="_label", probabilityCol="_p", maxIter=rounds, regParam=regularisation, tol=1e-10, standardization=False).fit(x)
    return model.transform(x).withColumn("calibrated", vector_to_array("_p")[1]).drop("_label", "_features", "_p", "rawPrediction", "prediction")


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def signal_ratio(source: Column, estimate: Column) -> Column:
    """Signal to noise in decibels after the best scaling of the source."""
    power = _dot(source, source)
    a = _dot(source, estimate) / power
    rest = F.transform(F.arrays_zip(source.alias("s"), estimate.alias("e")), lambda p: p["e"] - a * p["s"])
    return 10 * F.log10(a * a * power / _dot(rest, rest))
