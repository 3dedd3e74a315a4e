"""Queries that SQL cannot state, over whole tables, against plain versions in Python."""

import math
import time
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import cleaners
from corpusloom.operators import metrics, sequential, signals
from corpusloom.plans import registry


def found(spark, small, name):
    return registry.queries()[name](spark, small).collect()


@pytest.fixture(scope="module")
def bench(spark, small):
    return {r.item_id: r.text for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()}


@pytest.fixture(scope="module")
def vectors(spark, small):
    return {r.vec_id: (np.array(r.embedding, float), r.label) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()}


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def split(text):
    return [w for w in text.replace("\n", " ").split(" ") if w]


def test_subword_tokenizers(spark, small, bench):
    import sentencepiece
    from tokenizers import Tokenizer

    piece = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    word, byte = (Tokenizer.from_file(public_tokenizers.path(p)) for p in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    for r in found(spark, small, "F5_subword_tokenizers"):
        t = bench[r.item_id]
        assert r.bpe == piece.encode(t, out_type=str) and r.hugging_face == word.encode(t, add_special_tokens=False).tokens and r.phn == t.split()
    for r in found(spark, small, "F6_sentence_pieces"):
        assert r.pieces == piece.encode(r.text, out_type=str) and r.back == piece.decode(r.pieces) and r.text == bench[r.item_id]
    for r in found(spark, small, "F9_word_pieces"):
        assert r.tokens == byte.encode(r.text, add_special_tokens=False).tokens
    wanted = {}
    for i, t in bench.items():
        hyp = " ".join(w for k, w in enumerate(t.replace("\n", " ").split(" "), 1) if k % 7)
        a, b = piece.encode(t, out_type=str), piece.encode(hyp, out_type=str)
        wanted[i] = (distance(a, b), len(a))
    got = {r.item_id: r for r in found(spark, small, "M3_token_error_rate")}
    assert {i: (r.errors, r.tokens) for i, r in got.items() if i is not None} == wanted
    whole = got[None]
    assert (whole.errors, whole.tokens) == tuple(map(sum, zip(*wanted.values()))) and whole.ter == round(whole.errors / whole.tokens * 100, 2) > 0


def test_cleaners(spark, small):
    assert cleaners.tacotron("(Hello-World);   &  jr. & dr.") == "HELLO WORLD, AND JUNIOR AND DOCTOR"
    assert cleaners.tacotron("Çafé: 1,204 & 17") == "CAFE, ONE THOUSAND TWO HUNDRED FOUR AND SEVENTEEN"
    assert cleaners.spoken(0) == "zero" and cleaners.spoken(1_000_021) == "one million twenty one" and cleaners.spoken(-5) == "minus five"
    assert cleaners.whisper_basic("A [x] b (c) D’é!") == "a b d é " and cleaners.whisper_en("Um, I can't; we're [x] ok") == "i can not we are ok"
    df = spark.createDataFrame([(" ab1Z ",), (None,), ("ﾊ１",), ("À",)], "t string")
    named = {n: [r[0] for r in df.select(cleaners.cleaned(F.col("t"), [n])).collect()] for n in cleaners.CLEANERS}
    assert named["korean_cleaner"] == ["에이비일지", None, "ﾊ１", "À"] and named["jaconv"][2] == "ハ1" and named["vietnamese"][3] == "à"
    assert [r[0] for r in df.select(cleaners.cleaned(F.col("t"), ["tacotron", "korean_cleaner"])).collect()][0] == "에이비오엔이지"
    with pytest.raises(ValueError, match="no cleaner"):
        cleaners.cleaned(F.col("t"), ["other"])
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert all(r.text == cleaners.whisper_basic(cleaners.tacotron(texts[r.doc_id])) for r in found(spark, small, "F11_named_cleaners"))


def test_tokens_by_name(spark):
    df = spark.createDataFrame([("a bc  a",), ("",)], "t string")
    of = lambda *a, **k: [r[0] for r in df.select(cleaners.tokens(F.col("t"), *a, **k)).collect()]
    assert of("word") == [["a", "bc", "a"], []] and of("char")[0] == ["a", "<space>", "b", "c", "<space>", "<space>", "a"]
    assert of("phn", lexicon={"a": ["AH"], "bc": ["B", "K"]}) == [["AH", "B", "K", "AH"], []] and of("phn", lexicon={"a": ["AH"]})[0] == ["AH", "<unk>", "AH"]
    for kind in ("bpe", "other"):
        with pytest.raises(ValueError):
            of(kind)


def test_letters_and_marks(spark, small, bench):
    for r in found(spark, small, "F8_jaso"):
        assert r.tokens == ["<space>" if c == " " else c for c in unicodedata.normalize("NFKD", r.text + " 한국")] and len(r.tokens) > len(r.text) + 3


def test_edit_counts(spark, small, bench):
    rows = found(spark, small, "F20_edit_counts")
    assert len(rows) == len(bench)
    for r in rows:
        ref = [w.lower() for w in split(bench[r.item_id])]
        hyp = [w + "s" if i % 5 == 0 else w for i, w in enumerate(w for k, w in enumerate(ref, 1) if k % 7)] + ["end"]
        assert r.substitutions + r.deletions + r.insertions == distance(ref, hyp) and r.hits + r.substitutions + r.deletions == len(ref) and r.hits + r.substitutions + r.insertions == len(hyp)
    assert sequential.aligned_counts(list("abc"), list("axcd")) == (2, 1, 0, 1) and sequential.aligned_counts([], list("ab")) == (0, 0, 0, 2)
    (r,) = found(spark, small, "R17_word_error_counts")
    errors = words = 0
    for t in bench.values():
        ref = split(t)
        hyp = ["other" if i % 5 == 4 else w for i, w in enumerate(w for k, w in enumerate(ref, 1) if k % 7)]
        errors, words = errors + distance([w.lower() for w in ref], [w.lower() for w in hyp]), words + len(ref)
    assert (r.errors, r.words, r.wer) == (errors, words, round(errors / words * 100, 2))


def test_letter_errors_of_pairs_of_any_length(spark):
    from corpusloom.functions import text as T

    random = np.random.default_rng(8)
    texts = ["".join(random.choice(list("abcé😀"), n)) for n in (0, 1, 2, 31, 64, 65, 200, 300, 700)]
    texts += [t[::2] for t in texts] + [t[1:] + "b" for t in texts]
    pairs = [(a, b) for a in texts for b in texts]
    want = [distance(a, b) for a, b in pairs if len(a) * len(b) < 30_000]
    assert [T.edit_distance(a, b) for a, b in pairs if len(a) * len(b) < 30_000] == want
    df = spark.createDataFrame([*pairs, (None, "a"), ("a", None)], "r string, h string").select(T.letter_errors(F.col("r"), F.col("h")), F.levenshtein("r", "h"))
    assert all(a == b for a, b in df.collect())
    began = time.time()
    a, b = ("".join(random.choice(list("abcdefgh"), n)) for n in (60_000, 50_000))
    assert 10_000 < T.edit_distance(a, b) < 60_000 and time.time() - began < 15  # 3e9 pairs of letters


def test_texts_in_order_need_no_table(spark, small):
    import pandas as pd

    from corpusloom.functions import text as T

    quick = T._quick_errors(pd.Series(["abcd", "bd", "ab", None]), pd.Series(["bd", "abcd", "xy", "a"]))
    assert quick[:2].tolist() == [2, 2] and quick[2:].isna().all()  # the others are left to the built-in distance
    assert "_quick_errors" in registry.queries()["R14_macro_by_group"](spark, small)._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_very_long_pairs(spark):
    n = 60_000  # over what two bytes could name, with one word lost
    df = spark.createDataFrame([([f"w{i}" for i in range(n)], [f"w{i}" for i in range(n) if i != n - 2], 1)], "r array<string>, h array<string>, k int")
    from corpusloom.functions import text as T

    said = df.select(F.pandas_udf(T._letters, "ref string, hyp string")("r", "h").alias("s")).select("s.*").first()
    assert len(set(said.ref)) == n == len(said.ref) and len(said.hyp) == n - 1 and set(said.hyp) < set(said.ref)
    near = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), ([], ["x"]), (None, ["x"])], "r array<string>, h array<string>")
    assert [r[0] for r in near.select(T.word_errors(F.col("r"), F.col("h"))).collect()] == [1, 1, None]


def test_warped_scores(spark, small, vectors):
    def plain(v):
        frames = v.reshape(8, 8)
        ref = [[200 + f[0] * 400 if f[0] > -0.05 else 0.0, *f[1:]] for f in frames]
        hyp = [[210 + f[0] * 390 if f[0] > -0.04 else 0.0, *(f[1:] * 0.9)] for f in (*frames[:4], *frames[3:])]
        cost = lambda a, b: math.sqrt(sum((x - y) ** 2 for x, y in zip(a[1:], b[1:])))
        best = {}
        for i, a in enumerate(ref):
            for j, b in enumerate(hyp):
                before = [best[p] for p in ((i - 1, j - 1), (i - 1, j), (i, j - 1)) if p in best]
                d, path = min(before, key=lambda x: x[0]) if before else (0.0, [])
                best[i, j] = (d + cost(a, b), [*path, (i, j)])
        path = best[len(ref) - 1, len(hyp) - 1][1]
        pairs = [(ref[i], hyp[j]) for i, j in path]
        voiced = [(a[0], b[0]) for a, b in pairs if a[0] > 0 and b[0] > 0]
        f0 = math.sqrt(sum((math.log(a) - math.log(b)) ** 2 for a, b in voiced) / len(voiced)) if voiced else None
        mcd = sum(10 / math.log(10) * math.sqrt(2) * cost(a, b) for a, b in pairs) / len(pairs)
        note = lambda x: round(69 + 12 * math.log2(x / 440))
        return f0, mcd, sum((a[0] > 0) != (b[0] > 0) for a, b in pairs) / len(pairs), sum(note(a) == note(b) for a, b in voiced) / len(voiced) if voiced else None

    rows = found(spark, small, "M14_warped_distance")
    assert len(rows) == len(vectors)
    for r in rows:
        assert (r.f0_rmse, r.mcd, r.vuv, r.semitones) == pytest.approx(plain(vectors[r.vec_id][0]), abs=1e-9)


def test_calibrated_scores(spark, small):
    rows = found(spark, small, "M17_score_calibration")
    from corpusloom.plans.aggregate_queries import scores

    of = {r.event_id: (r.score / 10000.0, r.event_id % 40 / 40.0, r.label) for r in scores(spark, small).collect()}
    x = np.array([[a, b, 1.0] for a, b, _ in of.values()])
    y = np.array([c for *_, c in of.values()], float)
    w, penalty = np.zeros(3), np.diag([0.01, 0.01, 0.0]) * len(y)
    for _ in range(60):  # Newton's method
        p = 1 / (1 + np.exp(-x @ w))
        w -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (p - y) + penalty @ w)
    want = dict(zip(of, 1 / (1 + np.exp(-x @ w))))
    assert len(rows) == len(want) and all(r.calibrated == pytest.approx(want[r.event_id], abs=1e-4) for r in rows)
    assert max(want.values()) - min(want.values()) > 0.01


def test_log_mel_masks_and_warps(spark, small, vectors):
    hz = np.linspace(0, 8000, 9)
    mel = lambda f: 2595 * math.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(8000) * k / 5 / 2595) - 1) for k in range(6)]
    bands = np.array([[max(0.0, min((f - a) / (b - a), (c - f) / (c - b))) * 2 / (c - a) for a, b, c in zip(edges, edges[1:], edges[2:])] for f in hz])
    for r in found(spark, small, "N6_log_mel"):
        x = vectors[r.vec_id][0]
        frames = [abs(np.fft.fft(x[i * 8 : i * 8 + 16] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(16) / 16))))[:9] for i in range(7)]
        want = np.array([[math.log(max(1e-10, sum(f[k] ** 2 * bands[k][b] for k in range(9)))) for b in range(4)] for f in frames])
        assert np.allclose(r.mel, want)
        masked = want.copy()
        masked[:, 1:3] = 0
        assert np.allclose(r.masked, masked) and len(r.warped) == 7
        assert np.allclose(r.warped[:1], want[:1]) and np.allclose(r.warped[-1], want[5] + (2.5 * 4 / 3 - 0.5 - 2) * (want[6] - want[5]))
        assert np.allclose(r.warped[1], want[0] + ((1.5 * 3 / 4 - 0.5) - 0) * (want[1] - want[0]))
    df = spark.createDataFrame([([[1.0, 2.0]],), ([],)], "m array<array<double>>")
    assert [r[0] for r in df.select(signals.time_warped(F.col("m"), 1, 1)).collect()] == [[[1.0, 2.0]], []]


def test_noise_and_rooms(spark, small, vectors):
    for r in found(spark, small, "N7_noise_and_rooms"):
        x = vectors[r.vec_id][0]
        want = np.zeros(64)
        for k in range(64):  # band by band
            share = min(k, 64 - k) / 64
            if 0.1 <= share <= 0.3:
                c = sum(x[n] * np.exp(-2j * np.pi * k * n / 64) for n in range(64))
                want += np.real(c * np.exp(2j * np.pi * k * np.arange(64) / 64)) / 64
        assert np.allclose(r.band, want)
        noise = np.array(r.noisy) - x
        assert np.allclose(noise / noise[np.abs(noise).argmax()], x[::-1] / x[::-1][np.abs(noise).argmax()]) and 10 * np.log10(np.mean(x**2) / np.mean(noise**2)) == pytest.approx(10)
        room = np.array([x[n] + 0.5 * (x[n - 2] if n > 1 else 0) + 0.25 * (x[n - 3] if n > 2 else 0) for n in range(64)])
        assert np.allclose(r.room, room * np.sqrt(np.mean(x**2) / np.mean(room**2)))


def test_frechet_distance(spark, small, vectors):
    got = {r.sets: r.distance for r in found(spark, small, "N9_frechet_distance")}
    a, b = (np.array([v for v, label in vectors.values() if label % 2 == k]) for k in (0, 1))
    c, d = np.cov(a.T), np.cov(b.T)
    roots = np.sqrt(np.maximum(np.real(np.linalg.eigvals(c @ d)), 0)).sum()
    want = ((a.mean(0) - b.mean(0)) ** 2).sum() + np.trace(c) + np.trace(d) - 2 * roots
    assert got["other"] == pytest.approx(want, rel=1e-6) and abs(got["same"]) < 1e-6 < want


def test_clusters_and_axes(spark, small, vectors):
    rows = found(spark, small, "N10_trained_clusters")
    centres = {r.cluster: np.array(r.centre) for r in rows}
    assert len(rows) == len(vectors) and len(centres) == 5
    members = defaultdict(list)
    for r in rows:
        x = vectors[r.vec_id][0]
        d = {k: ((x - c) ** 2).sum() for k, c in centres.items()}
        assert d[r.cluster] <= min(d.values()) + 1e-9
        members[r.cluster].append(x)
    assert all(np.allclose(np.mean(m, 0), centres[k], atol=1e-3) for k, m in members.items())
    x = np.array([v for v, _ in vectors.values()])
    _, _, axes = np.linalg.svd(x - x.mean(0), full_matrices=False)
    got = {r.vec_id: r.axes for r in found(spark, small, "N10_principal_axes")}
    y = np.array([got[i] for i in vectors])
    assert np.allclose(np.abs(y), np.abs((x - x.mean(0)) @ axes[:3].T), atol=1e-6)


def test_balanced_split(spark, small):
    docs = Counter(r.source for r in spark.read.parquet(f"{small}/documents.parquet").collect())
    rows = found(spark, small, "O10_balanced_split")
    part = {r.source: r.part for r in rows}
    assert len(rows) == sum(docs.values()) and part == sequential.balanced_groups(sorted(docs.items()), 4) and sorted(part, key=lambda s: (part[s], s)) == sorted(docs)


def test_bleu_and_overlap(spark):
    df = spark.createDataFrame([(1, "a b c d e".split(), "a b c e".split()), (2, "x y".split(), "x y".split())], "id long, r array<string>, h array<string>")
    r = metrics.bleu(df, "r", "h", "id", 2).first()
    assert (r.p1, r.p2) == (1.0, 3 / 4) and r.brevity == pytest.approx(math.exp(1 - 7 / 6)) and r.bleu == pytest.approx(r.brevity * math.sqrt(0.75))
    texts = spark.createDataFrame([(1, "a b a b".split()), (2, "a b c".split()), (3, ["z"])], "id long, ws array<string>")
    own = {r.id: (r.arithmetic, r.geometric) for r in metrics.auto_bleu(texts, "id", "ws").collect()}
    assert own[1] == pytest.approx(((1 + 2 / 3) / 2, math.sqrt(2 / 3))) and own[2] == (0, 0) and own[3] == (0, 0)
    other = {r.id: (r.arithmetic, r.geometric) for r in metrics.self_bleu(texts, "id", "ws").collect()}
    assert other[1] == pytest.approx(((2 / 4 + 1 / 3) / 2, math.sqrt(2 / 4 * 1 / 3))) and other[2] == pytest.approx(((2 / 3 + 1 / 2) / 2, math.sqrt(1 / 3))) and other[3] == (0, 0)
