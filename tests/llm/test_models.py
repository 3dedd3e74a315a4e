"""Near duplicates, decontamination, nearest neighbours, toxicity, the language model and the pipeline against brute
force."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import common, components, decontamination, language_model, near_dedup, nearest, queries, toxicity

DOCS = "doc_id long, text string, n long, kept string"
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words(text):
    return [w for w in SPACE.split(lower(text)) if w]


# --- hashing and ranks


def test_words_are_hashed_alike_wherever_they_stand(monkeypatch):
    texts = ["a B c", None, "", " \n", "c\tb  a", "é É x", "w" * 50 + " a " + "v" * 10]
    whole = [w[a:b].tolist() for _, _, w, bounds in common.word_hashes(texts) for a, b in zip(bounds[:-1], bounds[1:])]
    assert whole[0] == whole[4][::-1] and whole[1] == whole[2] == whole[3] == [] and whole[5][0] != whole[5][1] and whole[6][1] == whole[0][0]
    monkeypatch.setattr(common, "CHUNK", 16)
    common._tables.cache_clear()
    cut = [w[a:b].tolist() for _, _, w, bounds in common.word_hashes(texts) for a, b in zip(bounds[:-1], bounds[1:])]
    common._tables.cache_clear()
    assert cut == whole


def test_ranks_have_no_gaps(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 1).otherwise(F.col("id") % 7))
    got = defaultdict(list)
    for r in common.ranked(df, "k", ["id"], parts=5).collect():
        got[r.k].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values())


def test_filter_lets_every_id_pass(spark):
    df = spark.range(2000)
    kept = {r.id for r in common.filtered_to(df, df.filter("id % 50 = 0"), "id").collect()}
    assert set(range(0, 2000, 50)) <= kept and len(kept) < 100


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 150)] + [(200, 199), (5, 5)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(1, 61)) and all(got[i] == 100 for i in range(101, 150)) and got[200] == 199 and 0 not in got
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- near duplicates


def shingles(text):
    w = words(text)
    return frozenset() if not w else frozenset([tuple(w)]) if len(w) < 5 else frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def linked(texts):
    """(n_shingles, component) of each id by all pairs."""
    sets, up = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}

    def of(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * min(len(sets[a]), len(sets[b])) < 75 * max(len(sets[a]), len(sets[b])):
                continue
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and (x := of(a)) != (y := of(b)):
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), of(i)) for i in ids}


def edited(w, rnd, n):
    w = list(w)
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"x{rnd.randrange(10**6)}"
    return w


def test_sizes_that_can_be_similar_share_a_cell():
    band = lambda n: math.floor(math.log(n) / math.log(1.005 * 100 / near_dedup.PERCENT))
    for n in [*range(1, 3000), *(10**k + d for k in range(4, 9) for d in (-1, 0, 1))]:
        most = 100 * n // near_dedup.PERCENT
        assert band(most) - band(n) in (0, 1)


@pytest.mark.parametrize("banded", [1024, 2])
def test_near_duplicates_by_brute_force(spark, monkeypatch, banded):
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "BANDED", banded)
    monkeypatch.setattr(near_dedup, "PER_HUB", 4)
    rnd = random.Random(3)
    base = [[f"w{rnd.randrange(3000)}" for _ in range(rnd.randrange(60, 200))] for _ in range(8)]
    passage = [f"p{i}" for i in range(40)]
    texts = {}
    for i in range(160):
        w = edited(base[i % 8], rnd, rnd.randrange(0, 9)) if i % 3 else [f"w{rnd.randrange(3000)}" for _ in range(30)] + passage
        texts[1000 - i] = " ".join(w).upper() if i % 5 == 0 else "\n".join(w)
    texts |= {1: "a b c", 2: "A  b\tc", 3: "a b c d", 4: None, 5: "", 6: " \n ", 7: "É b", 8: "é b"}
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs(spark, *texts.items())).collect()}
    for i, (n, component) in linked(texts).items():
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (n, component, component == i)
    assert got[2].component_id == 1 and got[4].kept and got[6].kept and got[8].kept


def test_near_duplicates_on_the_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op3_minhash_near_dedup(spark, small).collect()}
    assert got == linked(texts)


def test_near_duplicates_of_odd_rows(spark):
    same = "one two three four five six seven"
    got = near_dedup.near_duplicates(docs(spark, (None, same), (3, same), (3, same), (9, same + " eight"))).collect()
    assert sorted((str(r.doc_id), r.component_id, r.kept) for r in got) == [("3", 3, True), ("3", 3, True), ("9", 3, False), ("None", 3, False)]
    lone = near_dedup.near_duplicates(docs(spark, (None, same))).collect()
    assert [(r.doc_id, r.component_id, r.kept) for r in lone] == [(None, None, True)]
    assert near_dedup.near_duplicates(docs(spark, (1, same)).limit(0)).count() == 0
    assert sorted(r.doc_id for r in near_dedup.deduplicated(docs(spark, (2, same), (1, same), (5, None))).collect()) == [1, 5]


def test_deduplication_is_by_row(spark):
    same, other, third = ("one two three four five six seven", "red green blue white black pink grey", "ant bee cat dog eel fox gnu")
    df = docs(spark, (None, same), (None, other), (3, same), (4, third), (4, third), (4, other), (9, None), (9, None))
    got = sorted((str(r.doc_id), r.text) for r in near_dedup.deduplicated(df).collect())
    assert got == [("3", same), ("4", third), ("4", other), ("9", None), ("9", None)]
    assert near_dedup.deduplicated(df).columns == df.columns


# --- decontamination


def test_edited_copies_are_found_and_others_left_alone(spark):
    rnd = random.Random(1)
    bench = [(i, " ".join(f"b{rnd.randrange(400)}" for _ in range(rnd.randrange(12, 50))) + ".") for i in range(40)]
    rows, want = [], set()
    for i in range(120):
        filler = [f"b{rnd.randrange(400)}" for _ in range(150)]
        if i % 3 == 0:
            k = rnd.randrange(40)
            w = bench[k][1].rstrip(".").split()
            w = [x if rnd.random() > 0.12 else f"e{rnd.randrange(99)}" for x in w]
            filler[70:70] = [x.upper() + "," for x in w] if i % 2 else w
            want.add((i, k))
        if "b1" in filler:
            want.add((i, 91))  # an item of one word
        rows.append((i, " ".join(filler)))
    df, items = docs(spark, *rows), spark.createDataFrame(bench + [(90, None), (91, "b1"), (92, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, items).collect()}
    assert got == want
    kept = decontamination.clean(df, items)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if i % 3} and kept.columns == df.columns


def test_copies_in_many_documents_are_found(spark):
    one, two = [f"a{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    copies = [x if i % 4 else f"e{i}" for i, x in enumerate(one)], two[:18], two[20:]  # edited, and two partial ones
    rows = [(i, " ".join([f"f{i}x{j}" for j in range(60)] + copies[(i >= 30) + (i >= 58)])) for i in range(60)]
    df, items = docs(spark, *rows, (99, "f g h")), spark.createDataFrame([(1, " ".join(one)), (2, " ".join(two))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(df, items).collect()}
    assert got == {(i, 1 + (i >= 30)) for i in range(60)}
    assert [r.doc_id for r in decontamination.clean(df, items).collect()] == [99]


def test_short_items_are_found_as_they_are(spark):
    df = docs(spark, (1, "x Alpha, beta y alpha beta"), (2, "alpha x beta"), (3, "beta"), (4, "gamma beta gamma"))
    items = spark.createDataFrame([(1, "alpha beta"), (2, "gamma"), (3, "ALPHA beta!"), (4, "a b c")], "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.score, r.end) for r in decontamination.contaminated(df, items).collect())
    assert got == [(1, 1, 1.0, 3), (1, 3, 1.0, 3), (4, 2, 1.0, 1)]
    assert decontamination.clean(df, items).count() == 4 and {r.doc_id for r in decontamination.clean(df, items, shortest=2).collect()} == {2, 3, 4}


def best_score(item, text):
    """The best local alignment of all of a text, cell by cell."""
    row, best = [0] * (len(text) + 1), 0
    for a in item:
        new = [0]
        for j, b in enumerate(text, 1):
            new.append(max(0, row[j - 1] + (2 if a == b else -1), row[j] - 1, new[-1] - 1))
        row, best = new, max(best, *new)
    return best


def test_contaminated_by_brute_force(spark):
    """Every document against every item: those that share three words in a row and reach the least score."""
    rnd = random.Random(4)
    bench = [[f"b{rnd.randrange(60)}" for _ in range(rnd.randrange(3, 30))] for _ in range(25)]
    texts = []
    for i in range(80):
        w = [f"b{rnd.randrange(60)}" for _ in range(rnd.randrange(0, 60))]
        k = bench[i % 25]
        texts.append(w[: len(w) // 2] + [x if rnd.random() > 0.25 else "zz" for x in k[: rnd.randrange(len(k) + 1)]] + w[len(w) // 2 :])
    df = docs(spark, *((i, " ".join(t)) for i, t in enumerate(texts)))
    items = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(bench)], "item_id long, text string")
    grams = lambda w: {tuple(w[i : i + 3]) for i in range(len(w) - 2)}
    want = {(i, k): best_score(b, t) / (2 * len(b)) for i, t in enumerate(texts) for k, b in enumerate(bench) if grams(b) & grams(t) and best_score(b, t) >= 0.4 * 2 * len(b)}
    got = {(r.doc_id, r.item_id): r.score for r in decontamination.contaminated(df, items).collect()}
    # A seed's window ends a third of the item beyond it, so an alignment that strays further may score a little less.
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) and all(got[x] <= want[x] + 1e-9 for x in got)
    assert np.mean([got[x] == pytest.approx(want[x]) for x in got]) > 0.95


def test_decontamination_of_very_long_texts(spark):
    item = " ".join(f"i{k}" for k in range(30))
    long = " ".join(f"w{k % 977}" for k in range(120_000))
    df = docs(spark, (1, long + " " + item), (2, item + " " + long), (3, long), (4, "v" * 400_000 + " " + item))
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    assert sorted((r.doc_id, r.score) for r in decontamination.contaminated(df, items).collect()) == [(1, 1.0), (2, 1.0), (4, 1.0)]
    clash = df.withColumn("item_id", F.lit("x")).withColumn("score", F.lit(1))
    assert [r.doc_id for r in decontamination.clean(clash, items).collect()] == [3] and decontamination.contaminated(clash, items).count() == 3


def test_alignment_by_brute_force():
    rnd = np.random.default_rng(0)
    for _ in range(60):
        a, b = rnd.integers(0, 6, rnd.integers(1, 12)).astype(np.uint64), rnd.integers(0, 6, rnd.integers(1, 20)).astype(np.uint64)
        h = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(1, len(a) + 1):
            for j in range(1, len(b) + 1):
                h[i, j] = max(0, h[i - 1, j - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
        assert decontamination.aligned(a, b)[0] == h.max()


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    df = docs(spark, (None, "x alpha beta gamma delta epsilon zeta y"), (1, None), (1, ""), (2, "alpha beta gamma delta epsilon zeta"), (2, "alpha beta gamma delta epsilon zeta"))
    got = decontamination.contaminated(df, items).collect()
    assert sorted((str(r.doc_id), r.score) for r in got) == [("2", 1.0), ("2", 1.0), ("None", 1.0)]
    assert decontamination.contaminated(df.limit(0), items).count() == 0 and decontamination.contaminated(df, items.limit(0)).count() == 0
    assert decontamination.clean(df, items).count() == 2


# --- nearest neighbours


def test_perturbations_come_in_order_and_are_valid():
    sets = nearest.perturbations(4, 40)
    assert sets[0] == [] and sets[1] == [0] and len(sets) == 40 and len({tuple(s) for s in sets}) == 40
    assert all(7 - r not in s for s in sets for r in s)


def exact(good, queries, k=10):
    """{query: [(score, id)]} by all pairs, within a length; good, queries: (id, vector)."""
    out = {}
    for q, v in queries:
        v = np.array(v, float)
        out.setdefault((q, tuple(v)), sorted((float(np.sqrt(((v - np.array(y, float)) ** 2).sum())), i) for i, y in good if i != q and len(y) == len(v))[:k])
    return out


def found(df):
    got = defaultdict(list)
    for r in nearest.digest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.score, r.vec_id, r["rank"]))
    return got


@pytest.mark.parametrize("clusters", [20, 0])
def test_neighbours_by_brute_force(spark, clusters, monkeypatch):
    """Clustered and isotropic vectors, with small cells and blocks."""
    monkeypatch.setattr(nearest, "CELL", 500)
    monkeypatch.setattr(nearest, "ROWS", 100)
    monkeypatch.setattr(nearest, "BLOCK", 3)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(max(1, clusters), 16))
    x = [(int(i), (centres[i % clusters] + 0.1 * rng.normal(size=16) if clusters else rng.normal(size=16)).tolist(), 1) for i in range(1500)]
    x += [(2000, None, 1), (2100, [0.0] * 16, 1), (2200, [float("nan")] * 16, 1), (2300, [None] * 16, 1), (None, [1.0] * 16, 1), (1, x[1][1], 1)]
    got = found(spark.createDataFrame(x, "vec_id long, embedding array<double>, rank int"))
    good = [(i, v) for i, v, _ in x if v and i not in (None, 2100, 2200, 2300)]
    want = exact(good, [(i, v) for i, v in good if i % 100 == 0])
    hits = 0
    assert set(got) == set(range(0, 1500, 100))
    for (q, _), true in want.items():
        assert [r for _, _, r in got[q]] == list(range(1, 11)) and [f[:2] for f in got[q]] == sorted(f[:2] for f in got[q])
        hits += len({i for _, i, _ in got[q]} & {i for _, i in true})
    assert hits >= 0.9 * 10 * len(want)


def test_neighbours_with_repeated_queries_and_several_lengths(spark):
    rng = np.random.default_rng(3)
    base = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows = [(500, [1.0, 2.0]), (600, [1.0, 2.5]), (700, [5.0, 5.0, 5.0]), *base, base[100], base[200], base[7], (100, [0.5] * 4)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got, want = found(df), exact(rows, [r for r in rows if r[0] % 100 == 0])
    for q in (0, 200, 500, 600):
        true = next(t for (i, _), t in want.items() if i == q)
        near = {(round(s, 9), i) for s, i in true}
        assert len({(round(s, 9), i) for s, i, _ in got[q]} & near) >= 0.9 * len(near) and [r for *_, r in got[q]] == list(range(1, len(true) + 1))
        assert [i for _, i, _ in got[q]].count(7) <= 2 and max(Counter(i for _, i, _ in got[q] if i not in (7, 100, 200)).values()) == 1
    # Two vectors under one id are two queries.
    near = {(round(s, 9), i) for (q, _), true in want.items() if q == 100 for s, i in true}
    assert len(got[100]) == 20 and len({(round(s, 9), i) for s, i, _ in got[100]} & near) >= 0.9 * len(near)
    assert 700 not in got  # alone with its length
    again = found(df.repartition(7))
    assert again == got


def test_a_hot_vector_is_found(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [1.0] * 8 if i % 3 else rng.normal(size=8).tolist()) for i in range(900)]
    got, want = found(spark.createDataFrame(rows, "vec_id long, embedding array<float>")), exact([(i, np.float32(v)) for i, v in rows], [(i, np.float32(v)) for i, v in rows if i % 100 == 0])
    for (q, _), true in want.items():
        if q % 3:
            assert [(i, r) for _, i, r in got[q]] == [(i, r) for r, (_, i) in enumerate(true, 1)]


def test_recall_on_the_table(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in rows.collect()]
    got, want = found(rows), exact(table, [t for t in table if t[0] % 100 == 0])
    assert np.mean([len({i for _, i, _ in got[q]} & {i for _, i in true}) / 10 for (q, _), true in want.items()]) >= 0.9 and len(got) == 20
    of = dict(table)
    assert all(abs(s - np.sqrt(((np.array(of[q], float) - np.array(of[i], float)) ** 2).sum())) < 1e-12 for q, f in got.items() for s, i, _ in f)


def test_few_candidates_and_no_queries(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [5.0, 5.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in nearest.digest(df).orderBy("rank").collect()] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert nearest.digest(df.filter("vec_id > 0")).count() == 0 and nearest.digest(df.limit(0)).count() == 0


# --- toxicity


def made_up(rnd, n):
    return [rnd.choice("abcdefgh") * rnd.randrange(1, 3) + rnd.choice(("ing", "the", "on", "re", "st")) + rnd.choice("aeiou") for _ in range(n)]


def labelled(n, seed=0):
    rnd = random.Random(seed)
    bad = ("vilegrub", "mudwretch", "sneerling", "gutworm")
    out = []
    for i in range(n):
        w, toxic = made_up(rnd, rnd.randrange(5, 200)), int(i % 4 == 0)
        if toxic:
            for _ in range(rnd.randrange(1, 4)):
                w.insert(rnd.randrange(len(w)), rnd.choice(bad))
        out.append((i, " ".join(w), toxic))
    return out


def test_held_out_texts_and_misspellings():
    rows = labelled(600)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]))
    new = labelled(300, seed=7)
    p = model.score([t for _, t, _ in new]) >= toxicity.REJECT
    y = np.array([y for _, _, y in new]) == 1
    assert (p & y).sum() >= 0.98 * y.sum() and (p & ~y).sum() <= 0.02 * (~y).sum()
    filler = " ".join(made_up(random.Random(1), 60))
    twisted = model.score([f"{filler} {w} {filler}" for w in ("vilegrubb", "mudwretcch", "sneerrling", "vilegrab")])
    clean = model.score([f"{filler} {w} {filler}" for w in ("table", "garden", "window", "paper")])
    assert twisted.min() > clean.max()


def test_scores_do_not_depend_on_how_a_text_is_cut(monkeypatch):
    rows = labelled(200)
    model = toxicity.fit([t for _, t, _ in rows], np.array([y for _, _, y in rows]), rounds=40)
    texts = [t for _, t, _ in rows[:40]] + ["", None, "a", "%%"]
    whole = model.score(texts)
    assert np.allclose(whole, [model.score([t])[0] for t in texts])
    monkeypatch.setattr(toxicity, "CHUNK", 64)
    assert np.allclose(whole, model.score(texts))


def test_toxicity_query(spark):
    rows = labelled(500) + [(1000, None, 0), (1001, "", 0), (None, "x", 1)]
    df = docs(spark, *[(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i is None or i < 450] + [(3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.digest(df, labels).collect()
    assert len(got) == 503 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    assert all(r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 3 == 1) for r in got)
    truth = {i: y for i, _, y in rows}
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    kept = toxicity.accepted(df, labels)
    assert kept.columns == df.columns and {1000, 1001} <= {r.doc_id for r in kept.collect()}
    assert toxicity.digest(df.limit(0), labels).count() == 0
    assert {r.predicted for r in toxicity.digest(df, labels.limit(0)).collect()} == {0}


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = labelled(400)
    df = docs(spark, *[(i, t) for i, t, _ in rows])
    as_is = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    turned = spark.createDataFrame([(i, 1, 1 - y if held(i) else y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    a, b = toxicity.trained(df, as_is), toxicity.trained(df, turned)
    assert np.array_equal(a.bucket, b.bucket) and a.a == b.a


def test_long_texts_are_learnt_from(spark):
    rows = [(i, t + " of the and in to" * (450 if y else 1), y) for i, t, y in labelled(400)]
    assert min(len(t) for _, t, y in rows if y) > toxicity.SAMPLE_CHARS
    df = docs(spark, *[(i, t) for i, t, _ in rows])
    got = toxicity.digest(df, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")).collect()
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == rows[r.doc_id][2] for r in held) >= 0.9 * len(held)


def test_pieces_come_from_all_over_a_text(spark):
    assert toxicity.even_cap([10, 20, 300, 400], 130) == 50 and toxicity.even_cap([10, 20], 130) == 20
    text = " ".join(f"w{i}" for i in range(9000))
    got = docs(spark, (1, text), (2, "a b")).select(toxicity.pieces("text", 5000)).collect()
    found = [int(w[1:]) for w in got[0][0].split()]
    assert got[1][0] == "a b" and len(got[0][0]) <= 5100 and set(found) <= set(range(9000))
    assert found == sorted(found) and max(np.diff([0, *found, 9000])) < 1200


def plain_scores(model, texts):
    """Each text's score word by word, with whole numbers, from the model's tables."""
    mask, odd = (1 << 64) - 1, int(toxicity._ODD)
    values, seeds = [int(v) for v in common.stream(256, 21)], [int(v) for v in common.stream(16, 22)]

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    known = dict(zip(model.known.tolist(), model.own.tolist()))
    letter = lambda c: c >= 128 or chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789"
    out = []
    for text in texts:
        b = [c if letter(c) else 32 for c in (text or "").encode().lower()]
        words = bytes(b).split()
        logits = []
        for w in words:
            padded, total, n = b" " + w + b" ", 0.0, 0
            for size in toxicity.GRAMS:
                for i in range(len(padded) - size + 1):
                    h = 0
                    for c in padded[i : i + size]:
                        h = (h * odd + values[c]) & mask
                    total, n = total + model.bucket[mixed((h + seeds[size]) & mask) >> (64 - toxicity.BUCKETS_LOG2)], n + 1
            h = sum(values[c] * pow(odd, k, 1 << 64) for k, c in enumerate(w)) & mask
            logits.append(total / max(1, n) + known.get(mixed((h + len(w)) & mask), 0.0))
        k = toxicity.WINDOW
        windows = [sum(logits[i : i + k]) / k for i in range(len(logits) - k + 1)] if len(logits) > k else [sum(logits) / len(logits)] if logits else []
        worst = model.bias + max(windows) if windows else model.empty
        out.append(1 / (1 + math.exp(-min(40, max(-40, model.a * worst + model.b)))))
    return out


def test_scores_are_those_of_a_plain_scorer(spark, small):
    df, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    model = toxicity.trained(df, labels)
    texts = {r.doc_id: r.text for r in df.collect()}
    got = {r.doc_id: r.score for r in queries.op9_toxicity(spark, small).collect()}
    some = sorted((i for i, t in texts.items() if len(t or "") < 3000))[:60]
    assert np.allclose([got[i] for i in some], plain_scores(model, [texts[i] for i in some]), atol=1e-9)
    odd = ["", None, "a", "A b!", "é" * 9, "x y z w", " \n "]
    assert np.allclose(model.score(odd), plain_scores(model, odd), atol=1e-9)


# --- language model


def brute(texts, train):
    """Base and model scores with dictionaries."""
    uni, bi = Counter(), Counter()
    tokens = {i: [*words(t), None] for i, t in texts.items()}
    for i in train:
        uni.update(tokens[i])
        bi.update(zip(["<s>", *tokens[i][:-1]], tokens[i]))
    n, v = sum(uni.values()), len(uni)
    context, kinds, follows = Counter(), defaultdict(Counter), Counter()
    for (u, w), c in bi.items():
        context[u] += c
        kinds[u][min(c, 3)] += 1
        follows[w] += 1
    spectrum = lambda cs: np.array([sum(c == k for c in cs) for k in (1, 2, 3, 4)])
    d2, d1 = language_model.discounts(spectrum(bi.values())), language_model.discounts(spectrum(follows.values()))
    left = sum(d1[min(c, 3) - 1] for c in follows.values()) / max(1, len(bi)) if follows else 1.0

    def p(u, w):
        alone = (follows[w] - d1[min(follows[w], 3) - 1] if follows[w] else 0) / max(1, len(bi)) + left / (v + 1)
        if not context[u]:
            return alone
        own = bi[u, w] - d2[min(bi[u, w], 3) - 1] if bi[u, w] else 0
        return own / context[u] + sum(d2[k - 1] * c for k, c in kinds[u].items()) / context[u] * alone

    out = {}
    for i, ts in tokens.items():
        base = sum(math.log10((uni[t] + 1) / (n + v + 1)) for t in ts)
        out[i] = (len(ts), sum(uni[t] > 0 for t in ts), n, base, sum(math.log10(p(u, t)) for u, t in zip(["<s>", *ts[:-1]], ts)))
    return out, p, list(uni), [u for u in context]


def check_model(texts, rows):
    train = [i for i in texts if zlib.crc32(str(i).encode()) % 7 != 2]
    want, p, vocabulary, contexts = brute(texts, train)
    for r in rows:
        n, known, total, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    for u in contexts[:3]:
        assert math.isclose(sum(p(u, w) for w in vocabulary) + p(u, "never seen"), 1, rel_tol=1e-9)


def test_model_by_brute_force(spark, monkeypatch):
    monkeypatch.setattr(language_model, "BUFFER", 300)
    monkeypatch.setattr(language_model, "HOT", 16)
    rnd = random.Random(4)
    names = [f"w{int(rnd.expovariate(0.05))}" for _ in range(4000)]
    texts = {i: " ".join(rnd.choice(names).upper() if i % 2 else rnd.choice(names) for _ in range(rnd.randrange(0, 60))) for i in range(150)}
    texts |= {900: None, 901: "", 902: "the " * 700}
    rows = language_model.digest(docs(spark, *texts.items())).collect()
    assert len(rows) == len(texts)
    check_model(texts, rows)


def test_model_on_the_table(spark, small):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    rows = queries.op10_lm_scoring(spark, small).collect()
    check_model(texts, rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_model_of_odd_rows(spark):
    got = language_model.digest(docs(spark, (None, "a b"), (4, "a b"), (4, "a b"))).collect()
    assert len(got) == 3 and all(r.train_tokens == 9 and not r.held_out for r in got) and len({r.score for r in got}) == 1
    assert language_model.digest(docs(spark, (1, "a")).limit(0)).count() == 0
    untrained = language_model.digest(docs(spark, (2, "a b"), (4, "a")).filter("doc_id = -1").unionByName(docs(spark, next((i, "a") for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)))).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in untrained] == [(2, 0, 0, 0.0)]


# --- pipeline


def test_pipeline_stage_by_stage(spark):
    small = "/root/testdata/sf0.01"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "minhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    table = spark.read.parquet(f"{small}/documents.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["toxicity"](spark, table, small).cache()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    gone = set(ids(table)) - set(ids(kept))
    assert kept.columns == table.columns and sum(labels.get(i, 1) == 0 for i in gone) <= 4
    distinct = stages["minhash_near_dedup"](spark, kept, small).cache()
    groups = linked({r.doc_id: r.text for r in kept.collect()})
    assert ids(distinct) == sorted({c for _, c in groups.values()}) and distinct.columns == table.columns
    clean = stages["benchmark_decontamination"](spark, distinct, small).cache()
    items = [" ".join(r.text.split()) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in distinct.collect() if any(t in " ".join((r.text or "").split()) for t in items)}
    assert holds and not holds & set(ids(clean)) and clean.count() >= distinct.count() - len(holds) - 1
    masked = stages["pii"](spark, clean, small).cache()
    assert ids(masked) == ids(clean) and masked.filter("text rlike '[a-z0-9]@[a-z0-9]+[.][a-z]'").count() == 0
    assert all(r.n_chars == len(r.text) for r in masked.filter("text IS NOT NULL").collect())
    packed = stages["best_fit_packing"](spark, masked, small)
    assert sorted({r.doc_id for r in packed.collect()}) == ids(masked)


def test_stages_take_odd_rows(spark, tmp_path):
    """Null ids and texts, repeated rows, clashing columns: every stage keeps the columns and what is clean."""
    words_ = [f"w{i}" for i in range(60)]
    text = lambda k: " ".join(words_[(k * 7 + i * i) % 60] for i in range(40))
    rows = [(None, text(1)), (None, text(2)), (5, text(3)), (5, text(3)), (5, text(4)), (6, None), (6, None), (7, ""), (8, text(5) + " mail a.b@c.de")]
    names = "_id long, _text string, _row long, item_id long, toxic int, score double, rank int, length long"
    df = spark.createDataFrame([(i, t, 1, 2, 3, 4, 5, 6.0, 7, 8) for i, t in rows], f"doc_id long, text string, {names}")
    spark.createDataFrame([(1, "one two three four five six")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(5, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    key = lambda d: sorted(((r.doc_id, r.text) for r in d.collect()), key=repr)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, df, str(tmp_path))
        assert after.columns == df.columns, name
        want = rows if name != "minhash_near_dedup" else rows[:3] + rows[4:]
        if name == "pii":
            assert [t for _, t in key(after) if t and "[EMAIL]" in t] and len(key(after)) == len(rows)
        else:
            assert key(after) == sorted(want, key=repr), name
        assert stage(spark, df.limit(0), str(tmp_path)).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in packed) == sorted(str(i) for i, _ in rows) and all(r.length >= 1 for r in packed)


def test_pipeline_leaves_no_scratch(spark, small):
    import os
    from urllib.parse import urlparse

    base = urlparse(common.shared_dir(spark)).path
    before = set(os.listdir(base))
    corpus_pipeline.run(spark, small).write.format("noop").mode("overwrite").save()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(base)) - before}
    assert left <= {"pipeline-pii"}  # what the last stage reads


def test_pipeline_of_an_empty_table(spark, small, tmp_path):
    import shutil

    for t in ("labels", "benchmark"):
        shutil.copy(f"{small}/{t}.parquet", tmp_path / f"{t}.parquet")
    spark.read.parquet(f"{small}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered_queries():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{i}" for i in range(1, 11)} and "pipeline" in names
