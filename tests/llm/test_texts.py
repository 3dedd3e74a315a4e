"""Chat formatting, personal data, HTML extraction, sharding and packing against plain versions."""

import hashlib
import html
import re
import time
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusloom.llm import chat, packing, pii, queries, sharding, template, wrappers

DOCS = "doc_id long, text string, rank int, slot string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS)


# --- templates and chat


def out(source, **env):
    parts = []
    template.compiled(source)(env, lambda t, m: parts.append((t, m)))
    return "".join(t for t, _ in parts), "".join(t for t, m in parts if m)


def test_template_language():
    assert out("{% for m in ms %}{{ loop.index }}{{ m.a|upper }}{% if not loop.last %}, {% endif %}{% endfor %}", ms=[{"a": "x"}, {"a": "y"}])[0] == "1X, 2Y"
    assert out("{% if a == 1 %}one{% elif a > 1 and b %}more{% else %}none{% endif %}", a=2, b=True)[0] == "more"
    assert out("a  {{- ' b ' -}}  c{# note #}{% set x = 1 + 2 %}{{ x ~ 'y' }}")[0] == "a b c3y"
    assert out("{% generation %}{{ t }}{% endgeneration %}!", t="hi") == ("hi!", "hi")
    assert out("{{ x.__class__ }}{{ x['y'] if x else 'no' }}", x={"y": 5})[0] == "5"


def test_constants_are_folded():
    tree = template.fold_body(template.parse("{{ 'a' ~ 'b' }}{% if 1 > 2 %}x{% else %}c{% endif %}{{ n + 1 + 1 }}"), template.FILTERS)
    assert tree[0] == template.Text("abc") and len(tree) == 2


@pytest.mark.parametrize("bad", ["{% for x in y %}", "{{ a + }}", "{% unknown %}", "{{ 'a'|nothing }}", "{{ open('x') }}"])
def test_bad_templates(bad):
    with pytest.raises(template.TemplateError):
        template.compiled(bad)


@given(st.text(alphabet="<|\\aim_startend>\n%", max_size=40), st.text(alphabet="<|\\\n%ab0A25", max_size=12))
@settings(max_examples=300, deadline=None)
def test_what_is_formatted_can_be_read(text, role):
    turns = [{"role": role, "text": text}, {"role": "assistant", "text": text}, {"role": "assistant", "text": None}]
    back = list(chat.parsed(chat.rendered(turns)))
    assert [(r, t) for r, t, _ in back] == [(role, text), ("assistant", text), ("assistant", "")]
    assert [m for _, _, ms in back for m in ms] == ([text] if role == "assistant" else []) + [text, ""]


def test_long_conversations_come_in_chunks(monkeypatch):
    monkeypatch.setattr(chat, "CHUNK_CHARS", 100)
    turns = [{"role": "assistant", "text": "y" * 30 + "<|im_end|>"} for _ in range(50)]
    chunks = list(chat.rendered(turns))
    assert len(chunks) > 10 and len(list(chat.parsed(chunks))) == 50


def test_conversations_with_nulls_and_ties(spark):
    rows = [(1, 0, "user", None, 7), (1, 0, "user", "b", 7), (1, None, None, "a", 7), (None, 1, "assistant", "é<|im_end|>", 7), (1, 0, "user", "b", 7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_turns int")
    got = {r.conv_id: r for r in chat.digest(df).collect()}
    assert set(got) == {-1, 1, None} and got[1].n_turns == 4
    assert got[1].turns_sha256 == hashlib.sha256("\na\nuser\n\nuser\nb\nuser\nb\n".encode()).hexdigest()
    assert got[None].loss_chars == 11 and got[None].loss_sha256 == hashlib.sha256("é<|im_end|>".encode()).hexdigest()
    assert {r.conv_id for r in chat.digest(df.limit(0)).collect()} == {-1}


def test_all_conversations(spark, small):
    want = {}
    for r in spark.read.parquet(f"{small}/conversations.parquet").orderBy("conv_id", "turn", "role", "text").collect():
        want.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    got = {r.conv_id: r for r in queries.op1_chat_formatting(spark, small).collect()}
    assert set(got) == {*want, -1}
    for k, turns in want.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[k].n_turns, got[k].loss_chars) == (len(turns), len(loss))
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


# --- personal data

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_spans(text):
    def ok(kind, x):
        digits = re.sub("[^0-9]", "", x)
        return {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in x.split(".")), "card": lambda: 14 <= len(digits) <= 19 and pii.luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()

    found = [(m.start(), i, kind, m.end()) for i, (kind, p) in enumerate(PLAIN.items()) for m in re.finditer(p, text) if ok(kind, m[0])]
    return [(k, s, e) for s, _, k, e in sorted(found)]


@given(st.text(alphabet="a@.-+ 0145 ()é%\n", max_size=60))
@settings(max_examples=500, deadline=None)
def test_base_spans_are_those_of_the_plain_patterns(text):
    assert [x[:3] for x in pii.find(text) if x[0] in pii.BASE] == plain_spans(text)


def test_checksums_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    assert pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83WEST12345698765432")
    assert [x[0] for x in pii.find("iban GB82 WEST 1234 5698 7654 32.")] == ["iban"]
    assert not pii.find("code 123-45-6789 here") and [x[0] for x in pii.find("ssn 123-45-6789 here")] == ["ssn"]


def test_long_runs_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "+1" * 100_000, "a@" * 100_000):
        pii.find(text)


def test_masked_text():
    text = "mail a.b@c.de or +1 (555) 010-9999."
    assert pii.redacted(text, pii.find(text)) == "mail [EMAIL] or [PHONE]."


def test_all_documents_for_personal_data(spark, small):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op5_pii(spark, small).collect():
        want = plain_spans(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PLAIN]


def test_keys_and_tokens():
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    assert [x[:3] for x in pii.find(f'a token = "{key}" b')] == [("secret", 11, 51)]
    assert pii.find(f"commit {key} of") == [] and pii.find("token: " + "a" * 40) == [] and pii.find("password " + "ab1" * 200) == []
    assert pii.redacted(f"key {key}!", pii.find(f"key {key}!")) == "key [SECRET]!"
    began = time.time()
    assert pii.find("token " + "ab1-" * 300_000) == [] and time.time() - began < 5
    many = " ".join(f"u{i}@m{i}.org 123-45-6789 ssn" for i in range(20_000))
    began = time.time()
    assert sum(k == "ssn" for k, *_ in pii.find(many)) == 20_000 and time.time() - began < 20


def test_personal_data_of_odd_rows(spark):
    got = pii.digest(docs(spark, (1, None), (1, ""), (None, "x@y.z"), (1, "x@y.z"))).collect()
    assert len(got) == 4 and sum(r.n_email for r in got) == 2
    masked = pii.redact(spark.createDataFrame([(1, "x@y.z", 5, "k"), (2, None, None, "k")], "doc_id long, text string, n_chars long, spans string")).orderBy("doc_id").collect()
    assert [(r.text, r.n_chars, r.spans) for r in masked] == [("[EMAIL]", 7, "k"), (None, None, "k")]


# --- pages


def main_text(*pages):
    whole = None
    for p in pages:
        own = wrappers.known(wrappers.blocks(p))
        whole = own if whole is None else wrappers.together(whole, own)
    said = wrappers._to_text(wrappers.labels(whole))
    return whole.wrapper, [wrappers.main_text(wrappers.blocks(p), said) for p in pages]


def test_article_without_its_surroundings():
    page = """<!doctype html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
    <header><h2>Site</h2></header><nav><ul><li><a href=x>Home</a></li><li>More</li></ul></nav><!-- <p>no</p> --><div class="ad">Buy</div>
    <div class="cookie-notice">We use</div><article><h1>Title &amp; more</h1><p><b>One</b>  two<br>three<p>&eacute;&#233; &amp;lt; a < b<ul><li>x<li>y</ul>
    <form><input><button>Go</button></form><aside>Side</aside><section class="comments"><p>Reader</p></section></article><footer>&copy;</footer>"""
    assert main_text(page)[1] == ["Title & more\nOne two three\néé &lt; a < b\nx\ny"]


def test_wrapper_of_pages_without_an_article():
    page = "<body><div class=menu><a>M</a></div><div class=c><h1>{}</h1>{}</div><div>All rights</div></body>"
    wrapper, texts = main_text(page.format("A", "<p>one</p><p>two</p>"), page.format("B", "<p>three</p>"), page.format("C", ""))
    assert texts == ["A\none\ntwo", "B\nthree", "C"]
    assert "(<p>TEXT</p>)+" in wrappers.expression(wrapper) and "text" in wrappers.expression(wrapper)


def test_what_one_page_alone_has_is_main_text():
    page = "<body><div class=c><h1>{}</h1>{}</div><div>All rights</div></body>"
    texts = main_text(page.format("A", "<p>one</p>"), page.format("B", "<p>two</p><blockquote>said</blockquote>"), page.format("C", "<p>six</p><h3>Part</h3>"))[1]
    assert texts == ["A\none", "B\ntwo\nsaid", "C\nsix\nPart"]


def neutral(n, body):
    """A page of plain containers whose class words say nothing: menu, notice, article, comments, footer."""
    menu = "".join(f"<li><a href=/{i}>m{n}{i}</a></li>" for i in range(5))
    return f"<html><body><div class=qa><ul>{menu}</ul></div><div class=qb>Special {n} offer</div><div class=qc><div class=qd>{body}<h4>Share this page</h4></div><div class=qe><p>me too {n}</p></div></div><div class=qf>of {n}</div></body></html>"


def test_neutral_names_and_what_recurs():
    words = lambda k, n: " ".join(f"w{k}{i}" for i in range(n))
    bodies = [f"<h1>T{k}</h1><p>{words(k, 60)}</p>" + "".join(f"<p>{words(k + j + 1, 9)}</p>" for j in range(k % 3)) for k in range(6)]
    pages = [neutral(n, b) for n, b in enumerate(bodies)]
    want = ["\n".join(x for x in re.split(r"</?(?:h1|p)>", b) if x) for b in bodies]
    assert main_text(*pages)[1] == want
    # Without what the host's other pages say, the same pages give other texts.
    assert all(main_text(p)[1] != [w] for p, w in zip(pages, want))
    empty = wrappers._to_text(wrappers.Labels([], 0, frozenset()))
    assert all(wrappers.main_text(wrappers.blocks(p), empty) != w for p, w in zip(pages, want))


def test_slots_tell_apart_what_one_path_has_twice():
    page = "<body><div class=c><p>Signed in</p><h1>{}</h1><p>{}</p><h2>{}</h2><p>{}</p></div></body>"
    texts = main_text(*(page.format(f"A{i}", f"one {i}", f"B{i}", f"two {i}") for i in range(3)))[1]
    assert texts == [f"A{i}\none {i}\nB{i}\ntwo {i}" for i in range(3)]


def test_a_further_turn_counts_for_what_varies():
    group = lambda x: ["r", [["t", 7, False, x, x, 1, 4, 0]], False]
    (_, inside, *_), = wrappers.merged([group(5), group(7)], [group(5)])
    assert inside == [["t", 7, False, 5, 7, 2, 12, 0]]


@pytest.mark.parametrize(
    "page",
    ["<a " * 300_000 + '"', "<div>a" * 170_000, "<dl><dd>" + "<div>" * 100_000 + "<dt>x" * 60_000, "".join(f"<div class=c{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}>t{i}" for i in range(50_000)), "<p class='" * 100_000, "</div>" * 160_000, "&" * 10**6, "<p>x<h2>y</h2>" * 70_000, '<a b="' * 170_000],
)
def test_hostile_pages_take_linear_time(page):
    began = time.time()
    main_text(page, "<article><p>x</p></article>", page[: len(page) // 2])
    assert time.time() - began < 15  # each is read four times, on a machine that may do other work


@pytest.mark.parametrize("page", [None, "", "plain", "<", "<div", "<p>a</div></p><b>b", "<!-- never closed <p>x", "<script>x", "<textarea>a", "<table><tr><td>1<td>2<tr><td>3", "</p></p>", "<p " + "a=" * 20])
def test_broken_pages_do_not_fail(page):
    main_text(page)


def test_all_pages(spark, small):
    pages = {r.page_id: r for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    got = queries.op2_html_extraction(spark, small).collect()
    assert len(got) == len(pages)
    for r in got:
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id].html, re.S)[1]
        blocks = [" ".join(html.unescape(re.sub("</?b>|<br>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_labels_too_large_to_broadcast(spark, small, monkeypatch):
    want = sorted(map(tuple, queries.op2_html_extraction(spark, small).collect()))
    monkeypatch.setattr(wrappers, "BROADCAST", 0)
    assert sorted(map(tuple, queries.op2_html_extraction(spark, small).collect())) == want


def test_texts_do_not_depend_on_how_long_the_wrapper_is(spark):
    name = lambda i: "".join(chr(97 + i // 26**k % 26) for k in range(3))
    page = "<body><div class=qa><p>Signed in</p><h1>{}</h1><p>{}</p>{}</div></body>"
    few = [page.format(f"A{i}", f"one {i}", "<h4>Share this</h4>" if i % 2 else "") for i in range(4)]
    long = page.format("A4", "one 4", "".join(f"<div class=z{name(i)}><p>part {i}</p></div>" for i in range(3100)))
    df = spark.createDataFrame([(i, "http://h/", x) for i, x in enumerate([*few, long])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in wrappers.extract(df).collect()}
    assert [got[i] for i in range(4)] == [f"A{i}\none {i}" for i in range(4)]


@pytest.mark.parametrize("bits", [1, 1 << 26])
def test_alignment_is_a_longest_one_of_any_size(bits, monkeypatch):
    import random

    def plain(x, y):
        like = lambda a, b: bool(a[1] & b[1]) if a[0] == b[0] == "r" else a == b
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if like(x[i], y[j]) else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(x) or j < len(y):
            both = i < len(x) and j < len(y) and like(x[i], y[j])
            alone = i < len(x) and (j == len(y) or best[i + 1][j] >= best[i][j + 1])
            yield (i if both or alone else None), (j if both or not alone else None)
            i, j = i + (both or alone), j + (both or not alone)

    monkeypatch.setattr(wrappers, "BITS", bits, raising=False)
    draw = random.Random(5)
    sign = lambda k: ("r", frozenset(draw.sample(range(k), draw.randrange(min(3, k))))) if draw.random() < 0.3 else (draw.choice("oct"), draw.randrange(k))
    for _ in range(400):
        k = draw.choice((1, 3, 20))
        x, y = ([sign(k) for _ in range(draw.randrange(25))] for _ in range(2))
        assert list(wrappers._aligned(x, y)) == list(plain(x, y))
    x = [("t", i) for i in range(1500)]
    assert sum(i is not None and j is not None for i, j in wrappers._aligned(x, [x[900], *x])) == 1500


def test_what_a_worker_holds_of_hosts_is_bounded(monkeypatch):
    hosts = [[f"<body><div class=h{h}><p>Signed in</p><h1>A{i}</h1>{'<p>x</p>' * i}</div></body>" for i in range(3)] for h in "abc"]
    want = [main_text(*pages)[1] for pages in hosts]
    monkeypatch.setattr(wrappers, "WORKER", 0)
    monkeypatch.setattr(wrappers, "_HOSTS", wrappers._Hosts())
    assert [main_text(*pages)[1] for pages in hosts] == want
    assert len(wrappers._HOSTS.held) == 1 and wrappers._HOSTS.size == sum(map(len, wrappers._HOSTS.held))


def test_pages_of_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "<article>a</article>", 1), (1, "x", None, 1), (None, "http://h/", "", 1)], "page_id long, url string, html string, host int")
    assert sorted((str(r.page_id), r.text) for r in wrappers.extract(df).collect()) == [("1", ""), ("1", "a"), ("None", "")]
    assert wrappers.extract(df.limit(0)).count() == 0


# --- shards


def test_jump_hashing_moves_rows_to_the_new_shard_only():
    import numpy as np

    keys = np.arange(20_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for n in (1, 2, 39, 40):
        a, b = sharding.jump(keys, n), sharding.jump(keys, n + 1)
        assert ((a == b) | (b == n)).all() and abs((b == n).mean() - 1 / (n + 1)) < 0.02 and a.max() < n


def plain_jump(key, shards):
    """The published loop, one key at a time."""
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_shards_of_the_table(spark, small):
    table = spark.read.parquet(f"{small}/documents.parquet")
    hashes = {r.doc_id: r.h & ((1 << 64) - 1) for r in table.select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    texts = {r.doc_id: (r.text or "").encode() for r in table.collect()}
    got = queries.op7_sharding(spark, small).collect()
    slots = {}
    for r in got:
        raw = texts[r.doc_id]
        assert (r.size, r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain_jump(hashes[r.doc_id], 40), plain_jump(hashes[r.doc_id], 41)) and r.grown_shard in (r.shard, 40)
        slots.setdefault(r.shard, []).append((r.doc_id, r.slot))
    assert len(got) == len(texts) and all([s for _, s in sorted(x)] == list(range(len(x))) for x in slots.values())


def test_shards_of_odd_rows(spark):
    df = docs(spark, (1, None), (1, "é"), (1, "é"), (None, "a"), (None, "b"), *((i, "t") for i in range(2, 400)))
    got = sharding.assign(df, 7).collect()
    assert len(got) == 403 and {r.law for r in got} == {"key"}
    for s in range(7):
        own = [r.slot for r in got if r.shard == s]
        assert sorted(own) == list(range(len(own)))
    one = [r for r in got if r.doc_id == 1]
    assert len({r.shard for r in one}) == 1 and sorted(r.size for r in one) == [16, 18, 18] and {r.text_crc32 for r in one} == {0, zlib.crc32("é".encode())}
    assert all(r.grown_shard in (r.shard, 7) for r in got)
    assert sharding.assign(df.limit(0), 7).count() == 0


def test_written_shards(spark, tmp_path):
    df = docs(spark, *((i, "t") for i in range(50)))
    sharding.write(df, str(tmp_path / "s"), 4)
    assert spark.read.parquet(str(tmp_path / "s")).count() == 50


# --- packing


def test_cuts():
    assert packing.cuts(1) == [(0, 1)] and packing.cuts(2048) == [(0, 2048)] and packing.cuts(5000) == [(0, 904), (904, 2048), (2952, 2048)]


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_plan_is_best_fit_decreasing(counts):
    from bisect import bisect_left, insort

    slots, held = packing.plan(counts, 50), {}
    for s in slots:
        for r in range(s.rank_from, s.rank_to):
            held.setdefault(s.first_sequence + r - s.rank_from, []).append((s.offset, s.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 50
    assert sum(len(p) for p in held.values()) == sum(counts.values())
    room, bins = [], 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            i = bisect_left(room, length)
            left = room.pop(i) if i < len(room) else 50
            bins += left == 50
            insort(room, left - length)
    assert len(held) == bins


@given(st.text(max_size=200))
@settings(max_examples=200, deadline=None)
def test_both_tokenizer_libraries_agree(text):
    import public_tokenizers

    assert packing.token_ids(text) == packing._slow(public_tokenizers.path("byte_bpe_50k.json")).encode(text, add_special_tokens=False).ids


def test_libraries_agree_over_the_border(monkeypatch):
    """Texts just below and above the length from which the slower library takes over."""
    monkeypatch.setattr(packing, "LONG", 4000)
    base = "Näive  text, 12 ſ!\n\tand\u00a0more… ééé 日本語 " * 140
    for n in (3990, 3999, 4000, 4001, 4010, 5000):
        text = base[:n]
        slow = packing._slow(packing_vocabulary()).encode(text, add_special_tokens=False).ids
        assert packing.token_ids(text) == slow == packing._fast(packing_vocabulary("tiktoken")).encode_ordinary(text)


def packing_vocabulary(kind="json"):
    import public_tokenizers

    return public_tokenizers.path(f"byte_bpe_50k.{kind}")


def test_packed_documents(spark, small):
    import numpy as np
    import public_tokenizers

    slow = packing._slow(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    got, total = {}, 0
    rows = queries.op8_best_fit_packing(spark, small).collect()
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    for i, t in texts.items():
        ids = np.array([*slow.encode(t, add_special_tokens=False).ids, 0], "<u4")
        total += len(ids)
        own = sorted(got[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == packing.cuts(len(ids))
        assert [r.ids_crc32 for r in own] == [zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in own]
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) <= -(-total // 2048) * 1.05 + 1


def test_packing_odd_rows(spark):
    got = packing.packed(docs(spark, (1, None), (1, ""), (None, "a"), (2, "<|endoftext|>"), (2, "word " * 60_000))).collect()
    assert sum(r.length == 1 for r in got) == 2 and max(r.length for r in got) == 2048
    assert packing.packed(docs(spark, (1, "a")).limit(0)).count() == 0
    assert got[0].asDict().keys() == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert spark.range(1).select(F.lit(1)).count() == 1


def test_chat_digests_match_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{small}/conversations.parquet'")
    ran = con.execute(queries.oracle_sql()["op1_chat_formatting"])
    names = [d[0] for d in ran.description]
    assert sorted(ran.fetchall()) == sorted(tuple(r[n] for n in names) for r in queries.op1_chat_formatting(spark, small).collect())
