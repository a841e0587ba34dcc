import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.llm import decontaminate as D
from lodestar.llm import html_mincut as H
from lodestar.llm import line_dedup as L
from lodestar.llm import mixing as M
from lodestar.llm import secrets_scan as S
from lodestar.llm import token_packing as P
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


# ---- decontamination -------------------------------------------------------


def plain_align(doc, item):
    h = np.zeros((len(item) + 1, len(doc) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(doc) + 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (D.MATCH if item[i - 1] == doc[j - 1] else D.MISMATCH), h[i - 1, j] + D.GAP, h[i, j - 1] + D.GAP)
    return int(h.max())


def test_alignment_score_is_smith_watermans():
    rng = np.random.default_rng(0)
    for _ in range(200):
        doc, item = rng.integers(0, 6, rng.integers(1, 30)), rng.integers(0, 6, rng.integers(1, 15))
        score, a, b = D.align(doc, item)
        assert score == plain_align(doc, item)
        assert 0 <= a <= b <= len(doc) and (score == 0 or plain_align(doc[a:b], item) == score)


def test_passages_are_found_and_clean_documents_kept(spark):
    rng = random.Random(1)
    words = [f"t{i}" for i in range(3000)]
    items = [(i, " ".join(rng.choices(words, k=30))) for i in range(20)] + [(90, None), (91, ""), (92, "t1 t2")]
    docs, want = [], set()
    for d in range(120):
        text = rng.choices(words, k=rng.choice([5, 60, 400]))
        if d % 3 == 0:
            i = rng.randrange(20)
            copy = items[i][1].upper().split() if d % 2 else items[i][1].split()
            if d % 4 == 0:
                copy[7] = "edited"
                del copy[15]
                copy.insert(20, "more")
            at = rng.randrange(len(text))
            text[at:at] = copy
            want.add((d, i))
        docs.append((d, " ".join(text)))
    docs += [(500, None), (501, ""), (502, "t9 " * 50_000)]
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int").repartition(4)
    it = spark.createDataFrame(items, "item_id long, text string")
    got = D.contaminated(df, it).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want
    by = dict(docs)
    for r in got:
        w = [x.lower() for x in by[r.doc_id].split()]
        assert plain_align(w[r.first_word : r.last_word], dict(items)[r.item_id].split()) == r.score
    kept = D.decontaminate(df, it)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(by) - {d for d, _ in want}
    assert D.contaminated(df, it.limit(0)).count() == 0 and D.contaminated(df.limit(0), it).count() == 0


def test_edited_copies_in_many_documents_are_found(spark):
    rng = random.Random(5)
    words = [f"t{i}" for i in range(3000)]
    item = rng.choices(words, k=40)
    # of the item's 38 n-grams ten are left, and all copies hold the same ones
    copy = ["edited" if i % 4 == 3 else x for i, x in enumerate(item)]
    docs = [(d, " ".join(rng.choices(words, k=60) + (copy if d % 20 == 0 else []))) for d in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = D.contaminated(df, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted(r.doc_id for r in got) == list(range(0, 200, 20))
    assert all(r.score == plain_align(copy, item) for r in got)


def all_pairs(docs, items, min_coverage=D.MIN_COVERAGE):
    """Document, item and score by aligning every document with every item."""
    code = {w: i for i, w in enumerate({w for _, t in docs + items for w in t})}
    want = Counter()
    for d, t in docs:
        for i, u in items:
            score = D.align(np.array([code[w] for w in t]), np.array([code[w] for w in u]))[0] if t and u else 0
            if u and score >= (min_coverage * D.MATCH * len(u) if len(u) >= D.SEED_WORDS else D.MATCH * len(u)):
                want[d, i, score] += 1
    return want


def frames(spark, docs, items):
    return (
        spark.createDataFrame([(d, " ".join(t)) for d, t in docs], "doc_id long, text string").repartition(4),
        spark.createDataFrame([(i, " ".join(t)) for i, t in items], "item_id long, text string"),
    )


def edited(rng, copy, words, share):
    for _ in range(int(len(copy) * share)):
        at = rng.randrange(len(copy))
        copy[at : at + 1] = rng.choice([[], [rng.choice(words)], [copy[at], rng.choice(words)]])
        copy = copy or [rng.choice(words)]
    return copy


@pytest.mark.parametrize("vocabulary, least", [(400, 0.5), (60, 0.5), (400, 0.8), (400, 0.34)])
def test_found_pairs_are_those_of_all_pairs(spark, vocabulary, least):
    """With edits from none to heavy, words of very unequal frequency, short items and repeated rows."""
    rng = random.Random(vocabulary)
    words = [f"q{i}" for i in range(vocabulary)]
    weight = [1 / (i + 3) for i in range(vocabulary)]
    items = [(i, rng.choices(words, weight, k=n)) for i, n in enumerate([1, 2, 2, 3, 4, 5, 8, 8, 25, 25, 40, 60, 60, 60])]
    docs = []
    for d in range(160):
        text = rng.choices(words, weight, k=rng.choice([1, 3, 30, 120]))
        copy = edited(rng, list(items[rng.randrange(14)][1]), words, rng.choice([0, 0.1, 0.2, 0.3, 0.45]))
        at = rng.randrange(len(text))
        text[at : at + rng.choice([0, len(text)])] = copy
        docs.append((d, text))
    docs += [docs[0], docs[0]]
    got = Counter((r.doc_id, r.item_id, r.score) for r in D.contaminated(*frames(spark, docs, items), least).collect())
    want = all_pairs(docs, items, least)
    assert got == want and sum(want.values()) > 100


def test_copies_without_a_common_ngram_are_found(spark):
    """Every third word another, a word put between any two, every second word left out, and short items in long texts."""
    rng = random.Random(8)
    words = [f"v{i}" for i in range(5000)]
    items = [(i, [f"i{i}w{k}" for k in range(n)]) for i, n in enumerate([29, 30, 31, 44, 2, 1])]
    docs = []
    for i, u in items:
        third = ["changed" if k % 3 == 2 else w for k, w in enumerate(u)]
        between = [x for w in u for x in (w, "between")][:-1]
        pairs = [x for k, w in enumerate(u) for x in ([w, "extra"] if k % 2 else [w])]
        for k, copy in enumerate((third, between, pairs, u[::2])):
            around = rng.choices(words, k=200)
            docs.append((10 * i + k, around[:90] + copy + around[90:]))
    want = all_pairs(docs, items)
    got = Counter((r.doc_id, r.item_id, r.score) for r in D.contaminated(*frames(spark, docs, items)).collect())
    assert got == want
    assert {(10 * i + k, i) for i in range(4) for k in range(3)} | {(40, 4), (50, 5)} <= {(d, i) for d, i, _ in want}


def test_frequent_words_and_passages_lose_nothing(spark):
    """Items made of words, and sharing passages, that nearly all documents hold."""
    rng = random.Random(3)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(900)]
    shared = rng.choices(common, k=12)
    items = [(i, rng.choices(rare, k=6) + shared + rng.choices(common + rare[:50], k=14)) for i in range(8)] + [(8, rng.choices(common, k=20))]
    docs = []
    for d in range(100):
        text = rng.choices(common * 60 + rare, k=rng.choice([20, 200])) + shared
        if d % 3 == 0:
            text += edited(rng, list(items[d % 9][1]), rare, 0.3)
        docs.append((d, text))
    got = Counter((r.doc_id, r.item_id, r.score) for r in D.contaminated(*frames(spark, docs, items)).collect())
    assert got == all_pairs(docs, items)


def test_item_seeds_are_its_rarest():
    about = D.Items([(1, " ".join(f"w{i}" for i in range(30)))], 0.5)
    word_keys, gram_keys = about.keys()
    often = {int(h): i for i, h in enumerate(about.words[0])}
    about.choose(word_keys, np.array([often[int(h)] for h in word_keys.keys]), gram_keys, np.arange(len(gram_keys.keys)))
    n = 30 - about.words_needed[0] + about.hits_needed[0]
    assert sorted(often[int(h)] for h in about.word_seeds.keys) == list(range(n)) and n < 20
    assert len(about.gram_seeds.keys) == 28 - about.grams_needed[0] + 1 < 28


def test_items_in_several_blocks(spark, monkeypatch):
    docs, items = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/benchmark.parquet")
    one = sorted(map(tuple, D.contaminated(docs, items).collect()))
    monkeypatch.setattr(D, "BLOCK_WORDS", 200)
    assert sorted(map(tuple, D.contaminated(docs, items).collect())) == one and one


# ---- html ------------------------------------------------------------------


def test_minimum_cut_is_minimal():
    rng = random.Random(4)
    for _ in range(150):
        n = rng.randint(1, 8)
        gain = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(a, b, rng.random() * 2) for a in range(n) for b in range(a) if rng.random() < 0.5]

        def cost(x):
            return sum(g if g > 0 and not k else -g if g < 0 and k else 0 for g, k in zip(gain, x)) + sum(w for a, b, w in edges if x[a] != x[b])

        best = min(cost([m >> i & 1 for i in range(n)]) for m in range(1 << n))
        assert math.isclose(cost(H.min_cut(gain, edges)), best, abs_tol=1e-9)


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><header><a href=/>Home</a></header><div id="cookie-notice">We use cookies.</div>
<div class="sidebar"><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div class="post-content"><h1>The &amp; title</h1><p>First   para
with caf&eacute;.<p>Second<br>line.<script>var x="</p><p>no";</script><form><label>Email</label></form><div class="ad">Buy!</div><blockquote>Quote</blockquote></div>
<section class="comments"><p>Great article, I like it a lot.</p></section><!-- <p>hidden</p> --><footer>Copyright</footer></body></html>"""


def test_main_text_of_a_page(spark):
    rows = [(1, "u", PAGE), (2, "u", None), (3, None, ""), (4, "u", "plain words"), (5, "u", "<article><p>" + "word " * 50_000 + "</article>"), (6, "u", "<p>un<b>clo")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in H.extract_main_text(df).collect()}
    assert got[1].text == "The & title First para with café. Second line. Quote"
    assert got[2].text == got[3].text == "" and got[5].n_chars == 50_000 * 5 - 1
    assert all(r.n_chars == len(r.text) for r in got.values())
    assert H.extract_main_text(df.limit(0)).count() == 0


PARA = "<p>The first paragraph says what there is, and why it matters to all.</p><p>The second one goes on, with more to tell of the same.</p><p>A third ends it.</p>"
TOLD = "The first paragraph says what there is, and why it matters to all. The second one goes on, with more to tell of the same. A third ends it."
NAV = "<nav><a href=/a>Home</a> <a href=/b>News</a></nav>"


@pytest.mark.parametrize(
    "page, want",
    [
        (f'<body class="no-sidebar">{PARA}', TOLD),
        (f'<body class="sidebar">{PARA}', TOLD),
        (f'<body>{NAV}<div class="page comments-open">{PARA}</div></body>', TOLD),
        (f'<body><div class="wrapper sidebar">{PARA}</div><footer>end</footer></body>', TOLD),
        (f'<article><div class="article-header"><h1>Headline</h1></div>{PARA}</article>', "Headline " + TOLD),
        (f'<form id="aspnetForm">{NAV}<div>{PARA}</div></form>', TOLD),
        (PARA, TOLD),
        (f'<p title="the hidden gem">{TOLD}</p>', TOLD),
        (f'<div class="site-nav"><a href=/>Home</a></div><div class="entry">{PARA}<div class="share-buttons">Share this</div></div><section class="comments"><p>Great, I like it a lot, and so do all my friends.</p><p>Me too.</p></section>', TOLD),
        (f'<article>{PARA}<div class="related-posts"><a href=/1>Another</a></div><section id="comments"><article class="comment"><p>First!</p></article></section></article>', TOLD),
        (f'<main>{PARA}<aside><div class="content">Our best offers for you.</div></aside></main>', TOLD),
        ("A line of text without markup", "A line of text without markup"),
        (f"<p>a < b and c > d; {TOLD}</p>", f"a < b and c > d; {TOLD}"),
    ],
)
def test_ordinary_pages_without_training(page, want):
    assert H.main_text(page, H.PRIOR) == want


def test_long_bad_pages_take_time_in_proportion():
    import time

    def seconds(part, n):
        page = PARA + part * n + PARA
        start = time.perf_counter()
        H.main_text(page, H.PRIOR)
        return time.perf_counter() - start

    for part in ('<a title="x ', "<b x='y \"", "</i></div>", "<b>", "<!", "<a b=\"c>", "<b>x<hr>", "<script>", "<p><i>"):
        few, many = min(seconds(part, 4_000) for _ in range(2)), seconds(part, 32_000)
        assert many < 24 * few + 1.0, part


def test_pages_give_their_article(spark):
    import html as entities

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    for r in H.extract_main_text(pages).join(pages.select("page_id", "html"), "page_id").collect():
        want = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        assert r.text == " ".join(entities.unescape(re.sub(r"<[^>]*>", " ", want)).split())


# ---- secrets ---------------------------------------------------------------


def test_base_spans_are_those_of_the_patterns():
    cases = {
        "password: hunter2222": [("assign", 0, 20)],
        "PassWD='abcdef'": [("assign", 0, 14)],
        "secret=token:abcdef12": [],
        "token=abc": [],
        "api_key = \"x/Y+z=_.-9\"": [("assign", 0, 21)],
        "AKIA" + "A" * 16: [("access", 0, 20)],
        "AKIA" + "A" * 15: [],
        "x" + "0f" * 12: [("hex", 1, 25)],
        "0f" * 11: [],
        "é secret: short": [],
    }
    for text, want in cases.items():
        assert S.base_spans(text) == want, text


def test_novel_spans_need_a_context_and_novelty(spark):
    rng = random.Random(2)
    key = "".join(rng.choices("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789", k=40))
    rows = [(1, f"the bearer {key} is sent"), (2, f"the weather {key} is sent"), (3, "bearer configuration123 configuration123"), (4, None), (5, ""), (6, "password: hunter2222 " * 3), (7, "z" * 200_000)]
    got = {r.doc_id: r for r in S.secret_report(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, spans int")).collect()}
    assert got[1].spans == f"novel:11:{11 + len(key)}" and got[1].n_assign == 0
    assert all(got[i].spans == "" and got[i].base_sha256 == hashlib.sha256(b"").hexdigest() for i in (2, 3, 4, 5, 7))
    assert got[6].n_assign == 3 and got[6].base_sha256 == hashlib.sha256(b"assign:0:20,assign:21:41,assign:42:62").hexdigest()
    assert S.secret_report(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_secrets_of_any_length_and_alphabet_are_novel(spark):
    rng = random.Random(4)
    rows = []
    for i, (chars, n) in enumerate((c, n) for c in ("0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ") for n in (24, 48, 96, 192, 400)):
        rows.append((i, f"send Authorization: Bearer {''.join(rng.choices(chars, k=n))} with it", n))
    rows += [(90, "the bearer accessTokenProvider and getSecretValueRequest authorization123", 0), (91, "Bearer xyzxyzxyzxyzxyzxyzxyzxyz123", 0)]
    got = {r.doc_id: r for r in S.secret_report(spark.createDataFrame(rows, "doc_id long, text string, n int")).collect()}
    assert all(got[i].spans == (f"novel:27:{27 + n}" if n else "") for i, _, n in rows)


def test_novel_spans_match_a_plain_search():
    """Against a search that measures every token and compares it with every cue and base span."""
    rng = random.Random(12)
    novelty = S.Novelty()
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(40)):
            parts.append(rng.choice(["bearer", "the cat sat", "password: hunter22", "token", "words of no note here", "secret=abcdef99", "".join(rng.choices("ABCDEFGHabcdefgh23456789", k=rng.choice([8, 14, 30])))]))
        text = " ".join(parts)
        base = S.base_spans(text)
        cues = [m.start() for m in S._SENSITIVE.finditer(text)]
        want = []
        for m in S._TOKEN.finditer(text):
            a, b = m.span()
            near = any(a - S.NEAR_CHARS <= c < b for c in cues)
            free = not any(a < y and x < b for _, x, y in base)
            kind = re.search("[A-Za-z]", m[0]) and (re.search("[0-9]", m[0]) or 3 * sum(x.isalpha() and y.isalpha() and x.isupper() != y.isupper() for x, y in zip(m[0], m[0][1:])) >= len(m[0]))
            if near and free and kind and novelty.ratio(text, a, b) >= S.MIN_NOVELTY:
                want.append(("novel", a, b))
        assert S.novel_spans(text, base, novelty) == want


def test_many_spans_in_a_long_text_take_time_in_proportion():
    import time

    part, novelty = "password: hunter2222 token zz ", S.Novelty()
    seconds = []
    for n in (2_000, 16_000):
        text = part * n
        start = time.perf_counter()
        base = S.base_spans(text)
        S.novel_spans(text, base, novelty)
        seconds.append(time.perf_counter() - start)
        assert len(base) == n
    assert seconds[1] < 30 * seconds[0] + 0.5


def test_repeated_rows_stay_rows(spark):
    df = spark.createDataFrame([(1, "token: abcdef12")] * 3 + [(None, "token: abcdef12")], "doc_id long, text string")
    assert [r.n_assign for r in S.secret_report(df).collect()] == [1] * 4


# ---- packing ---------------------------------------------------------------


def test_best_fit_decreasing_takes_the_least_room():
    rng = random.Random(6)
    for _ in range(100):
        size = rng.choice([1, 7, 16, 100])
        lengths = [rng.randint(1, size) for _ in range(rng.randint(0, 60))]
        rows, room = [], []
        for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
            fits = [r for r in room if r >= lengths[i]]
            if fits:
                k = room.index(min(fits))
                room[k] -= lengths[i]
            else:
                room.append(size - lengths[i])
        rows = P.best_fit_decreasing(lengths, size)
        assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
        assert sorted(size - sum(lengths[i] for i in r) for r in rows) == sorted(room)


def test_packing_loses_no_id(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()] + [(8001, None), (8002, ""), (8003, "long one " * 9000), (None, "no id"), (8004, "<|endoftext|> twice"), (8004, "<|endoftext|> twice")]
    df = spark.createDataFrame([(d, t, 0) for d, t in rows], "doc_id long, text string, ids int").repartition(3)
    got = P.pack_tokens(df, length=256, shard_tokens=20_000).collect()
    parts = defaultdict(list)
    for n, r in enumerate(got):
        ids = np.frombuffer(r.ids, "<i4")
        assert len(ids) == 256 and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and list(r.position_resets) == list(r.cu_seqlens[:-1])
        assert (ids[r.n_tokens :] == P.END_ID).all()
        for k, (d, off) in enumerate(zip(r.doc_ids, r.doc_offsets)):
            parts[d].append((off, ids[r.cu_seqlens[k] : r.cu_seqlens[k + 1]].tolist()))
    encode = P._encoding(P.vocabulary_path())
    want = defaultdict(Counter)
    for d, t in rows:
        want[d][tuple(encode.encode_ordinary(t or "") + [P.END_ID])] += 1
    for d, texts in want.items():
        if sum(texts.values()) == 1:
            assert [x for _, p in sorted(parts[d]) for x in p] == list(next(iter(texts)))
        else:
            assert sorted(x for _, p in parts[d] for x in p) == sorted(x for t, m in texts.items() for x in list(t) * m)
    assert P.pack_tokens(df.limit(0)).count() == 0


# ---- lines -----------------------------------------------------------------


def test_lines_above_the_ratio_go(spark):
    rows = [(i, f"http://u@Site.example:80/p{i}?x", f"<head><title>no</title></head><nav>menu</nav><p>own {i}<p>{'often' if i % 2 else 'odd'} <b>bo</b>ld</p><script>x()</script>") for i in range(8)]
    rows += [(20 + i, "https://small.example/", "<p>menu<p>same") for i in range(3)]
    rows += [(30, None, "<p>a<p>a"), (31, "not a url", None), (32, "http://site.example/", ""), (33, "http://big.example/", "<p>" + "x " * 50_000)]
    df = spark.createDataFrame([(*r, "t") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in L.drop_boilerplate_lines(df, 0.45, 5).collect()}
    # nine pages of site.example: the menu is on eight, each second line on four
    assert got[1].host == "site.example" and got[1].n_lines == 3 and got[1].text == "own 1\noften bold"
    assert L.drop_boilerplate_lines(df, 0.4, 5).where("page_id = 1").first().text == "own 1"
    assert got[21].text == "menu\nsame" and got[30].text == "a\na" and got[31].n_lines == got[32].n_lines == 0
    # by default a host of any number of pages counts, and a line of one page stays
    every = {r.page_id: r.text for r in L.drop_boilerplate_lines(df, 0.45).collect()}
    assert every[21] == "" and every[30] == "a\na"
    assert L.drop_boilerplate_lines(df.limit(0)).count() == 0


def test_line_ratios_match_brute_force(spark):
    rng = random.Random(9)
    rows = [(i % 55, f"http://h{min(i % 7, 3)}.example/", "".join(f"<p>{rng.choice('abcdefghij')}{rng.randrange(3)}</p>" for _ in range(rng.randrange(9)))) for i in range(60)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    lines = [(d, u[7:-1], re.findall("<p>(.*?)</p>", h)) for d, u, h in rows]
    pages, seen = Counter(h for _, h, _ in lines), Counter((h, x) for _, h, ls in lines for x in set(ls))
    want = sorted((d, h, len(ls), "\n".join(x for x in ls if not (seen[h, x] > 1 and seen[h, x] > 0.3 * pages[h]))) for d, h, ls in lines)
    assert sorted((r.page_id, r.host, r.n_lines, r.text) for r in L.drop_boilerplate_lines(df).collect()) == want


# ---- mixing ----------------------------------------------------------------


def shares(sizes: list[int], weights=M.WEIGHTS, share: float = M.SHARE, most: float = M.MOST) -> list[float]:
    """Targets of sources in order: ``share`` of all words by weight, none above ``most`` times its size."""
    total = share * sum(sizes)
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    target, open_ = [0.0] * len(sizes), [i for i, s in enumerate(sizes) if s]
    left = total
    while open_:
        unit = left / sum(w[i] for i in open_)
        over = [i for i in open_ if unit * w[i] > most * sizes[i]]
        if not over:
            for i in open_:
                target[i] = unit * w[i]
            break
        for i in over:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in set(over)]
        left = max(left, 0.0)
    return target


def test_shares_are_capped_and_shared_anew():
    assert shares([100, 100, 100]) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    for sizes in ([], [0], [0, 5, 0], [1000, 1, 1, 1], [7, 900, 20, 3, 44]):
        t = shares(sizes)
        assert all(x <= 2 * s + 1e-9 for x, s in zip(t, sizes))
        assert sum(t) == pytest.approx(min(1.5 * sum(sizes), 2 * sum(sizes)))


def test_permutation_is_one():
    for n in (1, 2, 3, 100, 1000):
        x = M.permute(np.arange(n), np.full(n, n), np.full(n, 9))
        assert sorted(x.tolist()) == list(range(n))
    assert M.permute(np.arange(1000), np.full(1000, 1000), np.full(1000, 9)).tolist() != list(range(1000))


def mix_rows(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 30, 200, 3000])), rng.choice(["a", "b", "c", "d", None])) for i in range(300)]
    rows += [(900, None, "a"), (901, "", None), (902, "x y", "a"), (902, "x y", "a")]
    return rows, spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, taken int").repartition(4)


def test_mix_meets_its_targets(spark):
    rows, df = mix_rows(spark)
    got = M.mix_report(df).collect()
    assert len(got) == len(rows)
    size = Counter()
    for _, t, s in rows:
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    target = dict(zip(order, shares([size[s] for s in order])))
    src = {d: s for d, _, s in rows}
    taken = Counter()
    for r in got:
        s = src[r.doc_id]
        assert r.size * 2 >= r.taken >= 0 and r.source_size == size[s] and r.target == pytest.approx(target[s])
        taken[s] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 2 * M.BLOCK
    key = lambda r: (r.doc_id, r.size, r.taken)
    assert sorted(map(key, M.mix_report(df.repartition(2)).collect())) == sorted(map(key, got))
    assert M.mix_report(df.limit(0)).count() == 0


def test_small_sources_beside_a_hot_one_meet_their_targets(spark):
    rows = [(i, "w " * (i % 40 + 1), f"s{i:03d}") for i in range(160)] + [(1000 + i, "w " * 4000, "t") for i in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    small = [r for r in M.mix_report(df).collect() if r.doc_id < 1000]
    assert len(small) == 160 and all(abs(r.taken - r.target) <= 1 for r in small)


def test_targets_and_numbers_of_sources_are_those_of_the_plain_rounds(spark):
    rng = random.Random(6)
    names = [f"n{i:04d}" for i in range(700)] + ["", "\U0001f600", "\uffee", "Z", None]
    rows = [(s, rng.choice([0, 1, 5, 80, 3000, 100_000])) for s in names for _ in range(rng.randint(1, 3))]
    got = M.sources_of(spark.createDataFrame(rows, "source string, size long").repartition(7)).orderBy("source_no").collect()
    order = sorted(names, key=lambda s: (s is None, s or ""))
    size = Counter()
    for s, n in rows:
        size[s] += n
    assert [(r.source_no, r.source, r.size) for r in got] == [(i, s, size[s]) for i, s in enumerate(order)]
    assert [r.target for r in got] == pytest.approx(shares([size[s] for s in order]))
    drawn = M.draws(M.sources_of(spark.createDataFrame(rows, "source string, size long")), 40)
    per = drawn.groupBy("shard").sum("n").collect()
    assert len(per) == 40 and all(r[1] == M.SHARD_SLOTS for r in per)
    quota, n = {r.source_no: r.quota for r in got}, {r.source_no: r[1] for r in drawn.groupBy("source_no").sum("n").collect()}
    slots, total = sum(quota.values()), 40 * M.SHARD_SLOTS
    for s, q in quota.items():
        want = total * q / slots
        assert abs(n.get(s, 0) - want) <= 6 * want**0.5 + 3 and (q or s not in n)


def test_two_hundred_thousand_sources(spark):
    df = spark.range(0, 200_000, 1, 8).select(F.col("id").alias("doc_id"), F.lit("one two three").alias("text"), F.format_string("s%06d", "id").alias("source"))
    df = df.unionByName(spark.range(200_000, 200_400, 1, 4).select(F.col("id").alias("doc_id"), F.repeat(F.lit("hot "), 1000).alias("text"), F.lit("t").alias("source")))
    got = M.mix_report(df)
    total = got.agg(F.count("*"), F.sum("taken"), F.max(F.col("taken") - 2 * F.col("size")), F.max(F.when(F.col("doc_id") < 200_000, F.abs(F.col("taken") - F.col("target"))))).first()
    assert total[0] == 200_400 and total[2] <= 0 and total[3] <= 1 and abs(total[1] - 1.5 * 1_000_000) <= 0.35 * 1_500_000


@pytest.mark.parametrize("size", [1, 10, 65, 100, 5000])
def test_a_source_of_any_size_meets_its_target(spark, size):
    rows = [(1, "w " * size, "a")] + [(10 + i, "x " * 2000, "b") for i in range(60)]
    got = M.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id = 1").first()
    assert got.target == 2 * size and abs(got.taken - got.target) <= max(1, size // 64)


def test_long_and_repeated_texts_and_null_ids_are_mixed(spark):
    rows = [(1, "w " * 300_000, "a"), (None, "y " * 900, "b"), (None, "y " * 900, "b"), (2, "z " * 500, None), (2, "z " * 500, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = M.mix_report(df).collect()
    assert len(got) == 5 and all(0 <= r.taken <= 2 * r.size for r in got)
    total = Counter()
    for r in got:
        total[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= 0.02 * target for (_, target), n in total.items())


def test_mixed_documents_hold_the_words_taken(spark):
    rows, df = mix_rows(spark)
    df = df.selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as long) as n_chars")
    out = M.mixed_documents(df)
    assert out.columns == df.columns
    words = Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        words[r.doc_id] += len(WORD.findall(r.text))
    report = Counter()
    for r in M.mix_report(df).collect():
        report[r.doc_id] += r.taken
    assert +words == +report


def nested_edges(rng, n):
    """Edges as a page has them: to the block before, and to the last block of the same parent."""
    edges, last, stack, new = [(i - 1, i, rng.randint(0, 6) / 4) for i in range(1, n)], {}, [0], 1
    for i in range(n):
        move = rng.random()
        if move < 0.35:
            stack.append(new)
            new += 1
        elif move < 0.6 and len(stack) > 1:
            stack.pop()
        if stack[-1] in last:
            edges.append((last[stack[-1]], i, rng.randint(0, 6) / 4))
        last[stack[-1]] = i
    return edges


def test_cut_of_nested_and_of_dense_graphs_is_least_and_takes_ties():
    rng = random.Random(4)
    for t in range(120):
        n = rng.randint(1, 9)
        gain = [rng.randint(-6, 6) / 4 for _ in range(n)]
        edges = nested_edges(rng, n) if t % 2 else [(a, b, rng.randint(0, 6) / 4) for a in range(n) for b in range(a) if rng.random() < 0.6]

        def cost(x, gain=gain, edges=edges):
            return sum(g if g > 0 and not k else -g if g < 0 and k else 0 for g, k in zip(gain, x)) + sum(w for a, b, w in edges if x[a] != x[b])

        every = [[bool(m >> i & 1) for i in range(n)] for m in range(1 << n)]
        best = min(map(cost, every))
        # the largest of the least cuts
        assert H.min_cut(gain, edges) == [any(x[i] for x in every if cost(x) == best) for i in range(n)]


@pytest.mark.parametrize("row", ["<tr><td>{0}</td><td><a href=/x{0}>item {0}</a></td><td>red stone</td></tr>", "<li>{0} small</li>", "<p>blue stone {0}</p>", "<div><p>one {0}</p><ul><li>two</li></ul></div>"])
def test_pages_of_very_many_blocks_take_time_in_proportion(row):
    import time

    def took(n):
        page = "<body>" + "".join(row.format(i) for i in range(n))
        began = time.process_time()
        H.main_text(page, H.PRIOR)
        return time.process_time() - began

    took(200)
    assert took(16_000) < 24 * max(took(2_000), 0.05)  # in proportion it is 8, by the square 64
