import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestar.llm import brown_lm, language
from tests.conftest import DATA

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict_languages(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edges(spark):
    rows = [(i, t, "en") for i, t in enumerate(["the cat and the dog", "a house of the king"] * 9)] + [(i + 50, "der Hund und die Katze", "de") for i in range(9)]
    rows += [(100, None, "en"), (101, "", None), (102, "12 34 !", "de"), (103, "日本語", None), (104, "the dog " * 30_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in language.predict_languages(df.selectExpr("*", "1 as score", "2 as lang_pred")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[103].lang_pred in ("en", "de") and got[104].lang_pred == "en" and got[55].lang_pred == "de"
    assert [got[i].held_out for i in got] == [zlib.crc32(str(i).encode()) % 3 == 1 for i in got]
    assert language.predict_languages(df.limit(0)).count() == 0
    kept = language.keep_identified(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == set(got) - {100, 101, 102}


def test_predictions_are_naive_bayes(spark):
    """Against counts in dictionaries, n-gram by n-gram, and posteriors from them."""
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang").collect()]
    docs += [(7001, None, "en"), (7002, "\u00bd \u00b2 \u2460", "en"), (7003, "x" * 70_000 + " der", None), (7004, "der und", None), (7004, "der und", None)]
    df = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, lang string, score int").repartition(3)

    def grams(t):
        plain = " " + (t or "").lower() + " "
        letter = lambda c: (ord(c) > 191 or "a" <= c <= "z") and ord(c) not in (0xD7, 0xF7) and not 0x2000 <= ord(c) <= 0x206F
        x = [c if letter(c) else " " for c in plain]
        x = [c for i, c in enumerate(x) if i == 0 or c != " " or x[i - 1] != " "]
        out = []
        for n in language.ORDERS:
            for i in range(len(x) - n + 1):
                h = n
                for c in x[i : i + n]:
                    h = (h * 1_000_003 + ord(c)) % (1 << 64)
                out.append(h)
        return (language.mix(np.array(out, np.uint64)) & np.uint64((1 << language.BITS) - 1)).tolist()

    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    bag = {}
    for d, t, lang in docs:
        if lang is not None and not held(d):
            bag.setdefault(lang, Counter()).update(grams(t))
    size = 1 << language.BITS
    log = {k: (c, math.log(sum(c.values()) + 0.5 * size)) for k, c in bag.items()}
    got = sorted((r.doc_id, r.held_out, r.lang_pred, r.score) for r in language.predict_languages(df).collect())
    assert len(got) == len(docs)
    for (d, h, name, score), (_, t, _) in zip(got, sorted(docs, key=lambda r: r[0])):
        assert h == held(d)
        if d in (7001, 7002) or not any(c.isalpha() for c in t or ""):
            assert (name, score) == ("und", 0.0)
            continue
        total = {k: sum(math.log(c[g] + 0.5) - room for g in grams(t)) for k, (c, room) in log.items()}
        top = max(total.values())
        assert total[name] > top - 0.05  # the model is kept in single precision
        if len(t) < 3000:
            assert math.isclose(score, 1 / sum(math.exp(v - total[name]) for v in total.values()), abs_tol=2e-3)


def test_languages_in_blocks_are_told_as_in_one(spark, monkeypatch):
    rng = random.Random(2)
    docs = [(i, "".join(rng.choice("abcdefgh"[k % 6 : k % 6 + 3] + "xyz") for _ in range(40)) + " " + "qrstuv"[k % 6] * 9, f"l{k:02d}") for i in range(300) for k in [rng.randrange(23)]]
    docs += [(900, None, "l03"), (901, "", None), (902, "12 !", "zz"), (903, "abc", None), (903, "abc", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3)
    one = sorted(map(tuple, language.predict_languages(df).collect()))
    kept = sorted(map(str, language.keep_identified(df, 0.2).collect()))
    monkeypatch.setattr(language, "LANGUAGES", 5)
    got = sorted(map(tuple, language.predict_languages(df).collect()))
    assert [r[:3] for r in got] == [r[:3] for r in one] and np.allclose([r[3] for r in got], [r[3] for r in one], atol=1e-9)
    assert sorted(map(str, language.keep_identified(df, 0.2).collect())) == kept and language.keep_identified(df).columns == df.columns


def test_twenty_thousand_languages_pass_in_blocks_of_bounded_size(spark):
    """A column of wrong values costs passes, not memory: names come by blocks, and each has a matrix of its own."""
    df = spark.range(0, 20_000, 1, 4).select(F.col("id").alias("doc_id"), F.lit("some text").alias("text"), F.format_string("l%05d", "id").alias("lang"))
    blocks = list(language._blocks(df))
    assert [len(b) for b in blocks] == [language.LANGUAGES] * 39 + [32] and sum(blocks, []) == [f"l{i:05d}" for i in range(20_000)]
    logp = language.train(df, blocks[7])
    assert logp.nbytes == 32 << 20 and np.allclose(np.exp(logp.astype(float)).sum(axis=0), 1, atol=1e-3) and (logp == logp[:, :1]).all()


def test_untrained_model_gives_und(spark):
    df = spark.createDataFrame([(2, "the cat", None)], "doc_id long, text string, lang string")
    assert language.predict_languages(df).first().lang_pred == "und"


def test_base_scores_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(brown_lm, "HEAD", 500)  # so that most words take the join
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    rows = [(r.doc_id, r.text) for r in docs] + [(9001, None), (9002, ""), (9003, "neverseen words")]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, n_tokens int").repartition(3)
    tokens = {d: WORD.findall(low(t)) + [None] for d, t in rows}
    held = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows}
    c = Counter(w for d, ws in tokens.items() if not held[d] for w in ws)
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in brown_lm.score_texts(df).collect()}
    for d, ws in tokens.items():
        r = got[d]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
    # a class model beats unigrams on held-out text
    out = [got[d] for d in got if held[d]]
    assert sum(r.score for r in out) > sum(r.base_score for r in out)
    assert brown_lm.score_texts(df.limit(0)).count() == 0


def test_repeated_rows_stay(spark):
    df = spark.createDataFrame([(1, "a b")] * 3 + [(2, "a c")], "doc_id long, text string")
    got = brown_lm.score_texts(df).collect()
    assert len(got) == 4 and len({(r.doc_id, round(r.score, 9)) for r in got}) == 2


def test_exchange_gain_is_the_likelihood_gain():
    rng = np.random.default_rng(1)
    k, n = brown_lm._N_CLASSES, 12
    classes = rng.integers(0, 3, n)
    pairs = rng.integers(0, 6, (n, n))

    def table(cls):
        joint = np.zeros((k, k))
        for a in range(n):
            for b in range(n):
                joint[cls[a], cls[b]] += pairs[a, b]
        return joint

    joint = table(classes)
    for w in range(n):
        right, left = np.zeros(k), np.zeros(k)
        for x in range(n):
            right[classes[x]] += pairs[w, x]
            left[classes[x]] += pairs[x, w]
        best = brown_lm.best_class(right, left, float(pairs[w, w]), int(classes[w]), joint)
        tried = []
        for c in range(4):
            moved = classes.copy()
            moved[w] = c
            tried.append(brown_lm.likelihood(table(moved)))
        assert math.isclose(tried[best] if best < 4 else brown_lm.likelihood(joint), max(tried), rel_tol=1e-9)


def test_scores_match_the_class_model_by_brute_force(spark, monkeypatch):
    """Counts, classes and products in dictionaries, given only the classes that were learnt; and what learning gained."""
    monkeypatch.setattr(brown_lm, "HEAD", 900)
    monkeypatch.setattr(brown_lm, "CORE", 300)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    docs += [(9001, None), (9003, "neverseen words"), (9004, "long words " * 30_000), (9004, "twice"), (9004, "twice"), (None, "no id")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    train = df.where(~language.held_out(F.col("doc_id"), 7, 2))
    model = brown_lm.learn(train, brown_lm.word_counts(train))

    def ids_of(text):
        batch = pa.RecordBatch.from_arrays([pa.array([text], pa.string())], names=["text"])
        return [int(i) for _, _, ids, _ in brown_lm._tokens(batch) for i in ids]

    cls = dict(zip(model.head.find.keys.tolist(), model.head.classes.tolist()))
    end = brown_lm._END_CLASS
    class_of = lambda w: cls.get(w, brown_lm.CLASSES + (w & (brown_lm.SUFFIXES - 1)))
    n, joint = Counter(), Counter()
    for d, t in docs:
        if not held(d):
            ws = ids_of(t)
            n.update(ws)
            c = [end, *map(class_of, ws), end]
            joint.update(zip(c, c[1:]))
    tokens, kinds, out = Counter(), Counter(), Counter()
    for w, m in n.items():
        tokens[class_of(w)] += m
        kinds[class_of(w)] += 1
    for (a, _), m in joint.items():
        out[a] += m
    prior, k = brown_lm.TRANSITION_PRIOR, brown_lm._N_CLASSES

    def score(text):
        ws = ids_of(text)
        c = [end, *map(class_of, ws), end]
        total = sum(math.log10((joint[a, b] + prior) / (out[a] + prior * k)) for a, b in zip(c, c[1:]))
        return total + sum(math.log10((n[w] + 1) / (tokens[class_of(w)] + kinds[class_of(w)] + 1)) for w in ws), len(ws) + 1

    got = sorted(((-1 if r.doc_id is None else r.doc_id, r.n_tokens, round(r.score, 5), round(math.log(r.perplexity), 6)) for r in brown_lm.score_texts(df).collect()))
    want = sorted((-1 if d is None else d, m, round(s, 5), round(-s / m * math.log(10), 6)) for d, t in docs for s, m in [score(t)])
    assert all(g[:2] == w[:2] and math.isclose(g[2], w[2], rel_tol=1e-6, abs_tol=1e-4) and math.isclose(g[3], w[3], abs_tol=1e-4) for g, w in zip(got, want)) and len(got) == len(want)
    # core words are all clustered, many others too, and classes explain the text better than suffixes alone
    assert sum(c < brown_lm.CLASSES for c in cls.values()) > 300

    def value(of):
        pairs = np.zeros((k, k))
        for d, t in docs:
            if not held(d):
                c = np.array([end, *map(of, ids_of(t)), end])
                np.add.at(pairs, (c[:-1], c[1:]), 1)
        words = Counter()
        for w, m in n.items():
            words[of(w)] += m
        return brown_lm.likelihood(pairs)

    assert value(class_of) > value(lambda w: brown_lm.CLASSES + (w & (brown_lm.SUFFIXES - 1)))


def test_exchange_finds_planted_classes(spark, monkeypatch):
    """Words of three kinds that follow each other in a cycle."""
    monkeypatch.setattr(brown_lm, "CORE", 60)
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(f"{'abc'[(k + i) % 3]}{rng.integers(20)}" for k in range(60))) for i in range(300)]
    train = spark.createDataFrame(rows, "doc_id long, text string")
    model = brown_lm.learn(train, brown_lm.word_counts(train))
    kinds = {}
    for w in (f"{x}{i}" for x in "abc" for i in range(20)):
        batch = pa.RecordBatch.from_arrays([pa.array([w])], names=["text"])
        at = int(np.flatnonzero(model.head.find.keys == next(brown_lm._tokens(batch))[2][0])[0])
        kinds.setdefault(int(model.head.classes[at]), set()).add(w[0])
    assert all(len(x) == 1 for x in kinds.values())


def test_words_beyond_the_head_leave_their_suffix_class(spark, monkeypatch):
    """Broadcast or joined, the classes of rare words give the same scores, and better ones than their suffix classes."""
    monkeypatch.setattr(brown_lm, "HEAD", 40)
    monkeypatch.setattr(brown_lm, "CORE", 30)
    rng = np.random.default_rng(5)
    kind = lambda k: f"{'abc'[k]}{rng.integers(10)}" if rng.random() < 0.7 else f"{'xyz'[k]}{rng.integers(400)}{'pqr'[rng.integers(3)]}"
    rows = [(i, " ".join(kind((k + i) % 3) for k in range(60))) for i in range(400)] + [(900, None), (901, "a1 neverseen z1q")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    train = df.where(~language.held_out(F.col("doc_id"), 7, 2))
    counts = brown_lm.word_counts(train)
    model = brown_lm.learn(train, counts)
    assert model.tail is None and len(model.head.find.keys) > 300 and (model.head.classes < brown_lm.CLASSES).sum() > 300
    found = []
    for few in (brown_lm.FEW, 0):
        monkeypatch.setattr(brown_lm, "FEW", few)
        found.append(sorted(tuple(r) for r in brown_lm.score_texts(df).collect()))
    apart = brown_lm.learn(train, counts)
    assert apart.tail.count() == len(model.head.find.keys) - 40 and np.allclose(apart.trans, model.trans) and np.allclose(apart.room, model.room)
    assert len(found[0]) == len(rows) and all(a[:5] == b[:5] and np.allclose(a[5:], b[5:]) for a, b in zip(*found))
    monkeypatch.setattr(brown_lm, "_placed", lambda rest, head, joint: rest.limit(0).selectExpr("word", "0 as cls", "1L as n", "true as in_head"))
    stay = sorted(tuple(r) for r in brown_lm.score_texts(df).collect())
    assert sum(r[6] for r in found[0] if r[1]) > sum(r[6] for r in stay if r[1])
