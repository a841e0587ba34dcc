"""Brown class-based bigram language model, trained and applied as Spark jobs.

Words are 64-bit hashes whose five low bits are a suffix class.  Exchange
clustering runs on the ``CORE`` most frequent words: starting from classes by
frequency rank, each pass counts in Spark every word's neighbours by class and
moves words to the class with the best gain in likelihood, until the likelihood of
all training text settles.  All other words are then exchanged
against these classes in one pass: each goes from its suffix class to the best
class where that gains more than naming a class costs.  A text's probability is the
product of smoothed class transitions and word emissions, its end included.

Counts of all words are a table; the ``HEAD`` most frequent are broadcast with
their classes, a model of fixed size, and the others meet their counts in a join.
So do the classes of words beyond that left their suffix class, unless there are
few of them (``FEW``), which are broadcast too, with the same results.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .store import materialise
from .textarrays import mix, slices, utf8, words

HEAD = 1 << 18
CORE = 1 << 12
FEW = 1 << 20
CLASSES = 64
SUFFIXES = 32
SETTLED = 1e-4  # a pass that gains less of the likelihood, twice in a row, is the last
FLUSH = 2_000_000
SMALL = 16  # gains of counts up to this come from a table
TRANSITION_PRIOR = 0.1
END = -(1 << 62)
_END_CLASS = CLASSES + SUFFIXES
_N_CLASSES = CLASSES + SUFFIXES + 1


def _tokens(batch: pa.RecordBatch):
    """(first row, last row, ids, row pointers) of slices of the column ``text``; the end token is not among them."""
    buf, off = utf8(batch.column("text"))
    for i, j in slices(off):
        w = words(buf, off[i : j + 1])
        if len(w.start):
            tail = w.raw[w.end - 1].astype(np.uint64) * np.uint64(257) + w.raw[np.maximum(w.end - 2, w.start)]
            ids = (w.hash & ~np.uint64(SUFFIXES - 1)) | (mix(tail) & np.uint64(SUFFIXES - 1))
        else:
            ids = w.hash
        yield i, j, ids.view(np.int64), w.indptr


class Lookup:
    """Positions of ids in a sorted array, -1 where absent, by a table of hash slots."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        self.bits = max(10, int(math.ceil(math.log2(max(2, len(keys))))) + 3)
        slot = self._slot(keys)
        self.at = np.full(1 << self.bits, -1, dtype=np.int32)
        self.at[slot] = np.arange(len(keys), dtype=np.int32)
        self.many = np.bincount(slot, minlength=1 << self.bits) > 1

    def _slot(self, ids: np.ndarray) -> np.ndarray:
        return (ids.view(np.uint64) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(ids), -1, dtype=np.int32)
        slot = self._slot(ids)
        at = self.at[slot]
        miss = self.keys[np.maximum(at, 0)] != ids
        at[miss] = -1
        again = np.flatnonzero(miss & self.many[slot])
        if len(again):
            p = np.minimum(np.searchsorted(self.keys, ids[again]), len(self.keys) - 1)
            at[again] = np.where(self.keys[p] == ids[again], p, -1)
        return at


def word_counts(texts: DataFrame) -> DataFrame:
    """(word, n) of all tokens of ``texts(text)``; the end token is ``END``."""

    def run(batches):
        held, count, docs = [], 0, 0

        def flush():
            w, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(w), pa.array(n)], names=["word", "n"])

        for batch in batches:
            docs += batch.num_rows
            for _, _, ids, _ in _tokens(batch):
                held.append(ids)
                count += len(ids)
                if count > FLUSH:
                    yield flush()
                    held, count = [], 0
        if count:
            yield flush()
        if docs:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([docs])], names=["word", "n"])

    return texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Head:
    """The most frequent words by id, their counts, places among the core words (-1: none) and classes; room for core words."""

    find: Lookup
    n: np.ndarray
    core: np.ndarray
    classes: np.ndarray
    room: int

    def symbols(self, ids: np.ndarray, ptr: np.ndarray):
        """Places in the head (-1: none) and classes of a slice: an end, then each row's tokens and an end."""
        rows = len(ptr) - 1
        where = np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(ptr)) + 1
        place = np.full(len(ids) + rows + 1, -1, dtype=np.int64)
        cls = np.full(len(place), _END_CLASS, dtype=np.int64)
        at = self.find(ids)
        place[where] = at
        cls[where] = np.where(at >= 0, self.classes[at], _suffix_class(ids)) if len(self.classes) else _suffix_class(ids)
        return place, cls

    @staticmethod
    def spread(ids: np.ndarray, ptr: np.ndarray) -> np.ndarray:
        """The words of a slice where ``symbols`` has them; 0 at ends."""
        rows = len(ptr) - 1
        out = np.zeros(len(ids) + rows + 1, dtype=np.int64)
        out[np.arange(len(ids)) + np.repeat(np.arange(rows), np.diff(ptr)) + 1] = ids
        return out


def _suffix_class(ids: np.ndarray) -> np.ndarray:
    return CLASSES + (ids & (SUFFIXES - 1))


def head_of(counts: DataFrame) -> Head:
    """The ``HEAD`` most frequent words, all in their suffix classes."""
    top = counts.where(F.col("word") != END).orderBy(F.desc("n"), "word").limit(HEAD).toArrow()
    ids, n = top["word"].to_numpy().astype(np.int64), top["n"].to_numpy().astype(np.int64)
    by_id = np.argsort(ids)
    rank = np.arange(len(ids))[by_id]
    return Head(Lookup(ids[by_id]), n[by_id], np.where(rank < CORE, rank, -1), _suffix_class(ids[by_id]), CORE)


def _summed(keys: list[np.ndarray]):
    k, n = np.unique(np.concatenate(keys), return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array(k.astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "n"])


def _keyed(texts: DataFrame, head, keys_of) -> DataFrame:
    """(key, n): how often ``keys_of(head, places, classes)`` gives each key over all slices; tasks add up before the shuffle."""

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for _, _, ids, ptr in _tokens(batch):
                held.append(keys_of(head.value, *head.value.symbols(ids, ptr)).astype(np.int32))
                count += len(held[-1])
                if count > FLUSH:
                    yield _summed(held)
                    held, count = [], 0
        if count:
            yield _summed(held)

    return texts.select("text").mapInArrow(run, "key int, n long")


def _core_keys(head: Head, place: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """Adjacent symbols of which one is a core word; others are their suffix classes and the end."""
    core = np.where(place >= 0, head.core[place], -1) if len(head.core) else np.full(len(place), -1)
    sym = np.where(core >= 0, core, head.room + cls - CLASSES)
    left, right = sym[:-1], sym[1:]
    use = (left < head.room) | (right < head.room)
    return left[use] << 14 | right[use]


def _rest(texts: DataFrame, head) -> DataFrame:
    """(word, key, n): how often each word that is not core has a neighbour of a class (key & 127) after it or (key & 128) before it."""

    def summed(held):
        word, key = (np.concatenate(x) for x in zip(*held))
        names, at = np.unique(word, return_inverse=True)
        both, n = np.unique(at << 8 | key, return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(names[both >> 8]), pa.array((both & 255).astype(np.int16)), pa.array(n.astype(np.int32))], names=["word", "key", "n"])

    def run(batches):
        held, count = [], 0
        for batch in batches:
            for _, _, ids, ptr in _tokens(batch):
                place, cls = head.value.symbols(ids, ptr)
                rest = cls != _END_CLASS
                if len(head.value.core):
                    rest &= (place < 0) | (head.value.core[place] < 0)
                at = np.flatnonzero(rest)
                word = head.value.spread(ids, ptr)[at]
                held.append((np.concatenate([word, word]), np.concatenate([cls[at + 1], 128 | cls[at - 1]])))
                count += 2 * len(at)
                if count > FLUSH:
                    yield summed(held)
                    held, count = [], 0
        if count:
            yield summed(held)

    return texts.select("text").mapInArrow(run, "word long, key short, n int")


def _tail_steps(place: np.ndarray, cls: np.ndarray, word: np.ndarray):
    """Where a symbol or the next is a word beyond the head: positions, and (word, class) of both sides, words null within the head."""
    tail = (place < 0) & (cls != _END_CLASS)
    at = np.flatnonzero(tail[:-1] | tail[1:])
    name = lambda k: pa.array(word[k], mask=~tail[k])
    return at, [name(at), pa.array(cls[at].astype(np.int32)), name(at + 1), pa.array(cls[at + 1].astype(np.int32))]


_STEP = ["left", "lc", "right", "rc"]
_STEP_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32()]


def _with_classes(steps: DataFrame, tail: DataFrame) -> DataFrame:
    """``steps(left, lc, right, rc, ..)`` where either side is a word of ``tail(word, cls)``, with both classes after the exchange as la and ra."""
    to = lambda side, c: tail.select(F.col("word").alias(side), F.col("cls").alias(c))
    j = steps.join(to("left", "la"), "left", "left").join(to("right", "ra"), "right", "left")
    return j.where("la is not null or ra is not null").withColumns({"la": F.coalesce("la", "lc"), "ra": F.coalesce("ra", "rc")})


def _tail_pairs(texts: DataFrame, head, tail: DataFrame) -> np.ndarray:
    """What the words of ``tail`` change in the counts of adjacent class pairs."""

    def run(batches):
        for batch in batches:
            for _, _, ids, ptr in _tokens(batch):
                place, cls = head.value.symbols(ids, ptr)
                yield pa.RecordBatch.from_arrays(_tail_steps(place, cls, head.value.spread(ids, ptr))[1], names=_STEP)

    j = _with_classes(texts.select("text").mapInArrow(run, "left long, lc int, right long, rc int"), tail)
    out = np.zeros((_N_CLASSES, _N_CLASSES))
    # classes are few, so are pairs of pairs of classes
    was = j.groupBy("lc", "rc").agg(F.count("*").alias("n")).toArrow()
    now = j.groupBy("la", "ra").agg(F.count("*").alias("n")).toArrow()
    for got, sign in ((was, -1), (now, 1)):
        a, b, n = (got[i].to_numpy() for i in range(3))
        np.add.at(out, (a, b), sign * n)
    return out


def _class_keys(head: Head, place: np.ndarray, cls: np.ndarray) -> np.ndarray:
    return cls[:-1] * _N_CLASSES + cls[1:]


def class_pairs(texts: DataFrame, head) -> np.ndarray:
    """Counts of all adjacent class pairs."""
    out = np.zeros(_N_CLASSES * _N_CLASSES)
    got = _keyed(texts, head, _class_keys).groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out.reshape(_N_CLASSES, _N_CLASSES)


def _phi(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(joint: np.ndarray) -> float:
    """The part of the class bigram log-likelihood that classes decide."""
    return float(_phi(joint).sum() - _phi(joint.sum(axis=1)).sum() - _phi(joint.sum(axis=0)).sum())


def best_class(r: np.ndarray, l: np.ndarray, s: float, a: int, joint: np.ndarray) -> int:
    """The class to which a word of class ``a`` moves with the best gain in likelihood; ``a`` when none gains.

    r and l are the word's counts by class of the next and the previous symbol, s
    that beside itself; joint has the counts of class pairs.  Ties keep the lower
    class.
    """
    r, l = r.copy(), l.copy()
    r[a] -= s
    l[a] -= s
    base = joint.copy()
    base[a] -= r
    base[:, a] -= l
    base[a, a] -= s
    np.maximum(base, 0, out=base)
    # whatever class takes the word, its neighbours' sums hold their side of it
    rows, cols = (base.sum(axis=1) + l)[:CLASSES], (base.sum(axis=0) + r)[:CLASSES]
    gain = (_phi(base[:CLASSES] + r) - _phi(base[:CLASSES])).sum(axis=1) + (_phi(base[:, :CLASSES] + l[:, None]) - _phi(base[:, :CLASSES])).sum(axis=0)
    d = np.arange(CLASSES)
    x = base[d, d]  # the class beside itself, which both sums above have counted
    gain += _phi(x + r[:CLASSES] + l[:CLASSES] + s) - _phi(x + r[:CLASSES]) - _phi(x + l[:CLASSES]) + _phi(x)
    nr, nl = r.sum() + s, l.sum() + s
    gain -= _phi(rows + nr) - _phi(rows) + _phi(cols + nl) - _phi(cols)
    b = int(np.argmax(gain))
    return b if gain[b] > gain[a] + 1e-9 else a


def _around(pairs: DataFrame, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of each core word by class of the next and the previous symbol, and beside itself; ``pairs(key, n)``."""
    wide = CORE * _N_CLASSES

    def run(batches):
        total = np.zeros(2 * wide + CORE, dtype=np.int64)
        for batch in batches:
            key, n = (batch.column(c).to_numpy() for c in ("key", "n"))
            left, right = key >> 14, key & 16383
            a, b = left < CORE, right < CORE
            np.add.at(total, left[a].astype(np.int64) * _N_CLASSES + classes[right[a]], n[a])
            np.add.at(total, wide + right[b].astype(np.int64) * _N_CLASSES + classes[left[b]], n[b])
            same = a & (left == right)
            np.add.at(total, 2 * wide + left[same].astype(np.int64), n[same])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["key", "n"])

    # one row per core word, side and class at most: fixed in size
    got = pairs.mapInArrow(run, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(2 * wide + CORE)
    out[got["key"].to_numpy()] = got["n"].to_numpy()
    return out[:wide].reshape(CORE, _N_CLASSES), out[wide : 2 * wide].reshape(CORE, _N_CLASSES), out[2 * wide :]


def exchange(pairs: DataFrame, words: int) -> np.ndarray:
    """Classes of the core words, in order of frequency, of which there are ``words``.

    A pass moves every ``share``-th word, so that words side by side seldom move
    together; a pass that loses is taken back and ``share`` doubled.
    """
    classes = np.concatenate([np.zeros(CORE, dtype=np.int64), CLASSES + np.arange(SUFFIXES), [_END_CLASS]])
    classes[:words] = np.arange(words) % CLASSES
    best, kept, share, settled = -math.inf, classes, 2, 0
    for p in itertools.count():
        right, left, own = _around(pairs, classes)
        joint = np.zeros((_N_CLASSES, _N_CLASSES))
        np.add.at(joint, classes[:CORE], right)
        # pairs whose left side is no core word are seen from the right only
        outer = np.zeros((_N_CLASSES, _N_CLASSES))
        np.add.at(outer, classes[:CORE], left)
        joint[CLASSES:, :CLASSES] = outer.T[CLASSES:, :CLASSES]
        now = likelihood(joint)
        if now < best:
            classes, share = kept, 2 * share
            if share > 16:
                break
            continue
        settled = settled + 1 if now - best < SETTLED * abs(now) else 0
        best, kept = now, classes
        if settled == 2:
            break
        classes = classes.copy()
        for w in range(p % share, words, share):
            b = best_class(right[w], left[w], own[w], int(classes[w]), joint)
            if b != classes[w]:
                a, r, l, s = int(classes[w]), right[w].copy(), left[w].copy(), own[w]
                r[a] -= s
                l[a] -= s
                joint[a] -= r
                joint[b] += r
                joint[:, a] -= l
                joint[:, b] += l
                joint[a, a] -= s
                joint[b, b] += s
                np.maximum(joint, 0, out=joint)
                classes[w] = b
    return kept[:words]


def _placed(rest: DataFrame, head, joint: np.ndarray) -> DataFrame:
    """(word, cls, n, in_head) of the words that leave their suffix class, ``rest(word, key, n)`` being their neighbours.

    A word's gain in a class is the change of likelihood when its counts join the
    row and the column of that class, against those of its suffix class; it moves
    when the difference exceeds log ``CLASSES``.
    """
    grow = lambda j, r: _phi(j + r) - _phi(j)
    # by side: what n more of class c add to the row (column) of class d, for small n
    sides = [joint[:CLASSES].T.copy(), joint[:, :CLASSES].copy()]
    tables = [np.stack([grow(j, n) for n in range(SMALL + 1)]).astype(np.float32) for j in sides]
    rows, cols = joint.sum(axis=1), joint.sum(axis=0)
    back = [joint.T, joint]

    def move(batches):
        parts = [[b.column(c).to_numpy() for c in ("word", "key", "n")] for b in batches]
        if not parts:
            return
        word, key, n = (np.concatenate(x) for x in zip(*parts))
        words_, at = np.unique(word, return_inverse=True)
        key, at = np.unique(at << 8 | key, return_inverse=True)
        n = np.bincount(at, weights=n)
        cut = np.flatnonzero(np.append(True, key[1:] >> 8 != key[:-1] >> 8))
        for i, k in slices(np.append(cut, len(key)), 1 << 15):
            e = slice(cut[i], cut[k] if k < len(cut) else len(key))
            first = cut[i:k] - cut[i]
            names = words_[key[cut[i:k]] >> 8]
            side, c, m = key[e] >> 7 & 1, key[e] & 127, n[e]
            own = np.repeat(_suffix_class(names), np.diff(np.append(first, len(m))))
            gain = np.empty((len(m), CLASSES), dtype=np.float32)
            stay = np.empty(len(m))
            for s in (0, 1):
                few = np.flatnonzero((side == s) & (m <= SMALL))
                gain[few] = tables[s][m[few].astype(np.int64), c[few]]
                many = np.flatnonzero((side == s) & (m > SMALL))
                gain[many] = grow(sides[s][c[many]], m[many][:, None])
                here = np.flatnonzero(side == s)
                j = back[s][c[here], own[here]]
                stay[here] = _phi(j) - _phi(np.maximum(j - m[here], 0))
            total, stays = np.add.reduceat(gain, first, axis=0), np.add.reduceat(stay, first)
            times = np.add.reduceat(np.where(side == 0, m, 0), first)
            total = total - grow(rows[:CLASSES], times[:, None]) - grow(cols[:CLASSES], times[:, None])
            for side_sum in (rows, cols):
                j = side_sum[_suffix_class(names)]
                stays = stays - _phi(j) + _phi(np.maximum(j - times, 0))
            to = total.argmax(axis=1)
            go = total[np.arange(len(to)), to] - stays > math.log(CLASSES)
            yield pa.RecordBatch.from_arrays([pa.array(names[go]), pa.array(to[go].astype(np.int32)), pa.array(times[go].astype(np.int64)), pa.array(head.value.find(names[go]) >= 0)], names=["word", "cls", "n", "in_head"])

    return rest.repartition("word").mapInArrow(move, "word long, cls int, n long, in_head boolean")


def _joined(head: Head, tail: pa.Table) -> Head:
    """The head with the words of ``tail(word, cls, n)`` as well."""
    ids = np.concatenate([head.find.keys, tail["word"].to_numpy().astype(np.int64)])
    order = np.argsort(ids)
    both = lambda a, b: np.concatenate([a, b])[order]
    return replace(head, find=Lookup(ids[order]), n=both(head.n, tail["n"].to_numpy()), core=both(head.core, np.full(len(tail), -1)), classes=both(head.classes, tail["cls"].to_numpy().astype(np.int64)))


@dataclass
class Model:
    """What scoring needs: the head, log transitions, log room of each class, totals; ``tail(word, cls)`` are moved words beyond the head."""

    head: Head
    trans: np.ndarray
    room: np.ndarray
    tokens: int
    kinds: int
    ends: int
    tail: DataFrame | None = None


def learn(train: DataFrame, counts: DataFrame) -> Model:
    """The class model of ``train(text)``, whose word counts are ``counts``."""
    spark = train.sparkSession
    total = counts.agg(F.sum("n"), F.count("*"), F.sum(F.when(F.col("word") == END, F.col("n")))).first()
    head = head_of(counts)
    shared = spark.sparkContext.broadcast(head)
    pairs = materialise(_keyed(train, shared, _core_keys).groupBy("key").agg(F.sum("n").alias("n")))
    core = np.flatnonzero(head.core >= 0)
    classes = head.classes.copy()
    classes[core] = exchange(pairs, len(core))[head.core[core]]
    head = replace(head, classes=classes)
    tail = None
    if len(core) < len(classes):
        shared = spark.sparkContext.broadcast(head)
        moved = materialise(_placed(_rest(train, shared), shared, class_pairs(train, shared)))
        got = moved.where("in_head").toArrow()  # at most ``HEAD``
        head = replace(head, classes=classes.copy())
        head.classes[head.find(got["word"].to_numpy())] = got["cls"].to_numpy()
        tail = moved.where("not in_head").select("word", "cls", "n")
        if tail.limit(FEW + 1).count() <= FEW:
            head, tail = _joined(head, tail.toArrow()), None
    shared = spark.sparkContext.broadcast(head)
    joint = class_pairs(train, shared)
    if tail is not None:
        joint += _tail_pairs(train, shared, tail)
    trans = np.log10((joint + TRANSITION_PRIOR) / (joint.sum(axis=1, keepdims=True) + TRANSITION_PRIOR * _N_CLASSES))

    # tokens and distinct words of each class; those of the suffix classes from the whole table
    tokens, kinds = np.zeros(_N_CLASSES), np.zeros(_N_CLASSES)
    for c, t, k in counts.where(F.col("word") != END).groupBy(F.col("word").bitwiseAND(F.lit(SUFFIXES - 1)).alias("c")).agg(F.sum("n"), F.count("*")).collect():
        tokens[CLASSES + c], kinds[CLASSES + c] = t, k
    was = _suffix_class(head.find.keys)
    for sign, of in ((-1, was), (1, head.classes)):
        np.add.at(tokens, of, sign * head.n)
        np.add.at(kinds, of, sign)
    if tail is not None:
        for c, to, t, k in tail.groupBy(F.col("word").bitwiseAND(F.lit(SUFFIXES - 1)), "cls").agg(F.sum("n"), F.count("*")).collect():
            for sign, of in ((-1, CLASSES + c), (1, to)):
                tokens[of] += sign * t
                kinds[of] += sign * k
    return Model(head, trans, np.log10(tokens + kinds + 1), int(total[0] or 0), int(total[1]), int(total[2] or 0), tail)


def score_texts(docs: DataFrame, modulus: int = 7, remainder: int = 2) -> DataFrame:
    """Scores of each row of ``docs(doc_id, text)`` under a model learnt from the rows that are not held out.

    Returns doc_id, held_out, n_tokens (words and the end), n_known (tokens with
    a training count), train_tokens, base_score (add-one unigrams) and score
    (class bigrams), both as log10 probability of the text, and perplexity, that of
    the class model by token.  A null or empty text is its end token.  With no
    training rows all words are unknown and classes uniform.  Repeated rows stay
    rows; further columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), held_out(F.col("doc_id"), modulus, remainder).alias("held_out"))
    train = docs.where("not held_out")
    counts = materialise(word_counts(train))
    learnt = learn(train, counts)
    model = spark.sparkContext.broadcast((learnt.head, np.log10(learnt.head.n + 1.0), learnt.trans, learnt.room))
    base_room = math.log10(learnt.tokens + learnt.kinds + 1)
    end_log = math.log10(learnt.ends + 1)
    learnt_tail = learnt.tail is not None

    def run(batches):
        head, logn, trans, room = model.value
        start = _row_start()
        far = learnt_tail
        for batch in batches:
            if not batch.num_rows:
                continue
            n_tok, n_known, shared, moves, tw, tc = [], [], [], [], [], []
            steps, step_count = [], []
            for i, j, ids, ptr in _tokens(batch):
                place, c = head.symbols(ids, ptr)
                step = trans[c[:-1], c[1:]] - np.where(c[1:] == _END_CLASS, 0.0, room[c[1:]])
                row = np.repeat(np.arange(j - i), np.diff(ptr) + 1)
                words_row = np.repeat(np.arange(j - i), np.diff(ptr))
                known = place[1:][c[1:] != _END_CLASS]
                hit = known >= 0
                moves.append(np.bincount(row, weights=step, minlength=j - i))
                shared.append(np.bincount(words_row[hit], weights=logn[known[hit]], minlength=j - i))
                n_tok.append(np.diff(ptr) + 1)
                at, sides = _tail_steps(place, c, head.spread(ids, ptr)) if far else (np.zeros(0, int), [pa.array([], t) for t in _STEP_TYPES])
                steps.append(sides)
                step_count.append(np.bincount(row[at], minlength=j - i))
                n_known.append(np.bincount(words_row[hit], minlength=j - i))
                rare_ptr = np.concatenate([[0], np.cumsum(np.bincount(words_row[~hit], minlength=j - i))])
                rare = ids[~hit]
                for k in range(j - i):
                    w, m = np.unique(rare[rare_ptr[k] : rare_ptr[k + 1]], return_counts=True)
                    tw.append(w)
                    tc.append(m.astype(np.int32))
            lens = np.concatenate([[0], np.cumsum([len(x) for x in tw])]).astype(np.int32)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.concatenate(step_count))]).astype(np.int32))
            size = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(start + np.arange(size)),
                    batch.column("doc_id"),
                    batch.column("held_out"),
                    pa.array(np.concatenate(n_tok).astype(np.int64)),
                    pa.array(np.concatenate(n_known).astype(np.int64)),
                    pa.array(np.concatenate(shared)),
                    pa.array(np.concatenate(moves)),
                    pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(tw))),
                    pa.ListArray.from_arrays(pa.array(lens), pa.array(np.concatenate(tc))),
                    *(pa.ListArray.from_arrays(ends, pa.concat_arrays(x)) for x in zip(*steps)),
                ],
                names=["row", "doc_id", "held_out", "n_tokens", "n_head", "head_log", "moves", "rare", "times", *_STEP],
            )
            start += size

    scored = materialise(docs.mapInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_head long, head_log double, moves double, rare array<long>, times array<int>, left array<long>, lc array<int>, right array<long>, rc array<int>"))
    rare = scored.where(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("x")).select("row", F.col("x.rare").alias("word"), F.col("x.times").alias("times"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum("times").alias("n_rare"), F.sum(F.col("times") * F.log10(F.col("n") + 1)).alias("rare_log"))
    if learnt_tail:
        # words beyond the head that left their suffix class change the steps beside them

        def changed(batches):
            _, _, trans, room = model.value
            step = trans - np.append(room[:_END_CLASS], 0.0)
            for batch in batches:
                lc, rc, la, ra = (batch.column(x).to_numpy() for x in ("lc", "rc", "la", "ra"))
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(step[la, ra] - step[lc, rc])], names=["row", "by"])

        steps = scored.where(F.size("left") > 0).select("row", F.explode(F.arrays_zip(*_STEP)).alias("x")).select("row", "x.*")
        by = _with_classes(steps, learnt.tail).select("row", "lc", "rc", "la", "ra").mapInArrow(changed, "row long, by double")
        scored = scored.join(by.groupBy("row").agg(F.sum("by").alias("by")), "row", "left").withColumn("moves", F.col("moves") + F.coalesce("by", F.lit(0.0)))
    words_log = F.col("head_log") + F.coalesce("rare_log", F.lit(0.0))
    score = words_log + F.col("moves")
    return scored.join(rare, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_head") + F.coalesce("n_rare", F.lit(0)) + F.lit(1 if learnt.ends else 0)).cast("long").alias("n_known"),
        F.lit(learnt.tokens).cast("long").alias("train_tokens"),
        (words_log + F.lit(end_log) - F.col("n_tokens") * F.lit(base_room)).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def _row_start() -> int:
    """Row numbers of a task: its partition above, a running number below."""
    from pyspark import TaskContext

    return TaskContext.get().partitionId() << 33
