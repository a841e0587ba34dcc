"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment.

A document is aligned with a test item around the item's seeds; word matches,
mismatches and gaps are scored, so edits and insertions cost a little and a copy
remains a copy.  Seeds are taken rarest first, by counts over all documents, until
no passage that reaches the least score can be without one:

* A passage of score S with m matched words has at most 2m - S other steps, so its
  matches lie in at most 2m - S + 1 runs, and those hold at least 2S - 3m - 2
  n-grams of three words of the item.
* So a passage holds ``q`` of the item's n-grams, and thus one of all but the
  ``q - 1`` most frequent; or it matches at least (2S - 1 - q) / 3 of the item's
  words, and thus ``SEED_HITS`` of as many of its rarest words as make that certain.

What the seeds find is bounded from above before it is aligned: each word of a
passage adds a match if the item has it, else it costs one.  All bounds are exact,
so no passage at or above the least coverage is lost.

Items are the query set: they are taken in blocks of ``BLOCK_WORDS`` words, whose
counts and seeds pass through the driver, so that the number of items bounds nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise
from .textarrays import shingles, slices, utf8, words

SEED_WORDS = 3
SEED_HITS = 4
MATCH, MISMATCH, GAP = 2, -1, -1
MIN_COVERAGE = 0.5
BLOCK_WORDS = 2_000_000
PIECE_HITS = 1_000_000


class Keys:
    """Sorted hashes, looked up in arrays of hashes."""

    def __init__(self, hashes: np.ndarray):
        self.keys = np.unique(hashes)
        # a table over 22 hash bits of the keys, to dismiss most hashes at once
        self.slot = np.zeros(1 << 22, dtype=bool)
        self.slot[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in ``h`` that hold a key, and the keys' numbers."""
        if not len(self.keys):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.slot[(h >> np.uint64(42)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[at]), len(self.keys) - 1)
        ok = self.keys[k] == h[at]
        return at[ok], k[ok]


class Seeds(Keys):
    """Hashes with, for each, its places (item, position) in the items."""

    def __init__(self, hashes: np.ndarray, item: np.ndarray, place: np.ndarray):
        super().__init__(hashes)
        order = np.argsort(hashes, kind="stable")
        self.item, self.place = item[order], place[order]
        self.first = np.searchsorted(hashes[order], self.keys)
        self.last = np.append(self.first[1:], len(hashes)) if len(self.keys) else self.first

    def hits(self, h: np.ndarray, ptr: np.ndarray):
        """(row, item, position in the row, place in the item) arrays of what rows share with items, by groups of rows."""
        at, k = self.find(h)
        if not len(at):
            return
        row = np.searchsorted(ptr, at, side="right") - 1
        n = len(ptr) - 1
        total = np.zeros(n + 1, dtype=np.int64)
        np.add.at(total, row + 1, self.last[k] - self.first[k])
        bound = np.searchsorted(row, np.arange(n + 1))
        for x, y in slices(np.cumsum(total), PIECE_HITS):
            part = slice(bound[x], bound[y])
            many = self.last[k[part]] - self.first[k[part]]
            entry = np.repeat(self.first[k[part]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            where = np.repeat(row[part], many)
            yield where, self.item[entry], np.repeat(at[part], many) - ptr[where], self.place[entry]


class Items:
    """Test items as word hashes, with the bounds that a passage of the least coverage keeps."""

    def __init__(self, block: list[tuple[int, str]], min_coverage: float):
        self.names = [i for i, _ in block]
        buf, off = utf8(pa.array([t for _, t in block], pa.string()))
        self.words: list[np.ndarray] = []
        self.grams: list[np.ndarray] = []
        for i, j in slices(off):
            w = words(buf, off[i : j + 1])
            sh, ptr = shingles(w, SEED_WORDS)
            for r in range(j - i):
                x = w.hash[w.indptr[r] : w.indptr[r + 1]]
                self.words.append(x)
                self.grams.append(sh[ptr[r] : ptr[r + 1]] if len(x) >= SEED_WORDS else np.zeros(0, np.uint64))
        size = [len(x) for x in self.words]
        self.size = np.array(size, dtype=np.int64)
        least = [max(1, math.ceil(min_coverage * MATCH * n - 1e-9)) if n >= SEED_WORDS else MATCH * n for n in size]
        self.least = np.array(least, dtype=np.int64)
        # the longest passage of a document: all words of the item, and as many other steps as the score allows
        self.span = self.size + np.maximum(0, MATCH * self.size - self.least)
        self.grams_needed = np.array([1 + len(g) // 8 for g in self.grams], dtype=np.int64)
        some = -(-self.least // 2)
        self.words_needed = np.maximum(np.maximum(1, some), -(-(2 * self.least - 1 - self.grams_needed) // 3))
        self.hits_needed = np.minimum(SEED_HITS, self.words_needed)

    def keys(self) -> tuple[Keys, Keys]:
        return tuple(Keys(np.concatenate([np.zeros(0, np.uint64), *x])) for x in (self.words, self.grams))

    def choose(self, word_keys: Keys, word_count: np.ndarray, gram_keys: Keys, gram_count: np.ndarray) -> None:
        """The seeds, rarest first, given how often each word and n-gram occurs in the documents."""

        def rarest(hashes, keys, count, take):
            out = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, h in enumerate(hashes):
                if not len(h):
                    continue
                place = np.argsort(count[np.searchsorted(keys.keys, h)], kind="stable")[: take(i, len(h))]
                for got, x in zip(out, (h[place], np.full(len(place), i), place)):
                    got.append(x)
            return Seeds(*(np.concatenate(x) for x in out))

        self.gram_seeds = rarest(self.grams, gram_keys, gram_count, lambda i, n: n - self.grams_needed[i] + 1)
        self.word_seeds = rarest(self.words, word_keys, word_count, lambda i, n: max(0, n - self.words_needed[i] + self.hits_needed[i]))

    def windows(self, w, sh: np.ndarray, ptr: np.ndarray):
        """(row, item, first word, end word, words needed): places that may hold a passage, those of a row and item joined where they meet."""
        for row, item, pos, place in self.gram_seeds.hits(sh, ptr):
            extra = self.span[item] - self.size[item]
            yield from _joined(row, item, pos - place - extra, pos - place + self.span[item], w, -(-self.least // 2))
        for row, item, pos, _ in self.word_seeds.hits(w.hash, w.indptr):
            order = np.lexsort((pos, item, row))
            row, item, pos = row[order], item[order], pos[order]
            one = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (pos[1:] != pos[:-1]))
            row, item, pos = row[one], item[one], pos[one]
            first = np.arange(len(row))
            last = first + self.hits_needed[item] - 1
            near = last < len(row)
            first, last = first[near], last[near]
            near = (row[first] == row[last]) & (item[first] == item[last]) & (pos[last] - pos[first] < self.span[item[first]])
            first, last = first[near], last[near]
            span = self.span[item[first]]
            yield from _joined(row[first], item[first], pos[last] - span + 1, pos[first] + span, w, self.words_needed)


def _joined(row, item, start, end, w, needed):
    """Ranges of words as in ``Items.windows``, cut to their rows; overlapping ones of a row and item become one."""
    start = np.maximum(0, start)
    end = np.minimum(w.indptr[row + 1] - w.indptr[row], end)
    order = np.lexsort((start, item, row))
    row, item, start, end = row[order], item[order], start[order], end[order]
    if not len(row):
        return
    fresh = np.append(True, (row[1:] != row[:-1]) | (item[1:] != item[:-1]))
    group = np.cumsum(fresh)
    reach = group * (1 << 40) + end
    reach = np.maximum.accumulate(reach)
    cut = fresh.copy()
    cut[1:] |= group[1:] * (1 << 40) + start[1:] > reach[:-1]
    a = np.flatnonzero(cut)
    b = np.append(a[1:], len(row)) - 1
    yield from zip(row[a].tolist(), item[a].tolist(), start[a].tolist(), (reach[b] - group[b] * (1 << 40)).tolist(), needed[item[a]].tolist())


def align(doc: np.ndarray, item: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman score of two word sequences and the start and end of the best local alignment in ``doc``.

    A row of the matrix at a time; the gap along a row is a running maximum.
    """
    m = len(doc)
    step = GAP * np.arange(m + 1)
    prev = np.zeros(m + 1, dtype=np.int64)
    origin = np.arange(m + 1)
    best, best_at, best_from = 0, 0, 0
    for w in item:
        diag = prev[:-1] + np.where(doc == w, MATCH, MISMATCH)
        up = prev[1:] + GAP
        now = np.zeros(m + 1, dtype=np.int64)
        src = np.arange(m + 1)
        now[1:] = np.maximum(0, np.maximum(diag, up))
        src[1:] = np.where(now[1:] == 0, src[1:], np.where(diag >= up, origin[:-1], origin[1:]))
        flat = now - step
        peak = np.maximum.accumulate(flat)
        lead = np.maximum.accumulate(np.where(flat == peak, np.arange(m + 1), 0))
        spread = peak + step
        better = spread > now
        now = np.where(better, spread, now)
        src = np.where(better, src[lead], src)
        k = int(np.argmax(now))
        if now[k] > best:
            best, best_at, best_from = int(now[k]), k, int(src[k])
        prev, origin = now, src
    return best, best_from, best_at


def _places(text: np.ndarray, item: np.ndarray, needed: int, least: int, span: int):
    """Ranges of ``text`` that may hold a passage: ``needed`` words of the item within ``span``, and words enough to score ``least``."""
    has = np.isin(text, item)
    n = len(text)
    total = np.concatenate([[0], np.cumsum(has)])
    start = np.flatnonzero(total[np.minimum(np.arange(n) + span, n)] - total[:-1] >= needed)
    if not len(start):
        return
    worth = np.concatenate([[0], np.cumsum(np.where(has, MATCH, MISMATCH))])
    cut = np.flatnonzero(np.append(True, np.diff(start) > span))
    for a, b in zip(start[cut].tolist(), start[np.append(cut[1:], len(start)) - 1].tolist()):
        b = min(n, b + span)
        part = worth[a : b + 1]
        if (part - np.minimum.accumulate(part)).max() >= least:
            yield a, b


def _item_blocks(items: DataFrame):
    """Items (id, text) in blocks of at most ``BLOCK_WORDS`` words, read one block at a time."""
    block, total = [], 0
    rows = items.select(F.col("item_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).where("item_id is not null")
    for r in rows.orderBy("item_id", "text").toLocalIterator():
        n = r["text"].count(" ") + 1
        if block and total + n > BLOCK_WORDS:
            yield block
            block, total = [], 0
        block.append((r["item_id"], r["text"]))
        total += n
    if block:
        yield block


def _occurrences(docs: DataFrame, parts: tuple[Keys, Keys]) -> list[np.ndarray]:
    """How often the words and the n-grams of a block of items occur in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def run(batches):
        parts = shared.value
        count = [np.zeros(len(p.keys), dtype=np.int64) for p in parts]
        for batch in batches:
            buf, off = utf8(batch.column("text"))
            for i, j in slices(off):
                w = words(buf, off[i : j + 1])
                for c, p, h in zip(count, parts, (w.hash, shingles(w, SEED_WORDS)[0])):
                    c += np.bincount(p.find(h)[1], minlength=len(c))
        for part, c in enumerate(count):
            at = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), part, np.int32)), pa.array(at), pa.array(c[at])], names=["part", "key", "n"])

    sums = docs.select("text").mapInArrow(run, "part int, key long, n long").groupBy("part", "key").agg(F.sum("n").alias("n")).toArrow()
    out = [np.zeros(len(p.keys), dtype=np.int64) for p in parts]
    part, key, n = (sums.column(c).to_numpy() for c in ("part", "key", "n"))
    for p, o in enumerate(out):
        o[key[part == p]] = n[part == p]
    return out


def contaminated(docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """(doc_id, item_id, score, coverage, first_word, last_word): passages of test items in documents.

    ``docs(doc_id, text)`` and ``items(item_id, text)``; score is the best local
    alignment in the document, coverage its share of the item's own score, and
    rows below ``min_coverage`` are left out; none at or above it is.  Words are
    ASCII lower-cased; first_word and last_word bound the passage in the document
    (from 0, end exclusive).  An item shorter than ``SEED_WORDS`` words counts only
    where all of it is found in a row, as half of it would be any word.  Null or
    empty texts and null items match nothing; a row of ``docs`` repeated gives its
    rows again.  The documents are read twice a block of items, first for counts.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    schema = "doc_id long, item_id long, score int, coverage double, first_word int, last_word int"
    found = None
    for block in _item_blocks(items):
        about = Items(block, min_coverage)
        word_keys, gram_keys = about.keys()
        word_count, gram_count = _occurrences(docs, (word_keys, gram_keys))
        about.choose(word_keys, word_count, gram_keys, gram_count)
        about.grams = []
        shared = spark.sparkContext.broadcast(about)

        def run(batches, shared=shared):
            about = shared.value
            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                out = []
                buf, off = utf8(batch.column("text"))
                for i, j in slices(off):
                    w = words(buf, off[i : j + 1])
                    best: dict[tuple[int, int], tuple[int, int, int]] = {}
                    for r, it, lo, hi, needed in about.windows(w, *shingles(w, SEED_WORDS)):
                        text, target, least = w.hash[w.indptr[r] + lo : w.indptr[r] + hi], about.words[it], int(about.least[it])
                        for x, y in _places(text, target, needed, least, int(about.span[it])):
                            s, a, b = align(text[x:y], target)
                            if s >= least and (s, -lo - x - a) > best.get((r, it), (0, 0, 0))[:2]:
                                best[r, it] = (s, -lo - x - a, lo + x + b)
                    out += [(ids[i + r], about.names[it], s, s / (MATCH * len(about.words[it])), -a, b) for (r, it), (s, a, b) in sorted(best.items())]
                cols = list(zip(*out)) if out else [[]] * 6
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["doc_id", "item_id", "score", "coverage", "first_word", "last_word"])

        part = docs.mapInArrow(run, schema)
        found = part if found is None else found.unionByName(part)
    return found if found is not None else spark.createDataFrame([], schema)


def decontaminate(docs: DataFrame, items: DataFrame, min_coverage: float = MIN_COVERAGE) -> DataFrame:
    """Documents without a passage of a test item; columns of ``docs``, null ids stay."""
    leaks = materialise(contaminated(docs, items, min_coverage).where("doc_id is not null").select(F.col("doc_id").alias("_leak")).distinct())
    return docs.join(leaks, docs["doc_id"].cast("long") == leaks["_leak"], "left_anti").select(*docs.columns)
