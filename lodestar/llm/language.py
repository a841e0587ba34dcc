"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are (language, bucket) sums that Spark adds up; the model is a
matrix of log-probabilities, ``2 ** BITS`` rows by at most ``LANGUAGES`` columns,
of 32 MB at most, and is broadcast.  A batch is scored as a sparse product: bucket
ids in row order against the matrix, summed per row.  More languages than that are
taken in blocks, each trained and scored on its own, and a document's best and its
posterior are put together from those of the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import materialise
from .textarrays import mix, slices

BITS = 14
ORDERS = (2, 3)
UNKNOWN = "und"
LANGUAGES = 512
_LETTER = regex.compile(r"\p{L}")
_SLICE_CHARS = 1 << 18


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """True where crc32 of the id's decimal text has this remainder; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket ids of all n-grams of these texts, and row pointers.

    Texts are lower-cased and framed by a space; runs without letters, digits'
    runs included, become one space.
    """
    plain = [" " + t.lower() + " " for t in texts]
    codes = np.frombuffer("".join(plain).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = np.cumsum([len(t) for t in plain])
    letter = (codes > 191) | ((codes >= 97) & (codes <= 122))
    letter &= (codes != 0xD7) & (codes != 0xF7) & ~((codes >= 0x2000) & (codes <= 0x206F))
    keep = letter.copy()
    keep[0] = True
    keep[1:] |= letter[:-1]
    keep[np.concatenate([[0], ends[:-1]])] = True
    x = np.where(letter, codes, 32)[keep].astype(np.uint64)
    counts = np.concatenate([[0], np.cumsum(keep)])[ends]
    row_end = np.repeat(counts, np.diff(np.concatenate([[0], counts])))
    ids, rows = [], []
    row = np.repeat(np.arange(len(texts)), np.diff(np.concatenate([[0], counts])))
    at = np.arange(len(x))
    for n in ORDERS:
        if len(x) < n:
            continue
        h = np.full(len(x) - n + 1, n, dtype=np.uint64)
        for k in range(n):
            h = h * np.uint64(1_000_003) + x[k : len(x) - n + 1 + k]
        ok = at[: len(h)] + n <= row_end[: len(h)]
        ids.append((mix(h[ok]) & np.uint64((1 << BITS) - 1)).astype(np.int32))
        rows.append(row[: len(h)][ok])
    if not ids:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(rows)


def _text_slices(texts: list[str]):
    lens = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    yield from slices(lens, _SLICE_CHARS)


def _blocks(docs: DataFrame) -> Iterator[list[str]]:
    """The languages of ``docs(lang)`` by code point, at most ``LANGUAGES`` at a time; null is none."""
    block: list[str] = []
    for r in docs.where("lang is not null").select(F.col("lang").cast("string").alias("lang")).distinct().orderBy("lang").toLocalIterator():
        block.append(r["lang"])
        if len(block) == LANGUAGES:
            yield block
            block = []
    if block:
        yield block


def train(docs: DataFrame, names: list[str]) -> np.ndarray:
    """The log-probability matrix of the languages ``names``, in code-point order, from ``docs(text, lang)``.

    ``names`` are all languages of ``docs`` from the first to the last of them; a
    language whose texts have no n-gram keeps even probabilities.
    """
    size = 1 << BITS

    def run(batches):
        number = {name: k for k, name in enumerate(names)}
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            langs = np.array([number[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for i, j in _text_slices(texts):
                ids, row = _grams(texts[i:j])
                here, code = np.unique(langs[i:j], return_inverse=True)
                got = np.bincount(code[row] * size + ids, minlength=len(here) * size).reshape(len(here), size)
                for k, x in zip(here.tolist(), got):
                    sums[k] = sums[k] + x if k in sums else x
        for k, x in sums.items():
            at = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(x[at].astype(np.int64))], names=["language", "bucket", "n"])

    rows = docs.select(F.col("text").cast("string"), F.col("lang").cast("string")).where(F.col("lang").between(names[0], names[-1]))
    sums = rows.mapInArrow(run, "language int, bucket int, n long").groupBy("language", "bucket").agg(F.sum("n").alias("n"))
    # the block's model, and no more, comes to the driver
    got = sums.toArrow()
    counts = np.zeros((size, len(names)))
    counts[got["bucket"].to_numpy(), got["language"].to_numpy()] = got["n"].to_numpy()
    logp = np.log(counts + 0.5) - np.log(counts.sum(axis=0) + 0.5 * size)
    return logp.astype(np.float32)


def _scored(text: Column, names: list[str], logp: np.ndarray, spark: SparkSession) -> Column:
    """struct(lang_pred, total, mass): the most probable of these languages, its log-probability, and the sum of all
    their probabilities as a multiple of it.

    A null text or a text without a letter gives ``und`` and a mass of 0.  Ties go
    to the first language by code point.  Only the text goes to Python.
    """
    model = spark.sparkContext.broadcast((names, logp))

    def run(column):
        names, logp = model.value
        texts = [t or "" for t in column]
        best, total, mass = [], [], []
        for i, j in _text_slices(texts):
            ids, row = _grams(texts[i:j])
            sums = np.stack([np.bincount(row, weights=logp[ids, k], minlength=j - i) for k in range(len(names))], axis=1)
            for t, x in zip(texts[i:j], sums):
                k = int(np.argmax(x))
                known = bool(_LETTER.search(t))
                best.append(names[k] if known else UNKNOWN)
                total.append(float(x[k]) if known else 0.0)
                mass.append(float(np.exp(np.minimum(x - x[k], 0)).sum()) if known else 0.0)
        return pd.DataFrame({"lang_pred": pd.Series(best, dtype=object), "total": np.array(total, dtype=float), "mass": np.array(mass, dtype=float)})

    return F.pandas_udf(run, "lang_pred string, total double, mass double")(text.cast("string"))


def with_language(docs: DataFrame, training: DataFrame) -> DataFrame:
    """(doc, lang_pred, score): each row of ``docs`` as a struct, its most probable language and its posterior under equal priors.

    Learnt from ``training(text, lang)``; rows without a lang teach nothing.  A
    null text, a text without a letter, or an untrained model gives ``und`` and 0.0.
    """
    spark = docs.sparkSession
    doc, text = F.struct(*docs.columns).alias("doc"), F.col("text").cast("string")
    blocks = _blocks(training)
    names = next(blocks, None)
    if names is None:
        return docs.select(doc, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    told = _scored(text, names, train(training, names), spark)
    more = next(blocks, None)
    if more is None:
        scored = docs.select(doc, told.alias("told"))
        return scored.select("doc", "told.lang_pred", F.when(F.col("told.mass") > 0, 1 / F.col("told.mass")).otherwise(0.0).alias("score"))
    rows = materialise(docs.select(doc, F.monotonically_increasing_id().alias("row")))
    text = F.col("doc.text").cast("string")
    parts = None
    for k, names in enumerate(chain([names, more], blocks)):
        told = _scored(text, names, train(training, names), spark)
        part = rows.select("row", told.alias("told")).select("row", F.struct("told.total", F.lit(-k).alias("order"), "told.lang_pred", "told.mass").alias("part"))
        parts = part if parts is None else parts.unionByName(part)
    # a row meets one part of each block
    best = parts.groupBy("row").agg(F.max("part").alias("best"), F.collect_list("part").alias("parts"))
    mass = F.aggregate("parts", F.lit(0.0), lambda a, p: a + p["mass"] * F.exp(p["total"] - F.col("best.total")))
    best = best.select("row", "best.lang_pred", F.when(F.col("best.mass") > 0, 1 / mass).otherwise(0.0).alias("score"))
    return rows.join(best, "row").select("doc", "lang_pred", "score")


def predict_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learnt from rows whose crc32(doc_id) mod 3 is not 1, given for all."""
    docs = docs.select("doc_id", F.col("text").cast("string"), F.col("lang").cast("string"), held_out(F.col("doc_id"), 3, 1).alias("held_out"))
    told = with_language(docs.select("doc_id", "text", "held_out"), docs.where("not held_out"))
    return told.select("doc.doc_id", "doc.held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """Documents whose language can be told: not ``und``, and a posterior of ``min_score`` at least; columns of ``docs``."""
    told = with_language(docs, docs.where(~held_out(F.col("doc_id"), 3, 1)))
    return told.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score)).select("doc.*")
