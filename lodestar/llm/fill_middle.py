"""Fill-in-the-middle: texts cut at line ends into prefix, middle and suffix, and put in another order.

Cuts are found eight bytes at a time.  The UTF-8 of many texts is viewed as
uint64 words; plain arithmetic on a word sets a bit in each byte that ends a
line, ``bitwise_count`` counts them, a running sum over the words finds the word
of the k-th end and a multiplication the byte inside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textarrays import slices, utf8

SEED = 7
RATE, SPM = 100, 50  # of a hundred: texts that are transformed, and of these the share with the suffix first
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SLICE = 1 << 22
_ONES = np.uint64(0x0101010101010101)
_LOW7 = np.uint64(0x7F7F7F7F7F7F7F7F)
_HIGH = np.uint64(0x8080808080808080)


def words_of(raw: np.ndarray) -> np.ndarray:
    """Bytes as little-endian words, zeros at the end, and one word of zeros after it."""
    padded = np.zeros((len(raw) // 8 + 2) * 8, dtype=np.uint8)
    padded[: len(raw)] = raw
    return padded.view("<u8")


def line_ends(words: np.ndarray) -> np.ndarray:
    """The lowest bit of each byte that is a line feed."""
    x = words ^ (np.uint64(10) * _ONES)
    return (~(((x & _LOW7) + _LOW7) | x | _LOW7)) >> np.uint64(7)


def inner_bytes(words: np.ndarray) -> np.ndarray:
    """The lowest bit of each byte that continues a code point."""
    return (words >> np.uint64(7)) & ~(words >> np.uint64(6)) & _ONES


class Marks:
    """Marked bytes of a buffer, by number and by place."""

    def __init__(self, marks: np.ndarray):
        self.marks = marks
        self.upto = np.zeros(len(marks) + 1, dtype=np.int64)
        np.cumsum(np.bitwise_count(marks), out=self.upto[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Marked bytes before each place."""
        word = at >> 3
        below = (np.uint64(1) << ((at & 7) * 8).astype(np.uint64)) - np.uint64(1)
        return self.upto[word] + np.bitwise_count(self.marks[word] & below)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Place of the k-th marked byte, from 1."""
        word = np.searchsorted(self.upto, k, side="left") - 1
        rest = (k - self.upto[word]).astype(np.uint64)
        running = self.marks[word] * _ONES  # byte i: marks in bytes 0 to i
        reached = ((running | _HIGH) - rest * _ONES) & _HIGH
        return word * 8 + 8 - np.bitwise_count(reached)


def cuts(raw: np.ndarray, start: np.ndarray, end: np.ndarray, h1: np.ndarray, h2: np.ndarray):
    """(n, first, second, prefix_chars, middle_chars): lines of each text, the bytes where its two cuts are, and code points."""
    words = words_of(raw)
    lines, inner = Marks(line_ends(words)), Marks(inner_bytes(words))
    before = lines.rank(start)
    whole = lines.rank(end) - before
    open_end = (end > start) & (raw[np.maximum(end - 1, 0)] != 10) if len(raw) else np.zeros(len(start), bool)
    n = whole + open_end
    x, y = h1 % (n + 1), h2 % (n + 1)
    places = []
    for k in (np.minimum(x, y), np.maximum(x, y)):
        at = start.copy()
        inside = (k > 0) & (k <= whole)
        at[inside] = lines.select((before + k)[inside]) + 1
        at[k > whole] = end[k > whole]
        places.append(at)
    first, second = places
    a, b, c = inner.rank(start), inner.rank(first), inner.rank(second)
    return n, first, second, first - start - (b - a), second - first - (c - b)


def fill_in_middle(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): each whole text of ``docs(doc_id, text)`` transformed.

    A text of n lines is cut after a and after b of them, a <= b, both taken from
    the hash of seed and doc_id.  ``psm`` is prefix, suffix, middle, each behind
    its mark; ``spm`` the same with the suffix first.  ``plain`` texts stay as
    they are: empty ones (null counts as empty), those that hold a mark, since
    they could not be restored, and those beyond ``rate`` of a hundred; their
    character counts are null.  A null doc_id hashes as an empty one.  Rows stand
    for themselves, so repeats come out repeated; other columns are not read.
    """
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    part = [F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks

    def run(batches):
        for batch in batches:
            buf, off = utf8(batch.column(1))
            for i, j in slices(off, SLICE):
                raw = buf[off[i] : off[j]]
                start, end = off[i:j] - off[i], off[i + 1 : j + 1] - off[i]
                h1, h2, h3, h4 = (batch.column(c).to_numpy()[i:j] for c in range(2, 6))
                n, first, second, before, between = cuts(raw, start, end, h1, h2)
                data, form, out = raw.tobytes(), [], []
                for r in range(j - i):
                    text = data[start[r] : end[r]]
                    if not text or h3[r] % 100 >= rate or any(x in text for x in marks):
                        form.append("plain")
                        out.append(text)
                        continue
                    a, b = first[r] - start[r], second[r] - start[r]
                    first_suffix = h4[r] % 100 < spm
                    form.append("spm" if first_suffix else "psm")
                    out.append(b"".join((s, text[b:], p, text[:a], m, text[a:b]) if first_suffix else (p, text[:a], s, text[b:], m, text[a:b])))
                plain = np.array([f == "plain" for f in form], dtype=bool)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        pa.array(n, pa.int64()),
                        pa.array(form, pa.string()),
                        pa.array(before, pa.int64(), mask=plain),
                        pa.array(between, pa.int64(), mask=plain),
                        pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    schema = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *part).mapInArrow(run, schema)


def restore(output: Column, form: Column) -> Column:
    """The text that ``fill_in_middle`` was given; a mark stands once in an output, so splitting at it is exact."""
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    cut = lambda x, mark, k: F.substring_index(x, mark, k)
    psm = F.concat(cut(rest, SUFFIX, 1), cut(rest, MIDDLE, -1), cut(cut(rest, MIDDLE, 1), SUFFIX, -1))
    spm = F.concat(cut(cut(rest, MIDDLE, 1), PREFIX, -1), cut(rest, MIDDLE, -1), cut(rest, PREFIX, 1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def fim_report(docs: DataFrame) -> DataFrame:
    """``fill_in_middle`` with digests of the output and of the text restored from it."""
    t = fill_in_middle(docs)
    return t.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("output"), F.col("form")), 256).alias("restored_sha256"))
