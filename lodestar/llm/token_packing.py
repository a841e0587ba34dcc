"""Token ids in packed binary matrices.

Texts are tokenised in their partition and packed there into rows of ``length``
ids by best-fit decreasing: pieces from the longest down, each into the open row
with the least room that holds it, found by a segment tree over capacities.  A
text longer than a row is split into full rows and a rest, so no id is lost.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textarrays import pieces_of

VOCABULARY = "byte_bpe_50k.tiktoken"
LENGTH = 2048
END_ID = 50256
SHARD_TOKENS = 1_000_000
PIECE_BYTES = 4 << 20


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where a public vocabulary file is; every machine has the package."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@lru_cache(maxsize=2)
def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("packed", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


class Capacities:
    """Open rows by room left; a segment tree over rooms 0..size gives the least room that is enough."""

    def __init__(self, size: int):
        self.base = 1
        while self.base <= size:
            self.base *= 2
        self.count = [0] * (2 * self.base)
        self.rows: list[list[int]] = [[] for _ in range(size + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.base + room
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove and return (room, row) with the least room of ``need`` at least."""
        i, count = self.base + need, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.base
        row = self.rows[room].pop()
        while i:
            count[i] -= 1
            i >>= 1
        return room, row


def best_fit_decreasing(lengths: list[int], size: int) -> list[list[int]]:
    """Rows of item numbers, each row at most ``size`` long; items of one length in order."""
    open_, rows = Capacities(size), []
    for i in sorted(range(len(lengths)), key=lambda k: (-lengths[k], k)):
        got = open_.take(lengths[i])
        if got is None:
            room, row = size, len(rows)
            rows.append([])
        else:
            room, row = got
        rows[row].append(i)
        if room > lengths[i]:
            open_.add(room - lengths[i], row)
    return rows


_SCHEMA = "shard long, row int, doc_ids array<long>, doc_offsets array<int>, cu_seqlens array<int>, position_resets array<int>, n_tokens int, ids binary"


def pack_tokens(docs: DataFrame, path: str | None = None, length: int = LENGTH, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Packed rows of the texts of ``docs(doc_id, text)``.

    A row has ``length`` little-endian 32-bit ids, padded by ``end_id``; the ids
    of a text are followed by one ``end_id``, so a null or empty text is that one
    id.  cu_seqlens are the cumulative piece lengths from 0; positions restart at
    0 at each of position_resets; doc_ids names each piece's document and
    doc_offsets where in its ids the piece begins.  Repeated rows are packed each;
    null ids stay null; further columns are ignored.  A shard is a run of a
    partition's texts of about ``shard_tokens`` ids, which bounds memory; a
    partition keeps its shards apart, so nothing is shuffled.
    """
    path = path or vocabulary_path()

    def rows_of(shard, ids, texts):
        pieces = []
        for k, t in enumerate(texts):
            pieces += [(k, a, min(len(t), a + length)) for a in range(0, len(t), length)]
        packed = best_fit_decreasing([b - a for _, a, b in pieces], length)
        out = {c: [] for c in ("doc_ids", "doc_offsets", "cu", "resets", "n", "ids")}
        for row in packed:
            line = np.full(length, end_id, dtype="<i4")
            cu = [0]
            for p in row:
                k, a, b = pieces[p]
                line[cu[-1] : cu[-1] + b - a] = texts[k][a:b]
                cu.append(cu[-1] + b - a)
            out["doc_ids"].append([ids[pieces[p][0]] for p in row])
            out["doc_offsets"].append([pieces[p][1] for p in row])
            out["cu"].append(cu)
            out["resets"].append(cu[:-1])
            out["n"].append(cu[-1])
            out["ids"].append(line.tobytes())
        m = len(packed)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([shard] * m, pa.int64()),
                pa.array(range(m), pa.int32()),
                pa.array(out["doc_ids"], pa.list_(pa.int64())),
                pa.array(out["doc_offsets"], pa.list_(pa.int32())),
                pa.array(out["cu"], pa.list_(pa.int32())),
                pa.array(out["resets"], pa.list_(pa.int32())),
                pa.array(out["n"], pa.int32()),
                pa.array(out["ids"], pa.binary()),
            ],
            names=["shard", "row", "doc_ids", "doc_offsets", "cu_seqlens", "position_resets", "n_tokens", "ids"],
        )

    def run(batches):
        from pyspark import TaskContext

        encode = _encoding(path).encode_ordinary
        shard = TaskContext.get().partitionId() << 32
        ids, texts, total = [], [], 0
        for batch in pieces_of(batches, 1, PIECE_BYTES):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                t = encode(text) if text else []
                t.append(end_id)
                ids.append(doc_id)
                texts.append(np.array(t, dtype="<i4"))
                total += len(t)
                if total >= shard_tokens:
                    yield rows_of(shard, ids, texts)
                    shard, ids, texts, total = shard + 1, [], [], 0
        if ids:
            yield rows_of(shard, ids, texts)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, _SCHEMA)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write packed rows as Parquet, one folder; ``ids`` of a file stacked are its matrix."""
    packed.write.mode("errorifexists").parquet(path)
