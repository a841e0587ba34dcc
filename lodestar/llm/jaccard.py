"""N-gram Jaccard self-join in size-banded tiles with bitmap signatures.

All filters are exact: no link is lost to them, whatever the data.

1. ``set_nodes``: every whole text becomes its set of shingle hashes; equal sets
   are one node, named by a 64-bit fingerprint.  The same pass counts all shingles
   in a sketch of fixed size; shingles in crowded cells are *common*.
2. Shingles are ordered: common ones last, hashes otherwise.  Any order does, and
   this one keeps passages that many texts hold out of the way.  A node posts the
   least ``n - ceil(t n) + l(n)`` of its n shingles, with ``l(n) = t n / 6``.  Two
   sets with a Jaccard of t share the least l of their common shingles in what
   they post, so a node with a partner has at least ``l(ceil(t n))`` postings that
   another node of like size posts too.  Nodes with fewer go.
3. Each shingle ties its nodes of like size to the least of them.  Components of
   those ties hold every link.  Postings of common shingles are salted, so that no
   task holds all texts of a large group of copies.
4. A small component is a tile.  A larger one is settled in levels: blocks of its
   size bands are tiles, the least node of each class found goes on to the next
   level, until classes no longer halve.  What may still link two classes, again by the
   exact count of step 2, is compared in tiles of pairs of blocks.
5. In a tile, bitmap signatures bound each overlap from above by bit counts;
   pairs that survive are settled by exact intersection of the sorted arrays.
   Nodes that are joined already need no further test, so a tile returns each
   of its nodes with the least that it is joined to.
6. Classes of nodes are classes of documents, named by the least of them.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialise
from .textarrays import mix, shingles, slices, utf8, words

TILE_SHINGLES = 1 << 18
PAIR_SHINGLES = 1 << 24  # of bitmaps, which take a thirtieth of the sets
SKETCH_BITS = 22
SLICE = 1 << 16  # cells of the sketch in a row
COUNTED = 1 << 18  # shingles that are counted at once
COMMON_SPARE = 16
SALTS = 256
BROADCAST_NODES = 1_000_000


def _sets(batch: pa.RecordBatch, k: int):
    """(row, sorted distinct shingle hashes) of the column ``text``."""
    buf, off = utf8(batch.column("text"))
    for i, j in slices(off):
        sh, ptr = shingles(words(buf, off[i : j + 1]), k)
        for r in range(i, j):
            yield r, np.unique(sh[ptr[r - i] : ptr[r - i + 1]])


def _name(s: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True)


def _cell(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _count(total: np.ndarray, held: list[np.ndarray]) -> None:
    """Cells are counted in their order, so that memory is passed once."""
    cell, n = np.unique(np.concatenate(held), return_counts=True)
    total[cell] += n.astype(total.dtype)


def least_common(n: int, pct: int) -> int:
    """How many of the least common shingles both of two linked sets post, the smaller having n."""
    return max(1, pct * n // 600)


def postings_of(n: int, pct: int) -> int:
    """Postings of a set of n: those that no partner's overlap can leave out, and ``least_common`` more."""
    return min(n, n - -(-pct * n // 100) + least_common(n, pct))


def least_shared(n: int, pct: int) -> int:
    """Postings that a set of n shares with any partner; the smallest partner has ceil(pct n / 100)."""
    return least_common(-(-pct * n // 100), pct)


def set_nodes(docs: DataFrame, k: int = 5) -> DataFrame:
    """(doc_id, n_shingles, node) of every row, and rows (part, slice, counts) of the sketch, told by ``slice``."""
    schema = "doc_id long, n_shingles long, node long, part int, slice int, counts binary"

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        total = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        for batch in batches:
            n, node, held, size = [], [], [], 0
            for _, s in _sets(batch, k):
                n.append(len(s))
                node.append(_name(s) if len(s) else None)
                held.append(_cell(s))
                size += len(s)
                if size > COUNTED:
                    _count(total, held)
                    held, size = [], 0
            if held:
                _count(total, held)
            none = [pa.nulls(batch.num_rows, t) for t in (pa.int32(), pa.int32(), pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), *none], names=["doc_id", "n_shingles", "node", "part", "slice", "counts"])
        for i in range(0, len(total), SLICE):
            cells = total[i : i + SLICE]
            if cells.any():
                none = [pa.nulls(1, pa.int64())] * 3
                yield pa.RecordBatch.from_arrays([*none, pa.array([part], pa.int32()), pa.array([i // SLICE], pa.int32()), pa.array([zstandard.compress(np.minimum(cells, 255).astype(np.uint8).tobytes(), 1)], pa.binary())], names=["doc_id", "n_shingles", "node", "part", "slice", "counts"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


def common_cells(sketch: DataFrame) -> np.ndarray:
    """Which cells of the sketch are crowded, as packed bits; ``sketch(part, slice, counts)``.

    A cell is crowded when its count is above what chance puts into a cell.
    Slices are added up by groups of parts, then as a whole, one row at a time;
    the bits are of fixed size.
    """

    def add(batches, last):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for p, s, c in zip(batch.column("part").to_pylist(), batch.column("slice").to_pylist(), batch.column("counts").to_pylist()):
                x = np.frombuffer(zstandard.decompress(c), dtype=np.uint8 if not last else "<i8")
                sums[p, s] = sums[p, s] + x if (p, s) in sums else x.astype(np.int64)
        for (p, s), x in sums.items():
            if last:
                mean = x.mean()
                out = np.packbits(x > mean + 8 * math.sqrt(mean) + COMMON_SPARE).tobytes()
            else:
                out = zstandard.compress(x.tobytes(), 1)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([s], pa.int32()), pa.array([out], pa.binary())], names=["part", "slice", "counts"])

    schema = "part int, slice int, counts binary"
    some = sketch.select((F.col("part") % 8).alias("part"), "slice", "counts").repartition("part", "slice").mapInArrow(lambda b: add(b, False), schema)
    whole = some.select(F.lit(0).alias("part"), "slice", "counts").repartition("slice").mapInArrow(lambda b: add(b, True), schema)
    bits = np.zeros((1 << SKETCH_BITS) // 8, dtype=np.uint8)
    for r in whole.collect():
        bits[r["slice"] * SLICE // 8 : (r["slice"] + 1) * SLICE // 8] = np.frombuffer(r["counts"], dtype=np.uint8)
    return bits


_POSTING = "key long, node long, n int"
_PACKED = "bucket int, key binary, node binary, n binary"
PACKED = 1_000_000  # postings that are dealt into buckets at once


def _rows(*cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["key", "node", "n"])


def _packed(key: np.ndarray, node: np.ndarray, n: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Postings as one row for each bucket; a bucket has all postings of a shingle, or of a common one and a salt."""
    at = np.where(n < 0, mix(key + (node.view(np.uint64) % np.uint64(SALTS) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)), key)
    at = ((at & np.uint64(0xFFFFFFFF)) % np.uint64(buckets)).astype(np.uint16)  # the high bits say which shingles are posted
    order = np.argsort(at, kind="stable")
    have = np.bincount(at, minlength=buckets)
    full = np.flatnonzero(have)
    ends = np.concatenate([[0], np.cumsum(have[full])])

    def column(x):
        return pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer((ends * x.itemsize).astype(np.int32)), pa.py_buffer(x[order])])

    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), column(key), column(node), column(n)], names=["bucket", "key", "node", "n"])


def _unpacked(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The postings of all rows of a batch of ``_packed``: keys, nodes and sizes."""

    def column(name, kind):
        c = batch.column(name)
        ends = np.frombuffer(c.buffers()[1], dtype=np.int32)[c.offset : c.offset + len(c) + 1]
        return np.frombuffer(c.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]].view(kind) if len(c) else np.zeros(0, kind)

    return [column("key", np.int64), column("node", np.int64), column("n", np.int32)]


def _buckets(df: DataFrame) -> int:
    """As many as shuffles have partitions: the fewer, the more postings of a node stand side by side and pack well."""
    return min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 << 16)


def _postings(docs: DataFrame, common: np.ndarray, k: int, pct: int) -> DataFrame:
    """(bucket, key, node, n): each node's least shingles and its size, negative at common ones, many in a row; each task names a node once."""
    cells = docs.sparkSession.sparkContext.broadcast(common)
    buckets = _buckets(docs)

    def run(batches):
        crowded = np.unpackbits(cells.value).astype(bool)
        seen: set[int] = set()
        keys, nodes, sizes, held = [], [], [], 0
        for batch in batches:
            for _, s in _sets(batch, k):
                n = len(s)
                if not n or (node := _name(s)) in seen:
                    continue
                seen.add(node)
                p = postings_of(n, pct)
                late = crowded[_cell(s)]
                light = s[~late][:p]
                heavy = s[late][: p - len(light)]
                keys += [light, heavy]
                sizes.append(np.repeat(np.array([n, -n], np.int32), [len(light), len(heavy)]))
                nodes.append(np.full(len(light) + len(heavy), node, np.int64))
                held += len(light) + len(heavy)
                if held > PACKED:
                    yield _packed(np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes), buckets)
                    keys, nodes, sizes, held = [], [], [], 0
        if keys:
            yield _packed(np.concatenate(keys), np.concatenate(nodes), np.concatenate(sizes), buckets)

    return docs.select(F.col("text").cast("string")).mapInArrow(run, _PACKED)


def _salted() -> Column:
    """Where a posting goes: by its shingle, common ones by their node as well."""
    return F.when(F.col("n") < 0, F.xxhash64("key", F.pmod("node", F.lit(SALTS)))).otherwise(F.col("key"))


def _repeated(key: np.ndarray) -> np.ndarray:
    """Which rows have a key that another row has too."""
    each = np.sort(key)
    again = np.unique(each[1:][each[1:] == each[:-1]])
    if not len(again):
        return np.zeros(len(key), dtype=bool)
    at = np.searchsorted(again, key)
    at[at == len(again)] = 0
    return again[at] == key


def _by_key(batches, pct: int, alone: bool = True):
    """All rows of a partition by key, size and node, without repeats, and where runs begin.

    A run is a stretch of a key's nodes in which each has at least pct of the
    size of the next; partners are in one run.  Without ``alone`` rows whose key no
    other row has are left out before the sort, but for those of common shingles.
    """
    parts = [_unpacked(batch) if pa.types.is_binary(batch.schema.field("key").type) else [batch.column(c).to_numpy() for c in ("key", "node", "n")] for batch in batches]
    if not parts:
        return None
    key, node, n = (np.concatenate(x) for x in zip(*parts))
    if not alone:
        met = _repeated(key) | (n < 0)
        key, node, n = key[met], node[met], n[met]
    size = np.abs(n).astype(np.int64)
    order = np.lexsort((node, size, key))
    key, node, n, size = key[order], node[order], n[order], size[order]
    new = np.ones(len(key), dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | (node[1:] != node[:-1]) | (n[1:] != n[:-1])
    key, node, n, size = key[new], node[new], n[new], size[new]
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (100 * size[:-1] < pct * size[1:])
    return key, node, n, first


def _shared(postings: DataFrame, pct: int) -> DataFrame:
    """Postings of the shingles that several nodes of like size have; those of common shingles all."""

    def run(batches):
        got = _by_key(batches, pct, alone=False)
        if got is None or not len(got[0]):
            return
        key, node, n, first = got
        group = np.cumsum(first) - 1
        many = (np.bincount(group)[group] > 1) | (n < 0)
        yield _rows(key[many], node[many], n[many])

    return postings.repartitionById(_buckets(postings), "bucket").mapInArrow(run, _POSTING)


def _peeled(shared: DataFrame, pct: int) -> DataFrame:
    """Postings of the nodes that share enough of them."""

    def run(batches):
        parts = [[batch.column(c).to_numpy() for c in ("key", "node", "n")] for batch in batches]
        if not parts:
            return
        key, node, n = (np.concatenate(x) for x in zip(*parts))
        _, at, have = np.unique(node, return_inverse=True, return_counts=True)
        size = np.abs(n).astype(np.int64)
        enough = have[at] >= np.maximum(1, pct * -(-pct * size // 100) // 600)
        yield _rows(key[enough], node[enough], n[enough])

    return shared.repartition("node").mapInArrow(run, _POSTING)


def _thin(key: np.ndarray, size: np.ndarray, pct: int) -> np.ndarray:
    """Rows with the least and the greatest size of each size band of a run; rows are ordered by key and size."""
    band = np.floor(np.log(size) / math.log(100 / pct)).astype(np.int64)
    edge = np.ones(len(key) + 1, dtype=bool)
    edge[1:-1] = (key[1:] != key[:-1]) | (band[1:] != band[:-1])
    return edge[:-1] | edge[1:]


def _pairs_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct pairs, ordered."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


def _hooked(ties: DataFrame) -> DataFrame:
    """(a, b): the same components with fewer edges: each a to the least of its b, and its other b to that as well."""

    def run(batches):
        parts = [[batch.column(c).to_numpy() for c in ("a", "b")] for batch in batches]
        if not parts:
            return
        a, b = _pairs_of(*(np.concatenate(x) for x in zip(*parts)))
        first = np.ones(len(a), dtype=bool)
        first[1:] = a[1:] != a[:-1]
        least = b[first][np.cumsum(first) - 1]
        rest = b != least
        x, y = _pairs_of(np.concatenate([a[first], b[rest]]), np.concatenate([b[first], least[rest]]))
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], names=["a", "b"])

    return ties.repartition("a").mapInArrow(run, "a long, b long").distinct()


def _ties(shared: DataFrame, pct: int) -> DataFrame:
    """(a, b): ties of each node of a run with the least node of that run; a node alone has none.

    A common shingle's runs are those of its salts first; their least nodes,
    with the ends of the run's size bands, are tied in the same way.
    """
    schema = "a long, b long, key long, n int"

    def tied(batches, again):
        got = _by_key(batches, pct)
        if got is None:
            return
        key, node, n, first = got
        least = np.minimum.reduceat(node, np.flatnonzero(first))[np.cumsum(first) - 1]
        other = np.flatnonzero(node != least)
        a, b = _pairs_of(node[other], least[other])
        none = pa.nulls(len(a), pa.int64()), pa.nulls(len(a), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *none], names=["a", "b", "key", "n"])
        if again:
            rows = np.flatnonzero((n < 0) & _thin(np.cumsum(first), np.abs(n), pct))
            yield pa.RecordBatch.from_arrays([pa.array(least[rows]), pa.nulls(len(rows), pa.int64()), pa.array(key[rows]), pa.array(np.abs(n[rows]))], names=["a", "b", "key", "n"])

    one = materialise(shared.repartition(_salted()).mapInArrow(lambda b: tied(b, True), schema))
    ends = one.where("key is not null").select("key", F.col("a").alias("node"), "n")
    two = ends.repartition("key").mapInArrow(lambda b: tied(b, False), schema)
    return _hooked(one.where("b is not null").select("a", "b").unionByName(two.select("a", "b")))


def bitmap(s: np.ndarray) -> np.ndarray:
    """A signature of a set: its hashes as bits, a power of two of at least twice its size."""
    width = 1 << max(8, math.ceil(math.log2(2 * len(s))))
    h = (s >> np.uint64(20)) & np.uint64(width - 1)
    bits = np.zeros(width // 64, dtype=np.uint64)
    np.bitwise_or.at(bits, (h >> np.uint64(6)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
    return bits


def folded(bits: list[np.ndarray]) -> np.ndarray:
    """Signatures as rows of the least width among them; a wider one is folded by halves, which keeps every bit's hash."""
    width = min(map(len, bits))
    out = np.zeros((len(bits), width), dtype=np.uint64)
    for i, b in enumerate(bits):
        out[i] = np.bitwise_or.reduce(b.reshape(-1, width), axis=0)
    return out


def _ones(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows).sum(axis=-1, dtype=np.int64)


def _bound(mine: np.ndarray, left: int, theirs: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """A bound from above of the overlaps of a set with others: bits that only one side has are elements that the other lacks; ``left`` and ``rest`` are sizes less their bits."""
    return np.minimum(left, rest) + _ones(theirs & mine)


def most_shared(i: int, cand: np.ndarray, bits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A bound from above of the overlaps of set i with others."""
    return _bound(bits[i], n[i] - _ones(bits[i]), bits[cand], n[cand] - _ones(bits[cand]))


class Bitmaps:
    """Signatures of sets in the order of their sizes, as rows of arrays, one for each width, folded and counted once."""

    def __init__(self, n: np.ndarray, bits: list[np.ndarray]):
        self.widths = np.array([len(b) for b in bits], dtype=np.int64)  # grow with sizes, so a width is a range
        self.n, self.first, self.rows = n, {}, {}
        for w in np.unique(self.widths):
            at = np.flatnonzero(self.widths == w)
            self.first[int(w)] = int(at[0])
            self._put(int(w), int(w), folded(bits[at[0] : at[-1] + 1]))

    def _put(self, own: int, width: int, rows: np.ndarray) -> None:
        self.rows[own, width] = rows, self.n[self.first[own] : self.first[own] + len(rows)] - _ones(rows)

    def most_shared(self, i: int, cand: np.ndarray) -> np.ndarray:
        """A bound of the overlaps of set i with ``cand``, smaller sets in their order."""
        out = np.empty(len(cand), dtype=np.int64)
        mine, of = int(self.widths[i]), self.widths[cand]
        for w in self.first:
            a, b = np.searchsorted(of, [w, w + 1])
            if a == b:
                continue
            if (mine, w) not in self.rows:
                own = self.rows[mine, mine][0]
                self._put(mine, w, np.bitwise_or.reduce(own.reshape(len(own), -1, w), axis=1))
            (wide, left), (rows, rest) = self.rows[mine, w], self.rows[w, w]
            x, at = i - self.first[mine], cand[a:b] - self.first[w]
            for p in range(0, b - a, 1 << 12):
                some = at[p : p + (1 << 12)]
                out[a + p : a + p + len(some)] = _bound(wide[x], left[x], rows[some], rest[some])
        return out


def tile_links(sets: list[np.ndarray], pct: int = 75, classes: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= pct * union.

    Sets of one of ``classes`` are joined already; of the others, those that their
    bitmaps do not keep apart are intersected, the likeliest first.
    """
    m = len(sets)
    size = np.array([len(s) for s in sets], dtype=np.int64)
    order = np.argsort(size, kind="stable")
    n = size[order]
    links: list[tuple[int, int]] = []
    label = np.arange(m) if classes is None else np.unique(np.array(classes)[order], return_inverse=True)[1]
    own = Bitmaps(n, [bitmap(sets[r]) for r in order]) if m > 2 else None
    low = np.searchsorted(n, -(-pct * n // 100), side="left")
    for i in range(1, m):
        cand = low[i] + np.flatnonzero(label[low[i] : i] != label[i])
        if not len(cand):
            continue
        if own:
            bound = own.most_shared(i, cand)
            good = 100 * bound >= pct * (n[i] + n[cand] - bound)
            cand = cand[good][np.argsort(-bound[good], kind="stable")]
        a = sets[order[i]]
        for j in cand:
            if label[j] == label[i]:
                continue
            b = sets[order[j]]
            at = np.searchsorted(a, b)
            at[at == len(a)] = 0
            both = int(np.count_nonzero(a[at] == b))
            if 100 * both >= pct * (len(a) + len(b) - both):
                links.append((int(order[i]), int(order[j])))
                old, new = label[i], label[j]
                label[label == old] = new
    return links


def close_nodes(sizes: np.ndarray, bits: list[np.ndarray], classes: np.ndarray, pct: int = 75) -> np.ndarray:
    """Which of some sets have another of another class that their bitmaps do not keep apart."""
    order = np.argsort(sizes, kind="stable")
    n, kind = sizes[order].astype(np.int64), np.unique(classes[order], return_inverse=True)[1]
    rows = Bitmaps(n, [bits[r] for r in order])
    low = np.searchsorted(n, -(-pct * n // 100), side="left")
    near = np.zeros(len(n), dtype=bool)
    for i in range(1, len(n)):
        cand = low[i] + np.flatnonzero(kind[low[i] : i] != kind[i])
        if len(cand):
            bound = rows.most_shared(i, cand)
            good = 100 * bound >= pct * (n[i] + n[cand] - bound)
            near[cand[good]] = True
            near[i] |= good.any()
    out = np.zeros(len(n), dtype=bool)
    out[order] = near
    return out


def _node_sets(docs: DataFrame, active: DataFrame, k: int) -> DataFrame:
    """(node, label, total, hashes): the sets of the nodes in ``active(doc_id, node, label, total)``, each node once but for repeats of its row."""
    told = ["node", "label", "total"]

    def rows(batch, at, data):
        return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(at, pa.int64())) for c in told), pa.array(data, pa.binary())], names=[*told, "hashes"])

    def run(batches):
        for batch in batches:
            want = batch.column("node").to_numpy()
            at, data = [], []
            for r, s in _sets(batch, k):
                if len(s) and _name(s) == want[r]:
                    at.append(r)
                    data.append(s.tobytes())
                if len(data) >= 256:
                    yield rows(batch, at, data)
                    at, data = [], []
            yield rows(batch, at, data)

    active = active.select("doc_id", *told)
    if active.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES:
        active = F.broadcast(active)
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(active, "doc_id")
    return texts.select("text", *told).mapInArrow(run, "node long, label long, total long, hashes binary")


def _stars(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, least node of its component) of every node but the least ones."""
    up: dict[int, int] = {}

    def top(x):
        while x in up:
            up[x] = up.get(up[x], up[x])
            x = up[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return [(x, top(x)) for x in list(up)]


def _links(rows: DataFrame, pct: int) -> DataFrame:
    """(a, b): the linked nodes of each tile of ``rows(tile, node, class, hashes)`` with the least of them; tiles pass one after the other."""

    def settle(held: dict[int, tuple[int, bytes]]):
        nodes = list(held)
        found = tile_links([np.frombuffer(held[x][1], dtype=np.uint64) for x in nodes], pct, [held[x][0] for x in nodes])
        stars = _stars([(nodes[i], nodes[j]) for i, j in found])
        return pa.RecordBatch.from_arrays([pa.array([a for a, _ in stars], pa.int64()), pa.array([b for _, b in stars], pa.int64())], names=["a", "b"])

    def run(batches):
        now, held = None, {}
        for batch in batches:
            for t, node, c, data in zip(*(batch.column(x).to_pylist() for x in ("tile", "node", "class", "hashes"))):
                if t != now:
                    if len(held) > 1:
                        yield settle(held)
                    now, held = t, {}
                held[node] = (c, data)
        if len(held) > 1:
            yield settle(held)

    return rows.select("tile", "node", "class", "hashes").repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(run, "a long, b long")


def _close(rows: DataFrame, pct: int) -> DataFrame:
    """(tile, node, class) of the nodes of ``rows(tile, node, class, n, bits)`` that a bitmap does not keep apart from another class."""
    schema = "tile string, node long, class long"

    def settle(tile, held):
        node, cls, n, bits = (list(x) for x in zip(*held))
        keep = close_nodes(np.array(n), [np.frombuffer(b, dtype=np.uint64) for b in bits], np.array(cls), pct)
        at = np.flatnonzero(keep)
        return pa.RecordBatch.from_arrays([pa.array([tile] * len(at), pa.string()), pa.array([node[i] for i in at], pa.int64()), pa.array([cls[i] for i in at], pa.int64())], names=["tile", "node", "class"])

    def run(batches):
        now, held = None, []
        for batch in batches:
            for t, *row in zip(*(batch.column(x).to_pylist() for x in ("tile", "node", "class", "n", "bits"))):
                if t != now:
                    if len(held) > 1:
                        yield settle(now, held)
                    now, held = t, []
                held.append(row)
        if len(held) > 1:
            yield settle(now, held)

    return rows.select("tile", "node", "class", "n", "bits").repartition("tile").sortWithinPartitions("tile", "node").mapInArrow(run, schema)


def _bitmaps(sets: DataFrame) -> DataFrame:
    """(node, n, bits) of ``sets(node, hashes)``."""

    def run(batches):
        for batch in batches:
            n, bits = [], []
            for data in batch.column("hashes").to_pylist():
                s = np.frombuffer(data, dtype=np.uint64)
                n.append(len(s))
                bits.append(bitmap(s).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(n, pa.int64()), pa.array(bits, pa.binary())], names=["node", "n", "bits"])

    return sets.select("node", "hashes").mapInArrow(run, "node long, n long, bits binary")


def _band(level: int, pct: int) -> Column:
    """The size band; every other level has its edges half a band off."""
    return F.floor(F.log("n_shingles") / math.log(100 / pct) + (level % 2) / 2).cast("int")


def _block_pairs(open_: DataFrame, pct: int) -> DataFrame:
    """(node, class, tile) of nodes that may be linked beyond their class: pairs of blocks of like size.

    ``open_(node, n_shingles, label, class)``.  A class of more than half a pair
    has blocks of its own, which meet all blocks but each other, so that a large
    class costs its size times the number of blocks of the rest.
    """
    half = max(1, PAIR_SHINGLES // 2)
    open_ = open_.withColumn("band", _band(0, pct))
    own = open_.groupBy("label", "band", "class").agg(F.sum("n_shingles").alias("total"))
    rest = own.where(F.col("total") <= half).groupBy("label", "band").agg(F.ceil(F.sum("total") / half).alias("rest"))
    own = own.join(rest, ["label", "band"], "left")
    spread = lambda c, n: F.pmod(F.xxhash64(c), n.cast("long"))
    placed = open_.join(own, ["label", "band", "class"]).withColumn("owner", F.when(F.col("total") > half, F.col("class")))
    placed = placed.withColumn("block", F.when(F.col("owner").isNotNull(), spread("node", F.ceil(F.col("total") / half))).otherwise(spread("class", F.col("rest"))))
    blocks = placed.select("label", "band", "owner", "block").distinct()
    name = lambda p: F.concat_ws("/", F.col(f"{p}band"), F.coalesce(F.col(f"{p}owner").cast("string"), F.lit("rest")), F.col(f"{p}block"))
    other = blocks.select("label", *(F.col(c).alias(f"o_{c}") for c in ("band", "owner", "block")))
    near = (F.abs(F.col("band") - F.col("o_band")) <= 1) & ~(F.col("owner").isNotNull() & (F.col("owner").eqNullSafe(F.col("o_owner"))))
    tile = F.concat_ws("|", F.col("label"), F.least(name(""), name("o_")), F.greatest(name(""), name("o_")))
    tiles = blocks.join(other, "label").where(near).select("label", "band", F.coalesce("owner", F.lit(0)).alias("owner"), F.col("owner").isNull().alias("free"), "block", tile.alias("tile"))
    key = ["label", "band", "owner", "free", "block"]
    return placed.withColumn("free", F.col("owner").isNull()).withColumn("owner", F.coalesce("owner", F.lit(0))).join(tiles, key).select("node", "class", "tile")


def _settled(active: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """(node, class): the classes of ``active(node, n_shingles, label, total)``, named by their least node; a node alone may be missing.

    ``sets(node, label, total, hashes)``: a small component's sets go to its tile
    as they are, so that only those of large components are joined with blocks.
    """
    small = sets.where(F.col("total") <= TILE_SHINGLES).select("node", F.col("node").alias("class"), F.col("label").cast("string").alias("tile"), "hashes")
    classes = materialise(_links(small, pct)).select(F.col("a").alias("node"), F.col("b").alias("class"))
    sets = sets.where(F.col("total") > TILE_SHINGLES).select("node", "hashes")
    with_sets = lambda tiles: tiles.join(sets, "node")
    large = active.where(F.col("total") > TILE_SHINGLES).select("node", "n_shingles", "label", F.col("node").alias("class"))
    before, level = large.count(), 0
    if not before:
        return classes
    while True:
        # a class is named by its least node, which stands for it; a level has it in one tile
        reps = large.where(F.col("node") == F.col("class"))
        per = reps.groupBy("label").agg(F.sum("n_shingles").alias("whole"))
        reps = reps.join(per, "label").withColumn("band", F.when(F.col("whole") > TILE_SHINGLES, _band(level, pct)).otherwise(-1))
        of = reps.groupBy("label", "band").agg(F.ceil(F.sum("n_shingles") / TILE_SHINGLES).alias("blocks"))
        reps = reps.join(of, ["label", "band"]).withColumn("block", F.pmod(F.xxhash64("node", F.lit(level)), F.col("blocks").cast("long")))
        stars = _links(with_sets(reps.select("node", "class", F.concat_ws("/", "label", "band", "block").alias("tile"))), pct)
        large = materialise(large.join(stars.select(F.col("a").alias("class"), F.col("b").alias("least")), "class", "left").select("node", "n_shingles", "label", F.coalesce("least", "class").alias("class")))
        after = large.where(F.col("node") == F.col("class")).count()
        level += 1
        if level > 1 and after > before // 2:
            break
        before = after
    # components of several classes: bitmaps of blocks meet in pairs, and what they do not keep apart is settled exactly
    several = large.where(F.col("node") == F.col("class")).groupBy("label").count().where("count > 1")
    open_ = materialise(large.join(several, "label", "left_semi"))
    if not open_.isEmpty():
        bits = materialise(_bitmaps(sets.join(open_.select("node"), "node", "left_semi")))
        near = materialise(_close(_block_pairs(open_, pct).join(bits, "node"), pct))
        pairs = _links(with_sets(near), pct)
        of = lambda c: large.select(F.col("node").alias(c), F.col("class").alias(f"{c}_class"))
        joined = connected_components(pairs.join(of("a"), "a").join(of("b"), "b").select(F.col("a_class").alias("a"), F.col("b_class").alias("b")))
        large = large.join(joined.select(F.col("id").alias("class"), F.col("label").alias("least")), "class", "left").select("node", F.coalesce("least", "class").alias("class"))
    return classes.unionByName(large.select("node", "class"))


def jaccard_components(docs: DataFrame, k: int = 5, pct: int = 75) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``.

    Two rows are linked when 100 * |A n B| >= ``pct`` * |A u B| for their sets of
    ``k``-word shingles; component_id is the least doc_id reachable.  Sets are
    compared as 64-bit hashes, the only thing that chance enters.  A null or empty
    text, or one without words, has no shingles and is its own component; a null
    doc_id stays a row of its own with a null or shared component.  Equal texts
    share a component; repeated rows stay rows.  Further columns are ignored; an
    empty table gives no rows.
    """
    told = materialise(set_nodes(docs, k))
    plain = told.where("slice is null").select("doc_id", "n_shingles", "node")
    common = common_cells(told.where("slice is not null").select("part", "slice", "counts"))
    nodes = materialise(plain.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").alias("n_shingles")))
    peeled = materialise(_peeled(_shared(_postings(docs, common, k, pct), pct), pct))
    labels = connected_components(_ties(peeled, pct))
    active = materialise(nodes.join(labels.withColumnRenamed("id", "node"), "node").where("doc_id is not null"))
    active = materialise(active.join(active.groupBy("label").agg(F.sum("n_shingles").alias("total")), "label"))
    sets = materialise(_node_sets(docs, active, k))
    classes = materialise(_settled(active, sets, pct))
    placed = nodes.join(classes, "node", "left").select("node", "doc_id", F.coalesce("class", "node").alias("class"))
    least = placed.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    placed = placed.join(least, "class").select("node", "component_id")
    shown = plain.where("node is not null").join(placed, "node").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return shown.unionByName(plain.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def drop_near_copies(docs: DataFrame, k: int = 5, pct: int = 75) -> DataFrame:
    """One document of each Jaccard component, that with the least doc_id; texts without words stay.

    Repeated rows of one doc_id are one document; rows without a doc_id cannot be
    named and stay.  Columns are those of ``docs``.
    """
    keep = jaccard_components(docs, k, pct).where("component_id = doc_id").select("doc_id").distinct()
    named = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).join(keep, "doc_id", "left_semi").select(*docs.columns)
    return named.unionByName(docs.where("doc_id is null"))
