"""Near-duplicate vectors by cosine: tiles in principal-axis order, products bounded by what is left of them.

Equal rows are one node with a weight.  Nodes of a label are put in order of
their first principal coordinate and cut into blocks; two blocks meet only if
their ranges are near enough for a link.  Inside a tile the leading coordinates
are multiplied first; by Cauchy-Schwarz the rest adds at most the product of
what is left of both norms, so a pair stops as soon as it cannot reach the
threshold.  Pairs that get through are decided on the vectors as given.  A tile
reports a count for each node and a spanning forest of its links, never pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .store import materialise

THRESHOLD = 0.98
BLOCK = 2048  # nodes on a side of a tile
STRIP = 256  # rows of a tile handled at once
SAMPLE = 4096  # vectors, chosen by hash, that the axes are fitted on; any axes give the same links
AXES = 1 << 22  # numbers in all axes together
SLACK = 1e-9  # rounding of rotated products; pairs within it go on to the exact test


def usable(embedding: str = "embedding"):
    """Whether a vector has only finite components and is not zero."""
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(embedding).isNotNull() & F.coalesce(fine, F.lit(False)) & F.coalesce(F.exists(embedding, lambda x: x != 0), F.lit(False))


def vectors_of(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and vectors by length, each vector put to the scale of its largest component by a power of two."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.asarray(column.value_lengths())
    start = np.cumsum(size) - size
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        x = flat[start[rows][:, None] + np.arange(d)]
        out[int(d)] = rows, np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0))[1][:, None])
    return out


def fit_axes(nodes: DataFrame, sample: int = SAMPLE) -> dict[int, np.ndarray]:
    """Principal axes of unit vectors, widest first, by length of vector; lengths without axes keep their own order."""
    got = nodes.orderBy(F.xxhash64("h1"), "h1", "h2").limit(sample).select("embedding").toArrow()
    axes, room = {}, AXES
    for d, (rows, x) in sorted(vectors_of(got["embedding"]).items(), key=lambda v: -len(v[1][0])):
        if d * d > room:
            continue
        room -= d * d
        u = x / np.linalg.norm(x, axis=1)[:, None]
        u = u - u.mean(0)
        axes[d] = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    return axes


def rotated(x: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    """Unit vectors in principal coordinates."""
    u = x / np.linalg.norm(x, axis=1)[:, None]
    a = axes.get(x.shape[1])
    return u if a is None else u @ a


def _stops(d: int) -> list[int]:
    """Ends of the groups of coordinates that are multiplied together."""
    ends = [min(8, d)]
    while ends[-1] < d:
        ends.append(min(2 * ends[-1], d))
    return ends


def candidates(a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of two tables of unit vectors whose product reaches the threshold, as far as rounding can tell."""
    ends, least = _stops(a.shape[1]), threshold - SLACK
    squares = lambda x: np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    left = [np.sqrt(np.hstack([squares(x), np.zeros((len(x), 1))])) for x in (a, b)]
    done = ends[0]
    s = a[:, :done] @ b[:, :done].T
    for k, end in enumerate(ends):
        alive = s + np.outer(left[0][:, done], left[1][:, done]) >= least
        if done == a.shape[1]:
            return np.nonzero(alive)
        if np.count_nonzero(alive) * 8 < alive.size:
            break
        s += a[:, done : ends[k + 1]] @ b[:, done : ends[k + 1]].T
        done = ends[k + 1]
    i, j = np.nonzero(alive)
    s = s[i, j]
    for end in ends[ends.index(done) + 1 :]:
        s = s + np.einsum("ij,ij->i", a[i, done:end], b[j, done:end])
        done = end
        ok = s + left[0][i, done] * left[1][j, done] >= least
        i, j, s = i[ok], j[ok], s[ok]
    return i, j


def linked(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of these pairs, those whose cosine reaches the threshold, on the vectors as given."""
    na, nb = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    if len(i) * 8 > len(a) * len(b):
        dots = (a @ b.T)[i, j]
    else:
        dots = np.concatenate([np.einsum("ij,ij->i", a[i[k : k + (1 << 16)]], b[j[k : k + (1 << 16)]]) for k in range(0, len(i), 1 << 16)] or [np.zeros(0)])
    ok = dots / (na[i] * nb[j]) >= threshold
    return i[ok], j[ok]


def hook(label: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``label`` with the groups of the ends of each pair made one, named by the least member."""
    while True:
        a, b = label[x], label[y]
        apart = a != b
        if not apart.any():
            return label
        x, y, a, b = x[apart], y[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def _tile(threshold: float, axes: dict[int, np.ndarray]):
    def run(table: pa.Table) -> pa.Table:
        block, b1, b2 = (table[c].to_numpy() for c in ("block", "b1", "b2"))
        cls, weight = table["cls"].to_numpy(), table["weight"].to_numpy()
        ((_, x),) = vectors_of(table["embedding"]).values()
        r = rotated(x, axes)
        one, two = np.flatnonzero(block == b1), np.flatnonzero(block == b2)
        same = len(b1) > 0 and b1[0] == b2[0]
        count, label = np.zeros(len(cls), np.int64), np.arange(len(cls))
        for k in range(0, len(one), STRIP):
            p = one[k : k + STRIP]
            q = two[k:] if same else two
            i, j = candidates(r[p], r[q], threshold)
            if same:
                later = q[j] > p[i]
                i, j = i[later], j[later]
            i, j = linked(x[p], x[q], i, j, threshold)
            i, j = p[i], q[j]
            np.add.at(count, i, weight[j])
            np.add.at(count, j, weight[i])
            label = hook(label, i, j)
        some = np.flatnonzero(count)
        return pa.table({"cls": cls[some], "n": count[some], "root": cls[label[some]]})

    return run


def _blocks(nodes: DataFrame, axes: dict[int, np.ndarray], size: int) -> DataFrame:
    """``nodes`` with their length and first coordinate, in blocks of one label and length along that coordinate."""

    def project(batches):
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("embedding"))
            first, dim = np.zeros(batch.num_rows), np.zeros(batch.num_rows, np.int32)
            for d, (rows, x) in vectors_of(column).items():
                first[rows], dim[rows] = rotated(x, axes)[:, 0], d
            yield batch.append_column("dim", pa.array(dim)).append_column("first", pa.array(first))

    def cut(batches):
        number, held, last = TaskContext.get().partitionId() << 32, 0, None
        for batch in batches:
            keys = np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("label", "dim")])
            n = keys.shape[1]
            if not n:
                continue
            new = np.ones(n, dtype=bool)
            new[1:] = (keys[:, 1:] != keys[:, :-1]).any(0)
            new[0] = last is None or (keys[:, 0] != last).any()
            # place of each row in its run, a run going on from the batch before
            at = np.arange(n)
            start = np.maximum.accumulate(np.where(new, at, -1))
            place = np.where(start < 0, at + held, at - start)
            number_of = number + np.cumsum(new | (place % size == 0))
            number, held, last = int(number_of[-1]), int(place[-1]) + 1, keys[:, -1]
            yield batch.append_column("block", pa.array(number_of))

    rows = nodes.select("cls", "label", "weight", "embedding")
    schema = "cls long, label long, weight long, embedding array<double>, dim int, first double"
    kind = nodes.schema["embedding"].dataType.simpleString()
    schema = schema.replace("array<double>", kind)
    placed = rows.mapInArrow(project, schema).repartitionByRange("label", "dim", "first").sortWithinPartitions("label", "dim", "first")
    return materialise(placed.mapInArrow(cut, schema + ", block long"))


def _near_blocks(rows: DataFrame, threshold: float) -> DataFrame:
    """(b1, b2): pairs of blocks, b1 <= b2, whose ranges of the first coordinate are close enough for a link.

    Ranges are entered in cells as wide as a link's reach; a pair is told once,
    in the first cell where a block and the other's surroundings meet.
    """
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-6
    b = rows.groupBy("block").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.min("first").alias("lo"), F.max("first").alias("hi"))
    b = materialise(b.withColumns({"from": F.floor(F.col("lo") / reach), "to": F.floor(F.col("hi") / reach)}))
    one = b.select(F.col("block").alias("b1"), "label", "dim", F.col("lo").alias("lo1"), F.col("hi").alias("hi1"), F.col("from").alias("from1"), F.explode(F.sequence("from", "to")).alias("cell"))
    two = b.select(F.col("block").alias("b2"), "label", "dim", "lo", "hi", (F.col("from") - 1).alias("from2"), F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("cell"))
    j = one.join(two, ["label", "dim", "cell"]).where((F.col("b1") <= F.col("b2")) & (F.col("cell") == F.greatest("from1", "from2")))
    return j.where((F.col("lo") - F.col("hi1") <= reach) & (F.col("lo1") - F.col("hi") <= reach)).select("b1", "b2")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row of ``vectors(vec_id, embedding, label)``.

    Two rows of one label link when the cosine of their vectors, in double
    precision, is at least ``threshold`` (above 0).  n_links counts the other
    rows linked directly, exact repeats of a row among them; component_id is the
    smallest vec_id reachable by links, kept whether it is the row's own.

    Rows whose vec_id or label is null, or whose vector is null, empty, zero or
    holds a null or non-finite component, link with nothing and are their own
    component; vectors of different lengths never link.  A row whose vec_id is
    null has a null component and is kept.  Rows that share a vec_id but differ
    are rows of their own.  An empty table gives none; other columns are not read.
    """
    v = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable()
    rows = v.withColumns({"h1": F.when(fine, F.xxhash64("label", "embedding")), "h2": F.when(fine, F.xxhash64("embedding", "label"))})
    # equal rows are told by 128 bits of hash
    nodes = rows.where("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"), F.first("label").alias("label"), F.first("embedding").alias("embedding"))
    nodes = materialise(nodes.withColumn("cls", F.monotonically_increasing_id()))
    axes = fit_axes(nodes)
    placed = _blocks(nodes, axes, block)
    pairs = materialise(_near_blocks(placed, threshold))
    meets = pairs.select(F.col("b1").alias("block"), "b1", "b2").unionByName(pairs.where("b1 <> b2").select(F.col("b2").alias("block"), "b1", "b2"))
    told = placed.select("block", "cls", "weight", "embedding").join(meets, "block").groupBy("b1", "b2").applyInArrow(_tile(threshold, axes), "cls long, n long, root long")
    told = materialise(told)
    counts = told.groupBy("cls").agg(F.sum("n").alias("n"))
    roots = connected_components(told.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))).select(F.col("id").alias("cls"), F.col("label").alias("root"))
    known = nodes.select("cls", "h1", "h2", "least", "weight").join(counts, "cls", "left").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    known = materialise(known)
    names = known.groupBy("root").agg(F.min("least").alias("component_id"))
    known = known.join(names, "root").select("h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "h1", "h2").join(known, ["h1", "h2"], "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
