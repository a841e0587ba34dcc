"""Hard negatives of anchors by score windows below each positive.

Every positive sets an upper and a lower limit for its negatives.  The upper
limits of an anchor's positives cut all scores into disjoint slots, so a row is
in one slot of an anchor.  Tiles of anchors by rows keep the best few of each
slot, a ranked window merges them, and one pass over an anchor's slots, lowest
first, merges each into what lies below it: that is the answer of the window
whose upper limit the slot has, cut at the window's lower limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise

EVERY = 50  # anchors are rows whose id is divisible by it
POSITIVES, NEGATIVES = 5, 3
LOW_PCT, HIGH_PCT = 50, 95
SCALE = 256
ANCHOR_BLOCK = ROW_BLOCK = 1 << 14  # vectors of a tile's sides
CELLS = 1 << 21  # scores held at once
_LEAST = np.iinfo(np.int64).min


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """Rows with an id, a label and a vector whose components are all finite, ``scale`` times too."""
    whole = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(whole, F.lit(False)))


def _matrices(table: pa.Table, scale: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Row numbers and whole-number vectors by length of vector; a double holds each component exactly."""
    column = table["embedding"].combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.asarray(column.value_lengths())
    start = np.cumsum(size) - size
    out = {}
    for d in np.unique(size):
        rows = np.flatnonzero(size == d)
        at = start[rows][:, None] + np.arange(d)
        out[int(d)] = rows, np.floor(scale * flat[at])
    return out


def inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two tables of whole numbers, exactly, cut to 64 bits; floats where their mantissa holds every sum."""
    with np.errstate(over="ignore", invalid="ignore"):
        most = np.sqrt((a * a).sum(1).max(initial=0)) * np.sqrt((b * b).sum(1).max(initial=0)) * 1.01
    if most < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if most < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    return np.clip(whole(a).dot(whole(b).T), _LEAST, -1 - _LEAST).astype(np.int64)


def _strips(a: np.ndarray, b: np.ndarray):
    """(rows of a, rows of b, scores) of parts of a bounded size; large vectors are kept apart, since their products cost more."""
    norm = lambda x: np.sqrt((x * x).sum(1))
    with np.errstate(over="ignore"):
        na, nb = norm(a), norm(b)
    for la in (True, False):
        for lb in (True, False):
            i, j = np.flatnonzero((na < 1 << 12) == la), np.flatnonzero((nb < 1 << 12) == lb)
            if not len(i) or not len(j):
                continue
            step = max(1, CELLS // len(j))
            for k in range(0, len(i), step):
                rows = i[k : k + step]
                yield rows, j, inner(a[rows], b[j])


def _best(anchor: np.ndarray, slot: np.ndarray, score: np.ndarray, vec: np.ndarray, k: int) -> np.ndarray:
    """Places of the best k of each anchor and slot: high scores first, then small ids."""
    order = np.lexsort((vec, ~score, slot, anchor))
    a, s = anchor[order], slot[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


def _tiles(anchors: DataFrame, rows: DataFrame, tile, schema: str, blocks: tuple[int, int]) -> DataFrame:
    """``tile(anchors, rows)`` over every block of anchors and block of rows."""
    n_anchor, n_row = blocks
    left = anchors.withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_row - 1))))
    right = rows.withColumn("ab", F.explode(F.sequence(F.lit(0), F.lit(n_anchor - 1))))
    return left.groupBy("ab", "rb").cogroup(right.groupBy("ab", "rb")).applyInArrow(tile, schema)


def _top_positives(scale: int, k: int):
    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 3]
        no, al, aid = (left[c].to_numpy() for c in ("anchor_no", "label", "vec_id"))
        rl, rid = right["label"].to_numpy(), right["vec_id"].to_numpy()
        rows = _matrices(right, scale)
        for d, (i, a) in _matrices(left, scale).items():
            if d not in rows:
                continue
            j, b = rows[d]
            for label in np.intersect1d(al[i], rl[j]):
                mine, theirs = al[i] == label, rl[j] == label
                ii, jj = i[mine], j[theirs]
                for x, y, s in _strips(a[mine], b[theirs]):
                    p, q = ii[x], jj[y]
                    other = aid[p][:, None] != rid[q]
                    s[~other] = _LEAST
                    if len(q) > k:
                        other &= s >= np.partition(s, len(q) - k, axis=1)[:, len(q) - k][:, None]
                    r, c = np.nonzero(other)
                    keep = _best(p[r], np.zeros(len(r), np.int64), s[r, c], rid[q[c]], k)
                    out.append((no[p[r[keep]]], s[r[keep], c[keep]], rid[q[c[keep]]]))
        return pa.table([np.concatenate(x) for x in zip(*out)], names=["anchor_no", "score", "vec_id"])

    return tile


def _top_slots(scale: int, k: int):
    def tile(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [(np.zeros(0, np.int64),) * 4]
        no, al = left["anchor_no"].to_numpy(), left["label"].to_numpy()
        rl, rid = right["label"].to_numpy(), right["vec_id"].to_numpy()
        limits = [left[c].to_pylist() for c in ("low", "high")]
        wide = max((len(x) for x in limits[0]), default=0)
        # places beyond an anchor's last slot admit nothing
        low = np.array([x + [-1 - _LEAST] * (wide - len(x)) for x in limits[0]], dtype=np.int64).reshape(len(al), wide)
        high = np.array([x + [_LEAST] * (wide - len(x)) for x in limits[1]], dtype=np.int64).reshape(len(al), wide)
        least = np.where(high > _LEAST, low, -1 - _LEAST).min(axis=1, initial=-1 - _LEAST)
        most = high.max(axis=1, initial=_LEAST)
        rows = _matrices(right, scale)
        for d, (i, a) in _matrices(left, scale).items():
            if d not in rows:
                continue
            j, b = rows[d]
            for x, y, s in _strips(a, b):
                p, q = i[x], j[y]
                r, c = np.nonzero((s >= least[p][:, None]) & (s <= most[p][:, None]) & (al[p][:, None] != rl[q]))
                score = s[r, c]
                slot = (high[p[r]] >= score[:, None]).sum(1)
                ok = (slot > 0) & (score >= low[p[r], slot - 1])
                r, c, score, slot = r[ok], c[ok], score[ok], slot[ok]
                keep = _best(p[r], slot, score, rid[q[c]], k)
                out.append((no[p[r[keep]]], slot[keep], score[keep], rid[q[c[keep]]]))
        return pa.table([np.concatenate(x) for x in zip(*out)], names=["anchor_no", "slot", "score", "vec_id"])

    return tile


def _share(score: str, pct: int, up: bool) -> Column:
    """``pct`` of a hundred of a whole number, rounded down or up, without leaving 64 bits."""
    part = F.expr(f"`{score}` % 100") * pct / 100
    return F.expr(f"`{score}` div 100") * pct + (F.ceil(part) if up else F.floor(part))


def hard_negatives(vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES, low_pct: int = LOW_PCT, high_pct: int = HIGH_PCT, scale: int = SCALE) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of ``vectors(vec_id, label, embedding)``.

    A score is the inner product of two vectors with each component x taken as
    floor(scale * x); it is exact, and cut to the ends of a long.  Anchors are
    rows whose id is divisible by ``every``.  An anchor's positives are its first
    ``positives`` rows of the same label and another id, by score, ties by
    smaller id.  For each, the first ``negatives`` rows of another label with
    low_pct * positive_score <= 100 * negative_score <= high_pct * positive_score.

    Rows with a null id, label or vector or a component that is null or not
    finite take no part.  Vectors of different lengths have no score.  An exact
    repeat of a row counts once; rows that share an id but differ count each.
    Positives whose window is empty have no rows; empty tables give none.  Other
    columns are not read.
    """
    kept = usable(vectors, scale).select(F.col("vec_id").cast("long"), F.col("label").cast("long"), "embedding").distinct()
    kept = materialise(kept.withColumn("spread", F.xxhash64("vec_id", "label", "embedding")))
    n = kept.agg(F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("anchors")).first()
    # as many blocks as bound a tile; more where that gives every core some
    cores = kept.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, -(-n["anchors"] // ANCHOR_BLOCK)), max(1, -(-n["n"] // ROW_BLOCK), min(2 * cores, n["n"] // 1024))
    rows = kept.withColumn("rb", F.pmod("spread", F.lit(blocks[1])).cast("int")).drop("spread")
    anchors = kept.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("anchor_no"), "vec_id", "label", "embedding", F.pmod("spread", F.lit(blocks[0])).cast("int").alias("ab"))
    anchors = materialise(anchors)

    order = (F.desc("score"), F.col("vec_id"))
    first = lambda df, k, *by: df.withColumn("rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rn") <= k)
    best = first(_tiles(anchors, rows, _top_positives(scale, positives), "anchor_no long, score long, vec_id long", blocks), positives, "anchor_no")
    best = best.select("anchor_no", F.col("rn").cast("long").alias("slot"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), _share("score", low_pct, True).alias("low"), _share("score", high_pct, False).alias("high"))
    best = materialise(best)

    by_slot = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("slot", c))), lambda x: x[c]).alias(c)
    limits = best.groupBy("anchor_no").agg(by_slot("low"), by_slot("high"))
    tops = first(_tiles(anchors.join(limits, "anchor_no"), rows, _top_slots(scale, negatives), "anchor_no long, slot long, score long, vec_id long", blocks), negatives, "anchor_no", "slot")

    # lowest slot first: what lies under an upper limit is the slot and all below it
    found = tops.groupBy("anchor_no", "slot").agg(F.collect_list(F.struct((-1 - F.col("score")).alias("down"), "vec_id")).alias("top"))
    slots = best.join(found, ["anchor_no", "slot"], "left").groupBy("anchor_no").agg(F.sort_array(F.collect_list(F.struct(F.col("slot"), "positive_id", "positive_score", "low", F.coalesce("top", F.array().cast("array<struct<down: bigint, vec_id: bigint>>")).alias("top"))), asc=False).alias("slots"))
    held = "array<struct<down: bigint, vec_id: bigint>>"
    answer = "array<struct<positive_id: bigint, positive_score: bigint, negatives: " + held + ">>"
    zero = F.struct(F.array().cast(held).alias("below"), F.array().cast(answer).alias("out"))

    def step(s, x):
        below = F.slice(F.sort_array(F.concat(s["below"], x["top"])), 1, negatives)
        won = F.filter(below, lambda v: -1 - v["down"] >= x["low"])
        return F.struct(below.alias("below"), F.concat(s["out"], F.array(F.struct(x["positive_id"].alias("positive_id"), x["positive_score"].alias("positive_score"), won.alias("negatives")))).alias("out"))

    each = slots.select("anchor_no", F.explode(F.aggregate("slots", zero, step)["out"]).alias("p")).select("anchor_no", "p.positive_id", "p.positive_score", F.posexplode("p.negatives").alias("at", "v"))
    each = each.join(anchors.select("anchor_no", F.col("vec_id").alias("anchor_id")), "anchor_no")
    return each.select("anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("v.vec_id").alias("negative_id"), "positive_score", (-1 - F.col("v.down")).alias("negative_score"))
