"""Fuzzy de-duplication of places: likeness of names, and merging in the order of ids by rounds."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from ..sources.shared import materialise
from .clean import bucketed, close_pairs

_TABLE = 1 << 22  # entries of the table of letter places held at once
_FULL = ~np.uint64(0)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of each text, padded with -1, and lengths."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    size = np.array([len(t) for t in texts], dtype=np.int64)
    out = np.full((len(texts), int(size.max(initial=0))), -1, dtype=np.int64)
    out[np.arange(out.shape[1]) < size[:, None]] = flat
    return out, size


def common_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair, for all pairs at once.

    Bit i of a pair's row stands for letter i of a; a letter of b clears the lowest
    bit of each run that it can extend, by one addition.  Rows longer than 64 bits
    carry into the next word.
    """
    if not len(a):
        return np.zeros(0, np.int64)
    x, nx = _codes(a)
    y, _ = _codes(b)
    letters, places = np.unique(np.concatenate([x.ravel(), y.ravel()]), return_inverse=True)
    x, y = places[: x.size].reshape(x.shape), places[x.size :].reshape(y.shape)
    pad = int(np.searchsorted(letters, -1)) if len(letters) and letters[0] == -1 else len(letters)
    words = max(1, -(-x.shape[1] // 64))
    out = np.zeros(len(a), dtype=np.int64)
    step = max(1, _TABLE // (words * (len(letters) + 1)))
    for k in range(0, len(a), step):
        xs, ys = x[k : k + step], y[k : k + step]
        row = np.arange(len(xs))
        where = np.zeros((len(xs), len(letters) + 1, words), dtype=np.uint64)
        for i in range(xs.shape[1]):
            where[row, xs[:, i], i // 64] |= np.uint64(1) << np.uint64(i % 64)
        where[:, pad] = 0
        v = np.full((len(xs), words), _FULL)
        for j in range(ys.shape[1]):
            hit = where[row, ys[:, j]]
            carry = np.zeros(len(xs), dtype=np.uint64)
            for w in range(words):
                old, u = v[:, w], v[:, w] & hit[:, w]
                s = old + u
                over = s < old
                t = s + carry
                carry = (over | (t < s)).astype(np.uint64)
                v[:, w] = t | (old & ~hit[:, w])
        inside = np.clip(nx[k : k + step, None] - 64 * np.arange(words), 0, 64).astype(np.uint64)
        mask = np.where(inside == 64, _FULL, (np.uint64(1) << (inside % np.uint64(64))) - np.uint64(1))
        out[k : k + step] = np.bitwise_count(~v & mask).sum(1)
    return out


def ratios(a: list[str], b: list[str]) -> np.ndarray:
    """100 * (1 - insertions and deletions / total length) of each pair; an empty string is like nothing."""
    na, nb = (np.array([len(t) for t in x], dtype=float) for x in (a, b))
    return np.where((na > 0) & (nb > 0), 200.0 * common_lengths(a, b) / np.maximum(na + nb, 1), 0.0)


def ratio(a: str, b: str) -> float:
    return float(ratios([a], [b])[0])


def _ratio(x: pd.Series, y: pd.Series) -> pd.Series:
    ok = (x.notna() & y.notna()).to_numpy()
    out = np.full(len(x), np.nan)
    out[ok] = ratios(x[ok].tolist(), y[ok].tolist())
    return pd.Series(out).astype(object).where(ok, None)


def token_sort_ratio(a: Column, b: Column) -> Column:
    """Likeness of two names by their sorted Latin tokens; null names give null."""
    return F.pandas_udf(_ratio, "double")(T.sorted_tokens(a), T.sorted_tokens(b))


def alike_pairs(places: DataFrame, threshold: float, metres: float) -> DataFrame:
    """(e, r): places of a bucket nearer than ``metres`` and alike by name, e before r.

    One Latin name holds the other, or their sorted tokens are alike; the latter
    is measured only where the lengths allow it.
    """
    near = close_pairs(places, metres)
    la, lb = F.length("tokens"), F.length("tokens_b")
    possible = ~F.col("contained") & (F.least(la, lb) * 200 >= (la + lb) * threshold) & (la > 0)
    like = F.pandas_udf(_ratio, "double")(F.when(possible, F.col("tokens")), F.when(possible, F.col("tokens_b")))
    near = near.withColumn("like", like)
    return near.where(F.col("contained") | (F.col("like") >= threshold)).select(F.col("a").alias("e"), F.col("b").alias("r"))


def dedupe_pois(poi: DataFrame, threshold: float = 85.0, metres: float = 200.0) -> DataFrame:
    """One record per physical place: (poi_id, name, lat, lon, merged) of each record kept.

    Within a bucket of 0.01 degrees records count in poi_id order: one merges into
    the first group whose present holder is near and alike, and becomes its holder
    when richer (hours, fee, wikidata, ASCII name); else it founds a group.

    This order is kept by rounds over the table of alike pairs.  A record is
    decided once all its earlier neighbours are and none that is still open can
    replace one of them before it; so many are decided at a time, none by a
    task that holds a bucket.  Rounds follow the longest chain of dependence.
    ``poi_id`` is a key.
    """
    rich = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")
    ascii_name = F.coalesce(F.col("name").rlike(r"\A[\x00-\x7F]*\z"), F.lit(False)).cast("int")
    worth = rich("hours_parsed") * 8 + rich("fee_parsed") * 4 + F.col("wikidata").isNotNull().cast("int") * 2 + ascii_name
    p = bucketed(poi).select("bucket", "poi_id", "name", "lat", "lon", T.normalise_name(F.col("name")).alias("latin"), T.sorted_tokens(F.col("name")).alias("tokens"), worth.alias("worth"))
    p = materialise(p)
    pairs = materialise(alike_pairs(p, threshold, metres))
    value = p.select("poi_id", "worth")
    open_ = pairs.select("r").distinct()
    # a row of a record with itself keeps it in the table when its neighbours have gone
    rows = pairs.unionByName(open_.select(F.col("r").alias("e"), "r"))
    rows = rows.join(value.withColumnsRenamed({"poi_id": "r", "worth": "wr"}), "r").join(value.withColumnsRenamed({"poi_id": "e", "worth": "we"}), "e")
    first = rows.join(open_.select(F.col("r").alias("e"), F.lit(True).alias("later")), "e", "left")
    live = materialise(first.select("r", "wr", "e", "we", F.when(F.col("later").isNull(), F.col("e")).alias("slot")))
    done = [p.join(open_.select(F.col("r").alias("poi_id")), "poi_id", "left_anti").select(F.col("poi_id").alias("x"), F.col("poi_id").alias("slot"), F.lit(True).alias("holds"))]
    other = F.col("e") != F.col("r")
    while True:
        threat = F.min(F.when(F.col("wr") > F.col("we"), F.col("r"))).over(Window.partitionBy("e"))
        waits = other & (F.col("slot").isNull() | F.coalesce(F.col("threat") < F.col("r"), F.lit(False)))
        seen = live.withColumn("threat", threat).groupBy("r").agg(F.max(waits).alias("waits"), F.min(F.when(other, F.struct("slot", "e", "we"))).alias("at"), F.first("wr").alias("wr"))
        new = seen.where(~F.col("waits")).select(F.col("r").alias("x"), F.coalesce("at.slot", "r").alias("slot"), F.coalesce(F.col("wr") > F.col("at.we"), F.lit(True)).alias("holds"), F.col("at.e").alias("held"))
        new = materialise(new)
        if new.isEmpty():
            break
        done.append(new.select("x", "slot", "holds"))
        if len(done) > 12:
            done = [materialise(_all(done))]
        # what is new of a record: its slot if it holds one, or who took its place
        known = new.select(F.col("x").alias("e"), F.when(F.col("holds"), F.col("slot")).alias("now"), F.lit(True).alias("settled"), F.lit(None).cast("string").alias("taken"))
        known = known.unionByName(new.where("holds and held is not null").select(F.col("held").alias("e"), F.lit(None).cast("string").alias("now"), F.lit(None).cast("boolean").alias("settled"), F.col("x").alias("taken")))
        known = known.groupBy("e").agg(F.max("now").alias("now"), F.max("settled").alias("settled"), F.min("taken").alias("taken"))
        left = live.join(new.select(F.col("x").alias("r")), "r", "left_anti").join(known, "e", "left")
        gone = (F.col("settled") & F.col("now").isNull()) | (F.col("taken") < F.col("r"))
        live = materialise(left.where(~other | ~F.coalesce(gone, F.lit(False))).select("r", "wr", "e", "we", F.coalesce("slot", "now").alias("slot")))
    groups = _all(done).groupBy("slot").agg(F.max(F.when(F.col("holds"), F.col("x"))).alias("poi_id"), (F.count("*") - 1).cast("int").alias("merged"))
    return groups.join(p, "poi_id").select("poi_id", "name", "lat", "lon", "merged")


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
