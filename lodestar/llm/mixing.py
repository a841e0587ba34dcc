"""Mixing sources to target weights by blocks of words.

Each source's words, its documents in a fixed order, are cut into blocks of
``block`` words, of a 64th of the source where that is less, one word at least.
Every output shard draws multinomial counts of slots, first per range of sources
and then within the ranges that it drew, so it handles what it draws and not all
sources.  The running counts, put to the scale of a source's quota, number its
slots: sources meet their targets, and a shard's counts are multinomial but for
that scale.  Slot j goes to block ``permutation(j mod n)`` of the source's n
blocks, so no block is taken a third time before all are taken twice; a source
that no shard draws has its slots in one shard.  Slots and blocks meet in a join
on the index.  Sources are a table, of any number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import materialise
from .textarrays import slices

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BLOCK = 64
LEAST_BLOCKS = 64
SHARD_SLOTS = 4096
BUCKET_ROWS = 4_000
PLACE_SLOTS = 50_000
FAN_BITS = 8
SEED = 20_240_601
_WORD = r"[^\x20\x09-\x0D]+"


def permute(index: np.ndarray, n: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1 for each element: a Feistel network walked until it falls below n."""
    index, n, seed = (np.asarray(x).astype(np.uint64) for x in (index, n, seed))
    half = np.maximum(1, (np.ceil(np.log2(np.maximum(n, 2).astype(np.float64))).astype(np.int64) + 1) // 2).astype(np.uint64)
    mask = (np.uint64(1) << half) - np.uint64(1)
    x = index.copy()
    todo = np.ones(len(x), dtype=bool)
    while todo.any():
        h, m, s = half[todo], mask[todo], seed[todo]
        left, right = x[todo] >> h, x[todo] & m
        for r in range(4):
            f = (right + s + np.uint64(r * 0x9E3779B9)) * np.uint64(0xD6E8FEB86659FD93)
            f = (f ^ (f >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
            left, right = right, (left ^ (f >> np.uint64(29))) & m
        x[todo] = (left << h) | right
        todo[todo] = x[todo] >= n[todo]
    return x.astype(np.int64)


def sized(docs: DataFrame) -> DataFrame:
    """``docs`` with ``size``, its number of words (null text: 0)."""
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(_WORD)), F.lit(0)).cast("long"))


def sources_of(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, source_no, size, n_docs, target, length, blocks, quota) of ``docs(source, size)``, written once.

    Sources are numbered by code point, null last.  Targets are ``SHARE`` of all
    words by ``WEIGHTS``, none above ``MOST`` times its source: words per unit of
    weight rise by rounds over the table until no further source is full.
    """
    spark = docs.sparkSession
    found = docs.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n_docs")).orderBy(F.col("source").asc_nulls_last())
    found = materialise(found.withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    base, bases = 0, []
    for r in sorted(found.groupBy(part.alias("part")).count().collect()):
        bases.append((r["part"], base))
        base += r["count"]
    bases = spark.createDataFrame(bases, "part long, base long")
    found = found.withColumn("part", part).join(F.broadcast(bases), "part").withColumn("source_no", F.col("base") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    weight = F.element_at(F.array(*(F.lit(w) for w in WEIGHTS)), (F.pmod("source_no", F.lit(len(WEIGHTS))) + 1).cast("int"))
    found = materialise(found.select("source", "source_no", "size", "n_docs", weight.alias("weight")))

    most = MOST * F.col("size")
    unit, full = 0.0, -1
    while True:
        over = F.lit(unit) * F.col("weight") > most
        got = found.where("size > 0").agg(F.sum("size").alias("all"), F.count(F.when(over, 1)).alias("full"), F.sum(F.when(over, most)).alias("taken"), F.sum(F.when(~over, F.col("weight"))).alias("open")).first()
        if got["full"] == full or not got["open"]:
            break
        full, unit = got["full"], max(0.0, SHARE * got["all"] - (got["taken"] or 0.0)) / got["open"]
    length = F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("size") / LEAST_BLOCKS)))
    found = found.withColumn("target", F.when(F.col("size") > 0, F.least(F.lit(unit) * F.col("weight"), most)).otherwise(0.0)).withColumn("length", length.cast("int"))
    found = found.withColumn("blocks", F.ceil(F.col("size") / F.col("length")))
    # a source's last block is shorter: slots are counted by the mean of its blocks
    quota = F.when(F.col("size") > 0, F.least(2 * F.col("blocks"), F.rint(F.col("target") * F.col("blocks") / F.col("size")).cast("long"))).otherwise(0)
    return materialise(found.withColumn("quota", quota.cast("long")).drop("weight"))


def draws(sources: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """(shard, source_no, n): multinomial counts of ``SHARD_SLOTS`` slots per shard, by the quotas of ``sources``.

    The counts of a shard are drawn for ranges of sources and then inside each
    range that got any, down a tree with 2 ** ``FAN_BITS`` branches a node.
    """
    spark = sources.sparkSession
    last = sources.agg(F.max("source_no")).first()[0] or 0
    depth = max(1, -(-int(last).bit_length() // FAN_BITS))
    drawn = spark.range(0, shards, 1, max(1, min(shards // 64, 2000))).select(F.col("id").alias("shard"), F.lit(0).cast("long").alias("node"), F.lit(SHARD_SLOTS).cast("long").alias("n"))
    for level in reversed(range(depth)):
        child = F.shiftright("source_no", FAN_BITS * level)
        kids = sources.where("quota > 0").groupBy(child.alias("child")).agg(F.sum("quota").alias("q"))
        kids = kids.groupBy(F.shiftright("child", FAN_BITS).alias("node")).agg(F.sort_array(F.collect_list(F.struct("child", "q"))).alias("kids"))
        top = level == depth - 1

        def draw(batches, level=level):
            for batch in batches:
                shard, node, n = (batch.column(c).to_numpy() for c in ("shard", "node", "n"))
                kids = batch.column("kids")
                off, flat = kids.offsets.to_numpy(), kids.values
                child, q = flat.field("child").to_numpy(), flat.field("q").to_numpy()
                out: list[list[np.ndarray]] = [[], [], []]
                for i in range(len(shard)):
                    c, p = child[off[i] : off[i + 1]], q[off[i] : off[i + 1]]
                    got = np.random.default_rng([seed, int(shard[i]), level, int(node[i])]).multinomial(int(n[i]), p / p.sum())
                    at = np.flatnonzero(got)
                    for x, y in zip(out, (np.full(len(at), shard[i]), c[at], got[at])):
                        x.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in out], names=["shard", "node", "n"])

        # the root has one row of at most 2 ** FAN_BITS branches
        drawn = drawn.join(F.broadcast(kids) if top else kids, "node").select("shard", "node", "n", "kids").mapInArrow(draw, "shard long, node long, n long")
    return drawn.withColumnRenamed("node", "source_no")


def plan_mix(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed documents, the takes of each block, and the sources.

    ``docs(row, doc_id, source, size)``.  Returns (row, doc_id, size, source_no,
    start, length) with start as word offset within the source and length as that
    of the source's blocks, (source_no, block, takes), and ``sources_of``.
    """
    spark = docs.sparkSession
    sources = sources_of(docs, block)
    totals = sources.agg(F.sum("n_docs").alias("rows"), F.sum("quota").alias("slots")).first()
    rows, slots = totals["rows"] or 0, totals["slots"] or 0
    names = sources.select(F.col("source").alias("name"), "source_no", "length")
    docs = docs.join(names, docs["source"].eqNullSafe(names["name"])).select("row", "doc_id", "size", "source_no", "length", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(max(1, -(-rows // BUCKET_ROWS)))).alias("bucket"))
    w = Window.partitionBy("source_no", "bucket").orderBy("doc_id", "size", "row")
    before = F.sum("size").over(w) - F.col("size")
    part = docs.groupBy("source_no", "bucket").agg(F.sum("size").alias("part"))
    base = part.select("source_no", "bucket", (F.sum("part").over(Window.partitionBy("source_no").orderBy("bucket")) - F.col("part")).alias("base"))
    placed = docs.withColumn("before", before).join(base, ["source_no", "bucket"]).select("row", "doc_id", "size", "source_no", "length", (F.col("before") + F.col("base")).alias("start"))

    if not slots:
        return placed, spark.createDataFrame([], "source_no long, block long, takes long"), sources
    shards = -(-slots // SHARD_SLOTS)
    drawn = draws(sources, shards, seed)
    # running counts per source, by groups of shards and then within a group
    drawn = materialise(drawn.withColumn("group", F.floor(F.col("shard") / 512)))
    groups = drawn.groupBy("source_no", "group").agg(F.sum("n").alias("n"))
    by = Window.partitionBy("source_no")
    groups = groups.select("source_no", "group", (F.sum("n").over(by.orderBy("group")) - F.col("n")).alias("base"), F.sum("n").over(by).alias("drawn"))
    limits = sources.select("source_no", "quota", "blocks")
    run = F.sum("n").over(Window.partitionBy("source_no", "group").orderBy("shard"))
    slot = drawn.withColumn("upto", run).join(groups, ["source_no", "group"]).join(limits, "source_no")
    # draws are put to the scale of the source's quota, so that its slots come out even
    scaled = lambda c: F.floor(c.cast("double") * F.col("quota") / F.col("drawn")).cast("long")
    before, after = F.col("base") + F.col("upto") - F.col("n"), F.col("base") + F.col("upto")
    slot = slot.select("source_no", "blocks", "shard", scaled(before).alias("a"), F.when(after == F.col("drawn"), F.col("quota")).otherwise(scaled(after)).alias("b"))
    # a source that no shard drew has all its slots in one
    missed = limits.join(groups.select("source_no").distinct(), "source_no", "left_anti")
    slot = slot.unionByName(missed.select("source_no", "blocks", F.pmod(F.xxhash64("source_no"), F.lit(shards)).alias("shard"), F.lit(0).cast("long").alias("a"), F.col("quota").alias("b")))

    def place(batches):
        for batch in batches:
            src, n, a, b = (batch.column(c).to_numpy() for c in ("source_no", "blocks", "a", "b"))
            for i, k in slices(np.concatenate([[0], np.cumsum(b - a)]), PLACE_SLOTS):
                count = b[i:k] - a[i:k]
                many = np.repeat(np.arange(i, k), count)
                j = a[many] + np.arange(len(many)) - np.repeat(np.cumsum(count) - count, count)
                at = permute(j % n[many], n[many], np.uint64(seed) + src[many].astype(np.uint64) * np.uint64(7919))
                yield pa.RecordBatch.from_arrays([pa.array(src[many]), pa.array(at)], names=["source_no", "block"])

    slot = slot.where("b > a").repartition(-(-slots // (4 * PLACE_SLOTS)), "source_no", "shard")
    takes = slot.mapInArrow(place, "source_no long, block long").groupBy("source_no", "block").agg(F.count("*").alias("takes"))
    return placed, takes, sources


def pieces(placed: DataFrame, takes: DataFrame) -> DataFrame:
    """(row, first, last, takes): word ranges [first, last) of documents whose block is taken ``takes`` times."""
    cut = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / F.col("length")), F.floor((F.col("start") + F.col("size") - 1) / F.col("length")))))
    return cut.join(takes, ["source_no", "block"]).select(
        "row",
        F.greatest(F.lit(0), F.col("block") * F.col("length") - F.col("start")).alias("first"),
        F.least(F.col("size"), (F.col("block") + 1) * F.col("length") - F.col("start")).alias("last"),
        "takes",
    )


def mix_report(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs(doc_id, text, source)``.

    Null sources form the last source; null or empty texts have size 0 and are
    never taken; repeated rows are placed one after the other; further columns
    are ignored; an empty table gives no rows.
    """
    rows = materialise(sized(docs.select("doc_id", F.col("source").cast("string"), "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size"))
    placed, takes, sources = plan_mix(rows, block, seed)
    taken = pieces(placed, takes).groupBy("row").agg(F.sum((F.col("last") - F.col("first")) * F.col("takes")).alias("taken"))
    about = sources.select("source_no", F.col("size").alias("source_size"), "target")
    return placed.join(taken, "row", "left").join(about, "source_no").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = SEED) -> DataFrame:
    """The mix as documents: up to two copies of each, made of the words that the mix takes, in their order.

    A document taken whole keeps its text as it is; of one taken in part, runs of
    words are cut out and joined by a space.  Columns are those of ``docs``;
    n_chars, where there is one, is that of the new text.
    """
    kept = F.struct(*docs.columns).alias("doc")
    rows = materialise(sized(docs).select(kept, F.col("source").cast("string").alias("source"), "doc_id", "size", F.monotonically_increasing_id().alias("row")))
    placed, takes, _ = plan_mix(rows.select("row", "doc_id", "source", "size"), block, seed)
    cut = pieces(placed, takes).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("takes"))))
    cut = cut.groupBy("row", "copy").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("cuts"), F.sum(F.col("last") - F.col("first")).alias("words"))
    both = rows.select("row", "doc", "size").join(cut, "row")
    whole = F.col("words") == F.col("size")
    split = F.regexp_extract_all(F.col("doc.text"), F.lit(f"({_WORD})"), F.lit(1))
    both = both.withColumn("split", F.when(~whole, split))
    parts = F.flatten(F.transform("cuts", lambda c: F.slice(F.col("split"), (c["first"] + 1).cast("int"), (c["last"] - c["first"]).cast("int"))))
    text = F.when(whole, F.col("doc.text")).otherwise(F.array_join(parts, " "))
    new = {"text": text, "n_chars": F.length(text)}
    return both.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col("doc").getField(c)).alias(c) for c in docs.columns))
