"""Connected components of an edge table, as label hooking with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import materialise

MAX_ROUNDS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """``edges(a, b)`` -> ``(id, label)``, label being the least id of the component.

    Each round gives a node, and the node its label points to, the least label
    of its neighbours, then follows labels once more.  Rounds grow with the
    logarithm of a component's diameter.  Only a count comes to the driver.
    Every id of ``edges`` is in the result once; no edges give no rows; null
    ends are ignored and self-loops name their node.
    """
    edges = edges.where("a is not null and b is not null").select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    both = materialise(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("id")).agg(F.least(F.first("a"), F.min("b")).alias("label")))
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("near"))
        seen = labels.join(near, "id")
        best = (
            seen.select("id", F.least("label", "near").alias("label"), F.col("label").alias("old"))
            .unionByName(seen.select(F.col("label").alias("id"), F.col("near").alias("label"), F.lit(None).cast("long").alias("old")))
            .groupBy("id")
            .agg(F.min("label").alias("label"), F.max("old").alias("old"))
        )
        best = materialise(best)
        jump = best.select(F.col("id").alias("label"), F.col("label").alias("next"))
        done = materialise(best.join(jump, "label").select("id", F.least("label", "next").alias("label"), (F.least("label", "next") != F.col("old")).alias("moved")))
        labels = done.select("id", "label")
        if done.where("moved").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return labels
