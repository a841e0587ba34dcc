"""Order statistics of groups with heavy tails."""

import numpy as np
import pytest

from lodestar.operators import metrics


def heavy():
    r = np.random.default_rng(6)
    a = np.concatenate([r.integers(0, 50, 300).astype(float), r.normal(size=900), [1e12, -1e12, np.inf]])
    return {"a": a, "b": np.array([5.0]), "c": np.repeat([2.0, 3.0], [400, 401]), "d": 10.0 ** r.uniform(-300, 300, 500)}


@pytest.mark.parametrize("most", [1 << 18, 20])
def test_ranks_are_exact_and_parts_are_small(spark, monkeypatch, most):
    data = heavy()
    df = spark.createDataFrame([(g, float(x)) for g, xs in data.items() for x in xs] + [("a", None), ("e", None)], "system string, seconds double").repartition(4)
    ranks = [(g, p, int(round(p / 100 * (len(xs) - 1)))) for g, xs in data.items() for p in (0, 1, 50, 95, 100)]
    got = metrics.at_ranks(df, "system", "seconds", spark.createDataFrame(ranks, "system string, p int, r long"), parts=4, most=most)
    assert {(r.system, r.p): r.value for r in got.collect()} == {(g, p): float(np.sort(data[g])[r]) for g, p, r in ranks}


def test_no_part_is_left_large(spark, monkeypatch):
    seen = []
    whole = metrics.materialise

    def watch(df):
        out = whole(df)
        if "span" in out.columns and "base" in out.columns:
            seen.append(out)
        return out

    monkeypatch.setattr(metrics, "materialise", watch)
    xs = heavy()["d"]
    df = spark.createDataFrame([("d", float(x)) for x in xs], "system string, seconds double")
    metrics.at_ranks(df, "system", "seconds", spark.createDataFrame([("d", 50, 250)], "system string, p int, r long"), parts=4, most=20).collect()
    last = [s for s in seen if not s.isEmpty()][-1].collect()
    assert all(((xs > r.lo) & (xs <= r.hi)).sum() <= 20 for r in last)


def test_medians_with_an_outlier(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4, 1e300)] + [("y", 1.0), ("y", 4.0)], "g string, v double")
    assert {r.g: r.median for r in metrics.median_of(df, "g", "v").collect()} == {"x": 3.0, "y": 2.5}
