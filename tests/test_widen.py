"""Widening in score bands: the rows of meeting all places, far fewer of them met."""

import math

import numpy as np

from lodestar.plans import retrieve


def tables(spark, places=4000, seed=3):
    r = np.random.default_rng(seed)
    kinds = ["beach", "temple", "museum", "park"]
    rows = []
    for i in range(places):
        kind = kinds[int(r.integers(0, 3)) if i % 400 else 3]
        score = None if i % 97 == 0 else round(float(r.integers(0, 200)) / 200, 3)
        rows.append((f"p{i:05}", float(r.uniform(6.0, 8.0)), float(r.uniform(80.0, 81.5)), float(r.integers(0, 60)), kind, score, bool(i % 5 == 0), float(r.integers(0, 10)) / 10))
    rows += [("far1", 20.0, 95.0, 0.0, "beach", 0.9, False, 0.0), ("far2", 20.1, 95.0, 0.0, "park", 0.1, False, 0.0)]
    p = spark.createDataFrame(rows, "poi_id string, lat double, lon double, entry_fee_lkr double, category string, prominence double, popularity_known boolean, popularity_index double")
    asked = [(1, 7.0, 80.7, 1e6, ["beach"]), (2, 7.0, 80.7, 100.0, ["park"]), (3, 5.0, 79.5, 1e6, ["temple", "beach"]), (4, 20.0, 95.0, 1e6, ["beach"]), (5, -40.0, 10.0, 1e6, ["beach"]), (6, 8.9, 82.4, 150.0, ["museum"]), (7, 6.1, 80.1, 0.0, ["park", "temple"]), (8, 7.5, 80.2, 1e6, ["opera"])]
    q = spark.createDataFrame(asked, "request_id long, start_lat double, start_lon double, budget double, interests array<string>")
    return rows, p, asked, q


def by_force(rows, asked):
    def km(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2))

    out = set()
    for rid, lat, lon, budget, wants in asked:
        fair = []
        for poi, a, b, fee, kind, prom, known, crowd in rows:
            if fee <= budget * 0.2:
                d = km(lat, lon, a, b)
                if d <= 250:
                    fair.append((poi, d, kind in wants, prom, None if prom is None else round(prom - (crowd if known else 0.0) * 0.35, 6)))
        steps = [
            [x for x in fair if x[2] and x[1] <= 60 and x[3] is not None and x[3] >= 0.25],
            [x for x in fair if x[2] and x[1] <= 60],
            [x for x in fair if x[2]],
            fair,
        ]
        step = next((i for i, s in enumerate(steps) if len(s) >= 15), 3)
        down = lambda v: math.inf if v is None else -v
        best = sorted(steps[step], key=lambda x: (down(x[4]), down(x[3]), x[0]))[:150]
        out |= {(rid, x[0], step, i + 1) for i, x in enumerate(best)}
    return out


def test_bands_give_the_rows_of_all_places(spark, monkeypatch):
    rows, p, asked, q = tables(spark)
    want = by_force(rows, asked)
    assert {r[2] for r in want} >= {0, 2, 3}
    met = []
    near = retrieve._near
    for one_pass in (retrieve.ONE_PASS, 0):
        seen = []
        monkeypatch.setattr(retrieve, "ONE_PASS", one_pass)
        monkeypatch.setattr(retrieve, "_near", lambda *a, seen=seen, **k: seen.append(near(*a, **k)) or seen[-1])
        assert set(map(tuple, retrieve.widen_candidates(q, p).collect())) == want
        met.append(sum(x.count() for x in seen[1:]))
        monkeypatch.undo()
    assert met[1] < met[0] * 0.6


def test_no_places_and_no_requests(spark, monkeypatch):
    _, p, _, q = tables(spark, 10)
    monkeypatch.setattr(retrieve, "ONE_PASS", 0)
    assert retrieve.widen_candidates(q, p.limit(0)).count() == 0 and retrieve.widen_candidates(q.limit(0), p).count() == 0
