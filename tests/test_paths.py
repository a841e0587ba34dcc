"""Fastest paths over contracted track, against Dijkstra's search."""

import heapq

import numpy as np
import pytest

from lodestar.operators import rail
from lodestar.sources.dims import TRAIN_KMH

CLASSES = list(TRAIN_KMH)


def frames(spark, edges, sources):
    return spark.createDataFrame(edges, "a long, b long, km double, cls string"), spark.createDataFrame([(s,) for s in sources], "src long")


def by_force(edges, sources):
    near = {}
    for a, b, km, cls in edges:
        if a != b and km is not None:
            t = km / TRAIN_KMH.get(cls, rail.OTHER_KMH) * 60.0
            near.setdefault(a, []).append((b, t, km))
            near.setdefault(b, []).append((a, t, km))
    out = {}
    for s in sources:
        todo, seen = [(0.0, 0.0, s)], {}
        while todo:
            t, km, n = heapq.heappop(todo)
            if n not in seen:
                seen[n] = (t, km)
                for m, u, w in near.get(n, ()):
                    heapq.heappush(todo, (t + u, km + w, m))
        out |= {(s, n): v for n, v in seen.items()}
    return out


def network():
    """Chains between junctions, a loop at a junction, parallel runs, rings without junctions, a dead end, a pair."""
    r = np.random.default_rng(8)
    edges, free = [], [1000]

    def chain(a, b, inner):
        nodes = [a, *range(free[0], free[0] + inner), b]
        free[0] += inner
        edges.extend((x, y, round(float(r.uniform(0.1, 9)), 4), str(r.choice([*CLASSES, "unknown"]))) for x, y in zip(nodes, nodes[1:]))

    for a, b, inner in [(1, 2, 7), (2, 3, 0), (3, 1, 12), (1, 3, 1), (2, 2, 5), (3, 4, 9), (1, 2, 3), (50, 50, 6), (60, 60, 2), (70, 71, 0)]:
        chain(a, b, inner)
    edges += [(2, 3, 0.5, "fast"), (4, 4, 1.0, "slow"), (3, 4, None, "slow"), (1003, 1004, 200.0, "hill"), (1, 2, 3.0, None)]
    return edges


def test_paths_are_those_of_dijkstra(spark):
    edges = network()
    sources = [1, 4, 1002, 1010, 1027, 50, 51, 1060, 70, 999_999, 1, 1043, 1044, 1050]
    e, s = frames(spark, edges, sources)
    got = {(x.src, x.node): x for x in rail.rail_paths(e, s).collect()}
    want = by_force(edges, set(sources))
    assert set(got) == set(want)
    for k, (t, km) in want.items():
        assert got[k].minutes == pytest.approx(t, abs=1e-6) and got[k].km == pytest.approx(km, abs=1e-6)
        assert sum(got[k].km_by_class.values()) <= got[k].km + 1e-6


def test_rounds_follow_junctions(spark, monkeypatch):
    """A line of 400 nodes and a ring of 130 take rounds by doubling, not one a node."""
    line = [(i, i + 1, 1.0 + i % 3, CLASSES[i % 4]) for i in range(400)]
    ring = [(1000 + i, 1000 + (i + 1) % 130, 1.0, "fast") for i in range(130)]
    rounds = []
    write = rail.materialise
    monkeypatch.setattr(rail, "materialise", lambda df: rounds.append(1) or write(df))
    e, s = frames(spark, line + ring, [0, 77, 1005])
    got = {(x.src, x.node): x.km for x in rail.rail_paths(e, s).collect()}
    assert len(rounds) < 60
    assert {k: round(v, 6) for k, v in got.items()} == {k: pytest.approx(v[1]) for k, v in by_force(line + ring, [0, 77, 1005]).items()}


def test_no_track_and_no_sources(spark):
    e, s = frames(spark, network(), [5])
    assert [tuple(r)[:4] for r in rail.rail_paths(e.limit(0), s).collect()] == [(5, 5, 0.0, 0.0)]
    assert rail.rail_paths(e, s.limit(0)).count() == 0
