"""Nearest neighbours where sites are crowded, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import near


def km(a, b):
    la, lo, lb, lp = np.radians(a[:, 0])[:, None], np.radians(a[:, 1])[:, None], np.radians(b[:, 0]), np.radians(b[:, 1])
    h = np.sin((lb - la) / 2) ** 2 + np.cos(la) * np.cos(lb) * np.sin((lp - lo) / 2) ** 2
    return 2 * 6371.0 * np.arcsin(np.sqrt(np.minimum(1, h)))


def nearest(points, sites, k, same=False):
    d = np.round(km(points, sites), 9)
    if same:
        np.fill_diagonal(d, np.inf)
    return {(p, r + 1): int(s) for p, row in enumerate(d) for r, s in enumerate(np.lexsort((np.arange(len(sites)), row))[:k]) if np.isfinite(row[s])}


def frames(spark, points, sites):
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "pid long, lat double, lon double")
    s = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(sites)], "sid long, slat double, slon double")
    return p, s


def shapes():
    r = np.random.default_rng(4)
    even = np.column_stack([r.uniform(6, 8, 300), r.uniform(80, 82, 300)])
    town = np.column_stack([7 + r.normal(size=400) * 0.0005, 81 + r.normal(size=400) * 0.0005])
    far = np.column_stack([r.uniform(-60, 75, 40), r.uniform(-170, 170, 40)])
    north = np.column_stack([r.uniform(78, 89.9, 60), r.uniform(-179, 179, 60)])
    spot = np.tile([[6.5, 80.5]], (120, 1))
    return {"town in a plain": np.vstack([even[:40], town]), "far apart": np.vstack([far, town[:150]]), "one spot": np.vstack([spot, even[:80]]), "north": np.vstack([north, far[:10]])}


@pytest.mark.parametrize("shape", ["town in a plain", "far apart", "one spot", "north"])
@pytest.mark.parametrize("k", [1, 6])
def test_nearest_where_sites_are_crowded(spark, shape, k):
    sites = shapes()[shape]
    points = np.vstack([sites[::7], shapes()["far apart"][:20] + 0.013, sites[-20:] + 0.0007])
    if shape == "north":
        points = points[np.abs(points[:, 1]) < 150]
    p, s = frames(spark, points, sites)
    got = {(r.pid, r.rn): r.sid for r in near.k_nearest(p, s, k).collect()}
    assert got == nearest(points, sites, k)


def test_same_ids_are_left_out(spark):
    sites = shapes()["town in a plain"]
    p, s = frames(spark, sites, sites)
    assert {(r.pid, r.rn): r.sid for r in near.k_nearest(p, s, 5, same=True).collect()} == nearest(sites, sites, 5, same=True)


def test_a_crowded_place_meets_few_pairs(spark, monkeypatch):
    """Pairs that are measured stay in proportion to the points, even with nearly all sites in one place."""
    r = np.random.default_rng(9)
    town = np.column_stack([7 + r.uniform(size=3960) * 0.02, 81 + r.uniform(size=3960) * 0.02])
    plain = np.column_stack([r.uniform(6, 8, 40), r.uniform(80, 82, 40)])
    even = np.column_stack([r.uniform(6, 8, 4000), r.uniform(80, 82, 4000)])
    cost = {}
    for name, sites in (("even", even), ("town", np.vstack([town, plain]))):
        seen = []
        level = near._levels

        def counted(df, lat, lon, levels, level=level, seen=seen):
            out = level(df, lat, lon, levels)
            if "sid" in df.columns and levels != [near.FINEST]:
                seen.append(out)
            return out

        fronts = []
        ranked = near._beside

        def beside(df, side, wide, ranked=ranked, fronts=fronts):
            out = ranked(df, side, wide)
            fronts.append(out)
            return out

        monkeypatch.setattr(near, "_levels", counted)
        monkeypatch.setattr(near, "_beside", beside)
        p, s = frames(spark, sites, sites)
        got = near.k_nearest(p, s, 5, same=True)
        assert got.count() == 5 * len(sites)
        wide = next(f for f in fronts if "reach" in f.columns)
        cost[name] = wide.join(seen[0], ["level", "cx", "cy"]).count()
        monkeypatch.undo()
    assert cost["town"] < 2 * cost["even"]


def test_all_pairs_are_dealt_by_their_number(spark, monkeypatch):
    """As brute force with many ids at one spot; a distance is taken once for two spots, and no task has most of the pairs."""
    monkeypatch.setattr(near, "BLOCK", 2000)
    monkeypatch.setattr(near, "MEMBERS", 8)
    r = np.random.default_rng(3)
    points = np.vstack([np.column_stack([r.uniform(6, 8, 150), r.uniform(80, 82, 150)]), np.tile([[7.0, 81.0]], (30, 1))])
    sites = np.vstack([np.column_stack([r.uniform(6, 8, 300), r.uniform(80, 82, 300)]), np.tile([[7.05, 81.05]], (200, 1)), points[:20]])
    p, s = frames(spark, points, sites)
    p, s = p.union(spark.sql("select 900L, cast(null as double), 81d")), s.union(spark.sql("select 900L, 7d, cast(null as double)"))
    got = near.pairs_within(p, s, 20.0, 3)
    d = km(points, sites)
    want = sorted((i, j, round(float(d[i, j]), 3)) for i, j in np.argwhere(d <= 20.0))
    rows = sorted(tuple(x) for x in got.collect())
    assert [x[:2] for x in rows] == [x[:2] for x in want] and np.allclose([x[2] for x in rows], [x[2] for x in want], atol=1.1e-3)
    parts = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == len(want) > 6000 and max(parts) < len(want) / 2


def test_nearby_stays_with_a_crowd_match_brute_force(spark, monkeypatch):
    """Shares of the pairs that tasks have follow their number, not the bytes of the tables."""
    from lodestar import queries_places as Q

    monkeypatch.setattr(near, "BLOCK", 500, raising=False)
    path = "/root/testdata/sf0.01"
    got = Q.nearby_stays(spark, path)
    st, a = Q.V.v_station(spark, path), Q.V.v_stay(spark, path).where(~Q.V.is_hotel(F.col("sltda_type")))
    st, a = st.select("station_id", "lat", "lon").collect(), a.select("acc_id", "lat", "lon").collect()
    d = km(np.array([x[1:] for x in st]), np.array([x[1:] for x in a]))
    want = sorted((st[i].station_id, a[j].acc_id, round(float(d[i, j]), 3)) for i, j in np.argwhere(d <= 20.0))
    rows = sorted(tuple(x) for x in got.collect())
    assert [x[:2] for x in rows] == [x[:2] for x in want] and np.allclose([x[2] for x in rows], [x[2] for x in want], atol=1.1e-3)
    parts = [x["count"] for x in got.groupBy(F.spark_partition_id()).count().collect()]
    assert max(parts) < len(want) / 3


def ragged(sides, seed, x=80.0, y=7.0):
    """A star-shaped ring of ``sides`` sides with a ragged edge, its sides in any order."""
    r = np.random.default_rng(seed)
    turn = np.sort(r.uniform(0, 2 * np.pi, sides))
    far = 0.6 + 0.3 * np.sin(5 * turn) + r.uniform(-0.05, 0.05, sides)
    at = np.column_stack([x + far * np.cos(turn), y + far * np.sin(turn)])
    return np.hstack([at, np.roll(at, -1, axis=0)])[r.permutation(sides)]


def inside(points, sides):
    lat, lon = points[:, :1], points[:, 1:]
    ax, ay, bx, by = sides.T
    with np.errstate(divide="ignore", invalid="ignore"):
        cross = ((ay > lat) != (by > lat)) & (lon < (bx - ax) * (lat - ay) / (by - ay) + ax)
    return cross.sum(1) % 2 == 1


def test_points_in_ragged_polygons(spark):
    """As testing all sides; latitudes of corners, level sides and overlapping polygons included."""
    box = np.array([[79.0, 6.0, 81.0, 6.0], [81.0, 6.0, 81.0, 8.0], [81.0, 8.0, 79.0, 8.0], [79.0, 8.0, 79.0, 6.0]])
    shapes_ = {"b": ragged(400, 1), "c": ragged(37, 2, 80.4, 7.3), "d": box, "a": ragged(3, 3, 80.1, 6.9)}
    r = np.random.default_rng(5)
    points = np.column_stack([r.uniform(5.8, 8.4, 600), r.uniform(78.8, 81.6, 600)])
    points = np.vstack([points, np.column_stack([shapes_["b"][:60, 1], r.uniform(79, 81, 60)]), [[6.0, 80.0], [8.0, 80.0], [7.0, 79.0], [7.0, 81.0]]])
    names = sorted(shapes_)
    held = np.array([inside(points, shapes_[n]) for n in names])
    want = {i: names[int(np.argmax(h))] for i, h in enumerate(held.T) if h.any()}
    p = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)] + [(9999, None, None)], "pid long, lat double, lon double")
    s = spark.createDataFrame([(n, *map(float, x)) for n in names for x in shapes_[n]], "district string, ax double, ay double, bx double, by double")
    assert {x.pid: x.district for x in near.containing(p, s).collect()} == want
    assert near.containing(p, s.limit(0)).count() == 0 and near.containing(p.limit(0), s).count() == 0


def test_sides_met_by_a_point_do_not_grow_with_the_polygon(spark, monkeypatch):
    r = np.random.default_rng(7)
    points = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(np.column_stack([r.uniform(6.4, 7.6, 500), r.uniform(79.4, 80.6, 500)]))], "pid long, lat double, lon double")
    met = {}
    for n in (200, 20_000):
        turn = np.linspace(0, 2 * np.pi, n, endpoint=False)
        at = np.column_stack([80 + 0.7 * np.cos(turn), 7 + 0.7 * np.sin(turn)])
        s = spark.createDataFrame([("x", *map(float, x)) for x in np.hstack([at, np.roll(at, -1, axis=0)])], "district string, ax double, ay double, bx double, by double")
        seen = []
        level = near._level
        monkeypatch.setattr(near, "_level", lambda c, level=level: seen.append(c) or level(c))
        assert near.containing(points, s).count() == sum((np.hypot(x.lon - 80, x.lat - 7) < 0.7) for x in points.collect())
        monkeypatch.undo()
        assert seen == ["lat", "low", "top"]
        box = s.selectExpr("min(least(ay, by)) as y0", "(max(greatest(ay, by)) - min(least(ay, by))) / count(*) as high")
        rows = s.where("ay <> by").crossJoin(box).selectExpr("explode(sequence(floor((least(ay, by) - y0) / high), floor((greatest(ay, by) - y0) / high))) as row")
        met[n] = points.crossJoin(box).selectExpr("floor((lat - y0) / high) as row").join(rows, "row").count() / 500
    assert met[20_000] < 1.5 * met[200] < 15


def test_first_within_are_those_of_all_pairs(spark, monkeypatch):
    """The first by rounded distance, then id, with crowds, ties and points of few sites in reach; not all pairs are met."""
    r = np.random.default_rng(5)
    fine = np.column_stack([7 + r.integers(0, 6, 120) * 4e-7, 81 + r.integers(0, 6, 120) * 4e-7])  # some 0.04 m apart: equal when rounded
    sites = np.vstack([np.column_stack([r.uniform(6, 8, 1500), r.uniform(80, 82, 1500)]), fine, np.tile([[6.5, 80.5]], (40, 1)), shapes()["town in a plain"][40:], [[9.0, 80.0], [9.05, 80.0]]])
    points = np.vstack([np.column_stack([r.uniform(6, 8, 60), r.uniform(80, 82, 60)]), fine[:5], [[6.5, 80.5], [6.5, 80.5], [7.0, 81.0], [9.01, 80.0], [8.9, 81.9], [40.0, 10.0]]])
    p, s = frames(spark, points, sites)
    p = p.withColumnRenamed("pid", "station").union(spark.sql("select 900L, cast(null as double), 81d"))
    s = s.select(F.format_string("n%d", "sid").alias("poi"), "slat", "slon").union(spark.sql("select 'none', 7d, cast(null as double)"))
    every = near.within(p, s, 15.0).select("station", "poi", F.round("km", 4).alias("km")).collect()
    want = {}
    for x in sorted(every, key=lambda x: (x.km, x.poi)):
        want.setdefault(x.station, []).append((x.km, x.poi))
    want = {(a, *b) for a, of in want.items() for b in of[:10]}
    met, inside = [], near.haversine_km
    monkeypatch.setattr(near, "haversine_km", lambda *a: met.append(a) or inside(*a))
    got = near.within(p, s, 15.0, first=("poi", 10, 4))
    assert {(x.station, x.km, x.poi) for x in got.collect()} == want and got.count() == len(want)
    assert {x[0] for x in want} >= {60, 65, 66, 68} and not {x[0] for x in want} & {70, 900} and len(want) < len(every) / 4


def test_nearby_places_meet_few_of_the_pairs(spark, monkeypatch):
    """The query's rows are those of all pairs in reach, and it does not make these."""
    from lodestar import queries_places as Q

    path = "/root/testdata/sf0.01"
    made = []
    spread = near._spread
    monkeypatch.setattr(near, "_spread", lambda *a: made.append(a) or spread(*a))
    got = {tuple(x) for x in Q.nearby_places(spark, path).collect()}
    assert not made
    st, poi = Q.V.v_station(spark, path).select("station_id", "lat", "lon").collect(), Q.V.v_poi(spark, path).select("poi_id", "lat", "lon").collect()
    d = np.round(km(np.array([x[1:] for x in st]), np.array([x[1:] for x in poi])), 4)
    want = set()
    for i, x in enumerate(st):
        near_by = sorted((d[i, j], poi[j].poi_id) for j in np.flatnonzero(d[i] <= 15.0))[:10]
        want |= {(x.station_id, n + 1, b, a) for n, (a, b) in enumerate(near_by)}
    assert {x[:3] for x in got} == {x[:3] for x in want} and len(got) == 971
