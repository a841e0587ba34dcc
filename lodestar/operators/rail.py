"""Track graphs: edges, classes, gaps, snapping, fastest paths and train offers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, in_hills
from ..sources.dims import DETOUR, TRAIN_KMH
from ..sources.shared import materialise
from .near import within

OTHER_KMH = 47.6  # speed on track of a class that is not known


def track_edges(ways: DataFrame) -> DataFrame:
    """(a, b, km): consecutive nodes of each way in use, smaller node first.

    ``ways(tags, nodes, geometry)``; disused, abandoned or unfinished track is
    left out, and so is a way whose geometry does not match its nodes.
    """
    dead = F.map_contains_key("tags", "disused") | F.map_contains_key("tags", "abandoned") | F.map_contains_key("tags", "construction")
    w = ways.where(~dead & (F.size("nodes") == F.size("geometry")) & (F.size("nodes") > 1))
    pts = F.arrays_zip(F.col("nodes").alias("n"), F.col("geometry").alias("g"))
    n = F.size("nodes") - 1
    hops = F.arrays_zip(F.slice(pts, F.lit(1), n).alias("p"), F.slice(pts, F.lit(2), n).alias("q"))
    e = w.select(F.explode(hops).alias("h")).select(F.col("h.p.n").alias("x"), F.col("h.q.n").alias("y"), F.col("h.p.g").alias("p"), F.col("h.q.g").alias("q")).where("x <> y")
    km = F.round(haversine_km(F.col("p.lat"), F.col("p.lon"), F.col("q.lat"), F.col("q.lon")), 4)
    return e.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), km.alias("km")).groupBy("a", "b").agg(F.min("km").alias("km"))


def track_class(lat: Column, lon: Column, cls: Column) -> Column:
    """Hill track by place, else the line's own class, else lowland."""
    return F.when(in_hills(lat, lon), "hill").otherwise(F.when(cls.isin("fast", "slow"), cls).otherwise("lowland"))


def heal_gaps(edges: DataFrame, nodes: DataFrame, km: float = 0.05) -> DataFrame:
    """(a, b, km): each dead end joined to the nearest node in reach that it has no edge to.

    ``edges(a, b)``, ``nodes(node, lat, lon)``; judged by the edges as given.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    ends = both.groupBy(F.col("a").alias("node")).agg(F.count("*").alias("deg")).where("deg = 1").join(nodes, "node")
    near = within(ends.select("node", "lat", "lon"), nodes.select(F.col("node").alias("other"), F.col("lat").alias("slat"), F.col("lon").alias("slon")), km)
    near = near.where("node <> other").join(both.select(F.col("a").alias("node"), F.col("b").alias("other")), ["node", "other"], "left_anti").where(F.col("km") < km)
    best = near.groupBy("node").agg(F.min(F.struct("km", "other")).alias("x"))
    return best.select(F.least("node", "x.other").alias("a"), F.greatest("node", "x.other").alias("b"), F.round("x.km", 4).alias("km")).distinct()


def station_snap(stations: DataFrame, nodes: DataFrame, km: float = 0.6) -> DataFrame:
    """(station_id, node, km): the nearest track node in reach; stations without one are dropped."""
    near = within(stations.select("station_id", "lat", "lon"), nodes.select("node", F.col("lat").alias("slat"), F.col("lon").alias("slon")), km)
    best = near.where(F.col("km") < km).groupBy("station_id").agg(F.min(F.struct("km", "node")).alias("x"))
    return best.select("station_id", F.col("x.node").alias("node"), F.round("x.km", 4).alias("km"))


def station_match(wanted: DataFrame, stations: DataFrame) -> DataFrame:
    """(wanted, station_id, match): exact name, then without the word for station, then a whole-word match.

    Words of a name are entered one by one, so a match is an equi-join; wanted
    names of several words match by their first word and are then checked.
    """
    clean = lambda c: F.regexp_replace(F.lower(F.trim(c)), r"\s+(railway\s+)?station$", "")
    w = wanted.select("wanted", F.lower(F.trim("wanted")).alias("want")).withColumn("token", F.element_at(F.split("want", " "), 1))
    s = stations.select("station_id", F.lower(F.trim("name")).alias("low"), clean(F.col("name")).alias("short"))
    s = s.withColumn("token", F.explode(F.array_distinct(F.split("low", "[^a-z0-9]+")))).where("token <> ''")
    j = w.join(s, "token")
    whole = F.concat(F.lit(" "), F.regexp_replace("low", "[^a-z0-9]+", " "), F.lit(" ")).contains(F.concat(F.lit(" "), F.col("want"), F.lit(" ")))
    j = j.withColumn("match", F.when(F.col("low") == F.col("want"), 1).when(F.col("short") == F.col("want"), 2).when(whole, 3)).where("match is not null")
    best = j.groupBy("wanted").agg(F.min(F.struct("match", "station_id")).alias("x"))
    return best.select("wanted", F.col("x.station_id").alias("station_id"), F.col("x.match").alias("match"))


def _cost(parts: Column) -> list[Column]:
    """minutes, km and parts of a path: the kilometres of each class say the rest, however the path was put together."""
    rates = [60.0 / v for v in TRAIN_KMH.values()] + [60.0 / OTHER_KMH]
    minutes, km = F.lit(0.0), F.lit(0.0)
    for i, rate in enumerate(rates):
        minutes, km = minutes + parts[i] * rate, km + parts[i]
    return [F.round(minutes, 9).alias("minutes"), F.round(km, 6).alias("km"), parts.alias("parts")]


def _sum(p: str, q: str, sign: int = 1) -> Column:
    """Kilometres by class of two paths together, or how far apart they are; to the millimetre, so that any order of adding agrees."""
    return F.zip_with(p, q, lambda x, y: F.round(x + y if sign > 0 else F.abs(x - y), 6))


def _best(df: DataFrame, *by: str) -> DataFrame:
    """The fastest row of each group; then the shorter, then that with less of the first classes."""
    rest = [c for c in df.columns if c not in (*by, "parts")]
    x = df.groupBy(*by).agg(F.min(F.struct(*_cost(F.col("parts")), *rest)).alias("x"))
    return x.select(*by, "x.parts", *(f"x.{c}" for c in rest))


def _runs(hops: DataFrame, stops: DataFrame) -> DataFrame:
    """(u, v, end, last, parts, low, open): from each hop u to v on, through nodes that are no stops, to the stop at its end.

    ``hops(u, v, parts)`` in both directions; ``last`` is the node before ``end``.
    A run takes over that of the hop it has come to, so its length doubles each
    round.  ``open`` runs go round a ring without stops, whose least node is
    ``low``.
    """
    inner = hops.join(stops, F.col("u") == F.col("node"), "left_anti").groupBy("u").agg(F.min("v").alias("p"), F.max("v").alias("q"))
    r = hops.join(inner.select(F.col("u").alias("v"), "p", "q"), "v", "left")
    after = F.when(F.col("p") == F.col("u"), F.col("q")).otherwise(F.col("p"))
    # (end, go) is the hop that a run has come to and not yet taken
    r = materialise(r.select("u", "v", F.col("v").alias("end"), F.col("u").alias("last"), "parts", F.least("u", "v").alias("low"), after.alias("go")))
    while True:
        to = r.select(F.col("u").alias("end"), F.col("v").alias("go"), *(F.col(c).alias(f"{c}2") for c in ("end", "last", "parts", "low", "go")))
        on = r.where("go is not null").join(to, ["end", "go"])
        on = on.select("u", "v", F.col("end2").alias("end"), F.col("last2").alias("last"), _sum("parts", "parts2").alias("parts"), F.least("low", "low2").alias("low"), F.col("go2").alias("go"), (F.col("go2").isNull() | (F.col("low2") < F.col("low"))).alias("news"))
        on = materialise(on)
        r = r.where("go is null").unionByName(on.drop("news"))
        if not on.where("news").limit(1).count():
            return r.withColumn("open", F.col("go").isNotNull()).drop("go")
        r = materialise(r)


def contracted(edges: DataFrame) -> DataFrame:
    """(u, v, end, last, parts): for each hop u to v the run of track through nodes with two neighbours to the next junction.

    ``edges(a, b, km, cls)``.  Junctions are the nodes with another number of
    neighbours, and the least node of a ring without any.  A run from a junction is
    an edge between junctions; the two runs from an inner node say how far the
    junctions around it are.  Loops at a node and edges without length are left
    out; of parallel edges the fastest counts.
    """
    known = list(TRAIN_KMH)
    cls = [F.col("cls") == c for c in known]
    other = ~F.coalesce(F.col("cls").isin(known), F.lit(False))
    parts = F.array(*(F.when(c, F.col("km")).otherwise(0.0) for c in [*cls, other]))
    e = edges.where("a <> b and km is not null").select("a", "b", parts.alias("parts"))
    hops = materialise(_best(e.select(F.col("a").alias("u"), F.col("b").alias("v"), "parts").unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v"), "parts")), "u", "v"))
    stops = hops.groupBy(F.col("u").alias("node")).count().where("count <> 2").select("node")
    runs = _runs(hops, stops)
    rings = materialise(runs.where("open").select(F.col("low").alias("node")).distinct())
    if not rings.isEmpty():
        runs = _runs(hops, stops.unionByName(rings))
    return materialise(runs.drop("open", "low"))


def _inner(runs: DataFrame) -> DataFrame:
    """(node, end1, last1, parts1, end2, last2, parts2) of the nodes inside a run, its two ends in one order for all of them."""
    mine = runs.join(runs.select(F.col("end").alias("u")).distinct(), "u", "left_anti")
    two = mine.groupBy(F.col("u").alias("node")).agg(F.min(F.struct("end", "last", "parts")).alias("x"), F.max(F.struct("end", "last", "parts")).alias("y"))
    return two.select("node", *(F.col(f"{s}.{c}").alias(f"{c}{i}") for i, s in ((1, "x"), (2, "y")) for c in ("end", "last", "parts")))


def _ends() -> Column:
    one = lambda i: F.struct(F.col(f"end{i}").alias("end"), F.col(f"parts{i}").alias("parts"))
    return F.explode(F.array(one(1), one(2))).alias("e")


def rail_paths(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(src, node, minutes, km, km_by_class): the fastest path along the track from each source to all it reaches.

    ``edges(a, b, km, cls)``, ``sources(src)``.  Lengths count to the millimetre.
    Runs of nodes with two neighbours are contracted first, so the frontier of
    improved nodes is relaxed over junctions only; the nodes in between then take
    the better of the two ends of their run, or the way along it from a source on
    the same run.  Nodes without a path have no row; a source always reaches itself.
    km_by_class is a map of the classes on the path; of paths of one time the
    shorter counts, then that with less of the first classes.
    """
    classes = list(TRAIN_KMH)
    runs = contracted(edges)
    inner = materialise(_inner(runs))
    asked = sources.select("src").where("src is not null").distinct()
    zero = F.array(*[F.lit(0.0)] * (len(classes) + 1))
    at = asked.join(inner, F.col("src") == F.col("node"), "left")
    away = at.where("node is not null").select("src", _ends()).select("src", F.col("e.end").alias("node"), F.col("e.parts").alias("parts"))
    best = at.where("node is null").select("src", F.col("src").alias("node"), zero.alias("parts")).unionByName(away)
    best = materialise(_best(best, "src", "node").withColumn("stale", F.lit(False)))
    legs = runs.join(inner.select(F.col("node").alias("u")), "u", "left_anti").where(F.col("u") != F.col("end")).select("u", "end", "parts")
    legs = materialise(_best(legs, "u", "end").withColumnRenamed("parts", "more"))
    while True:
        front = best.where("not stale").join(legs, F.col("node") == F.col("u"))
        step = front.select("src", F.col("end").alias("node"), _sum("parts", "more").alias("parts"), F.lit(False).alias("stale"))
        # of equal paths the old one counts: it comes as 0
        both = best.select("src", "node", "parts", F.lit(0).alias("new")).unionByName(step.select("src", "node", "parts", F.lit(1).alias("new")))
        best = materialise(_best(both, "src", "node").select("src", "node", "parts", (F.col("new") == 0).alias("stale")))
        if best.where("not stale").isEmpty():
            break
    best = best.select("src", "node", "parts")
    between = inner.select(F.col("node").alias("x"), _ends()).select("x", F.col("e.end").alias("node"), F.col("e.parts").alias("more"))
    through = best.join(between, "node").select("src", F.col("x").alias("node"), _sum("parts", "more").alias("parts"))
    run = ["end1", "last1", "end2", "last2"]
    along = asked.join(inner, F.col("src") == F.col("node")).select("src", *run, F.col("parts1").alias("here")).join(inner, run)
    along = along.select("src", "node", _sum("here", "parts1", -1).alias("parts"))
    out = _best(best.unionByName(through).unionByName(along), "src", "node").select("src", "node", *_cost(F.col("parts")))
    some = F.filter(F.array(*(F.struct(F.lit(c).alias("k"), F.col("parts")[i].alias("v")) for i, c in enumerate(classes))), lambda p: p["v"] > 0)
    return out.select("src", "node", "minutes", "km", F.map_from_entries(some).alias("km_by_class"))


def train_offers(trips: DataFrame, stations: DataFrame, paths: DataFrame, access_km: float = 3.0) -> DataFrame:
    """(trip_id, minutes, track_km, from_node, to_node) of trips with a station near each end and track between.

    ``trips(trip_id, lat1, lon1, lat2, lon2)``, ``stations(node, lat, lon)``,
    ``paths(src, node, minutes, km)``.
    """
    s = stations.select("node", F.col("lat").alias("slat"), F.col("lon").alias("slon"))

    def end(n: int) -> DataFrame:
        near = within(trips.select("trip_id", F.col(f"lat{n}").alias("lat"), F.col(f"lon{n}").alias("lon")), s, access_km).where(F.col("km") < access_km)
        best = near.groupBy("trip_id").agg(F.min(F.struct("km", "node")).alias("x"))
        return best.select("trip_id", F.col("x.node").alias(f"node{n}"), F.col("x.km").alias(f"km{n}"))

    j = end(1).join(end(2), "trip_id").where("node1 <> node2")
    j = j.join(paths.select(F.col("src").alias("node1"), F.col("node").alias("node2"), "minutes", "km"), ["node1", "node2"])
    access = (F.col("km1") + F.col("km2")) * DETOUR / 20.0 * 60.0
    return j.select("trip_id", F.round(access + 20.0 + F.col("minutes"), 3).alias("minutes"), F.col("km").alias("track_km"), F.col("node1").alias("from_node"), F.col("node2").alias("to_node"))


def speed_sums(journeys: DataFrame, classes: list[str]) -> DataFrame:
    """One row of the normal equations of minutes = kilometres by class times minutes per kilometre."""
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"{a}_{b}") for i, a in enumerate(classes) for b in classes[i:]]
    return journeys.agg(*aggs, *(F.sum(F.col(a) * F.col("minutes")).alias(f"{a}_t") for a in classes), F.count("*").alias("n"))


def speed_fit(journeys: DataFrame, classes: list[str]) -> DataFrame:
    """(trip, minutes, predicted, left_out): least-squares minutes, in sample and without the row itself.

    ``journeys(trip, minutes, <class km>..)``; the sums are Spark's, the small
    system of one row and column per class is solved where it is needed.  A
    leave-one-out value uses the same sums less the row's own.
    """
    import numpy as np
    import pandas as pd

    r = speed_sums(journeys, classes).first()
    k = len(classes)
    x, t = np.zeros((k, k)), np.zeros(k)
    for i, a in enumerate(classes):
        t[i] = r[f"{a}_t"] or 0.0
        for j in range(i, k):
            x[i, j] = x[j, i] = r[f"{a}_{classes[j]}"] or 0.0

    def run(batches):
        w = np.linalg.lstsq(x, t, rcond=None)[0]
        for pdf in batches:
            v, m = pdf[classes].to_numpy(float), pdf["minutes"].to_numpy(float)
            out = [float(a @ np.linalg.lstsq(x - np.outer(a, a), t - a * b, rcond=None)[0]) for a, b in zip(v, m)]
            yield pd.DataFrame({"trip": pdf["trip"], "minutes": m, "predicted": v @ w, "left_out": out})

    return journeys.select("trip", "minutes", *classes).mapInPandas(run, "trip long, minutes double, predicted double, left_out double")


