"""Distance joins on grids: nearest neighbours, radius joins, polygons.

No join compares all points with all sites: both sides meet on a grid cell.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import haversine_km, road_minutes
from ..sources.shared import materialise

KM_PER_DEGREE = 109.0  # at least, for either axis within 11 degrees of the equator
EARTH_KM = 6371.0
ONE_PASS = 50_000_000  # points times sites that are met at once rather than in bands
WHOLE = 400.0  # a cell of so many degrees has all sites in reach
MEMBERS = 64  # about so many ids of a spot share a row
BLOCK = 1 << 24  # pairs of ids in the cells of a block, in reach or not


def _spread(sites: DataFrame, size: float, lat: str = "slat", lon: str = "slon") -> DataFrame:
    """Sites once in each of the nine cells around theirs."""
    around = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (-1, 0, 1) for y in (-1, 0, 1)))
    s = sites.withColumn("_d", F.explode(around))
    return s.withColumns({"_cx": F.floor(F.col(lat) / size) + F.col("_d.dx"), "_cy": F.floor(F.col(lon) / size) + F.col("_d.dy")}).drop("_d")


def _reach_km(size: Column):
    """No site beyond the nine cells around a point is nearer than this; parallels shrink away from the equator."""
    across = F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.least(size, F.lit(90.0))))) * EARTH_KM
    return F.least(size * KM_PER_DEGREE, across) * 0.999


FINEST = 20  # level l has cells of WHOLE / 2 ** l degrees: 42 metres at the finest
AROUND = 2  # cells on each side of a point's own that are looked at where nine are not enough


def _width(level: Column) -> Column:
    return F.lit(WHOLE) / F.pow(F.lit(2.0), level)


def _up(cell: str, by: Column) -> Column:
    """A cell's number ``by`` levels higher: a half at each, rounded down."""
    return F.floor(F.col(cell) / F.pow(F.lit(2.0), by)).cast("long")


def _levels(df: DataFrame, lat: str, lon: str, levels: list[int]) -> DataFrame:
    """Rows once for each level, with their cell there."""
    width = WHOLE / 2**FINEST
    d = df.withColumns({"_fx": F.floor(F.col(lat) / width), "_fy": F.floor(F.col(lon) / width), "level": F.explode(F.array(*map(F.lit, levels)))})
    up = F.lit(FINEST) - F.col("level")
    return d.withColumns({"cx": _up("_fx", up), "cy": _up("_fy", up)}).drop("_fx", "_fy")


def _cell_counts(sites: DataFrame) -> DataFrame:
    """(level, cx, cy, n) of the cells that hold sites."""
    fine = _levels(sites, "slat", "slon", [FINEST]).groupBy("cx", "cy").agg(F.count("*").alias("n"))
    each = fine.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(FINEST))))
    up = F.lit(FINEST) - F.col("level")
    return each.groupBy("level", _up("cx", up).alias("cx"), _up("cy", up).alias("cy")).agg(F.sum("n").alias("n"))


def _pruned(front: DataFrame, need: int, unit: float = 0.0, beyond: float = float("inf")) -> DataFrame:
    """Cells of each point that may hold one of its ``need`` nearest sites, or one as near to within ``unit``, and none ``beyond`` so many kilometres.

    Every site of a cell is within the cell's far distance, so the nearest
    ``need`` are within the far distance at which the counts add up to it; a cell
    whose near distance is beyond that holds none.
    """
    width = _width(F.col("level"))
    half = lambda x: F.pow(F.sin(F.radians(x) / 2), F.lit(2.0))
    span = lambda at, cell: (F.greatest(F.col(cell) * width - F.col(at), F.col(at) - (F.col(cell) + 1) * width, F.lit(0.0)), F.greatest((F.col(cell) + 1) * width - F.col(at), F.col(at) - F.col(cell) * width))
    (u0, u1), (v0, v1) = span("lat", "cx"), span("lon", "cy")
    south, north = F.greatest(F.col("cx") * width, F.lit(-90.0)), F.least((F.col("cx") + 1) * width, F.lit(90.0))
    least = F.greatest(F.least(F.cos(F.radians(south)), F.cos(F.radians(north))), F.lit(0.0))
    most = F.when((south <= 0) & (north >= 0), 1.0).otherwise(F.greatest(F.cos(F.radians(south)), F.cos(F.radians(north))))
    own = F.cos(F.radians("lat"))
    # around the globe a difference beyond 180 degrees is a smaller one
    low = half(F.least(u0, F.lit(180.0))) + own * least * F.least(half(v0), half(v1))
    high = half(F.least(u1, F.lit(180.0))) + own * most * F.when((v0 <= 180) & (v1 >= 180), 1.0).otherwise(F.greatest(half(v0), half(v1)))
    km = lambda h: 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    f = front.withColumns({"_near": km(low) * 0.999 - 1e-6, "_far": km(high) * 1.001 + 1e-6 + unit})
    upto = F.sum("n").over(Window.partitionBy("pid").orderBy("_far", "level", "cx", "cy"))
    f = f.withColumn("_upto", upto)
    limit = F.min(F.when(F.col("_upto") >= need, F.col("_far"))).over(Window.partitionBy("pid"))
    f = f.withColumn("limit", F.least(F.coalesce(limit, F.lit(float("inf"))), F.lit(beyond)))
    return f.where(F.col("_near") <= F.col("limit")).drop("_near", "_far", "_upto")


def _own_cells(points: DataFrame, cells: DataFrame, least: int) -> DataFrame:
    """``points`` with the finest cell around each that holds ``least`` sites, as at; null without one."""
    full = cells.where(F.col("n") >= least)
    found = [r["level"] for r in full.select("level").distinct().collect()]  # one for each level
    own = _levels(points, "lat", "lon", sorted({0, *found})).join(full.select("level", "cx", "cy", F.lit(True).alias("full")), ["level", "cx", "cy"], "left")
    return own.groupBy("pid").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.max(F.when(F.col("full"), F.struct("level", "cx", "cy"))).alias("at"))


def _beside(df: DataFrame, side: Column | int, wide: Column | int) -> DataFrame:
    """Rows of a cell ``at`` once for each cell around it."""
    span = lambda n: F.explode(F.sequence(-n, n))
    d = df.withColumn("_dx", span(F.lit(side) if isinstance(side, int) else side)).withColumn("_dy", span(F.lit(wide) if isinstance(wide, int) else wide))
    return d.withColumns({"level": F.col("at.level"), "cx": F.col("at.cx") + F.col("_dx"), "cy": F.col("at.cy") + F.col("_dy")}).drop("_dx", "_dy")


def _cells_near(points: DataFrame, cells: DataFrame, need: int, cap: int, unit: float = 0.0, most: float = float("inf")) -> tuple[DataFrame, list[int]]:
    """(pid, lat, lon, level, cx, cy), and its levels: cells that together hold the ``need`` nearest sites of each point, at most ``cap`` sites in one where cells are split that far.

    A point starts around its own cell at the finest level where that cell alone
    holds enough sites, or from the whole where the cells around do not reach far
    enough.  Crowded cells are replaced by their occupied parts, and cells that
    are too far for the point are dropped, until none is crowded.
    """
    whole = F.struct(F.lit(0).alias("level"), F.floor(F.col("lat") / WHOLE).alias("cx"), F.floor(F.col("lon") / WHOLE).alias("cy"))
    cols = ["pid", "lat", "lon", "level", "cx", "cy", "n"]

    def around(p: DataFrame) -> DataFrame:
        wide = F.least(F.lit(12), F.ceil(AROUND / F.greatest(F.cos(F.radians("lat")), F.lit(0.01)))).cast("int")
        return _pruned(_beside(p.withColumn("wide", wide), AROUND, F.col("wide")).drop("at").join(cells, ["level", "cx", "cy"]), need, unit, most)

    crowded = (F.col("n") > cap) & (F.col("level") < FINEST)

    def kept(front: DataFrame, proven: Column) -> tuple[DataFrame, bool, bool, list[int]]:
        """The table once written; whether points in it want more around them, whether cells are crowded, and its levels."""
        front = materialise(front.withColumn("proven", proven).select(*cols, "proven"))
        r = front.agg(F.max(~F.col("proven")), F.max(crowded), F.collect_set("level")).first()
        return front, bool(r[0]), bool(r[1]), sorted(r[2])

    width = _width(F.col("level"))
    across = F.asin(F.cos(F.radians("lat")) * F.sin(F.radians(F.least(F.col("wide") * width, F.lit(90.0))))) * EARTH_KM
    proven = (F.col("level") == 0) | (F.col("limit") <= F.least(AROUND * width * KM_PER_DEGREE, across) * 0.999)
    front, short, more, levels = kept(around(_own_cells(points, cells, need).withColumn("at", F.coalesce("at", whole))), proven)
    if short:
        again = front.where(~F.col("proven")).select("pid", "lat", "lon").distinct()
        front, _, more, levels = kept(front.where("proven").select(*cols).unionByName(around(again.withColumn("at", whole)).select(*cols)), F.lit(True))
    while more:
        deeper = F.least(F.lit(2), FINEST - F.col("level"))
        part = F.explode(F.sequence(F.lit(0), (F.pow(F.lit(2), deeper) - 1).cast("int")))
        parts = front.where(crowded).withColumn("deeper", deeper).withColumn("dx", part).withColumn("dy", part)
        at = lambda c, d: (F.col(c) * F.pow(F.lit(2), F.col("deeper")) + F.col(d)).cast("long").alias(c)
        parts = parts.select("pid", "lat", "lon", (F.col("level") + F.col("deeper")).cast("int").alias("level"), at("cx", "dx"), at("cy", "dy"))
        parts = parts.join(cells, ["level", "cx", "cy"]).select(*cols)
        front, _, more, levels = kept(_pruned(front.where(~crowded).select(*cols).unionByName(parts), need, unit, most), F.lit(True))
    return front.select("pid", "lat", "lon", "level", "cx", "cy"), levels


def k_nearest(points: DataFrame, sites: DataFrame, k: int, same: bool = False, digits: int | None = None, most: float = float("inf")) -> DataFrame:
    """(pid, sid, km, rn): the k nearest sites of each point, nearest first, ties by sid.

    ``points(pid, lat, lon)``, ``sites(sid, slat, slon)``.  Cells follow the
    density: sites are counted on levels of cells, halved at each, and a point
    takes the level on which its own cell holds about as many sites as it wants,
    so that a crowded place costs no more than an even one.  What the nine cells
    there do not prove, or where they are crowded, is found by splitting cells
    under bounds from the counts.  The result is exact.

    Of sites at one place only the first few ids can count; the others are left
    out first.  The surroundings of a point do not reach over the 180th meridian.
    With ``same`` a site of the point's own id is left out, with ``digits`` sites
    are as near as their rounded distance says, and with ``most`` those beyond it
    are left out, so that a point may have fewer.  Points with null
    coordinates have no rows; fewer sites than k give all of them; a pid repeated
    is one point.
    """
    need, unit = k + 1 if same else k, 0.0 if digits is None else 10.0**-digits
    points = points.select("pid", "lat", "lon").where("lat is not null and lon is not null").dropDuplicates(["pid"])
    sites = sites.select("sid", "slat", "slon").where("slat is not null and slon is not null")
    sites = sites.withColumn("_rn", F.row_number().over(Window.partitionBy("slat", "slon").orderBy("sid"))).where(F.col("_rn") <= need).drop("_rn")
    sites = materialise(sites)
    cells = materialise(_cell_counts(sites))
    by = Window.partitionBy("pid")

    def ranked(front: DataFrame, levels: list[int], within_reach: bool) -> DataFrame:
        j = front.join(_levels(sites, "slat", "slon", levels or [0]), ["level", "cx", "cy"])
        if same:
            j = j.where(F.col("pid") != F.col("sid"))
        if within_reach:  # what is outside the box is out of reach as well
            j = j.where((F.abs(F.col("slat") - F.col("lat")) <= F.col("width")) & (F.abs(F.col("slon") - F.col("lon")) <= F.col("width")))
        j = j.withColumn("km", haversine_km("lat", "lon", "slat", "slon"))
        if within_reach:
            j = j.where(F.col("km") <= F.col("reach"))
        if most < float("inf"):
            j = j.where(F.col("km") <= most)
        if digits is not None:
            j = j.withColumn("km", F.round("km", digits))
        j = j.select("pid", "sid", "km", *(["reach"] if within_reach else []))
        return j.withColumn("rn", F.row_number().over(by.orderBy("km", "sid"))).where(F.col("rn") <= k)

    own = materialise(_own_cells(points, cells, (need + 2) // 3))
    nine = _beside(own.where("at is not null").select("at").distinct(), 1, 1).join(cells, ["level", "cx", "cy"]).groupBy("at").agg(F.sum("n").alias("held"))
    easy = own.join(nine.where(F.col("held") <= 16 * need + 64).select("at"), "at")
    easy = easy.withColumn("width", _width(F.col("at.level"))).withColumn("reach", _reach_km(F.col("width")))
    levels = [r["level"] for r in own.where("at is not null").select("at.level").distinct().collect()]  # one for each level
    top = ranked(_beside(easy, 1, 1).drop("at"), sorted(levels), True)
    # what is out of reach is no nearer than the last, rounded or not, or beyond what counts
    last = F.max("km").over(by)
    top = top.withColumn("_n", F.count("*").over(by)).withColumn("_last", last).where((F.col("reach") >= most) | ((F.col("_n") == k) & (F.col("_last") <= F.col("reach") - unit)))
    top = materialise(top.select("pid", "sid", "km", "rn"))
    left = materialise(own.join(top.where("rn = 1").select("pid"), "pid", "left_anti").select("pid", "lat", "lon"))
    if left.isEmpty():
        return top
    return top.unionByName(ranked(*_cells_near(left, cells, need, max(48, 4 * need), unit, most), False))


def within(points: DataFrame, sites: DataFrame, km: float, on: tuple[str, ...] = (), first: tuple[str, int, int] | None = None) -> DataFrame:
    """Pairs of ``points(.., lat, lon)`` and ``sites(.., slat, slon)`` at most ``km`` apart and equal in the columns ``on``, with their distance as km.

    With ``first``, which is a column of ``sites``, a number n and one of digits,
    only that column, and of each point only the n sites that come first by their
    distance rounded to so many digits, then by that column.  These are found
    around each spot of points by ``k_nearest``, so not all pairs in reach are met.
    """
    if first:
        if on:
            raise ValueError("first is for all sites")
        name, n, digits = first
        spots = materialise(points.where("lat is not null and lon is not null").select("lat", "lon").distinct().withColumn("_pid", F.monotonically_increasing_id()))
        near = k_nearest(spots.withColumnRenamed("_pid", "pid"), sites.select(F.col(name).alias("sid"), "slat", "slon"), n, digits=digits, most=km)
        return points.join(spots, ["lat", "lon"]).join(near.select(F.col("pid").alias("_pid"), F.col("sid").alias(name), "km"), "_pid").drop("_pid")
    size = max(0.002, km / KM_PER_DEGREE)
    p = points.withColumns({"_cx": F.floor(F.col("lat") / size), "_cy": F.floor(F.col("lon") / size)})
    return p.join(_spread(sites, size), ["_cx", "_cy", *on]).drop("_cx", "_cy").withColumn("km", haversine_km("lat", "lon", "slat", "slon")).where(F.col("km") <= km)


def _spots(df: DataFrame, of: str, lat: str, lon: str) -> DataFrame:
    """(lat, lon, part, ids): the ids of each spot, in parts of about ``MEMBERS``; rows without coordinates are left out."""
    parts = df.groupBy(lat, lon).agg(F.ceil(F.count("*") / MEMBERS).alias("parts"))
    j = df.join(parts, [lat, lon]).withColumn("part", F.pmod(F.xxhash64(of), F.col("parts")))
    return j.groupBy(lat, lon, "part").agg(F.collect_list(of).alias("ids"))


def pairs_within(points: DataFrame, sites: DataFrame, km: float, digits: int) -> DataFrame:
    """(pid, sid, km): all pairs of ``points(pid, lat, lon)`` and ``sites(sid, slat, slon)`` at most ``km`` apart, the distance then rounded.

    Where both tables fill one area the result grows with their product, so a pair
    costs no more than its row: distances are taken and rounded once for two spots,
    whose ids are spelled out afterwards.  Few bytes meet many, so tasks are dealt
    by the pairs to be met: the sites of a cell are parted into blocks, and the
    points around it, best the fewer, go to each.
    """
    size = max(0.002, km / KM_PER_DEGREE)
    cell = ["_cx", "_cy"]
    p = materialise(_spots(points.select("pid", "lat", "lon"), "pid", "lat", "lon").withColumnRenamed("ids", "pids"))
    s = materialise(_spots(sites.select("sid", "slat", "slon"), "sid", "slat", "slon").withColumnRenamed("ids", "sids"))
    p, s = _spread(p, size, "lat", "lon").drop("part"), s.withColumns({"_cx": F.floor(F.col("slat") / size), "_cy": F.floor(F.col("slon") / size)})
    held = lambda df, ids: df.groupBy(cell).agg(F.sum(F.size(ids)).alias(ids))
    met = materialise(held(p, "pids").join(held(s, "sids"), cell).select(*cell, (F.col("pids") * F.col("sids")).alias("pairs")))
    tasks = -(-(met.agg(F.sum("pairs")).first()[0] or 1) // BLOCK)
    blocks = met.select(*cell, F.ceil(F.col("pairs") / BLOCK).alias("blocks"))
    p = p.join(blocks, cell).withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    s = s.join(blocks, cell).withColumn("_block", F.pmod(F.xxhash64("slat", "slon", "part"), F.col("blocks"))).drop("blocks", "part")
    key = [*cell, "_block"]
    j = s.repartition(tasks, *key).join(p.repartition(tasks, *key), key)
    j = j.where((F.abs(F.col("slat") - F.col("lat")) <= size) & (F.abs(F.col("slon") - F.col("lon")) <= size))
    j = j.withColumn("km", haversine_km("lat", "lon", "slat", "slon")).where(F.col("km") <= km).select("pids", "sids", F.round("km", digits).alias("km"))
    return j.select(F.explode("pids").alias("pid"), "sids", "km").select("pid", F.explode("sids").alias("sid"), "km")


def score_cuts(scores: DataFrame, limit: int, by: float = 2.0) -> tuple[int, list[float]]:
    """The number of rows, and the values of ``band_score`` that part them into bands, falling; the first holds ``2 * limit`` at least, the rest ``by - 1`` times all above."""
    n = scores.count()
    top, t = [], 1 / by
    while n * t >= 2 * limit:
        top.append(t)
        t /= by
    if not top:
        return n, []
    found = scores.agg(F.percentile_approx("band_score", [1 - t for t in top], F.lit(10_000))).first()[0]
    return n, sorted(set(found or []), reverse=True)


def best_within(points: DataFrame, sites: DataFrame, km: float, by: str, limit: int) -> DataFrame:
    """Rows of ``within`` for ``points(pid, lat, lon)`` of distinct pid, the ``limit`` with the highest ``by`` of each point and all that tie with them among them.

    A site's value is the same for all points, so sites are met in bands of falling
    value, nulls last, and a point leaves once the bands so far hold enough for it.
    """
    points, sites = materialise(points), materialise(sites)
    asked = points.count()
    n, cuts = score_cuts(sites.select(F.col(by).alias("band_score")), limit)
    if asked * n <= ONE_PASS or not cuts:
        return within(points, sites, km).drop("lat", "lon", "slat", "slon")
    sites = sites.withColumn("_band", sum((F.when(F.col(by) >= cut, 0).otherwise(1) for cut in cuts), F.lit(0)))
    tasks = 4 * points.sparkSession.sparkContext.defaultParallelism  # few bytes meet many sites: dealt by points, not by size
    left, found = materialise(points.withColumn("_held", F.lit(0).cast("long")).repartition(tasks, "pid")), None
    for band in range(len(cuts) + 1):
        met = materialise(within(left.drop("_held"), sites.where(F.col("_band") == band), km).drop("lat", "lon", "slat", "slon", "_band"))
        found = met if found is None else found.unionByName(met)
        if band < len(cuts):
            more = met.groupBy("pid").agg(F.count("*").alias("_more"))
            left = left.join(more, "pid", "left").withColumn("_held", F.col("_held") + F.coalesce("_more", F.lit(0))).drop("_more")
            left = materialise(left.where(F.col("_held") < limit))
            if left.isEmpty():
                break
    return found


def knn_edges(poi: DataFrame, k: int = 25) -> DataFrame:
    """Undirected travel edges: the k nearest of every place, both directions joined, smaller number first.

    ``poi(k, poi_id, lat, lon)``; kilometres to two places, minutes to one.
    """
    near = k_nearest(poi.select(F.col("k").alias("pid"), "lat", "lon"), poi.select(F.col("k").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon")), k, same=True)
    # the distance is taken from the smaller side, so that both directions agree
    pairs = near.select(F.least("pid", "sid").alias("ka"), F.greatest("pid", "sid").alias("kb")).distinct()
    a = poi.select(F.col("k").alias("ka"), F.col("poi_id").alias("from_id"), "lat", "lon")
    b = poi.select(F.col("k").alias("kb"), F.col("poi_id").alias("to_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    e = pairs.join(a, "ka").join(b, "kb").withColumn("km", haversine_km("lat", "lon", "lat2", "lon2"))
    return e.select("ka", "kb", "from_id", "to_id", F.round("km", 2).alias("distance_km"), F.round(road_minutes(F.col("km")), 1).alias("duration_min"), F.lit("haversine").alias("method"))


def nearest_station(points: DataFrame, stations: DataFrame) -> DataFrame:
    """``points`` with nearest_station and station_km; null and infinite without stations."""
    s = stations.select(F.col("station_id").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    near = k_nearest(points, s, 1).select("pid", F.col("sid").alias("nearest_station"), F.col("km").alias("station_km"))
    return points.join(near, "pid", "left").withColumn("station_km", F.coalesce("station_km", F.lit(float("inf"))))


def district_vote(points: DataFrame, ref: DataFrame, k: int = 7, trust_km: float = 60.0) -> DataFrame:
    """(pid, district, confidence): inverse-distance vote of the k nearest reference points.

    ``ref(sid, slat, slon, district, weight)``.  A point whose nearest reference is
    beyond ``trust_km`` has a null district and confidence 0.  Ties go to the first
    name.
    """
    near = k_nearest(points, ref, k).join(ref.select("sid", "district", "weight"), "sid")
    near = near.withColumns({"w": F.col("weight") / F.greatest(F.col("km"), F.lit(0.25)), "first": F.min("km").over(Window.partitionBy("pid"))})
    votes = near.groupBy("pid", "district").agg(F.sum("w").alias("w"), F.min("first").alias("first"))
    best = votes.groupBy("pid").agg(F.min("first").alias("first"), F.sum("w").alias("total"), F.min(F.struct((-F.round("w", 9)).alias("w"), "district")).alias("b"))
    ok = F.col("first") <= trust_km
    return best.select("pid", F.when(ok, F.col("b.district")).alias("district"), F.when(ok, F.round(-F.col("b.w") / F.col("total"), 3)).otherwise(0.0).alias("confidence"))


def _level(at: str) -> Column:
    """The row of a polygon's own latitude rows; rounding keeps the order of latitudes, so no side misses a row it touches."""
    return F.floor((F.col(at) - F.col("y0")) / F.col("high")).cast("long")


def containing(points: DataFrame, segments: DataFrame, size: float = 0.25) -> DataFrame:
    """(pid, district): the first polygon by name that holds each point, by the even-odd rule.

    ``segments(district, ax, ay, bx, by)`` with x east and y north, in any order.
    A polygon is entered in the grid cells of its bounding box.  It has as many
    latitude rows as sides, and a side is entered in the rows it touches, so a
    point meets the few sides of its own row however many the polygon has.
    Level sides and those with a null end cross nothing.
    """
    box = segments.groupBy("district").agg(
        F.min(F.least("ax", "bx")).alias("x0"), F.max(F.greatest("ax", "bx")).alias("x1"), F.min(F.least("ay", "by")).alias("y0"), F.max(F.greatest("ay", "by")).alias("y1"), F.count("*").alias("sides")
    )
    box = box.withColumn("high", F.greatest((F.col("y1") - F.col("y0")) / F.col("sides"), F.lit(1e-9))).drop("sides")
    cells = box.withColumn("_cx", F.explode(F.sequence(F.floor(F.col("x0") / size), F.floor(F.col("x1") / size)))).withColumn("_cy", F.explode(F.sequence(F.floor(F.col("y0") / size), F.floor(F.col("y1") / size))))
    p = points.withColumns({"_cx": F.floor(F.col("lon") / size), "_cy": F.floor(F.col("lat") / size)})
    inside_box = p.join(cells, ["_cx", "_cy"]).where(F.col("lon").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    inside_box = inside_box.select("pid", "lat", "lon", "district", _level("lat").alias("row"))
    sloped = segments.where("ay <> by and ax is not null and bx is not null").join(box.select("district", "y0", "high"), "district").withColumns({"low": F.least("ay", "by"), "top": F.greatest("ay", "by")})
    rows = sloped.withColumn("row", F.explode(F.sequence(_level("low"), _level("top")))).select("district", "row", "ax", "ay", "bx", "by")
    crosses = ((F.col("ay") > F.col("lat")) != (F.col("by") > F.col("lat"))) & (F.col("lon") < (F.col("bx") - F.col("ax")) * (F.col("lat") - F.col("ay")) / F.nullif(F.col("by") - F.col("ay"), F.lit(0.0)) + F.col("ax"))
    hits = inside_box.join(rows, ["district", "row"]).where(crosses).groupBy("pid", "district").agg(F.count("*").alias("n")).where(F.col("n") % 2 == 1)
    return hits.groupBy("pid").agg(F.min("district").alias("district"))


def nearest_polygon(points: DataFrame, segments: DataFrame, size: float = 0.1) -> DataFrame:
    """(pid, district, degrees): the polygon whose side is nearest in the plane, ties by name.

    Sides are entered in the cells that their boxes touch; a side beyond the nine
    cells around a point is farther than the cell width, so rings widen for the
    points whose nearest side is farther than that.
    """
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    t = ((F.col("lon") - F.col("ax")) * dx + (F.col("lat") - F.col("ay")) * dy) / F.greatest(dx * dx + dy * dy, F.lit(1e-18))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    ex, ey = F.col("lon") - (F.col("ax") + t * dx), F.col("lat") - (F.col("ay") + t * dy)
    out, left = None, points.select("pid", "lat", "lon").where("lat is not null and lon is not null")
    while True:
        cells = lambda a, b: F.sequence(F.floor(F.least(a, b) / size) - 1, F.floor(F.greatest(a, b) / size) + 1)  # noqa: E731, B023
        sides = segments.withColumn("_cx", F.explode(cells("ax", "bx"))).withColumn("_cy", F.explode(cells("ay", "by")))
        p = left.withColumns({"_cx": F.floor(F.col("lon") / size), "_cy": F.floor(F.col("lat") / size)})
        best = p.join(sides, ["_cx", "_cy"]).withColumn("d", F.round(F.sqrt(ex * ex + ey * ey), 9)).groupBy("pid").agg(F.min(F.struct("d", "district")).alias("b"))
        best = best.select("pid", F.col("b.district").alias("district"), F.col("b.d").alias("degrees"))
        found = materialise(best if size >= WHOLE else best.where(F.col("degrees") < size * 0.999))
        out = found if out is None else out.unionByName(found)
        if size >= WHOLE:
            return out
        left = materialise(left.join(found, "pid", "left_anti"))
        if left.isEmpty():
            return out
        size = WHOLE if size * 4 > 90 else size * 4


def nearest_photo(poi: DataFrame, photos: DataFrame) -> DataFrame:
    """(pid, image_source, image_distance_m): own photo, else the nearest within a kilometre, else none.

    ``poi(pid, lat, lon, own)``, ``photos(sid, slat, slon)``.
    """
    near = within(poi.select("pid", "lat", "lon"), photos, 1.0).groupBy("pid").agg((F.min("km") * 1000).alias("m"))
    j = poi.join(near, "pid", "left")
    return j.select(
        "pid",
        F.when(F.col("own"), "wikipedia").when(F.col("m") <= 300, "nearby_300m").when(F.col("m") <= 1000, "nearby_1km").otherwise("none").alias("image_source"),
        F.when(F.col("own"), 0.0).otherwise(F.round("m", 1)).alias("image_distance_m"),
    )
