"""Candidates for a table of trip requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import score
from ..functions.geo import haversine_km
from ..operators.near import ONE_PASS, score_cuts, within
from ..sources.dims import DETOUR, MAX_TRANSFER, ROAD_KMH
from ..sources.shared import materialise

FLOOR, RADIUS_KM, WIDE_KM = 0.25, 60.0, 250.0
LEAST, MOST = 15, 150
STRAGGLERS = 64  # one request in so many is met by itself where it wants more bands than the others


def _near(requests: DataFrame, places: DataFrame, km: float, wanted: bool = False, on: tuple[str, ...] = ()) -> DataFrame:
    """Affordable places within ``km`` of each request's start, with distance and retrieval score; of its interests only if ``wanted``, and equal in the columns ``on``."""
    r = requests.withColumns({"lat": F.col("start_lat"), "lon": F.col("start_lon"), "poi_budget": F.round(F.col("budget") * 0.20, 4)})
    p = places.withColumnRenamed("lat", "slat").withColumnRenamed("lon", "slon")
    r = r.withColumn("category", F.explode(F.array_distinct("interests"))) if wanted else r
    j = within(r, p, km, (*on, "category") if wanted else on).where(F.col("entry_fee_lkr") <= F.col("poi_budget")).drop("lat", "lon")
    return j.withColumnsRenamed({"slat": "lat", "slon": "lon", "km": "distance_from_start_km"}).withColumn("retrieval_score", F.round(score.retrieval_score(), 6))


def best_first() -> list[Column]:
    return [F.desc("retrieval_score"), F.desc("prominence"), F.col("poi_id")]


def retrieve_candidates(requests: DataFrame, places: DataFrame, limit: int = MOST) -> DataFrame:
    """The best candidates of each request, rank from 1: wanted category, prominence floor, fee and radius.

    The join is on grid cells of the radius and the category, and where it would
    meet many places only on the bands of them that hold a request's best.
    """
    w = Window.partitionBy("request_id").orderBy(*best_first())
    j = _in_bands(requests, places.where(F.col("prominence") >= FLOOR), RADIUS_KM, limit)
    return j.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def _in_bands(requests: DataFrame, places: DataFrame, km: float, limit: int) -> DataFrame:
    """Rows of ``_near`` of wanted categories, the ``limit`` best of each request among them; places with a score only.

    A place's score is the same for all requests: places are counted band by band
    of falling score until a request has enough, and only then joined, each request
    with the bands down to its last.  What is counted is not kept, so that what is
    written follows the rows returned, not the pairs in reach.  The few that want
    more bands than the others, or all, are joined by themselves, so that the places
    of those bands need not be dealt out for all.
    """
    asked = requests.count()
    columns = ["poi_id", "lat", "lon", "entry_fee_lkr", "category", "prominence", "popularity_known", "popularity_index"]
    few = materialise(places.select(*columns, F.round(score.retrieval_score(), 6).alias("band_score")))
    n, cuts = score_cuts(few, limit)
    if asked * n <= ONE_PASS or not cuts:
        return _near(requests, places, km, wanted=True)
    band = lambda of: sum((F.when(of < cut, 1).otherwise(0) for cut in cuts), F.lit(0))
    few = few.withColumn("_band", band(F.col("band_score"))).drop("band_score")
    ask = ["request_id", "start_lat", "start_lon", "budget", "interests"]
    tasks = 4 * requests.sparkSession.sparkContext.defaultParallelism  # few bytes meet many places: the work is dealt by requests, not by size
    last, deep, late = None, None, 0
    left = materialise(requests.select(*ask, F.lit(0).cast("long").alias("_held")).repartition(tasks, "request_id"))
    for at in range(len(cuts)):
        more = _near(left, few.where(F.col("_band") == at), km, wanted=True).groupBy("request_id").agg(F.count("*").alias("_more"))
        left = materialise(left.join(more, "request_id", "left").withColumn("_held", F.col("_held") + F.coalesce("_more", F.lit(0))).drop("_more"))
        full = left.where(F.col("_held") >= limit).select("request_id", F.lit(at).alias("_last"))
        last = full if last is None else last.unionByName(full)
        left = left.where(F.col("_held") < limit)
        waiting = left.count()
        if deep is None and waiting <= asked // STRAGGLERS:
            deep, late = at, waiting
        if not waiting:
            break
    r = requests.join(last, "request_id", "left").withColumn("_last", F.coalesce("_last", F.lit(len(cuts))))
    worth = F.round(score.retrieval_score(), 6)
    most, p = (r, places) if deep is None else (r.where(F.col("_last") <= deep), places.where(worth >= cuts[deep]))
    most = most.repartition(tasks, "request_id").withColumn("_band", F.explode(F.sequence(F.lit(0), F.col("_last")))).drop("_last")
    j = _near(most, p.withColumn("_band", band(worth)), km, wanted=True, on=("_band",)).drop("_band")
    if not late:
        return j
    few_left = materialise(r.where(F.col("_last") > deep).drop("_last"))
    return j.unionByName(_near(few_left, places.repartition(tasks, "poi_id"), km, wanted=True))


def _score_bands(places: DataFrame, requests: int) -> tuple[DataFrame, list[float]]:
    """Places with their score, and the scores that part them into bands, falling; none where one pass is cheap.

    Each band holds about three times as many places as all above it.
    """
    columns = ["poi_id", "lat", "lon", "entry_fee_lkr", "category", "prominence", "popularity_known", "popularity_index"]
    p = materialise(places.select(*columns, F.round(score.retrieval_score(), 6).alias("band_score")))
    n = p.count()
    top = [t for t in (4.0**-i for i in range(6, 0, -1)) if n * t >= 2 * MOST]
    if requests * n <= ONE_PASS or not top:
        return p, []
    cuts = p.agg(F.percentile_approx("band_score", [1 - t for t in top], F.lit(10_000))).first()[0]
    return p, sorted(set(cuts or []), reverse=True)


def _best_within(requests: DataFrame, places: DataFrame, cuts: list[float], km: float, wanted: bool) -> DataFrame:
    """Rows of ``_near``, the ``MOST`` best of each request among them.

    A place's score is the same for all requests, so places come in bands of
    falling score and a request leaves once the bands so far hold enough for it.
    A request with few places in reach meets them all, and they are all returned.
    """
    left, found = requests, None
    for above, cut in zip([None, *cuts], [*cuts, None]):
        band = places if above is None else places.where(F.col("band_score").isNull() | (F.col("band_score") < above))
        band = band if cut is None else band.where(F.col("band_score") >= cut)
        met = _near(left, band, km, wanted).select("request_id", "poi_id", "retrieval_score", "prominence")
        met = materialise(met) if cuts else met
        found = met if found is None else found.unionByName(met)
        if cut is not None:
            full = found.groupBy("request_id").count().where(F.col("count") >= MOST)
            left = materialise(left.join(full, "request_id", "left_anti"))
            if left.isEmpty():
                break
    return found


def widen_candidates(requests: DataFrame, places: DataFrame) -> DataFrame:
    """(request_id, poi_id, step, rank): candidates after as many widening steps as a request needs.

    Steps are nested: 0 as asked, 1 without a prominence floor, 2 within the wide
    radius, 3 of all categories.  Only requests that stay short after a step take
    part in the next, and each stops at the bands that hold a request's best.
    """
    cols = ["request_id", "poi_id", "retrieval_score", "prominence"]
    w = Window.partitionBy("request_id")
    asked = materialise(_in_bands(requests, places.where(F.col("prominence") >= FLOOR), RADIUS_KM, MOST).select(*cols))
    enough = materialise(asked.groupBy("request_id").count().where(F.col("count") >= LEAST).select("request_id"))
    done = asked.join(enough, "request_id", "left_semi").withColumn("step", F.lit(0))
    short = materialise(requests.join(enough, "request_id", "left_anti"))
    waiting = short.count()
    if waiting:
        scored, cuts = _score_bands(places, waiting)
        for step, (km, wanted) in enumerate(((RADIUS_KM, True), (WIDE_KM, True), (WIDE_KM, False)), 1):
            met = materialise(_best_within(short, scored, cuts, km, wanted))
            enough = met.groupBy("request_id").count().where(F.col("count") >= (LEAST if step < 3 else 1)).select("request_id")
            done = done.unionByName(met.join(enough, "request_id", "left_semi").select(*cols, F.lit(step).alias("step")))
            short = materialise(short.join(enough, "request_id", "left_anti"))
            if short.isEmpty():
                break
    return done.withColumn("rank", F.row_number().over(w.orderBy(*best_first()))).where(F.col("rank") <= MOST).select("request_id", "poi_id", "step", "rank")


def with_scores(cand: DataFrame) -> DataFrame:
    """Candidates with pref, sust and utility."""
    c = cand.withColumns({"pref": score.heuristic_preference(F.col("interests")), "sust": score.place_sustainability()})
    return c.withColumn("utility", F.round(score.utility(F.col("w_pref"), F.col("pref"), F.col("sust")), 6))


def _with_near_rank(cand: DataFrame) -> DataFrame:
    w = Window.partitionBy("request_id").orderBy("start_min", "poi_id")
    c = cand.withColumn("start_min", F.round(F.col("distance_from_start_km") * DETOUR / ROAD_KMH * 60.0, 6))
    return c.withColumn("near_rank", F.row_number().over(w))


def _is_nearest(n: int) -> Column:
    return (F.col("near_rank") <= n) & (F.col("start_min") <= MAX_TRANSFER)


def keep_nearest(cand: DataFrame, n: int = 12) -> DataFrame:
    """The candidates nearest to the start, at most ``n`` and within the transfer limit."""
    return _with_near_rank(cand).where(_is_nearest(n))


def stratified_cap(cand: DataFrame, k: int = 40, n: int = 12) -> DataFrame:
    """``cand`` with cap_rank, round-robin over (district, category) groups, and keep: the first k and the ``n`` nearest.

    Groups are ordered by their best utility; inside one, the best come first.
    All is ranked within requests, so candidates are dealt once.
    """
    c = _with_near_rank(cand)
    g = Window.partitionBy("request_id", "district", "category")
    c = c.withColumn("depth", F.row_number().over(g.orderBy(F.desc("utility"), "poi_id"))).withColumn("group_best", F.max("utility").over(g))
    w = Window.partitionBy("request_id").orderBy("depth", F.desc("group_best"), "district", "category")
    c = c.withColumn("cap_rank", F.row_number().over(w))
    return c.withColumn("keep", (F.col("cap_rank") <= k) | F.coalesce(_is_nearest(n), F.lit(False))).drop("depth", "group_best", "near_rank", "start_min")


def cheapest_total(pool: DataFrame, need: int = 2) -> DataFrame:
    """(request_id, total): the sum of a request's cheapest ``need`` fees per day, infinite when there are too few."""
    w = Window.partitionBy("request_id").orderBy("entry_fee_lkr", "poi_id")
    p = pool.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= F.col("n_days") * need)
    return p.groupBy("request_id").agg(F.when(F.count("*") >= F.first("n_days") * need, F.sum("entry_fee_lkr")).otherwise(F.lit(float("inf"))).alias("total"))


def keep_affordable(capped: DataFrame, need: int = 2) -> DataFrame:
    """``capped`` with keep also set on the cheapest places where the capped pool cannot pay and the whole pool can.

    Both sums are taken over one ordering of each request, so the pool is read once.
    """
    w = Window.partitionBy("request_id")
    cheap = w.orderBy("entry_fee_lkr", "poi_id")
    wanted = F.col("n_days") * need
    infinite = F.lit(float("inf"))
    c = capped.withColumns({"_all": F.row_number().over(cheap), "_kept": F.sum(F.when(F.col("keep"), 1).otherwise(0)).over(cheap.rowsBetween(Window.unboundedPreceding, Window.currentRow))})
    paid = {"_whole": F.col("_all") <= wanted, "_inside": F.col("keep") & (F.col("_kept") <= wanted)}
    c = c.withColumns({name: F.when(F.count_if(first).over(w) >= wanted, F.sum(F.when(first, F.col("entry_fee_lkr"))).over(w)).otherwise(infinite) for name, first in paid.items()})
    c = c.withColumn("_cheap", F.row_number().over(w.orderBy("entry_fee_lkr", F.desc("utility"), "poi_id")))
    binds = (F.col("_inside") > F.col("poi_budget")) & (F.col("_whole") <= F.col("poi_budget"))
    c = c.withColumn("added", binds & (F.col("_cheap") <= wanted) & ~F.col("keep"))
    return c.withColumn("keep", F.col("keep") | F.col("added")).drop("_all", "_kept", "_whole", "_inside", "_cheap")


def pair_minutes() -> Column:
    """Estimated minutes between (lat, lon) and (lat2, lon2)."""
    return haversine_km("lat", "lon", "lat2", "lon2") * DETOUR / ROAD_KMH * 60.0
