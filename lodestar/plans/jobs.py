"""Whole jobs: the dataset build, planners by name, audit columns and result sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import score, tags
from ..operators import clean, dedupe, metrics, near
from ..sources.shared import materialise
from ..sources.views import impute
from . import planner

MIN_POLYGONS = 20

# planners by name: candidates of many requests -> (request_id, day_no, slot, poi_id)
PLANNERS: dict[str, Callable[[DataFrame], DataFrame]] = {"rule_based": planner.rule_based, "greedy_eco": planner.greedy_eco, "beam": planner.beam}


def run_planner(name: str, cand: DataFrame) -> DataFrame:
    """The plans of a named planner, with its name as ``system``."""
    if name not in PLANNERS:
        raise KeyError(f"no planner {name!r}; there are {', '.join(sorted(PLANNERS))}")
    return PLANNERS[name](cand).withColumn("system", F.lit(name))


def assign_districts(places: DataFrame, segments: DataFrame | None, reference: DataFrame | None, centres: DataFrame) -> DataFrame:
    """``places(poi_id, lat, lon, ..)`` with district, district_method and district_confidence.

    Polygons decide where there are ``MIN_POLYGONS`` of them at least, and the
    nearest polygon where none holds a place; else the vote of reference points;
    else, and where the vote is not trusted, the nearest of ``centres(sid, slat,
    slon, district)``.
    """
    p = places.select(F.col("poi_id").alias("pid"), "lat", "lon")
    if segments is not None and segments.select("district").distinct().count() >= MIN_POLYGONS:
        inside = near.containing(p, segments).select("pid", "district", F.lit("polygon").alias("m"), F.lit(1.0).alias("c"))
        out = p.join(inside, "pid", "left_anti")
        found = inside.unionByName(near.nearest_polygon(out, segments).select("pid", "district", F.lit("nearest_polygon").alias("m"), F.lit(0.7).alias("c")))
    else:
        by_centre = near.k_nearest(p, centres, 1).join(centres.select("sid", "district"), "sid").select("pid", F.col("district").alias("near"))
        if reference is None:
            found = by_centre.select("pid", F.col("near").alias("district"), F.lit("nearest_centroid").alias("m"), F.lit(0.0).alias("c"))
        else:
            vote = near.district_vote(p, reference).join(by_centre, "pid", "left")
            trusted = F.col("district").isNotNull()
            found = vote.select("pid", F.coalesce("district", "near").alias("district"), F.when(trusted, "knn_vote").otherwise("nearest_centroid_fallback").alias("m"), F.col("confidence").alias("c"))
    named = found.select(F.col("pid").alias("poi_id"), "district", F.col("m").alias("district_method"), F.col("c").alias("district_confidence"))
    return places.join(named, "poi_id", "left")


def build_dataset(elements: DataFrame, segments: DataFrame | None, reference: DataFrame | None, centres: DataFrame) -> DataFrame:
    """Raw elements to the catalogue: normalised, de-duplicated, imputed, with districts."""
    pois = clean.normalise_pois(elements)
    kept = dedupe.dedupe_pois(pois).select("poi_id", "merged")
    p = pois.join(kept, "poi_id").withColumnsRenamed({"open_min": "open_raw", "close_min": "close_raw", "entry_fee_lkr": "fee_raw"})
    return assign_districts(impute(p), segments, reference, centres)


def build_tables(
    elements: DataFrame,
    segments: DataFrame | None,
    reference: DataFrame | None,
    centres: DataFrame,
    stations: DataFrame | None = None,
    views: DataFrame | None = None,
    register: DataFrame | None = None,
    k: int = 25,
) -> dict[str, DataFrame]:
    """The whole dataset by name: places, edges and, with a register, stays.

    Places have rail access by ``stations(station_id, lat, lon)``, popularity by
    ``views(title, mean_views)`` and prominence; without stations or views the
    scores are 0 and popularity unknown.  Edges join each place with its ``k``
    nearest.  ``register`` is that of ``sources.register``.  Places are written
    once, as all tables read them.
    """
    p = materialise(build_dataset(elements, segments, reference, centres))
    if stations is not None:
        spots = near.nearest_station(p.select(F.col("poi_id").alias("pid"), "lat", "lon"), stations)
        spots = spots.select(F.col("pid").alias("poi_id"), "nearest_station", F.col("station_km").alias("nearest_station_km"), score.rail_access(F.col("station_km")).alias("rail_access_score"))
        p = p.join(spots, "poi_id", "left")
    else:
        p = p.withColumn("rail_access_score", F.lit(0.0))
    if views is not None:
        means = p.select("poi_id", tags.wiki_title(F.col("wikipedia")).alias("title")).join(views.select("title", "mean_views"), "title", "left").select("poi_id", "mean_views")
        p = p.join(metrics.popularity_index(means).withColumnRenamed("source", "popularity_source"), "poi_id", "left")
    else:
        p = p.withColumns({"popularity_index": F.lit(0.0), "popularity_source": F.lit("none")})
    p = p.withColumn("popularity_known", F.col("popularity_source") == "wikipedia")
    p = materialise(p.withColumn("prominence", score.prominence()))
    edges = near.knn_edges(p.select(F.xxhash64("poi_id").alias("k"), "poi_id", "lat", "lon"), k).drop("ka", "kb")
    out = {"places": p, "edges": edges}
    if register is not None:
        out["stays"] = score.scored_stays(register)
    return out


def _as_plans(plans: DataFrame, number) -> DataFrame:
    return plans.select(number.alias("run_id"), "day_no", "slot", "poi_id")


def planner_gates(name: str, cand: DataFrame, changed_min: float = 80.0, overlap_max: float = 30.0) -> DataFrame:
    """(gate, observed, threshold, passed) of a named planner over scored candidates of many requests.

    T2: the share of plans that change under twice the budget, in percent.  T3: the
    mean overlap, in percent, of each request's plans for two disjoint sets of
    categories; requests with a plan for one only do not count.  T8: the share of score tables with a made-up id that
    the score contract lets through.  T9: the number of requests whose plans differ
    when made twice.
    """
    from ..operators.metrics import plan_jaccard, plan_signature

    plan = PLANNERS[name]
    rid = F.col("request_id")
    base = materialise(plan(cand))

    def against(other: DataFrame) -> DataFrame:
        """(a, same, jaccard) of each request's plan and its plan in ``other``."""
        both = _as_plans(base, rid * 2).unionByName(_as_plans(other, rid * 2 + 1))
        pairs = cand.select(rid).distinct().select((rid * 2).alias("a"), (rid * 2 + 1).alias("b"))
        sig = materialise(plan_signature(both))
        j = pairs.join(sig.select(F.col("run_id").alias("a"), F.col("signature").alias("sa")), "a", "left").join(sig.select(F.col("run_id").alias("b"), F.col("signature").alias("sb")), "b", "left")
        return j.withColumn("same", F.col("sa").eqNullSafe(F.col("sb"))).join(plan_jaccard(both, pairs), ["a", "b"]).select("a", "same", "jaccard", F.col("sb").isNotNull().alias("other"))

    richer = against(plan(cand.withColumn("poi_budget", F.col("poi_budget") * 2)))
    half = F.pmod(F.xxhash64("category"), F.lit(2)) == 0
    one, two = plan(cand.where(half)), plan(cand.where(~half))
    both = _as_plans(one, rid * 2).unionByName(_as_plans(two, rid * 2 + 1))
    met = both.select(F.floor(F.col("run_id") / 2).alias("r"), (F.col("run_id") % 2).alias("side")).distinct().groupBy("r").count().where("count = 2")
    overlap = plan_jaccard(both, met.select((F.col("r") * 2).alias("a"), (F.col("r") * 2 + 1).alias("b")))
    again = against(plan(cand))
    fake = cand.groupBy("request_id").agg(F.collect_set("poi_id").alias("given")).withColumn("answer", F.concat("given", F.array(F.lit("made-up"))))
    through = fake.agg(F.coalesce(F.avg(F.when(F.size(F.array_except("answer", "given")) == 0, 100.0).otherwise(0.0)), F.lit(0.0)).alias("x"))
    rows = [
        ("T2", richer.agg(F.coalesce(F.avg(F.when(F.col("same"), 0.0).otherwise(100.0)), F.lit(100.0)).alias("x")), changed_min, lambda x: x >= changed_min),
        ("T3", overlap.agg(F.coalesce(F.avg("jaccard") * 100, F.lit(0.0)).alias("x")), overlap_max, lambda x: x <= overlap_max),
        ("T8", through, 0.0, lambda x: x == 0),
        ("T9", again.agg(F.count_if(~F.col("same")).cast("double").alias("x")), 0.0, lambda x: x == 0),
    ]
    out = None
    for gate, observed, threshold, passed in rows:
        row = observed.select(F.lit(gate).alias("gate"), F.round("x", 2).alias("observed"), F.lit(threshold).alias("threshold"), passed(F.col("x")).alias("passed"))
        out = row if out is None else out.unionByName(row)
    return out


def audit(requests: DataFrame, cand: DataFrame, widened: DataFrame) -> DataFrame:
    """(request_id, audit struct<candidates, categories, widening_step, known_popularity>) of every request."""
    c = cand.groupBy("request_id").agg(F.count("*").alias("candidates"), F.countDistinct("category").alias("categories"), F.count_if("popularity_known").alias("known_popularity"))
    w = widened.groupBy("request_id").agg(F.max("step").alias("widening_step"))
    j = requests.select("request_id").join(c, "request_id", "left").join(w, "request_id", "left")
    z = lambda n: F.coalesce(F.col(n), F.lit(0)).alias(n)
    return j.select("request_id", F.struct(z("candidates"), z("categories"), "widening_step", z("known_popularity")).alias("audit"))


def write_csv(df: DataFrame, path: str) -> None:
    """A small result table, such as gates or summaries, as one CSV file with a header; an existing path is an error."""
    df.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)
