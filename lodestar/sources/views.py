"""Views that give the tables of a star schema the shapes of the place-and-trip inputs.

``FIXTURES.md`` states the rules; ``VIEWS_SQL`` in ``lodestar.oracles`` states
the same in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import score
from .dims import CATEGORIES, HOTEL_TYPES, STAY_TYPES, category_default

TYPE_NAMES = [*STAY_TYPES, "Eco Lodges"]
GRADE_NAMES = ["ONE", "TWO", "THREE", "FOUR", "FIVE", "A", "B", "C", "STANDARD", "SUPERIOR", "DELUXE"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    """The element of a literal list at a 0-based index."""
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def placed_lat(k: Column) -> Column:
    return F.lit(5.85) + ((k * 7919) % 4050) / F.lit(1000.0)


def placed_lon(k: Column) -> Column:
    return F.lit(79.60) + ((k * 104729) % 2350) / F.lit(1000.0)


def v_poi(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    kept = F.concat(
        F.lit("{"),
        F.concat_ws(",", F.when(k % 3 == 0, F.lit('"tourism":"attraction"')), F.when(k % 4 == 1, F.lit('"historic":"ruins"')), F.when(k % 5 == 0, F.lit('"website":"w"')), F.when(k % 8 == 1, F.lit('"boundary":"protected_area"'))),
        F.lit("}"),
    )
    return table(spark, sf_dir, "part").select(
        k.alias("k"),
        F.concat(F.lit("node/"), k.cast("string")).alias("poi_id"),
        F.col("p_name").alias("name"),
        placed_lat(k).alias("lat"),
        placed_lon(k).alias("lon"),
        pick(CATEGORIES, k % 8).alias("category"),
        F.when(k % 10 == 0, F.col("p_size") * 5 + 360).cast("int").alias("open_raw"),
        F.when(k % 10 == 0, F.lit(1440) - F.col("p_size") * 6).cast("int").alias("close_raw"),
        F.when(k % 7 == 0, F.round(F.col("p_retailprice") * 2.5, 2)).alias("fee_raw"),
        (F.col("p_size") % 13).cast("int").alias("tag_count"),
        F.when(k % 9 == 0, F.concat(F.lit("Q"), k.cast("string"))).alias("wikidata"),
        F.when(k % 11 == 0, F.concat(F.lit("en:T "), (k % 100).cast("string"))).alias("wikipedia"),
        (k % 97 == 0).alias("unesco"),
        kept.alias("osm_tags_kept"),
    )


def impute(poi: DataFrame) -> DataFrame:
    """Hours, fee and dwell of a place, defaults by category, each with a flag."""
    c = F.col("category")
    return poi.select(
        *[x for x in poi.columns if x not in ("open_raw", "close_raw", "fee_raw")],
        F.coalesce("open_raw", category_default(c, 1)).cast("int").alias("open_min"),
        F.coalesce("close_raw", category_default(c, 2)).cast("int").alias("close_min"),
        F.col("open_raw").isNull().alias("hours_estimated"),
        F.coalesce("fee_raw", category_default(c, 3)).alias("entry_fee_lkr"),
        F.col("fee_raw").isNull().alias("fee_estimated"),
        category_default(c, 0).cast("int").alias("typical_dwell_min"),
        F.lit(True).alias("dwell_estimated"),
        F.lit("unknown").alias("eco_certified"),
        F.lit("unknown").alias("community_run"),
    )


def district_no(lat: Column, lon: Column) -> Column:
    """Number of the grid district that holds a point of the bounding box."""
    return (F.least(F.floor((lon - 79.60) / 0.47), F.lit(4)) + 5 * F.least(F.floor((lat - 5.85) / 0.81), F.lit(4))).cast("int")


def v_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue: imputed places with district, crowding and prominence."""
    k = F.col("k")
    p = impute(v_poi(spark, sf_dir)).withColumn("popularity_known", k % 11 == 0)
    p = p.withColumn("popularity_source", F.when(F.col("popularity_known"), "wikipedia").otherwise("none"))
    p = p.withColumn("popularity_index", F.when(F.col("popularity_known"), ((k * 37) % 100) / F.lit(100.0)).otherwise(0.0))
    p = p.withColumn("rail_access_score", (k % 11) / F.lit(10.0))
    p = p.withColumn("prominence", score.prominence())
    p = p.withColumn("district_no", district_no(F.col("lat"), F.col("lon")))
    d = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("district_no"), F.col("n_name").alias("district"))
    return p.join(F.broadcast(d), "district_no").drop("district_no")


def v_district(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 grid cells with corners and centres; one row per nation, a fixed number."""
    n = F.col("n_nationkey")
    x0, y0 = F.lit(79.60) + F.lit(0.47) * (n % 5), F.lit(5.85) + F.lit(0.81) * F.floor(n / 5)
    d = table(spark, sf_dir, "nation").select(n.alias("district_no"), F.col("n_name").alias("district"), x0.alias("x0"), y0.alias("y0"))
    return d.select("*", (F.col("x0") + 0.47).alias("x1"), (F.col("y0") + 0.81).alias("y1"), (F.col("y0") + 0.405).alias("lat"), (F.col("x0") + 0.235).alias("lon"))


def v_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sides of the district cells, unordered: (district, ax, ay, bx, by)."""
    d = v_district(spark, sf_dir)
    side = lambda a, b, c, e: F.struct(F.col(a).alias("ax"), F.col(b).alias("ay"), F.col(c).alias("bx"), F.col(e).alias("by"))
    sides = F.array(side("x1", "y0", "x1", "y1"), side("x0", "y0", "x1", "y0"), side("x0", "y1", "x0", "y0"), side("x1", "y1", "x0", "y1"))
    return d.select("district", F.explode(sides).alias("s")).select("district", "s.*")


def v_acc(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    found = k % 3 != 0
    return table(spark, sf_dir, "customer").select(
        k.alias("k"),
        F.concat(F.lit("sltda/"), F.lpad(k.cast("string"), 5, "0")).alias("acc_id"),
        F.col("c_name").alias("name"),
        pick(TYPE_NAMES, k % 12).alias("sltda_type"),
        (F.lit(1) + (k * 37) % 300).cast("int").alias("rooms"),
        F.when(k % 13 < 11, pick(GRADE_NAMES, k % 11)).alias("grade"),
        F.col("c_nationkey").alias("district_no"),
        (F.col("c_nationkey") * 4 + k % 4).cast("int").alias("division_no"),
        F.when(found, F.lit(5.85) + ((k * 6151) % 4050) / F.lit(1000.0)).alias("lat"),
        F.when(found, F.lit(79.60) + ((k * 15485) % 2350) / F.lit(1000.0)).alias("lon"),
    )


def v_stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Located stays with their sustainability score and nightly rate."""
    return score.scored_stays(v_acc(spark, sf_dir)).where("lat is not null")


def v_station(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("station_id"), F.col("s_name").alias("name"), placed_lat(k).alias("lat"), placed_lon(k).alias("lon"), k.alias("node"))


def v_request(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query set: the orders whose number is divisible by 50, against all places."""
    o = F.col("o_orderkey")
    return (
        table(spark, sf_dir, "orders")
        .where(o % 50 == 0)
        .select(
            o.alias("request_id"),
            (F.lit(1) + o % 3).cast("int").alias("n_days"),
            F.col("o_totalprice").alias("budget"),
            (F.lit(1) + o % 4).cast("int").alias("party"),
            (F.lit(6.50) + ((F.col("o_custkey") * 911) % 2500) / F.lit(1000.0)).alias("start_lat"),
            (F.lit(79.90) + ((F.col("o_custkey") * 577) % 1500) / F.lit(1000.0)).alias("start_lon"),
            ((o % 5) / F.lit(4.0)).alias("w_pref"),
            F.array(pick(CATEGORIES, o % 8), pick(CATEGORIES, (o + 3) % 8)).alias("interests"),
        )
    )


def v_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned stops: one run per order, three slots a day."""
    # rows equal in both give the same stop, so what orders them further never shows
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    rn = F.row_number().over(w) - 1
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"),
        (F.floor(rn / 3) + 1).cast("int").alias("day_no"),
        (rn % 3).cast("int").alias("slot"),
        F.concat(F.lit("node/"), F.col("l_partkey").cast("string")).alias("poi_id"),
    )


def v_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of the runs."""
    o = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        o.alias("run_id"),
        F.col("o_orderstatus").alias("system"),
        F.col("o_totalprice").alias("budget"),
        F.col("o_custkey").alias("request_key"),
        (F.lit(1) + o % 4).cast("int").alias("party"),
        ((o % 5) / F.lit(4.0)).alias("w_pref"),
        (F.lit(1) + o % 4).cast("int").alias("n_days"),
        (F.lit(6.50) + ((F.col("o_custkey") * 911) % 2500) / F.lit(1000.0)).alias("start_lat"),
        (F.lit(79.90) + ((F.col("o_custkey") * 577) % 1500) / F.lit(1000.0)).alias("start_lon"),
    )


def v_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type").isin("view", "click"))
        .groupBy(F.col("user_id").alias("title"), F.hour("ts").alias("period"))
        .agg(F.sum("value").alias("views"))
    )


def v_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track edges (a, b, km, cls) along lines of twenty nodes."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k)
    line = s.where(k % 20 != 19).select(k.alias("a"), (k + 1).alias("b"), (F.lit(1) + (k * 13) % 20).cast("double").alias("km"), pick(["lowland", "hill", "fast", "slow"], k % 4).alias("cls"))
    cut = s.where((k % 10 == 2) & (k % 20 < 10)).select(k.alias("a"), (k + 7).alias("b"), (F.lit(5) + (k * 17) % 30).cast("double").alias("km"), F.lit("lowland").alias("cls"))
    return line.unionByName(cut)


def v_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheap travel edges: each place with the next two, smaller number first."""
    from ..functions.geo import haversine_km, road_minutes

    p = v_poi(spark, sf_dir).select("k", "poi_id", "lat", "lon")
    a = p.withColumn("kb", F.explode(F.array(F.col("k") + 1, F.col("k") + 2)))
    b = p.select(F.col("k").alias("kb"), F.col("poi_id").alias("to_id"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    km = haversine_km("lat", "lon", "lat2", "lon2")
    return (
        a.join(b, "kb")
        .withColumn("km", km)
        .select(
            F.col("k").alias("ka"),
            "kb",
            F.col("poi_id").alias("from_id"),
            "to_id",
            F.round("km", 2).alias("distance_km"),
            F.round(road_minutes(F.col("km")), 1).alias("duration_min"),
            F.when(F.col("k") % 6 == 0, "osrm").otherwise("haversine").alias("method"),
        )
    )


def is_hotel(kind: Column) -> Column:
    return kind.isin(HOTEL_TYPES)
