"""Queries over places, stays, stations and raw elements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .functions import score
from .functions import tags as T
from .functions.geo import haversine_km, in_bbox, road_km, road_minutes
from .operators import browse, clean, dedupe, metrics, near
from .sources import osm, register
from .sources import views as V
from .sources.dims import DISTRICTS

KANDY = (7.2906, 80.6337)


def _poi(s, d):
    return V.v_poi(s, d)


def osm_scan(s, d):
    """Elements of JSON dumps in a column, a hundred places a dump."""
    e = osm.v_osm(s, d).withColumn("g", F.floor(F.col("id") / 100))
    dumps = e.groupBy("g").agg(F.to_json(F.struct(F.collect_list(F.struct("type", "id", "lat", "lon", "center", "tags")).alias("elements"))).alias("payload"))
    return osm.scan_json(dumps).select("type", "id", F.round(F.coalesce("lat", "center.lat"), 6).alias("lat"), F.size("tags").cast("long").alias("n_tags"))


def latest_snapshot(s, d):
    rows = _poi(s, d).select("poi_id", F.concat(F.lit("2026-0"), (F.col("k") % 3 + 1).cast("string"), F.lit("-15")).alias("extract_date"))
    return osm.latest_snapshot(rows)


def register_load(s, d):
    """The register with a number by customer, trimmed names, upper-case grades and numeric rooms."""
    c = V.v_acc(s, d).withColumn("raw_rooms", F.when(F.col("k") % 17 == 0, F.lit("n/a")).otherwise(F.col("rooms").cast("string"))).withColumn("raw_grade", F.when(F.col("k") % 5 == 0, F.lit(" nan ")).otherwise(F.lower("grade")))
    return register.clean_register(c.select("acc_id", "name", F.col("raw_grade").alias("grade"), F.col("raw_rooms").alias("rooms")))


def node_upsert(s, d):
    base = _poi(s, d).where("k % 3 <> 0").select("poi_id", "name", "category")
    delta = _poi(s, d).where("k % 2 = 0").select("poi_id", F.concat(F.col("name"), F.lit(" *")).alias("name"), F.lit("urban").alias("category"), F.lit(1).alias("seq"))
    more = _poi(s, d).where("k % 4 = 0").select("poi_id", F.concat(F.col("name"), F.lit(" **")).alias("name"), F.lit("beach").alias("category"), F.lit(2).alias("seq"))
    return clean.upsert(base, delta.unionByName(more), "poi_id", "seq")


def graph_edges(s, d):
    p = V.v_place(s, d)
    stays = V.v_stay(s, d)
    dims = p.select(F.lit("IN_DISTRICT").alias("kind"), F.col("poi_id").alias("a"), F.col("district").alias("b")).unionByName(p.select(F.lit("HAS_CATEGORY").alias("kind"), F.col("poi_id").alias("a"), F.col("category").alias("b")))
    dims = dims.unionByName(stays.select(F.lit("OF_TYPE").alias("kind"), F.col("acc_id").alias("a"), F.col("sltda_type").alias("b"))).distinct()
    ends = p.where("k % 3 <> 0").select("poi_id")
    e = V.v_edges(s, d).join(ends.withColumnRenamed("poi_id", "from_id"), "from_id", "left_semi").join(ends.withColumnRenamed("poi_id", "to_id"), "to_id", "left_semi")
    return dims.unionByName(e.select(F.lit("TRAVEL").alias("kind"), F.col("from_id").alias("a"), F.col("to_id").alias("b")))


def fetch_worklist(s, d):
    titles = _poi(s, d).select(T.wiki_title(F.col("wikipedia")).alias("title")).where("title is not null").distinct()
    cached = _poi(s, d).where("k % 3 = 0").select(T.wiki_title(F.col("wikipedia")).alias("title")).where("title is not null").distinct()
    return titles.join(cached, "title", "left_anti")


def name_pick(s, d):
    return osm.v_osm(s, d).select("id", T.pick_name(F.col("tags")).alias("name"))


def normalise_pois(s, d):
    n = clean.normalise_pois(osm.v_osm(s, d).withColumns({"lat": F.col("lat"), "lon": F.col("lon")}))
    return n.select("poi_id", "name", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "category", "open_min", "close_min", "hours_parsed", F.round("entry_fee_lkr", 2).alias("entry_fee_lkr"), "fee_parsed", "unesco", F.col("tag_count").cast("long").alias("tag_count"))


def drop_stats(s, d):
    return clean.drop_stats(osm.v_osm(s, d))


def categorise(s, d):
    return osm.v_osm(s, d).select("id", T.categorise(F.col("tags")).alias("category"))


def opening_hours(s, d):
    h = T.opening_hours(T.tag(F.col("tags"), "opening_hours"))
    return osm.v_osm(s, d).select("id", h["open_min"].alias("open_min"), h["close_min"].alias("close_min"))


def parse_fee(s, d):
    return osm.v_osm(s, d).select("id", F.round(T.parse_fee(F.col("tags")), 2).alias("fee"))


def validate_coords(s, d):
    a = V.v_acc(s, d).withColumn("lat", F.when(F.col("k") % 10 == 1, F.col("lat") + 5).otherwise(F.col("lat")))
    v = clean.validate_coords(a.select("acc_id", "lat", "lon"))
    return v.select("acc_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def required_defaults(s, d):
    df = _poi(s, d).select("poi_id", "wikidata", "open_raw", "fee_raw")
    return clean.required_defaults(df, {"open_raw": 480, "fee_raw": 0.0, "wikidata": None, "eco_certified": "unknown"})


def completeness(s, d):
    return clean.completeness(V.v_place(s, d), ["poi_id", "name", "district", "open_min", "wikidata"], ["wikidata"])


def browse_places(s, d):
    return browse.browse_places(V.v_place(s, d), categories=["heritage"], text="a", min_prominence=0.3).select("poi_id", "name", "prominence")


def browse_stays(s, d):
    return browse.browse_stays(V.v_stay(s, d), "home", 0.8).select("acc_id", "sltda_type", F.round("sustainability_score", 4).alias("sustainability_score"))


def validate_candidates(s, d):
    p = V.v_place(s, d).withColumn("close_min", F.when(F.col("k") % 19 == 0, F.col("open_min")).otherwise(F.col("close_min"))).withColumn("popularity_index", F.when(F.col("k") % 23 == 0, F.lit(1.5)).otherwise(F.col("popularity_index")))
    return clean.with_violations(p, clean.candidate_checks()).select("poi_id", F.array_join("violations", ",").alias("violations"))


def validate_requests(s, d):
    r = V.v_request(s, d).withColumn("n_days", F.when(F.col("request_id") % 700 == 0, F.lit(30)).otherwise(F.col("n_days"))).withColumn("budget", F.when(F.col("request_id") % 900 == 0, F.lit(0.0)).otherwise(F.col("budget")))
    return clean.with_violations(r, clean.request_checks()).select("request_id", F.array_join("violations", ",").alias("violations"))


def district_units(s, d):
    """Nation names with the words that mark other units or the unit itself."""
    suffix = V.pick([" District", " Disctrict", " DS Division", " Province", "", " Municipal Council", " district"], F.col("n_nationkey") % 7)
    return clean.district_units(V.table(s, d, "nation").select(F.concat(F.col("n_name"), suffix).alias("raw")))


def photo_filter(s, d):
    k = F.col("s_suppkey")
    t = V.table(s, d, "supplier").select(F.concat(F.col("s_name"), V.pick([" view.jpg", " map.png", " site plan.JPG", " flag.svg", " temple.WEBP", " notes.pdf", " lake.jpeg"], k % 7)).alias("title"))
    return t.where(F.col("title").rlike(r"(?i)\.(jpg|jpeg|png|webp)$") & ~F.col("title").rlike(r"(?i)\b(map|locator|diagram|plan|logo|flag|coat of arms|chart|svg|pdf|scan|document|seal)\b"))


def nearest_centroid(s, d):
    """The nearest of the district centres: the grid's own, one row per district."""
    sites = V.v_district(s, d).select(F.col("district_no").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    p = _poi(s, d).select(F.col("poi_id").alias("pid"), "lat", "lon")
    return near.k_nearest(p, sites, 1).select(F.col("pid").alias("poi_id"), F.col("sid").alias("district_no"), F.round("km", 3).alias("km"))


def nearest_station(s, d):
    p = _poi(s, d).select(F.col("poi_id").alias("pid"), "lat", "lon")
    j = near.nearest_station(p, V.v_station(s, d))
    return j.select(F.col("pid").alias("poi_id"), "nearest_station", F.round("station_km", 3).alias("station_km"), F.round(score.rail_access(F.round("station_km", 6)), 4).alias("rail_access_score"))


def knn_edges(s, d):
    return near.knn_edges(_poi(s, d), 25).select("from_id", "to_id", "distance_km", "duration_min", "method")


def _reference(s, d):
    """Published stays with their district, and anchors for districts with few."""
    acc = V.v_stay(s, d).join(V.v_district(s, d).select("district_no", "district"), "district_no")
    real = acc.where("k % 4 = 1").select(F.col("k").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), "district", F.lit(1.0).alias("weight"))
    per = real.groupBy("district").agg(F.count("*").alias("n"))
    anchors = V.v_district(s, d).join(per, "district", "left").where(F.coalesce("n", F.lit(0)) < 8)
    return real.unionByName(anchors.select((-F.col("district_no").cast("long") - 1).alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), "district", F.lit(0.25).alias("weight")))


def district_reference(s, d):
    return _reference(s, d).groupBy("district", "weight").agg(F.count("*").alias("n"))


def district_knn_vote(s, d):
    p = _poi(s, d).select(F.col("poi_id").alias("pid"), "lat", "lon")
    v = near.district_vote(p, _reference(s, d))
    return v.select(F.col("pid").alias("poi_id"), F.coalesce("district", F.lit("-")).alias("district"), "confidence", F.when(F.col("district").isNull(), "nearest_centroid_fallback").otherwise("sltda_knn").alias("method"))


def point_in_polygon(s, d):
    p = _poi(s, d).select(F.col("poi_id").alias("pid"), "lat", F.when(F.col("k") % 50 == 0, F.col("lon") + 2.5).otherwise(F.col("lon")).alias("lon"))
    hit = near.containing(p, V.v_segments(s, d))
    return hit.select(F.col("pid").alias("poi_id"), "district")


def nearest_polygon(s, d):
    p = _poi(s, d).where("k % 50 = 0").select(F.col("poi_id").alias("pid"), "lat", (F.col("lon") + 2.5).alias("lon"))
    return near.nearest_polygon(p, V.v_segments(s, d)).select(F.col("pid").alias("poi_id"), "district", F.round("degrees", 6).alias("degrees"))


def nearby_places(s, d):
    """Places within 15 km of each station, the nearest ten."""
    st = V.v_station(s, d).select("station_id", "lat", "lon")
    j = near.within(st, _poi(s, d).select("poi_id", F.col("lat").alias("slat"), F.col("lon").alias("slon")), 15.0, first=("poi_id", 10, 4)).withColumn("km", F.round("km", 4))
    rn = F.row_number().over(Window.partitionBy("station_id").orderBy("km", "poi_id"))
    return j.withColumn("rn", rn).where("rn <= 10").select("station_id", "rn", "poi_id", "km")


def nearby_stays(s, d):
    """Stays that are no hotels within 20 km of each station."""
    st = V.v_station(s, d).select(F.col("station_id").alias("pid"), "lat", "lon")
    stays = V.v_stay(s, d).where(~V.is_hotel(F.col("sltda_type"))).select(F.col("acc_id").alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    return near.pairs_within(st, stays, 20.0, 3).select(F.col("pid").alias("station_id"), F.col("sid").alias("acc_id"), "km")


def _dup(s, d):
    p = _poi(s, d).select("k", "poi_id", "name", "lat", "lon", F.col("open_raw").isNotNull().alias("hours_parsed"), F.col("fee_raw").isNotNull().alias("fee_parsed"), "wikidata")
    return p.unionByName(p.where("k % 5 = 0").select("k", F.concat(F.lit("way/"), F.col("k").cast("string")).alias("poi_id"), F.concat(F.col("name"), F.lit(" ව")).alias("name"), (F.col("lat") + 0.0005).alias("lat"), (F.col("lon") + 0.0005).alias("lon"), "hours_parsed", "fee_parsed", "wikidata"))


def dup_pairs(s, d):
    return clean.dup_pairs(_dup(s, d)).select("a", "b", F.round("m", 1).alias("m"), "contained")


def dedupe_pois(s, d):
    return dedupe.dedupe_pois(_dup(s, d))


def token_sort_ratio(s, d):
    p = _poi(s, d)
    return p.select("poi_id", F.round(dedupe.token_sort_ratio(F.col("name"), F.concat(F.lit("the "), F.reverse(F.split("name", " "))[0])), 4).alias("ratio"))


def normalise_name(s, d):
    return _dup(s, d).select("poi_id", T.normalise_name(F.col("name")).alias("latin"), T.sorted_tokens(F.col("name")).alias("tokens"))


def recover_coords(s, d):
    r = clean.recover_coords(V.v_acc(s, d))
    return r.select("acc_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "location_estimated", "location_method")


def resolve_titles(s, d):
    p = _poi(s, d)
    names = p.where("k % 18 = 0").select(F.col("wikidata").alias("q"), F.concat(F.lit("W_"), F.col("k").cast("string")).alias("wt"))
    j = p.join(names, p["wikidata"] == names["q"], "left")
    return j.select("poi_id", F.coalesce(T.wiki_title(F.col("wikipedia")), "wt").alias("title")).where("title is not null")


def wiki_title(s, d):
    k = F.col("k")
    t = _poi(s, d).select("poi_id", V.pick(["en:Old Fort", "si:Kotuwa", "Plain Title", "EN: Tea Hill ", ""], k % 5).alias("tag"))
    return t.select("poi_id", T.wiki_title(F.col("tag")).alias("title"))


def nearest_photo(s, d):
    own = _poi(s, d).select(F.col("poi_id").alias("pid"), "lat", "lon", F.col("wikipedia").isNotNull().alias("own"))
    c = V.v_acc(s, d).where("lat is not null").select(F.concat(F.lit("c"), F.col("k").cast("string")).alias("sid"), F.col("lat").alias("slat"), F.col("lon").alias("slon"))
    u = V.v_station(s, d).select(F.concat(F.lit("s"), F.col("station_id").cast("string")).alias("sid"), (F.col("lat") + 0.002).alias("slat"), F.col("lon").alias("slon"))
    return near.nearest_photo(own, c.unionByName(u))


def photo_coverage(s, d):
    p = nearest_photo(s, d)
    return metrics.value_share(p, "image_source")


def fee_override(s, d):
    """The longest name fragment that fits a place sets its fee, else the default stays."""
    rules = s.createDataFrame([("royal", "museum", None, 5000.0), ("ivory", None, None, 1500.0), ("ivory s", None, None, 1700.0), ("blue", None, "FRANCE", 900.0)], "fragment string, exclude string, district string, fee double")
    p = V.v_place(s, d).select("poi_id", F.lower("name").alias("low"), F.col("district").alias("place_district"), "entry_fee_lkr")
    hit = F.col("low").contains(F.col("fragment")) & ~F.coalesce(F.col("low").contains(F.col("exclude")), F.lit(False)) & (F.col("district").isNull() | (F.col("district") == F.col("place_district")))
    j = p.join(F.broadcast(rules), hit, "left").groupBy("poi_id", "entry_fee_lkr").agg(F.max_by("fee", F.length("fragment")).alias("fee"))
    return j.select("poi_id", F.coalesce("fee", "entry_fee_lkr").alias("fee"), F.col("fee").isNotNull().alias("overridden"))


def haversine(s, d):
    return _poi(s, d).select("poi_id", F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(KANDY[0]), F.lit(KANDY[1])), 3).alias("km"))


def road_estimate(s, d):
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.lit(KANDY[0]), F.lit(KANDY[1])), 3)
    return _poi(s, d).select("poi_id", F.round(road_km(km), 6).alias("road_km"), F.round(road_minutes(km), 6).alias("minutes"))


def canonical_district(s, d):
    k = F.col("k")
    names = [*DISTRICTS, "moneragala", "Nuwara-Eliya", "KILINOCHCI", "Trincom", "Amparai District", "Nowhere", " ", "Maha  Nuwara"]
    return _poi(s, d).select("poi_id", clean.canonical_district(V.pick(names, k % len(names))).alias("district"))


def prominence(s, d):
    return V.v_place(s, d).select("poi_id", "prominence")


def size_score(s, d):
    return score.scored_stays(V.v_acc(s, d)).select("acc_id", F.round("size_score", 6).alias("size_score"))


def accommodation_score(s, d):
    return score.scored_stays(V.v_acc(s, d)).select("acc_id", "category_score", "grade_adj", "sustainability_score", "acc_impact")


def rail_access(s, d):
    km = (F.col("k") * 7 % 3000) / F.lit(100.0)
    return _poi(s, d).select("poi_id", F.round(score.rail_access(km), 4).alias("score"))


def impute(s, d):
    return V.impute(_poi(s, d)).select("poi_id", "open_min", "close_min", "hours_estimated", "entry_fee_lkr", "fee_estimated", "typical_dwell_min", "eco_certified")


def place_sustainability(s, d):
    return V.v_place(s, d).select("poi_id", score.crowding_cost().alias("crowding_cost"), score.eco_cost().alias("eco_cost"), F.round(score.place_sustainability(), 4).alias("score"))


def plain_scores(s, d):
    p = V.v_place(s, d)
    return p.select("poi_id", F.col("prominence").alias("pref"), F.round(1.0 - F.when(F.col("popularity_known"), F.col("popularity_index")).otherwise(0.3), 4).alias("sust"))


def strip_html(s, d):
    p = V.table(s, d, "pages")
    return p.select("page_id", F.substring(F.trim(F.regexp_replace("html", "<[^>]+>", "")), 1, 120).alias("text"), F.regexp_replace("url", r"/(\d+)px-", "/640px-").alias("thumb"))


def category_share(s, d):
    p = V.v_place(s, d)
    return metrics.value_share(p, "category").withColumn("by", F.lit("category")).unionByName(metrics.value_share(p, "district").withColumn("by", F.lit("district")))


def acceptance(s, d):
    """Acceptance rows (id, observed, passed)."""
    p = V.v_place(s, d)
    per_d = p.groupBy("district").count().where("count >= 5").agg(F.count("*").alias("covered"))
    per_c = p.groupBy("category").count().where("count >= 30").agg(F.count("*").alias("cats"))
    e = V.v_edges(s, d).agg(F.count("*").alias("edges"))
    base = p.agg(F.count("*").alias("n"), (F.avg((~F.col("hours_estimated")).cast("int")) * 100).alias("parsed"), F.count_if(in_bbox(F.col("lat"), F.col("lon"))).alias("placed"))
    one = base.crossJoin(per_d).crossJoin(per_c).crossJoin(e)
    row = lambda i, v, ok: F.struct(F.lit(i).alias("id"), v.cast("double").alias("observed"), ok.alias("passed"))
    c = F.col
    rows = F.array(row("A1", c("n"), c("n") >= 400), row("A2", c("covered"), c("covered") == 25), row("A3", c("cats"), c("cats") == 8), row("A4", c("placed"), c("placed") == c("n")), row("A5", F.round(c("parsed"), 1), c("parsed") >= 0.5), row("A7", c("edges"), c("edges") > 0), row("A8", c("n"), F.lit(True)))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def imputation_rates(s, d):
    p = V.v_place(s, d)
    g = p.agg(*(F.round(F.avg(F.col(c).cast("int")) * 100, 2).alias(c) for c in ("hours_estimated", "fee_estimated", "dwell_estimated")))
    return g.unpivot([], ["hours_estimated", "fee_estimated", "dwell_estimated"], "field", "pct")


def spearman(s, d):
    return metrics.spearman(score.scored_stays(V.v_acc(s, d)))


def type_summary(s, d):
    return score.scored_stays(V.v_acc(s, d)).groupBy("sltda_type").agg(F.count("*").alias("n"), F.round(F.avg("sustainability_score"), 4).alias("mean_score"))


def seasonality(s, d):
    return metrics.seasonality(V.v_views(s, d))


def popularity_index(s, d):
    m = V.v_views(s, d).groupBy("title").agg(F.avg("views").alias("mean_views"))
    p = _poi(s, d).select("poi_id", F.when(F.col("k") % 11 == 0, F.col("k") % 100).alias("title"))
    return metrics.popularity_index(p.join(m, "title", "left").select("poi_id", "mean_views")).withColumn("popularity_index", F.round("popularity_index", 3))


def reassignment_matrix(s, d):
    """The most frequent changes from nearest centre to containing district."""
    old = nearest_centroid(s, d).withColumnRenamed("district_no", "old_no")
    new = V.v_place(s, d).select("poi_id", V.district_no(F.col("lat"), F.col("lon")).alias("new_no"))
    g = old.join(new, "poi_id").where("old_no <> new_no").groupBy("old_no", "new_no").agg(F.count("*").alias("n"))
    return g.orderBy(F.desc("n"), "old_no", "new_no").limit(12)


def prominence_hist(s, d):
    p = V.v_place(s, d)
    return p.groupBy(F.least(F.floor(F.col("prominence") * 5 + F.lit(1e-9)), F.lit(4)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def edge_stats(s, d):
    e = V.v_edges(s, d).withColumn("all", F.lit(1))
    counts = e.groupBy("all").agg(F.count("*").alias("edges"), F.round(F.count_if(F.col("method") == "osrm") * 100.0 / F.count("*"), 2).alias("measured_pct"))
    return counts.join(metrics.median_of(e, "all", "distance_km"), "all").select("edges", "measured_pct", F.round("median", 3).alias("median_km"))


def page_places(s, d):
    """Page three of a category's places, twenty a page, with totals."""
    p = browse.browse_places(V.v_place(s, d), categories=["nature"]).select("poi_id", "prominence")
    return browse.page_of(p, 3, 20)


def page_after(s, d):
    """The twenty places of a category that follow a given one."""
    p = browse.browse_places(V.v_place(s, d), categories=["nature"]).select("poi_id", "prominence")
    return browse.page_after(p, (0.75, "node/5"), 20)


def average_ranks(s, d):
    """Rank of every place by prominence, ties at their mean."""
    return metrics.average_ranks(V.v_place(s, d).select("poi_id", "prominence"), "prominence").select("poi_id", "rank")


def top_prominent(s, d):
    return browse.top_prominent(V.v_place(s, d)).select("poi_id", "prominence")


def place_by_id(s, d):
    return V.v_place(s, d).where("poi_id = 'node/42'").select("poi_id", "name", "category", "district")


def missing_districts(s, d):
    seen = V.v_place(s, d).where("prominence > 0.75").select("district").distinct()
    return V.v_district(s, d).select("district").join(seen, "district", "left_anti")


def pair_sample(s, d):
    """Forty repeatable pairs of places 5 to 150 km apart."""
    p = _poi(s, d)
    a = p.select("k", "lat", "lon").withColumn("kb", (F.col("k") * 7919 + 13) % 1999)
    b = p.select(F.col("k").alias("kb"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2"))
    j = a.join(b, "kb").withColumn("km", haversine_km("lat", "lon", "lat2", "lon2")).where(F.col("km").between(5, 150))
    return j.withColumn("key", (F.col("k") * 104729 + F.col("kb") * 31) % 100003).orderBy("key", "k").limit(40).select(F.col("k").alias("a"), F.col("kb").alias("b"), F.round("km", 3).alias("km"))


def estimate_error(s, d):
    """Estimated against measured minutes of the sample; measurements are a rule on the pair."""
    p = pair_sample(s, d).withColumn("est", F.col("km") * 1.35 / 35.0 * 60.0).withColumn("m", F.col("est") * (F.lit(0.7) + ((F.col("a") + F.col("b")) % 10) / F.lit(10.0)))
    return p.agg(F.round(F.avg(F.abs(F.col("est") - F.col("m")) / F.col("m")) * 100, 3).alias("mape"), F.round(F.median(F.col("m") / F.col("est") * 1.35), 4).alias("ratio"), F.round(F.count_if(F.col("est") < F.col("m")) * 100.0 / F.count("*"), 1).alias("under_pct"))


def district_list(s, d):
    return V.v_place(s, d).select("district").distinct()


def graph_counts(s, d):
    one = lambda df, n: df.agg(F.lit(n).alias("label"), F.count("*").alias("n"))
    p = V.v_place(s, d)
    return one(p, "POI").unionByName(one(V.v_stay(s, d), "Accommodation")).unionByName(one(p.select("district").distinct(), "District")).unionByName(one(p.select("category").distinct(), "Category")).unionByName(one(V.v_edges(s, d), "TRAVEL"))


def refine_edges(s, d):
    """Edges among the 400 most prominent places of one block of 80 take the measured minutes."""
    top = V.v_place(s, d).orderBy(F.desc("prominence"), "poi_id").limit(400).select("k")
    # 400 rows are left, so numbering them is one small task
    blocks = top.select("k", F.floor((F.row_number().over(Window.orderBy("k")) - 1) / 80).alias("block"))
    e = V.v_edges(s, d)
    a = blocks.select(F.col("k").alias("ka"), F.col("block").alias("ba"))
    b = blocks.select(F.col("k").alias("kb"), F.col("block").alias("bb"))
    j = e.join(F.broadcast(a), "ka", "left").join(F.broadcast(b), "kb", "left")
    hit = F.coalesce(F.col("ba") == F.col("bb"), F.lit(False)) & ((F.col("ka") + F.col("kb")) % 7 != 0)
    measured = F.round(F.lit(5.0) + (F.col("ka") * 13 + F.col("kb")) % 90, 1)
    return j.select("from_id", "to_id", F.when(hit, measured).otherwise(F.col("duration_min")).alias("duration_min"), F.when(hit, "osrm").otherwise(F.col("method")).alias("method"))


def queries() -> dict:
    import types

    skip = {"queries"}
    return {n: f for n, f in globals().items() if isinstance(f, types.FunctionType) and not n.startswith("_") and n not in skip and f.__module__ == __name__}
