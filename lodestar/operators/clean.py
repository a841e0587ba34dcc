"""Cleaning places and stays: validation, categories, de-duplication, recovery of coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tags as T
from ..functions.geo import haversine_km, in_bbox
from ..sources.dims import CATEGORIES, CATEGORY_DEFAULTS, NOT_DISTRICTS, lookup
from ..sources.views import impute

REASONS = ["no_name", "excluded", "no_coords", "out_of_bbox", "no_category"]


def examined(elements: DataFrame) -> DataFrame:
    """Elements with name, coordinates, category and the first reason to drop each (null: keep)."""
    tags = F.col("tags")
    node = F.col("type") == "node"
    e = elements.select(
        F.concat_ws("/", "type", F.col("id").cast("string")).alias("poi_id"),
        T.pick_name(tags).alias("name"),
        F.when(node, F.col("lat")).otherwise(F.col("center.lat")).alias("lat"),
        F.when(node, F.col("lon")).otherwise(F.col("center.lon")).alias("lon"),
        T.categorise(tags).alias("category"),
        "tags",
    )
    reason = (
        F.when(F.col("name").isNull(), REASONS[0])
        .when(T.excluded_name(F.col("name")), REASONS[1])
        .when(F.col("lat").isNull() | F.col("lon").isNull(), REASONS[2])
        .when(~in_bbox(F.col("lat"), F.col("lon")), REASONS[3])
        .when(F.col("category").isNull(), REASONS[4])
    )
    return e.withColumn("reject_reason", reason)


def normalise_pois(elements: DataFrame) -> DataFrame:
    """The places among raw elements, with parsed hours, fee and flags."""
    tags = F.col("tags")
    hours = T.opening_hours(T.tag(tags, "opening_hours"))
    fee = T.parse_fee(tags)
    return examined(elements).where("reject_reason is null").select(
        "poi_id",
        "name",
        "lat",
        "lon",
        "category",
        hours["open_min"].alias("open_min"),
        hours["close_min"].alias("close_min"),
        hours.isNotNull().alias("hours_parsed"),
        fee.alias("entry_fee_lkr"),
        fee.isNotNull().alias("fee_parsed"),
        T.tag(tags, "wikidata").alias("wikidata"),
        T.tag(tags, "wikipedia").alias("wikipedia"),
        T.unesco(tags).alias("unesco"),
        F.size(tags).alias("tag_count"),
        T.kept_tags(tags).alias("osm_tags_kept"),
    )


def drop_stats(elements: DataFrame) -> DataFrame:
    return examined(elements).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def validate_coords(df: DataFrame) -> DataFrame:
    """Coordinates outside the bounding box become null."""
    ok = in_bbox(F.col("lat"), F.col("lon"))
    return df.withColumns({"lat": F.when(ok, F.col("lat")), "lon": F.when(ok, F.col("lon"))})


def recover_coords(acc: DataFrame) -> DataFrame:
    """Missing coordinates from the division's median, else the district's; rows with neither go.

    ``acc`` has division_no, district_no, lat and lon; null group keys recover
    nothing.
    """
    geo = acc.where("lat is not null and lon is not null")
    div = geo.groupBy("division_no").agg(F.median("lat").alias("div_lat"), F.median("lon").alias("div_lon"))
    dis = geo.groupBy("district_no").agg(F.median("lat").alias("dis_lat"), F.median("lon").alias("dis_lon"))
    a = acc.withColumn("location_estimated", F.col("lat").isNull() | F.col("lon").isNull()).join(div, "division_no", "left").join(dis, "district_no", "left")
    lat = F.when(~F.col("location_estimated"), F.col("lat")).otherwise(F.coalesce("div_lat", "dis_lat"))
    lon = F.when(~F.col("location_estimated"), F.col("lon")).otherwise(F.coalesce("div_lon", "dis_lon"))
    method = F.when(~F.col("location_estimated"), "sltda_published").when(F.col("div_lat").isNotNull(), "aga_division_centroid").otherwise("district_centroid")
    return a.withColumns({"location_method": method, "lat": lat, "lon": lon}).where("lat is not null").drop("div_lat", "div_lon", "dis_lat", "dis_lon")


def required_defaults(df: DataFrame, defaults: dict) -> DataFrame:
    """Absent columns added and nulls filled; a null default leaves nulls."""
    for name, value in defaults.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(value))
        elif value is not None:
            df = df.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return df


def completeness(df: DataFrame, columns: list[str], sparse: list[str] = ()) -> DataFrame:
    """(property, rows, filled, ok): gaps fail, and so does a sparse property with no value."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count(c).alias(c) for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).alias("filled"), F.lit(c in sparse).alias("sparse")) for c in columns)))
    return counts.select("rows", each.alias("x")).select(
        "x.property", "rows", "x.filled", F.when(F.col("x.sparse"), F.col("x.filled") > 0).otherwise(F.col("x.filled") == F.col("rows")).alias("ok")
    )


def violations(checks: dict[str, Column]) -> Column:
    """Names of the checks that do not hold; a null outcome is a violation."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items())))


def candidate_checks() -> dict[str, Column]:
    c = F.col
    return {
        "category": c("category").isin(CATEGORIES),
        "lat": c("lat").between(5.85, 9.90),
        "lon": c("lon").between(79.60, 81.95),
        "open_min": c("open_min").between(0, 1440),
        "close_min": c("close_min").between(0, 1440),
        "hours_order": c("close_min") > c("open_min"),
        "entry_fee_lkr": c("entry_fee_lkr") >= 0,
        "typical_dwell_min": c("typical_dwell_min") > 0,
        "popularity_index": c("popularity_index").between(0, 1),
        "prominence": c("prominence").between(0, 1),
    }


def request_checks() -> dict[str, Column]:
    c = F.col
    return {
        "n_days": c("n_days").between(1, 21),
        "budget": c("budget") > 0,
        "party": c("party").between(1, 20),
        "interests": F.size("interests") > 0,
        "start_lat": c("start_lat").between(5.85, 9.90),
        "start_lon": c("start_lon").between(79.60, 81.95),
        "w_pref": c("w_pref").between(0, 1),
    }


def with_violations(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """``df`` with its violated checks; callers split on an empty list, so nothing is lost."""
    return df.withColumn("violations", violations(checks))


def district_units(names: DataFrame) -> DataFrame:
    """(raw, is_district, stem): rejects other units, strips the word for district."""
    low = F.regexp_replace(F.lower(F.trim("raw")), r"\s+", " ")
    bad = low.rlike("|".join(NOT_DISTRICTS))
    return names.select("raw", ((low != "") & ~bad).alias("is_district"), F.regexp_replace(F.trim("raw"), r"(?i) (district|disctrict)$", "").alias("stem"))


def unary_feasible(cand: DataFrame) -> DataFrame:
    """``cand`` with ok and hours_imputed: real fees within the budget, real hours long enough."""
    fits = F.greatest(F.lit(480), F.col("open_min")) + F.col("typical_dwell_min") <= F.least(F.lit(1080), F.col("close_min"))
    fee = F.col("fee_estimated") | (F.col("entry_fee_lkr") <= F.col("poi_budget"))
    return cand.withColumn("ok", fee & (F.col("hours_estimated") | fits)).withColumn("hours_imputed", fee & F.col("hours_estimated"))


def bucketed(poi: DataFrame) -> DataFrame:
    """``poi`` with its cell of 0.01 degrees, coordinates rounded half up."""
    return poi.withColumn("bucket", F.concat_ws("_", F.floor(F.col("lat") * 100 + 0.5), F.floor(F.col("lon") * 100 + 0.5)))


def close_pairs(places: DataFrame, metres: float) -> DataFrame:
    """Pairs a, b of a bucket closer than ``metres``, a before b, with m, the tokens of both and whether one Latin name holds the other.

    ``places(bucket, poi_id, lat, lon, latin, tokens)``.  Pairs meet on a grid of
    ``metres``, so a dense bucket does not pair all its places.
    """
    from .near import within

    p = places.select(F.col("poi_id").alias("a"), "lat", "lon", "bucket", "latin", "tokens")
    others = places.select(F.col("poi_id").alias("b"), F.col("lat").alias("slat"), F.col("lon").alias("slon"), F.col("bucket").alias("other"), F.col("latin").alias("latin_b"), F.col("tokens").alias("tokens_b"))
    near = within(p, others, metres / 1000).where((F.col("bucket") == F.col("other")) & (F.col("a") < F.col("b")))
    m = haversine_km("lat", "lon", "slat", "slon") * 1000
    held = (F.col("latin") != "") & (F.col("latin_b") != "") & (F.col("latin").contains(F.col("latin_b")) | F.col("latin_b").contains(F.col("latin")))
    return near.withColumn("m", m).where(F.col("m") < metres).select("a", "b", "m", F.coalesce(held, F.lit(False)).alias("contained"), "tokens", "tokens_b")


def dup_pairs(poi: DataFrame, metres: float = 200.0) -> DataFrame:
    """(a, b, m, contained): pairs of a bucket closer than ``metres``, a before b, and whether one Latin name holds the other."""
    p = bucketed(poi).select("poi_id", "lat", "lon", "bucket", T.normalise_name(F.col("name")).alias("latin"), F.lit(None).cast("string").alias("tokens"))
    return close_pairs(p, metres).select("a", "b", F.round("m", 2).alias("m"), "contained")


def canonical_district(name: Column) -> Column:
    """Any spelling of a district as its canonical name: alias, equality, six-letter prefix, in this order."""
    from ..sources.dims import DISTRICT_ALIASES, DISTRICTS

    key = F.regexp_replace(F.trim(F.regexp_replace(F.lower(name), "-", " ")), r"\s+", " ")
    squashed = F.regexp_replace(key, " ", "")
    flat = {d.lower().replace(" ", ""): d for d in DISTRICTS}
    prefix = None
    for f, d in flat.items():
        hit = squashed.startswith(f[:6])
        prefix = F.when(hit, d) if prefix is None else prefix.when(hit, d)
    return F.when(key != "", F.coalesce(lookup(key, DISTRICT_ALIASES), lookup(squashed, flat), prefix))


def latest_per_key(delta: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; of rows alike in ``order`` that with the least hash of all its columns."""
    w = Window.partitionBy(key).orderBy(F.desc(order), F.xxhash64(*delta.columns))
    return delta.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def upsert(base: DataFrame, delta: DataFrame, key: str, order: str) -> DataFrame:
    """``base`` with the last row of each key of ``delta`` set over it; new keys are added.

    Columns are those of ``base``; ``delta`` has them and ``order``.
    """
    last = latest_per_key(delta, key, order).select(*(F.col(c).alias(f"_{c}") for c in base.columns))
    both = base.join(last, base[key] == last[f"_{key}"], "full_outer")
    return both.select(*(F.when(F.col(f"_{key}").isNotNull(), F.col(f"_{c}")).otherwise(base[c]).alias(c) for c in base.columns))


