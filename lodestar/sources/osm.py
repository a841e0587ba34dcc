"""Raw map elements: building them from the place view, scanning, and snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .views import pick, v_poi

ELEMENT = (
    "type string, id bigint, lat double, lon double, center struct<lat: double, lon: double>, tags map<string, string>, nodes array<bigint>, "
    "geometry array<struct<lat: double, lon: double>>, members array<struct<type: string, role: string, geometry: array<struct<lat: double, lon: double>>>>"
)
DUMP = f"version double, generator string, elements array<struct<{ELEMENT}>>"

# test values: tag pairs by place number modulo 16, and texts of hours and charges
TAG_PAIRS = [
    ("boundary", "national_park", None, None),
    ("leisure", "nature_reserve", None, None),
    ("natural", "beach", None, None),
    ("historic", "ruins", None, None),
    ("amenity", "place_of_worship", None, None),
    ("amenity", "place_of_worship", "tourism", "yes"),
    ("natural", "peak", None, None),
    ("waterway", "waterfall", None, None),
    ("natural", "wood", None, None),
    ("natural", "wood", "tourism", "information"),
    ("tourism", "gallery", None, None),
    ("tourism", "viewpoint", None, None),
    ("shop", "bakery", None, None),
    ("tourism", "museum", None, None),
    ("historic", "temple", None, None),
    ("man_made", "lighthouse", None, None),
]
HOURS = ["24/7", "Mo-Fr 08:00-17:00", "08:30-12:00, 13:00-18:30", "18:00-02:00", "sunrise-sunset", None, None]
CHARGES = ["1,500 LKR", "USD 10", "12.5", None, None, None]


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Elements of a dump, one row each; a broken file fails the read."""
    return spark.read.schema(DUMP).option("multiLine", True).option("mode", "FAILFAST").json(path).select(F.explode("elements").alias("e")).select("e.*")


def scan_json(df: DataFrame, column: str = "payload") -> DataFrame:
    """Elements of dumps held as JSON text in a column; a null or unreadable text has none."""
    return df.select(F.explode(F.from_json(F.col(column), DUMP)["elements"]).alias("e")).select("e.*")


def latest_snapshot(df: DataFrame, column: str = "extract_date") -> DataFrame:
    """The rows of the newest snapshot; dates sort as text and null dates are never newest."""
    newest = df.agg(F.max(column).alias("_newest"))
    return df.join(F.broadcast(newest), F.col(column) == F.col("_newest"), "left_semi")


def save_raw(df: DataFrame, path: str) -> None:
    """Write an immutable snapshot, partitioned by its date; an existing path is an error."""
    df.write.mode("errorifexists").partitionBy("extract_date").json(path)


def _entries(pairs: list[tuple[Column, Column]]) -> Column:
    known = F.filter(F.array(*(F.struct(k.alias("key"), v.alias("value")) for k, v in pairs)), lambda p: p["value"].isNotNull())
    return F.map_from_entries(known)


def v_osm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places as raw elements, with rejects of every kind among them."""
    k = F.col("k")
    col = lambda i: pick([p[i] for p in TAG_PAIRS], k % 16)
    pairs = [
        (F.lit("name"), F.when(k % 61 != 0, F.when(k % 43 == 0, F.concat(F.lit("ATM "), F.col("name"))).otherwise(F.col("name")))),
        (F.lit("name:en"), F.when((k % 5 == 0) & (k % 61 != 0) & (k % 43 != 0), F.concat(F.col("name"), F.lit(" EN")))),
        (col(0), col(1)),
        (F.coalesce(col(2), F.lit("-")), col(3)),
        (F.lit("opening_hours"), pick(HOURS, k % 7)),
        (F.lit("charge"), pick(CHARGES, k % 6)),
        (F.lit("fee"), F.when(k % 4 == 1, F.lit("no"))),
        (F.lit("heritage:operator"), F.when(k % 97 == 0, F.lit("whc"))),
        (F.lit("wikidata"), F.col("wikidata")),
        (F.lit("wikipedia"), F.col("wikipedia")),
    ]
    lat = F.when(k % 59 == 0, F.lit(13.08)).otherwise(F.col("lat"))
    way, placed = k % 4 == 0, k % 53 != 0
    return v_poi(spark, sf_dir).select(
        F.when(way, "way").otherwise("node").alias("type"),
        k.alias("id"),
        F.when(~way & placed, lat).alias("lat"),
        F.when(~way & placed, F.col("lon")).alias("lon"),
        F.when(way & placed, F.struct(lat.alias("lat"), F.col("lon").alias("lon"))).alias("center"),
        _entries(pairs).alias("tags"),
    )
