"""Dimension tables: small fixed values, and how to turn them into columns.

Each is bounded by its own text, so it becomes a literal expression or a
broadcast table without a size check.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: domain
LAT_MIN, LAT_MAX, LON_MIN, LON_MAX = 5.85, 9.90, 79.60, 81.95
EARTH_KM = 6371.0
DETOUR, ROAD_KMH = 1.35, 35.0
DAY_START, DAY_END, BUFFER = 480, 1080, 15
MAX_LEG, MAX_TRANSFER, MAX_INTRA_DAY = 120.0, 240.0, 150.0
CATEGORIES = ["heritage", "wildlife", "nature", "beach", "religious", "adventure", "cultural", "urban"]

# fixed values: visit length, opening time, closing time and fee assumed per category
CATEGORY_DEFAULTS = {
    "heritage": (120, 480, 1050, 3000.0),
    "wildlife": (240, 360, 1080, 6000.0),
    "nature": (90, 0, 1440, 0.0),
    "beach": (150, 0, 1440, 0.0),
    "religious": (60, 300, 1260, 0.0),
    "adventure": (180, 360, 1020, 2000.0),
    "cultural": (90, 540, 1020, 1000.0),
    "urban": (60, 540, 1260, 0.0),
}

# fixed values: category rules in order; any (key, values) hit, and keys of which one must be present
CATEGORY_RULES = [
    ("wildlife", [("boundary", ["protected_area", "national_park"]), ("leisure", ["nature_reserve"]), ("tourism", ["zoo"]), ("protect_class", ["2", "4", "6"])], []),
    ("beach", [("natural", ["beach"]), ("leisure", ["beach_resort"])], []),
    ("heritage", [("historic", ["ruins", "archaeological_site", "castle", "fort", "monument", "memorial", "city_gate", "tomb"]), ("tourism", ["museum"]), ("heritage", ["1", "2", "3"])], []),
    (
        "religious",
        [("amenity", ["place_of_worship", "monastery"]), ("building", ["temple", "church", "mosque", "cathedral", "stupa"]), ("historic", ["temple", "wayside_shrine"])],
        ["historic", "heritage", "wikidata", "wikipedia", "tourism", "website", "ref:whc"],
    ),
    ("adventure", [("natural", ["peak", "cave_entrance", "cliff", "volcano"]), ("sport", ["climbing", "rafting", "surfing", "diving"]), ("tourism", ["wilderness_hut"])], []),
    ("nature", [("waterway", ["waterfall"]), ("natural", ["waterfall", "spring", "hot_spring"]), ("leisure", ["garden"])], []),
    ("nature", [("natural", ["wood", "water", "wetland"]), ("leisure", ["park"]), ("landuse", ["forest"])], ["tourism", "wikidata", "wikipedia", "website", "protect_class", "boundary"]),
    ("cultural", [("tourism", ["artwork", "gallery", "attraction", "theme_park"]), ("amenity", ["theatre", "arts_centre"]), ("historic", ["heritage"])], []),
    ("urban", [("tourism", ["viewpoint", "information"]), ("amenity", ["marketplace"]), ("man_made", ["lighthouse", "tower"])], []),
]
EXCLUDED_NAMES = r"(?i)^(bus|petrol|fuel|atm|toilet)|^untitled|^unnamed"
KEPT_TAGS = ["tourism", "historic", "natural", "leisure", "amenity", "boundary", "waterway", "man_made", "website", "phone"]
FORBIDDEN_COLUMNS = {"ta_rating", "ta_reviews", "ta_review_text", "ta_name", "ta_address", "google_rating", "google_reviews", "google_name", "google_address"}

# fixed values: score and nightly rate per register type
STAY_TYPES = {
    "Home Stay Units": (1.00, 4000.0),
    "Heritage Homes": (0.90, 12000.0),
    "Heritage Bungalows": (0.85, 14000.0),
    "Rented Homes": (0.80, 6000.0),
    "Bangalows": (0.75, 8000.0),
    "Rented Apartments": (0.70, 7000.0),
    "Guest Houses": (0.65, 6500.0),
    "Boutique Villas": (0.45, 22000.0),
    "Boutique Hotels": (0.40, 25000.0),
    "Tourist Hotels": (0.30, 15000.0),
    "Classified Hotels( 1-5 Star)": (0.20, 35000.0),
}
DEFAULT_STAY_SCORE, DEFAULT_RATE = 0.50, 10000.0
GRADES = {"ONE": 0.04, "TWO": 0.02, "THREE": 0.00, "FOUR": -0.03, "FIVE": -0.06, "A": 0.00, "B": 0.02, "C": 0.04, "STANDARD": 0.04, "SUPERIOR": 0.00, "DELUXE": -0.04}
ROOMS_FLOOR, ROOMS_CEILING = 1, 300
HOTEL_TYPES = ["Boutique Hotels", "Tourist Hotels", "Classified Hotels( 1-5 Star)", "Boutique Villas"]

# fixed values: prominence by category, ecological cost by category
PROMINENCE = {"wildlife": 0.10, "heritage": 0.10, "beach": 0.08, "nature": 0.05, "adventure": 0.06, "cultural": 0.05, "religious": 0.02, "urban": 0.02}
ECO_COST = {"wildlife": 0.85, "nature": 0.55, "beach": 0.45, "adventure": 0.40, "heritage": 0.25, "religious": 0.20, "cultural": 0.15, "urban": 0.10}
UNKNOWN_CROWDING = 0.35

# fixed values: emission factors in kg: basis, capacity, occupancy, low, central, high
EMISSIONS = {
    "walk": ("pkm", None, None, 0.0, 0.0, 0.0),
    "train": ("pkm", None, None, 0.00794, 0.022, 0.03546),
    "bus": ("pkm", None, None, 0.015161, 0.02717, 0.10846),
    "tuktuk": ("vkm", 3, None, 0.1135, 0.1135, 0.1135),
    "car_private": ("vkm", 4, None, 0.14262, 0.16691, 0.22472),
    "car_shared": ("vkm", 4, 4, 0.14262, 0.16691, 0.22472),
}
JOURNEY_LAMBDA, REFERENCE_KM = 0.40, 227.5
TRAIN_KMH = {"lowland": 47.6, "hill": 24.1, "fast": 64.0, "slow": 24.0}
HILL_BOX = (6.80, 7.50, 80.38, 81.10)

# fixed values: districts in order with an anchor each, and spellings of their names
DISTRICTS = {
    "Colombo": (6.9271, 79.8612),
    "Gampaha": (7.0873, 80.0144),
    "Kalutara": (6.5854, 79.9607),
    "Kandy": (7.2906, 80.6337),
    "Matale": (7.7500, 80.6800),
    "Nuwara Eliya": (6.9497, 80.7891),
    "Galle": (6.0535, 80.2210),
    "Matara": (5.9549, 80.5550),
    "Hambantota": (6.1241, 81.1185),
    "Jaffna": (9.6615, 80.0255),
    "Kilinochchi": (9.3803, 80.3770),
    "Mannar": (8.9810, 79.9044),
    "Vavuniya": (8.7514, 80.4971),
    "Mullaitivu": (9.2671, 80.8142),
    "Batticaloa": (7.7102, 81.6924),
    "Ampara": (7.2917, 81.6747),
    "Trincomalee": (8.5874, 81.2152),
    "Kurunegala": (7.4863, 80.3623),
    "Puttalam": (8.0362, 79.8283),
    "Anuradhapura": (8.3114, 80.4037),
    "Polonnaruwa": (7.9403, 81.0188),
    "Badulla": (6.9934, 81.0550),
    "Monaragala": (6.8728, 81.3510),
    "Ratnapura": (6.6828, 80.3992),
    "Kegalle": (7.2513, 80.3464),
}
DISTRICT_ALIASES = {
    "moneragala": "Monaragala",
    "monaragala": "Monaragala",
    "mullaithivu": "Mullaitivu",
    "mullaittivu": "Mullaitivu",
    "mulaitivu": "Mullaitivu",
    "mullativu": "Mullaitivu",
    "killinochchi": "Kilinochchi",
    "kilinochci": "Kilinochchi",
    "kilinochchi": "Kilinochchi",
    "nuwaraeliya": "Nuwara Eliya",
    "nuwara eliya": "Nuwara Eliya",
    "amparai": "Ampara",
    "ampara": "Ampara",
    "kaluthara": "Kalutara",
    "puttlam": "Puttalam",
    "puttalama": "Puttalam",
    "kegalla": "Kegalle",
    "pollonnaruwa": "Polonnaruwa",
    "trincomali": "Trincomalee",
    "thrincomalee": "Trincomalee",
    "vavuniyawa": "Vavuniya",
    "mannaram": "Mannar",
    "maha nuwara": "Kandy",
    "anuradapura": "Anuradhapura",
}
NOT_DISTRICTS = ["ds division", "divisional", "secretariat", "province", "gn division", "grama", "municipal", "urban council", "pradeshiya"]

# fixed values: stems that tell an interest
INTEREST_STEMS = {
    "heritage": ["heritage", "ruin", "ancient", "fort", "historic", "history", "unesco"],
    "wildlife": ["wildlife", "safari", "elephant", "leopard", "whale", "bird", "national park"],
    "nature": ["nature", "waterfall", "hill", "tea", "mountain", "forest", "lake", "garden"],
    "beach": ["beach", "surf", "coast", "sea", "snorkel", "diving"],
    "religious": ["religious", "temple", "kovil", "church", "mosque", "stupa", "dagoba"],
    "adventure": ["adventure", "hike", "hiking", "trek", "rafting", "climb", "zipline"],
    "cultural": ["cultural", "culture", "museum", "dance", "festival", "art", "craft"],
    "urban": ["urban", "city", "shopping", "market", "nightlife", "colombo"],
}

# fixed values: the query grid
BUDGETS = {"low": 40000.0, "medium": 100000.0, "high": 250000.0}
DURATIONS = {"short": 3, "medium": 7, "long": 12}
PROFILES = {"culture": ["heritage", "cultural"], "wildlife": ["wildlife", "nature"], "beach": ["beach"], "mixed": ["heritage", "wildlife", "beach"]}


def lookup(key: Column, values: dict, default=None) -> Column:
    """``values[key]``, or ``default``; a null or unknown key gives the default."""
    pairs = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in values.items()))
    found = F.element_at(pairs, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def category_default(category: Column, field: int) -> Column:
    return lookup(category, {c: v[field] for c, v in CATEGORY_DEFAULTS.items()})


def stays_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in STAY_TYPES.items()], "sltda_type string, category_score double, rate double")


def require_absent(df: DataFrame, forbidden: set[str] = FORBIDDEN_COLUMNS) -> DataFrame:
    """``df`` itself, or an error naming the columns that must not be stored."""
    bad = sorted(forbidden & {c.lower() for c in df.columns})
    if bad:
        raise ValueError(f"columns that must not be stored: {', '.join(bad)}")
    return df


def require_columns(df: DataFrame, needed: set[str]) -> DataFrame:
    """``df`` itself, or an error naming the columns it lacks."""
    lacking = sorted(needed - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    return df
