"""Scores of places, stays, journeys and requests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.dims import DEFAULT_RATE, DEFAULT_STAY_SCORE, ECO_COST, EMISSIONS, GRADES, JOURNEY_LAMBDA, PROMINENCE, REFERENCE_KM, ROOMS_CEILING, ROOMS_FLOOR, UNKNOWN_CROWDING, lookup, stays_dim


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def half_up(x: Column, digits: int) -> Column:
    """A non-negative number rounded half up, decimal halves that binary fractions fall short of included."""
    return F.round(x + 1e-9, digits)


def clip01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def prominence() -> Column:
    """How likely a place is a destination, from twelve signals of its row, 0 to 1."""
    tags = F.coalesce("osm_tags_kept", F.lit("{}"))
    one = lambda b, w: F.when(b, F.lit(w)).otherwise(F.lit(0.0))
    rich = F.least(F.lit(12), F.greatest(F.lit(0), F.coalesce("tag_count", F.lit(0)))) / F.lit(12.0) * 0.25
    s = rich + one(tags.contains('"tourism"'), 0.20) + one(F.lower(tags).contains("website"), 0.12)
    s = s + one(~F.col("hours_estimated"), 0.12) + one(~F.col("fee_estimated"), 0.08) + one(tags.contains('"historic"'), 0.08)
    s = s + one(F.lower(tags).contains("protect"), 0.08) + F.coalesce("rail_access_score", F.lit(0.0)) * 0.10
    s = s + one(F.col("wikidata").isNotNull(), 0.20) + one(F.col("wikipedia").isNotNull(), 0.15) + one(F.coalesce("unesco", F.lit(False)), 0.25)
    return F.round(clip01(s + lookup(F.col("category"), PROMINENCE, 0.0)), 4)


def retrieval_score(penalty: float = 0.35) -> Column:
    """Prominence less known crowding."""
    return F.col("prominence") - F.when(F.col("popularity_known"), F.coalesce("popularity_index", F.lit(0.0))).otherwise(0.0) * penalty


def crowding_cost() -> Column:
    return F.when(F.col("popularity_known"), F.round(clip01(F.col("popularity_index")), 4)).otherwise(F.lit(UNKNOWN_CROWDING))


def eco_cost() -> Column:
    return lookup(F.col("category"), ECO_COST, 0.30)


def place_sustainability() -> Column:
    return F.round(clip01(1.0 - (crowding_cost() * 0.75 + eco_cost() * 0.25)), 4)


def heuristic_preference(interests: Column) -> Column:
    return half_up(F.least(F.lit(1.0), F.when(F.array_contains(interests, F.col("category")), 0.75).otherwise(0.25) + F.col("prominence") * 0.25), 4)


def utility(w_pref: Column, pref: Column, sust: Column) -> Column:
    return w_pref * pref + (1 - w_pref) * (1 - JOURNEY_LAMBDA) * sust


def size_score(rooms: Column, median: Column) -> Column:
    """1 for the smallest, 0 at the ceiling, by the logarithm of rooms; null rooms take the median."""
    import math

    r = F.greatest(F.lit(float(ROOMS_FLOOR)), F.least(F.lit(float(ROOMS_CEILING)), F.coalesce(rooms.cast("double"), median)))
    return clip01(1.0 - (F.log(r) - math.log(ROOMS_FLOOR)) / (math.log(ROOMS_CEILING) - math.log(ROOMS_FLOOR)))


def scored_stays(acc: DataFrame) -> DataFrame:
    """``acc`` with category_score, rate, size_score, grade_adj, sustainability_score and acc_impact."""
    median = acc.agg(F.median("rooms").alias("rooms_median"))
    a = acc.join(F.broadcast(stays_dim(acc.sparkSession)), "sltda_type", "left").crossJoin(F.broadcast(median))
    a = a.withColumn("category_score", F.coalesce("category_score", F.lit(DEFAULT_STAY_SCORE))).withColumn("rate", F.coalesce("rate", F.lit(DEFAULT_RATE)))
    a = a.withColumn("size_score", size_score(F.col("rooms"), F.col("rooms_median"))).withColumn("grade_adj", lookup(F.col("grade"), GRADES, 0.0))
    a = a.withColumn("sustainability_score", F.round(clip01(F.col("category_score") * 0.65 + F.col("size_score") * 0.35 + F.col("grade_adj")), 4))
    return a.withColumn("acc_impact", F.round(1.0 - F.col("sustainability_score"), 4)).drop("rooms_median")


def rail_access(km: Column) -> Column:
    return F.round(
        F.when(km <= 2.0, 1.0).when(km <= 8.0, 1.0 - 0.4 * (km - 2.0) / 6.0).when(km <= 25.0, 0.6 * (1.0 - (km - 8.0) / 17.0)).otherwise(0.0), 4
    )


def estimated_mode(km: Column) -> Column:
    return F.when(km <= 1.5, "walk").when(km <= 6.0, "tuktuk").when(km < 60.0, "bus").otherwise("car_shared")


def kg_per_traveller(mode: Column, km: Column, party: Column, scenario: str = "central") -> Column:
    """Emissions one traveller is responsible for on one leg; 0 for no distance or an unknown mode."""
    at = {"low": 3, "central": 4, "high": 5}[scenario]
    party = F.greatest(party, F.lit(1))
    out = F.lit(0.0)
    for name, f in EMISSIONS.items():
        if f[0] == "pkm":
            kg = km * f[at]
        elif f[2]:
            kg = km * f[at] / F.lit(float(f[2]))
        else:
            kg = km * f[at] * F.ceil(party / F.lit(float(f[1]))) / party
        out = F.when(mode == name, kg).otherwise(out)
    return F.when(km > 0, out).otherwise(0.0)


def reference_kg(scenario: str = "central") -> float:
    return REFERENCE_KM * EMISSIONS["car_private"][{"low": 3, "central": 4, "high": 5}[scenario]]


def journey_score(kg_per_day: Column, scenario: str = "central") -> Column:
    return F.round(1.0 - F.least(F.lit(1.0), kg_per_day / reference_kg(scenario)), 4)


def trip_sustainability(place_mean: Column, kg_per_day: Column, scenario: str = "central") -> Column:
    return F.round((1 - JOURNEY_LAMBDA) * place_mean + JOURNEY_LAMBDA * journey_score(kg_per_day, scenario), 4)
