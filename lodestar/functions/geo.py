"""Distances and road estimates as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.dims import DETOUR, EARTH_KM, HILL_BOX, LAT_MAX, LAT_MIN, LON_MAX, LON_MIN, ROAD_KMH


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle kilometres; null where a coordinate is null."""
    lat1, lon1, lat2, lon2 = (F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2))
    a, b = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    h = a * a + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * b * b
    return F.lit(2 * EARTH_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def road_km(km: Column) -> Column:
    return km * DETOUR


def road_minutes(km: Column) -> Column:
    """Minutes by road for a straight-line distance."""
    return km * DETOUR / ROAD_KMH * 60.0


def in_bbox(lat: Column, lon: Column) -> Column:
    return lat.between(LAT_MIN, LAT_MAX) & lon.between(LON_MIN, LON_MAX)


def in_hills(lat: Column, lon: Column) -> Column:
    return lat.between(HILL_BOX[0], HILL_BOX[1]) & lon.between(HILL_BOX[2], HILL_BOX[3])


def cell(value: Column, size: float) -> Column:
    """Grid index of a coordinate."""
    return F.floor(value / size)


def on_sphere(lat: str, lon: str, name: str = "u") -> dict[str, Column]:
    """Columns ``name``x, ``name``y, ``name``z of the unit vector of a place; distances follow from the chords between them."""
    la, lo = F.radians(lat), F.radians(lon)
    return {f"{name}x": F.cos(la) * F.cos(lo), f"{name}y": F.cos(la) * F.sin(lo), f"{name}z": F.sin(la)}
