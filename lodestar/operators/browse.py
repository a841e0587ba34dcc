"""Catalogue pages: optional filters, order and paging as functions of their parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def browse_places(places: DataFrame, categories: list[str] | None = None, district: str | None = None, text: str | None = None, min_prominence: float | None = None) -> DataFrame:
    """The places that pass every filter given; a filter of None lets all pass, text is looked for in any case."""
    if categories is not None:
        places = places.where(F.col("category").isin(categories))
    if district is not None:
        places = places.where(F.col("district") == district)
    if text is not None:
        places = places.where(F.lower("name").contains(text.lower()))
    if min_prominence is not None:
        places = places.where(F.col("prominence") >= min_prominence)
    return places


def browse_stays(stays: DataFrame, kind: str | None = None, min_score: float | None = None) -> DataFrame:
    """The stays whose type holds ``kind``, in any case, with a sustainability score of ``min_score`` at least."""
    if kind is not None:
        stays = stays.where(F.lower("sltda_type").contains(kind.lower()))
    if min_score is not None:
        stays = stays.where(F.col("sustainability_score") >= min_score)
    return stays


def page_of(places: DataFrame, page: int, size: int) -> DataFrame:
    """One page of the places by prominence, from 1, with total, pages, has_next and has_prev.

    The page comes from a top-k over all rows, the total from one count.
    """
    total = places.agg(F.count("*").alias("total"))
    rows = places.orderBy(F.desc("prominence"), "poi_id").offset((page - 1) * size).limit(size)
    j = rows.crossJoin(F.broadcast(total))
    return j.select(*places.columns, "total", F.ceil(F.col("total") / size).cast("long").alias("pages"), (F.col("total") > page * size).alias("has_next"), F.lit(page > 1).alias("has_prev"))


def page_after(places: DataFrame, last: tuple[float, str] | None, size: int) -> DataFrame:
    """The ``size`` places that follow the place of prominence and id ``last`` in the order of ``page_of``; the first ones for None.

    Only the page itself is kept in order, however deep it lies.
    """
    if last is not None:
        value, key = last
        places = places.where((F.col("prominence") < value) | ((F.col("prominence") == value) & (F.col("poi_id") > key)))
    return places.orderBy(F.desc("prominence"), "poi_id").limit(size)


def top_prominent(places: DataFrame, n: int = 25) -> DataFrame:
    return places.orderBy(F.desc("prominence"), "poi_id").limit(n)
