"""Queries of the place-and-trip operators: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles, queries_places, queries_plans


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return queries_places.queries() | queries_plans.queries()


def oracle_sql() -> dict[str, str]:
    return oracles.all_oracles()
