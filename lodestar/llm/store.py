"""Tables of a folder by name; the shared folder and tables written there are the library's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import materialise, shared_dir

__all__ = ["materialise", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
