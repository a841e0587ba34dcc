"""The register of stays: a CSV reader with a checked header, and its clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# columns of the catalogue and what they are called in a file; give another map for other files
COLUMNS = {"name": "Name", "sltda_type": "Type", "grade": "Grade", "rooms": "Rooms", "lat": "Latitude", "lon": "Longitude", "district": "District", "division": "Division"}


def clean_register(raw: DataFrame) -> DataFrame:
    """Trimmed names and types, upper-case grades without "nan", numbers or null; other columns as they are."""
    grade = F.upper(F.trim("grade"))
    number = {"rooms": "int", "lat": "double", "lon": "double"}
    kinds = dict(raw.dtypes)
    new = {c: F.trim(c) for c in ("name", "sltda_type") if c in kinds}
    new |= {"grade": F.when(~grade.isin("NAN", ""), grade)} if "grade" in kinds else {}
    new |= {c: F.col(c).try_cast("double").try_cast(t) for c, t in number.items() if c in kinds}
    return raw.withColumns(new)


def read_register(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """The register in CSV files, one row per stay, with an ``acc_id`` by its content.

    ``columns`` maps catalogue names to header names; a header without one of them
    is an error that names all that are missing.  The id is a hash of the row's
    own fields and a number among rows alike, so it holds for files in any order.
    """
    columns = columns or COLUMNS
    raw = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').option("multiLine", True).csv(path)
    missing = sorted(set(columns.values()) - set(raw.columns))
    if missing:
        raise ValueError(f"the register lacks the columns {', '.join(missing)}")
    rows = raw.select(*(F.col(f"`{h}`").alias(c) for c, h in columns.items()))
    from pyspark.sql import Window

    key = F.xxhash64(*rows.columns)
    twin = F.row_number().over(Window.partitionBy(*rows.columns).orderBy(F.lit(0)))
    named = rows.withColumn("acc_id", F.concat_ws("-", F.lit("reg"), F.lower(F.hex(key)), twin.cast("string")))
    return clean_register(named)
