"""Two log operators that run on batches and streams by the same expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.views import table

FIELDS = ["days", "budget_lkr", "party_size", "interests"]
LOG = "ts timestamp, raw_text string, source string, edited_fields array<string>"


def v_parse_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A parse log from orders: edited fields by bits of the customer number."""
    c = F.col("o_custkey") % 16
    edited = F.array_compact(F.array(*(F.when(F.shiftright(c.cast("int"), i).bitwiseAND(F.lit(1)) == 1, F.lit(f)) for i, f in enumerate(FIELDS))))
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_orderpriority").alias("raw_text"),
        F.when(F.col("o_orderstatus") == "O", "llm").otherwise("rules").alias("source"),
        edited.alias("edited_fields"),
    )


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").json(path)


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The log's lines with the schema fixed; a stream reads files as they arrive."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOG).json(path)


def _unedited(log: DataFrame) -> DataFrame:
    field = F.explode(F.array(*map(F.lit, FIELDS))).alias("field")
    return log.select("ts", "source", "edited_fields", field).withColumn("kept", (~F.array_contains("edited_fields", F.col("field"))).cast("int"))


def parse_accuracy(log: DataFrame) -> DataFrame:
    """(source, field, n, kept_pct): the share of fields left as parsed."""
    g = _unedited(log).groupBy("source", "field").agg(F.count("*").alias("n"), F.sum("kept").alias("kept"))
    return g.select("source", "field", "n", F.round(F.col("kept") * 100.0 / F.col("n"), 2).alias("kept_pct"))


def parse_accuracy_windowed(log: DataFrame, width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(day, source, field, n, kept): the same per window; as a stream, windows close ``late`` after their end."""
    x = _unedited(log)
    if x.isStreaming:
        x = x.withWatermark("ts", late)
    g = x.groupBy(F.window("ts", width), "source", "field").agg(F.count("*").alias("n"), F.sum("kept").alias("kept"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "source", "field", "n", "kept")


def pageviews_daily(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """(day, title, views): daily sums per title of views and clicks; late events are dropped from a stream."""
    e = events.where(F.col("event_type").isin("view", "click")).select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("title"), F.col("value").alias("views"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    g = e.groupBy(F.window("ts", "1 day"), "title").agg(F.round(F.sum("views"), 4).alias("views"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "title", "views")


