"""Security events as streams: windows, sessions, duplicates, alerts, a blacklist join.

Each stream reads the event files as they come and ends when it has read what is there (availableNow),
so a run gives the same rows as the batch query. Time is cast to a zoned timestamp for watermarks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.formats import shared_path

LATE = "1 hour"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    files = f"{sf_dir}/events.parque[t]"  # as a pattern it may be one file or a folder of files
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 8).parquet(files).withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", LATE)


def tumbling(events: DataFrame) -> DataFrame:
    w = events.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame) -> DataFrame:
    """Failures in each 24 hours, moving by 6, with an alert over five."""
    w = events.where("event_type = 'error'").groupBy(F.window("ts", "24 hours", "6 hours"), "user_id").agg(F.count("*").alias("failures"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "user_id", "failures", (F.col("failures") > 5).alias("alert"))


def sessions(events: DataFrame) -> DataFrame:
    s = events.groupBy(F.session_window("ts", "6 hours"), "user_id").agg(F.count("*").alias("n"))
    return s.select(F.col("session_window.start").cast("timestamp_ntz").alias("start"), "user_id", "n")


def deduplicated(events: DataFrame) -> DataFrame:
    return events.dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type")


def without_blacklisted(events: DataFrame, blacklist: DataFrame) -> DataFrame:
    """Stream-static anti join: events of users that are not listed."""
    return events.join(blacklist, "user_id", "left_anti").select("event_id", "user_id")


def run_once(spark: SparkSession, plan: DataFrame, mode: str = "complete") -> DataFrame:
    """The stream's result as a table: each batch's output replaces (complete) or extends (append) it."""
    out, state = shared_path(spark, "stream-out"), shared_path(spark, "stream-state")

    def write(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    query = plan.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(plan.schema).parquet(out)


def streamed(shape: Callable[[DataFrame], DataFrame], mode: str = "complete") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run_once(spark, shape(event_stream(spark, sf_dir)), mode)
