"""Daily statistics and latest votes as Structured Streaming jobs over an events stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.sources.tables import scratch

LATE = "1 day"


def daily(events: DataFrame) -> DataFrame:
    """Counts and sums for each day and type; a day closes when events are LATE past it."""
    return events.withWatermark("ts", LATE).groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"), F.approx_count_distinct("user_id").alias("users"))


def unique(events: DataFrame) -> DataFrame:
    """Events without repeats of an id that come within LATE of each other."""
    return events.withWatermark("ts", LATE).dropDuplicatesWithinWatermark(["event_id"])


def run_available(stream: DataFrame, path: str, mode: str = "update") -> None:
    """Runs the stream over all that is there, and appends each batch's rows with its number to ``path``.

    A batch that is replayed after a failure overwrites its own folder, so rows come once.
    """

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/rows/batch={batch}")

    query = stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination()


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last update of each key that ``run_available`` has written."""
    rows = spark.read.parquet(f"{path}/rows")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("batch")))).where("nth = 1").drop("nth", "batch")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return rows.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily counts by type, as the stream's last update of each."""
    path = scratch(spark, "daily")
    run_available(daily(events_stream(spark, sf_dir)), path)
    rows = latest(spark, path, ["w", "event_type"])
    return rows.select(F.col("w.start").cast("date").cast("string").alias("day"), "event_type", "n", F.round("value", 2).alias("value"))


QUERIES = {"daily_stream": daily_stream}
ORACLE = {"daily_stream": "SELECT ts::DATE::VARCHAR AS day, event_type, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY 1, 2"}
