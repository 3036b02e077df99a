"""Tables and stand-in columns that several query modules use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores: a file of some megabytes is read in one or two tasks, whatever its rows cost after that."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def lat(key: str) -> Column:
    """A place for a key, the same in every engine: about 55 km of latitude."""
    return F.lit(40.5) + (F.col(key) % 997) / 2000


def lng(key: str) -> Column:
    return F.lit(-74.2) + (F.col(key) % 1009) / 2000


LAT, LNG = "(40.5 + ({0} % 997) / 2000.0)", "(-74.2 + ({0} % 1009) / 2000.0)"
HAVERSINE = "(2 * 6371000.0 * asin(least(1.0, sqrt(pow(sin(radians({2} - {0}) / 2), 2) + cos(radians({0})) * cos(radians({2})) * pow(sin(radians({3} - {1}) / 2), 2)))))"
AS_OF = "2024-06-01 00:00:00"
