"""Queries that write, and read back what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.queries.base import load
from gridmill.sources import index_store, writes
from gridmill.sources.tables import home


def place(spark: SparkSession, name: str, source: DataFrame) -> str:
    """A folder that belongs to the source's files, so that the query run again writes over its own table."""
    return f"{home(spark)}/written-{name}-{index_store.fingerprint([source], name)}"


def merged_table(spark: SparkSession, d: str) -> DataFrame:
    """SNK1, SNK2, SNK7: a staged load that rejects and transforms, and a merge that is run twice, read back."""
    source = load(spark, d, "customer")
    raw = source.select("c_custkey", F.concat(F.lit(" "), "c_name").alias("c_name"), F.col("c_acctbal").cast("double").alias("c_acctbal"))
    table = writes.Table(spark, place(spark, "merged", source), raw.schema, ["c_custkey"])
    table.load(raw, lambda df: df.withColumn("c_name", F.trim("c_name")), F.col("c_acctbal") > 0)
    new = raw.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.lit("renamed")).alias("c_name"), F.lit(1.0).alias("c_acctbal"))
    table.merge(new)
    table.merge(new)
    table.clean(4)  # an earlier run's reader may still be at its version
    return table.read()


def appended_log(spark: SparkSession, d: str) -> DataFrame:
    """SNK6, SNK10: events appended in batches, one of them twice, then a batch replaced; counts read back."""
    events = load(spark, d, "events")
    path = place(spark, "log", events)
    rows = events.select("event_id", (F.col("event_id") % 97).alias("query"), (F.col("event_id") % 4).alias("n"))
    for n in (0, 1, 1, 2, 3):
        writes.append_once(rows.where(F.col("n") == n).drop("n"), path, n)
    writes.replace_in_place(rows.where("n = 3 AND event_id % 8 = 3").drop("n").withColumn("batch", F.lit("3")), path, ["batch"])
    told = spark.read.schema("event_id long, query long, batch string").parquet(path)
    return told.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("latest"))


QUERIES = {f.__name__: f for f in (merged_table, appended_log)}
ORACLE = {
    "merged_table": """WITH o AS (SELECT c_custkey, c_name, c_acctbal::DOUBLE AS c_acctbal FROM customer WHERE c_acctbal > 0), n AS (SELECT c_custkey * 2 AS c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'renamed' END AS c_name, 1.0::DOUBLE AS c_acctbal FROM customer WHERE c_custkey % 3 = 0)
        SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(n.c_name, o.c_name) AS c_name, coalesce(n.c_acctbal, o.c_acctbal) AS c_acctbal FROM o FULL JOIN n ON n.c_custkey = o.c_custkey""",
    "appended_log": "SELECT event_id % 97 AS query, count(*) AS n, max(event_id) AS latest FROM events WHERE event_id % 4 <> 3 OR event_id % 8 = 3 GROUP BY 1",
}
