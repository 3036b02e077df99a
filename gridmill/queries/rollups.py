"""Roll-ups, lookups that keep the order of rows, milestones of verifications and chunks for a list of names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import community as C
from gridmill.queries.base import load
from gridmill.queries.community import LAST, last_votes

NAMES = " red widget, Bolt,,gear ,no such name"


def verification_milestones(spark: SparkSession, d: str) -> DataFrame:
    """When each user's verifications, one for each contribution, reached a milestone."""
    nth = F.row_number().over(Window.partitionBy("user").orderBy("ts", "event_id"))
    counted = last_votes(spark, d).where("kind = 'verified'").withColumn("n", nth)
    marks = F.broadcast(spark.createDataFrame(list(C.VERIFICATION_MILESTONES), "n int, title string, xp int"))  # two rows
    return counted.join(marks, "n").select("user", "title", "xp", "event_id")


def yield_by_format(spark: SparkSession, d: str) -> DataFrame:
    """Of each order priority the orders, the weighted share of lines returned, and how many by ship year, most first."""
    lines = load(spark, d, "lineitem").select("l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("hit"), F.year("l_shipdate").alias("tier"))
    rows = lines.join(load(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderpriority").alias("format")), "l_orderkey")
    tiers = rows.groupBy("format", "tier").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("hits"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("order"), "tier", "n")))
    told = tiers.groupBy("format").agg(F.sum("n").alias("lines"), F.round(100 * F.sum("hits") / F.sum("n"), 4).alias("percent"), listed.alias("t"))
    return told.select("format", "lines", "percent", F.array_join(F.transform("t", lambda x: F.concat_ws("=", x["tier"].cast("string"), x["n"].cast("string"))), ", ").alias("tiers"))


def lot_renames(spark: SparkSession, d: str) -> DataFrame:
    """Of each lot the building that its last row names, and all its buildings in the order of their first rows."""
    k = F.col("o_orderkey")
    lot = F.regexp_replace(F.trim(F.concat(F.lpad((k % 211).cast("string"), 10, "1"), F.when(k % 2 == 0, ".0").otherwise(" "))), r"\.0$", "")
    rows = load(spark, d, "orders").select(lot.alias("lot"), (F.col("o_custkey") % 7).alias("bin"), k.alias("at")).where("length(lot) = 10")
    firsts = rows.groupBy("lot", "bin").agg(F.min("at").alias("first"), F.max("at").alias("last"))
    told = firsts.groupBy("lot").agg(F.max_by("bin", "last").alias("bin"), F.array_sort(F.collect_list(F.struct("first", "bin"))).alias("all"))
    return told.select("lot", "bin", F.array_join(F.transform("all", lambda x: x["bin"].cast("string")), ",").alias("bins"))


def named_chunks(spark: SparkSession, d: str) -> DataFrame:
    """For a list of names the first three chunks of the buildings whose names hold each of them."""
    names = spark.createDataFrame([(NAMES,)], "names string").select(F.explode(F.split("names", ",")).alias("name")).select(F.trim("name").alias("name")).where("name <> ''").distinct()
    chunks = load(spark, d, "part").select(F.col("p_name").alias("building_name"), F.col("p_partkey").alias("chunk"))
    # The names are those of one request, so they are sent to the chunks.
    found = chunks.join(F.broadcast(names), F.contains(F.lower("building_name"), F.lower("name")))
    best = found.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("chunk"))).where("nth <= 3")
    listed = best.groupBy("name").agg(F.array_sort(F.collect_list("chunk")).alias("chunks"))
    return names.join(listed, "name", "left").select("name", F.array_join(F.coalesce("chunks", F.array().cast("array<long>")).cast("array<string>"), ",").alias("chunks"))


QUERIES = {f.__name__: f for f in (verification_milestones, yield_by_format, lot_renames, named_chunks)}
ORACLE = {
    "verification_milestones": f"""WITH {LAST}, n AS (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts, event_id) AS n FROM lastv WHERE kind = 'verified')
        SELECT "user", CASE n WHEN 10 THEN 'fact_checker' ELSE 'truth_seeker' END AS title, CASE n WHEN 10 THEN 25 ELSE 100 END AS xp, event_id FROM n WHERE n IN (10, 50)""",
    "yield_by_format": """WITH t AS (SELECT o_orderpriority AS format, year(l_shipdate) AS tier, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS hits FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
        SELECT format, sum(n)::BIGINT AS lines, round(100 * sum(hits) / sum(n), 4) AS percent, string_agg(tier || '=' || n, ', ' ORDER BY n DESC, tier) AS tiers FROM t GROUP BY 1""",
    "lot_renames": """WITH r AS (SELECT lpad((o_orderkey % 211)::VARCHAR, 10, '1') AS lot, o_custkey % 7 AS bin, o_orderkey AS k FROM orders), f AS (SELECT lot, bin, min(k) AS first FROM r GROUP BY 1, 2)
        SELECT lot, (SELECT arg_max(bin, k) FROM r WHERE r.lot = f.lot) AS bin, string_agg(bin::VARCHAR, ',' ORDER BY first) AS bins FROM f GROUP BY lot""",
    "named_chunks": """WITH n AS (SELECT unnest(['red widget', 'Bolt', 'gear', 'no such name']) AS name), c AS (SELECT name, p_partkey, row_number() OVER (PARTITION BY name ORDER BY p_partkey) AS nth FROM n JOIN part ON contains(lower(p_name), lower(name)))
        SELECT name, coalesce((SELECT string_agg(p_partkey::VARCHAR, ',' ORDER BY p_partkey) FROM c WHERE c.name = n.name AND nth <= 3), '') AS chunks FROM n""",
}
