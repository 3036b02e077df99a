"""Scan analytics, joins, aggregates, windows and set operations, on orders and events as stand-ins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import text as T
from gridmill.operators import keyed
from gridmill.queries.base import load


def accuracy_by_building(spark: SparkSession, d: str) -> DataFrame:
    """A1: scans, correct ones, their share and averages for each part, over its line items."""
    ok = F.col("l_returnflag") == "A"
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("total_scans"), F.count_if(ok).alias("correct_matches"), F.round(100.0 * F.count_if(ok) / F.count(F.lit(1)), 2).alias("accuracy_percent"), F.round(F.avg("l_discount"), 4).alias("avg_confidence"), F.round(F.avg("l_quantity"), 4).alias("avg_time"))


def daily_stats(spark: SparkSession, d: str) -> DataFrame:
    """Counts, distinct users, conditional counts and averages for each day."""
    return load(spark, d, "events").groupBy(F.to_date("ts").cast("string").alias("day")).agg(F.count(F.lit(1)).alias("total"), F.count_distinct("user_id").alias("users"), F.count_if(F.col("event_type") == "purchase").alias("confirmed"), F.round(F.avg("value"), 2).alias("avg_value"))


def needing_images(spark: SparkSession, d: str) -> DataFrame:
    """Customers with fewer than four orders, none included, best balance first."""
    orders = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))  # combined before the join
    joined = load(spark, d, "customer").join(orders, "c_custkey", "left").select("c_custkey", "c_mktsegment", "c_acctbal", F.coalesce("n", F.lit(0)).alias("image_count"))
    return joined.where("image_count < 4").orderBy(F.desc_nulls_last("c_acctbal"), "c_custkey")


def global_stats(spark: SparkSession, d: str) -> DataFrame:
    """One row of totals, conditional and distinct counts, extremes and coverage."""
    return load(spark, d, "events").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") > 50).alias("large"), F.count_distinct("user_id").alias("users"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"), F.count("props").alias("with_props"))


def vote_tally(spark: SparkSession, d: str) -> DataFrame:
    """A5: votes by kind for each user."""
    return load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("votes_for"), F.count_if(F.col("event_type") == "error").alias("votes_against"))


def method_stats(spark: SparkSession, d: str) -> DataFrame:
    """Share and mean by method over the last seven days of the data."""
    events = load(spark, d, "events")
    last = events.agg((F.max("ts") - F.expr("INTERVAL 7 DAYS")).alias("since"))
    recent = events.join(F.broadcast(last), F.col("ts") > F.col("since"))  # one row
    return recent.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.count_if(F.col("value") > 20) / F.count(F.lit(1)), 2).alias("share"), F.round(F.avg("value"), 3).alias("mean"))


def median_and_max(spark: SparkSession, d: str) -> DataFrame:
    """Exact median, count and maximum."""
    return load(spark, d, "part").groupBy("p_brand").agg(F.round(F.expr("percentile_cont(0.5) WITHIN GROUP (ORDER BY p_retailprice)"), 4).alias("median"), F.count("p_retailprice").alias("n"), F.max("p_retailprice").alias("most"))


def normalised_fame(spark: SparkSession, d: str) -> DataFrame:
    """A10: prices over the largest price."""
    part = load(spark, d, "part")
    most = part.agg(F.max("p_retailprice").alias("most"))
    return part.join(F.broadcast(most)).select("p_partkey", F.round(F.try_divide("p_retailprice", F.nullif("most", F.lit(0.0))), 6).alias("fame"))


def modal_value(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent priority of each customer, the first by name on ties."""
    counted = load(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return keyed.best_per_key(counted, ["o_custkey"], F.desc("n"), F.asc("o_orderpriority")).select("o_custkey", F.col("o_orderpriority").alias("modal"), "n")


def groups_over(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers with over 20 distinct parts."""
    return load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_partkey").alias("parts")).where("parts > 20")


def duplicates(spark: SparkSession, d: str) -> DataFrame:
    """A14, SNK12: names that stand more than once."""
    return keyed.violations(load(spark, d, "part"), ["p_name"])


def dominant(spark: SparkSession, d: str) -> DataFrame:
    """Each nation's most common segment and whether it is a majority."""
    counted = load(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy("c_nationkey")
    best = keyed.best_per_key(counted.withColumn("all", F.sum("n").over(total)), ["c_nationkey"], F.desc("n"), F.asc("c_mktsegment"))
    return best.select("c_nationkey", "c_mktsegment", "n", (2 * F.col("n") > F.col("all")).alias("majority"))


def distinct_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Distinct second words of names, sorted, at most 200 (the limit is the feature)."""
    word = F.trim(F.split_part("p_name", F.lit(" "), F.lit(2)))
    return load(spark, d, "part").select(word.alias("style")).where("style <> ''").distinct().orderBy("style").limit(200)


def counts_over_one(spark: SparkSession, d: str) -> DataFrame:
    """Works by maker, trimmed and in lower case, if more than one."""
    return load(spark, d, "part").groupBy(F.lower(F.trim("p_brand")).alias("maker")).agg(F.count(F.lit(1)).alias("works")).where("works > 1")


def survey_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Weighted rate by format, the eight lowest yields (the limit is the feature)."""
    rates = load(spark, d, "lineitem").groupBy("l_suppkey").agg(F.sum("l_quantity").alias("found"), F.sum("l_extendedprice").alias("of"))
    return rates.select("l_suppkey", F.round(F.col("found") / F.col("of"), 8).alias("rate")).orderBy("rate", "l_suppkey").limit(8)


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    """Counts of missing, placeholder and public-place keys."""
    key = T.canonical_key(F.when(F.col("c_custkey") % 10 == 0, F.lit(None)).when(F.col("c_custkey") % 10 == 1, F.lit("nan")).otherwise(F.concat(F.col("c_custkey").cast("string"), F.lit(".0"))))
    rows = load(spark, d, "customer").select(key.alias("bin"), "c_mktsegment")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("bin") == "N/A").alias("missing"), F.count_if(F.col("bin").contains(".")).alias("polluted"), F.count_if(F.lower("c_mktsegment").rlike("build|house")).alias("public_space"), F.count_distinct(F.when(F.col("bin") != "N/A", F.col("bin"))).alias("keys"))


def anti_join(spark: SparkSession, d: str) -> DataFrame:
    """J4, J5, SNK8: customers without orders."""
    return load(spark, d, "customer").select("c_custkey").join(load(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


def exists_flag(spark: SparkSession, d: str) -> DataFrame:
    """Whether a part was ever returned."""
    returned = load(spark, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey"), F.lit(True).alias("seen")).distinct()
    return load(spark, d, "part").select("p_partkey").join(returned, "p_partkey", "left").select("p_partkey", F.coalesce("seen", F.lit(False)).alias("has_images"))


def scalar_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One or all of a lot's buildings for each nation."""
    by = load(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.min("s_suppkey").alias("one"), F.array_join(F.sort_array(F.collect_set("s_suppkey")).cast("array<string>"), ",").alias("every"))
    return load(spark, d, "nation").select("n_nationkey").join(by, "n_nationkey", "left")


def inner_join(spark: SparkSession, d: str) -> DataFrame:
    """Revenue by segment over three tables."""
    items = load(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"))
    orders = load(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    joined = items.join(orders, "o_orderkey").join(load(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey")
    return joined.groupBy("c_mktsegment").agg(F.round(F.sum("revenue"), 2).alias("revenue"), F.count(F.lit(1)).alias("orders"))


def two_source_hydrate(spark: SparkSession, d: str) -> DataFrame:
    """Metadata from the first source that knows the key, and which it was."""
    keys = load(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    first = load(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name1"))
    second = load(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name2"))
    source = F.when(F.col("name1").isNotNull(), "notable").when(F.col("name2").isNotNull(), "lots").otherwise("none")
    return keys.join(first, "k", "left").join(second, "k", "left").select("k", F.coalesce("name1", "name2").alias("name"), source.alias("source"))


def fan_out(spark: SparkSession, d: str) -> DataFrame:
    """A region's text for each of its nations that has no supplier of its own."""
    own = load(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey"))
    members = load(spark, d, "nation").join(own, "n_nationkey", "left_anti")
    return members.join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat(F.lit("district "), "r_name").alias("blurb"))


def faulty_scans(spark: SparkSession, d: str) -> DataFrame:
    """Open or disputed orders of some priorities."""
    wrong = F.col("o_orderstatus").isin("O") | ~F.coalesce(F.col("o_totalprice") > 400000, F.lit(False))
    return load(spark, d, "orders").where(F.col("o_orderpriority").like("1-%") & wrong).select("o_orderkey", "o_orderstatus")


def confirm_flags(spark: SparkSession, d: str) -> DataFrame:
    """whether the confirmed building led or was among the first three, what failed, and the points."""
    pick = F.array(*[(F.col("event_id") * m) % 7 for m in (1, 3, 5, 9)])
    rows = load(spark, d, "events").select("event_id", pick.alias("c"), (F.col("user_id") % 7).alias("confirmed"))
    in3 = F.array_contains(F.slice("c", 1, 3), F.col("confirmed"))
    top = F.col("c")[0] == F.col("confirmed")
    return rows.select("event_id", top.alias("top1"), in3.alias("top3"), (~F.array_contains("c", F.col("confirmed"))).alias("retrieval_failure"), (in3 & ~top).alias("ranking_failure"), F.when(top, 10).when(in3, 5).otherwise(2).alias("xp"))


def leaderboard(spark: SparkSession, d: str) -> DataFrame:
    """Users by stamps, then points, from a ledger, with titles."""
    from gridmill.functions import community as C

    ledger = load(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "signup").alias("pioneer"), F.count_if(F.col("event_type") == "purchase").alias("validator"), F.sum(F.floor("value")).alias("xp"))
    best = ledger.withColumn("total", F.col("pioneer") + F.col("validator")).orderBy(F.desc("total"), F.desc("xp"), "user_id").limit(100)  # a page of at most 100
    return best.select("user_id", "total", "xp", C.title(F.col("pioneer"), F.col("validator")).alias("title"), F.row_number().over(Window.orderBy(F.desc("total"), F.desc("xp"), "user_id")).alias("place"))


def best_record(spark: SparkSession, d: str) -> DataFrame:
    """The largest order of each customer, the higher key on ties."""
    return keyed.best_per_key(load(spark, d, "orders"), ["o_custkey"], F.desc("o_totalprice"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


def first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The first three line items of each order, discounted ones first."""
    w = Window.partitionBy("l_orderkey").orderBy(F.desc_nulls_last(F.when(F.col("l_discount") > 0.05, 1)), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    return load(spark, d, "lineitem").withColumn("nth", F.row_number().over(w)).where("nth <= 3").select("l_orderkey", "l_linenumber", "l_partkey", "nth")


def interleaved(spark: SparkSession, d: str) -> DataFrame:
    """Rows of several lists in turn, each list's first rows first (a page of 60)."""
    ranked = load(spark, d, "supplier").withColumn("turn", F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")))
    return ranked.orderBy("turn", "s_nationkey").limit(60).select("turn", "s_nationkey", "s_suppkey")


def score_gap(spark: SparkSession, d: str) -> DataFrame:
    """The gap of each nation's two best suppliers and the verdict."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    told = load(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_acctbal", F.row_number().over(w).alias("nth"), F.lead("s_acctbal").over(w).alias("next"))
    gap = F.col("s_acctbal") - F.col("next")
    verdict = F.when(F.col("next").isNull(), "single").when(F.col("s_acctbal") > 9500, "single").when(gap < 1500, "ambiguous").otherwise("clear_winner")
    return told.where("nth = 1").select("s_nationkey", "s_suppkey", F.round(gap, 2).alias("gap"), verdict.alias("verdict"))


def paged(spark: SparkSession, d: str) -> DataFrame:
    """The second page of 50 distinct lots, urgent ones first."""
    lots = load(spark, d, "orders").where(F.col("o_orderpriority").substr(1, 1).isin("1", "3", "5")).select("o_custkey", (F.col("o_orderpriority") == "1-URGENT").alias("urgent")).distinct()
    return lots.orderBy(F.when(F.col("urgent"), 0).otherwise(1), "o_custkey").offset(50).limit(50)


def preference_sort(spark: SparkSession, d: str) -> DataFrame:
    """Each brand's two best pictures: exterior, neutral, interior; then by width."""
    score = F.when(F.lower("p_name").rlike("red|blue|green"), 2).when(F.lower("p_name").rlike("small|large"), 0).otherwise(1)
    w = Window.partitionBy("p_brand").orderBy(F.desc("score"), F.desc("p_size"), "p_partkey")
    return load(spark, d, "part").where("p_size >= 5").withColumn("score", score).withColumn("nth", F.row_number().over(w)).where("nth <= 2").select("p_brand", "p_partkey", "score", "nth")


def set_operations(spark: SparkSession, d: str) -> DataFrame:
    """Union, difference and intersection of key sets, and a union with prefixed ids."""
    a, b = load(spark, d, "customer").select(F.col("c_nationkey").alias("k")), load(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k"))
    told = [("union", a.union(b).distinct()), ("minus", a.subtract(b)), ("both", a.intersect(b))]
    out = told[0][1].select(F.lit("union").alias("kind"), F.concat(F.lit("union:"), F.col("k").cast("string")).alias("id"))
    for kind, rows in told[1:]:
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), F.concat(F.lit(f"{kind}:"), F.col("k").cast("string")).alias("id")))
    return out


def predicates(spark: SparkSession, d: str) -> DataFrame:
    """Optional ranges, case-blind equality, substrings, prefixes and list predicates."""
    labels = F.array(F.concat_ws(" > ", "p_type", "p_brand"), F.col("p_type"))
    keep = F.col("p_size").between(5, 45) & (F.lower("p_brand") != F.lower(F.lit("BRAND#7"))) & F.contains(F.lower("p_name"), F.lit("r")) & F.col("p_name").ilike("%E%") & F.exists(labels, lambda x: (x == "PROMO") | x.startswith("SMALL >")) & F.col("p_type").isin("PROMO", "SMALL", "LARGE") & (F.col("p_retailprice").isNull() | (F.col("p_retailprice") > 0))
    return load(spark, d, "part").where(keep).select("p_partkey", "p_name")


QUERIES = {f.__name__: f for f in (accuracy_by_building, daily_stats, needing_images, global_stats, vote_tally, method_stats, median_and_max, normalised_fame, modal_value, groups_over, duplicates, dominant, distinct_parsed, counts_over_one, survey_rollup, quality_report, anti_join, exists_flag, scalar_lookup, inner_join, two_source_hydrate, fan_out, faulty_scans, confirm_flags, leaderboard, best_record, first_chunks, interleaved, score_gap, paged, preference_sort, set_operations, predicates)}

ORACLE = {
    "accuracy_by_building": "SELECT l_partkey, count(*) AS total_scans, count(*) FILTER (l_returnflag = 'A') AS correct_matches, round(100.0 * count(*) FILTER (l_returnflag = 'A') / count(*), 2) AS accuracy_percent, round(avg(l_discount), 4) AS avg_confidence, round(avg(l_quantity), 4) AS avg_time FROM lineitem GROUP BY 1",
    "daily_stats": "SELECT ts::DATE::VARCHAR AS day, count(*) AS total, count(DISTINCT user_id) AS users, count(*) FILTER (event_type = 'purchase') AS confirmed, round(avg(value), 2) AS avg_value FROM events GROUP BY 1",
    "needing_images": "SELECT c_custkey, c_mktsegment, c_acctbal, count(o_orderkey) AS image_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL HAVING count(o_orderkey) < 4",
    "global_stats": "SELECT count(*) AS n, count(CASE WHEN value > 50 THEN 1 END) AS large, count(DISTINCT user_id) AS users, min(event_id) AS first_id, max(event_id) AS last_id, count(props) AS with_props FROM events",
    "vote_tally": "SELECT user_id, count(*) FILTER (event_type = 'signup') AS votes_for, count(*) FILTER (event_type = 'error') AS votes_against FROM events GROUP BY 1",
    "method_stats": "SELECT event_type, count(*) AS n, round(100.0 * count(*) FILTER (value > 20) / count(*), 2) AS share, round(avg(value), 3) AS mean FROM events WHERE ts > (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1",
    "median_and_max": "SELECT p_brand, round(quantile_cont(p_retailprice, 0.5), 4) AS median, count(p_retailprice) AS n, max(p_retailprice) AS most FROM part GROUP BY 1",
    "normalised_fame": "SELECT p_partkey, round(p_retailprice / nullif((SELECT max(p_retailprice) FROM part), 0), 6) AS fame FROM part",
    "modal_value": "SELECT o_custkey, o_orderpriority AS modal, n FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1",
    "groups_over": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 20",
    "duplicates": "SELECT p_name, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1",
    "dominant": "SELECT c_nationkey, c_mktsegment, n, 2 * n > total AS majority FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n, sum(count(*)) OVER (PARTITION BY c_nationkey) AS total FROM customer GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) = 1",
    "distinct_parsed": "SELECT DISTINCT trim(split_part(p_name, ' ', 2)) AS style FROM part WHERE trim(split_part(p_name, ' ', 2)) <> '' ORDER BY 1 LIMIT 200",
    "counts_over_one": "SELECT lower(trim(p_brand)) AS maker, count(*) AS works FROM part GROUP BY 1 HAVING count(*) > 1",
    "survey_rollup": "SELECT l_suppkey, round(sum(l_quantity) / sum(l_extendedprice), 8) AS rate FROM lineitem GROUP BY 1 ORDER BY 2, 1 LIMIT 8",
    "quality_report": "SELECT count(*) AS n, count(*) FILTER (c_custkey % 10 IN (0, 1)) AS missing, 0::BIGINT AS polluted, count(*) FILTER (regexp_matches(lower(c_mktsegment), 'build|house')) AS public_space, count(DISTINCT CASE WHEN c_custkey % 10 > 1 THEN c_custkey END) AS keys FROM customer",
    "anti_join": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)",
    "exists_flag": "SELECT p_partkey, EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_returnflag = 'R') AS has_images FROM part",
    "scalar_lookup": "SELECT n_nationkey, min(s_suppkey) AS one, string_agg(s_suppkey::VARCHAR, ',' ORDER BY s_suppkey) AS every FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1",
    "inner_join": "SELECT c_mktsegment, round(sum(r), 2) AS revenue, count(*) AS orders FROM (SELECT o_custkey, sum(l_extendedprice * (1 - l_discount)) AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY o_orderkey, o_custkey) JOIN customer ON c_custkey = o_custkey GROUP BY 1",
    "two_source_hydrate": "SELECT c_custkey AS k, coalesce(s_name, p_name) AS name, CASE WHEN s_name IS NOT NULL THEN 'notable' WHEN p_name IS NOT NULL THEN 'lots' ELSE 'none' END AS source FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey LEFT JOIN part ON p_partkey = c_custkey",
    "fan_out": "SELECT n_nationkey, 'district ' || r_name AS blurb FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)",
    "faulty_scans": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderpriority LIKE '1-%' AND (o_orderstatus = 'O' OR o_totalprice > 400000 IS NOT TRUE)",
    "confirm_flags": "SELECT event_id, a = c AS top1, c IN (a, b, e) AS top3, c NOT IN (a, b, e, g) AS retrieval_failure, c IN (a, b, e) AND a <> c AS ranking_failure, CASE WHEN a = c THEN 10 WHEN c IN (a, b, e) THEN 5 ELSE 2 END AS xp FROM (SELECT event_id, event_id % 7 AS a, event_id * 3 % 7 AS b, event_id * 5 % 7 AS e, event_id * 9 % 7 AS g, user_id % 7 AS c FROM events)",
    "leaderboard": "SELECT user_id, p + v AS total, xp, CASE WHEN v >= 25 THEN 'Database Legend' WHEN v >= 10 THEN 'Master Validator' WHEN p >= 1 THEN 'Pioneer' ELSE 'Explorer' END AS title, row_number() OVER (ORDER BY p + v DESC, xp DESC, user_id)::INT AS place FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') AS p, count(*) FILTER (event_type = 'purchase') AS v, sum(floor(value))::BIGINT AS xp FROM events GROUP BY 1) ORDER BY place LIMIT 100",
    "best_record": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey DESC) = 1",
    "first_chunks": "SELECT l_orderkey, l_linenumber, l_partkey, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY CASE WHEN l_discount > 0.05 THEN 1 END DESC NULLS LAST, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS nth FROM lineitem) WHERE nth <= 3",
    "interleaved": "SELECT turn::INT AS turn, s_nationkey, s_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS turn FROM supplier) ORDER BY turn, s_nationkey LIMIT 60",
    "score_gap": "SELECT s_nationkey, s_suppkey, round(s_acctbal - nxt, 2) AS gap, CASE WHEN nxt IS NULL OR s_acctbal > 9500 THEN 'single' WHEN s_acctbal - nxt < 1500 THEN 'ambiguous' ELSE 'clear_winner' END AS verdict FROM (SELECT *, row_number() OVER w AS nth, lead(s_acctbal) OVER w AS nxt FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey)) WHERE nth = 1",
    "paged": "SELECT * FROM (SELECT DISTINCT o_custkey, o_orderpriority = '1-URGENT' AS urgent FROM orders WHERE left(o_orderpriority, 1) IN ('1', '3', '5')) ORDER BY urgent DESC, o_custkey LIMIT 50 OFFSET 50",
    "preference_sort": "SELECT p_brand, p_partkey, score, nth::INT AS nth FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY score DESC, p_size DESC, p_partkey) AS nth FROM (SELECT *, CASE WHEN regexp_matches(lower(p_name), 'red|blue|green') THEN 2 WHEN regexp_matches(lower(p_name), 'small|large') THEN 0 ELSE 1 END AS score FROM part WHERE p_size >= 5)) WHERE nth <= 2",
    "set_operations": "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) SELECT 'union' AS kind, 'union:' || k AS id FROM (FROM a UNION FROM b) UNION ALL SELECT 'minus', 'minus:' || k FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'both', 'both:' || k FROM (FROM a INTERSECT FROM b)",
    "predicates": "SELECT p_partkey, p_name FROM part WHERE p_size BETWEEN 5 AND 45 AND lower(p_brand) <> 'brand#7' AND lower(p_name) LIKE '%r%' AND p_name ILIKE '%e%' AND (p_type = 'PROMO' OR p_type = 'SMALL') AND p_retailprice > 0",
}
