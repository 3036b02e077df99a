"""Contributions, verification, decay, edit votes, stamps and table maintenance, with events as the ledger."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import community as C
from gridmill.functions import text as T
from gridmill.operators import keyed
from gridmill.queries.base import AS_OF, load


def contributions(spark: SparkSession, d: str) -> DataFrame:
    """B1: tier, points and pioneer mark of each contribution; parts stand in for the forms."""
    k = F.col("p_partkey")
    address = F.when(k % 3 != 0, F.concat(F.lit("1 "), "p_name")).otherwise("x")
    materials = [F.when(k % m == 0, F.lit("brick")) for m in (2, 5, 7)]
    told = C.contribution(address, F.when(k % 4 == 0, F.col("p_brand")), (1700 + k % 400).cast("int"), F.when(k % 6 == 0, F.col("p_type")), F.when(k % 9 == 0, F.concat("p_name", "p_brand")), materials, k % 5 == 0)
    return load(spark, d, "part").select("p_partkey", told.alias("c")).select("p_partkey", F.col("c.type").alias("type"), F.col("c.xp").alias("xp"), F.col("c.fields").alias("fields"), F.col("c.pioneer").alias("pioneer"))


def votes(spark: SparkSession, d: str) -> DataFrame:
    """(contribution, user, kind, ts, event_id): the ledger of verifications; nobody votes for their own."""
    kind = F.when(F.col("event_type").isin("view", "signup", "purchase"), "verified").otherwise("disputed")
    return load(spark, d, "events").select((F.col("event_id") % 211).alias("contribution"), F.col("user_id").alias("user"), kind.alias("kind"), "ts", "event_id").where("contribution % 50 <> user")


def last_votes(spark: SparkSession, d: str) -> DataFrame:
    """Only the last vote of a user on a contribution counts."""
    return keyed.best_per_key(votes(spark, d), ["contribution", "user"], F.desc("ts"), F.desc("event_id"))


def reliability(spark: SparkSession, d: str) -> DataFrame:
    """Tallies, reliability, decay at a given time and status of each contribution."""
    told = last_votes(spark, d).groupBy("contribution").agg(F.count_if(F.col("kind") == "verified").alias("verified"), F.count_if(F.col("kind") == "disputed").alias("disputed"), F.min("ts").alias("created"), F.max(F.when(F.col("kind") == "verified", F.col("ts"))).alias("last"))
    score = C.reliability(F.col("verified"), F.col("disputed"))
    faded = C.decay(F.col("created") - F.expr("INTERVAL 1 DAY") * (F.col("contribution") % 300), F.col("last") - F.expr("INTERVAL 1 DAY") * (F.col("contribution") % 200), F.lit(AS_OF).cast("timestamp"))
    return told.select("contribution", "verified", "disputed", F.round(score, 4).alias("reliability"), F.round(faded, 4).alias("decay"), F.round(score * faded, 4).alias("effective"), C.status(score).alias("status"))


def edit_votes(spark: SparkSession, d: str) -> DataFrame:
    """Edits that enough voters accept."""
    told = votes(spark, d).groupBy("contribution").agg(F.count_if(F.col("kind") == "verified").alias("votes_for"), F.count_if(F.col("kind") == "disputed").alias("votes_against"))
    return told.withColumn("accepted", C.accepted(F.col("votes_for"), F.col("votes_against")))


def milestones(spark: SparkSession, d: str) -> DataFrame:
    """When each user first reached a number of stamps, with title and points."""
    nth = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    counted = load(spark, d, "events").where("event_type = 'purchase'").withColumn("n", nth)
    marks = F.broadcast(spark.createDataFrame(list(C.STAMP_MILESTONES), "n int, title string, xp int"))  # two rows
    return counted.join(marks, "n").select("user_id", "title", "xp", "event_id")


def unique_stamps(spark: SparkSession, d: str) -> DataFrame:
    """B8, SNK3: one stamp for each user, type and scan; stamps without a scan never conflict."""
    scan = F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 50)
    stamps = load(spark, d, "events").select("user_id", F.col("event_type").alias("type"), scan.alias("scan"), "event_id")
    kept = keyed.best_per_key(stamps.where("scan IS NOT NULL"), ["user_id", "type", "scan"], F.asc("event_id")).unionByName(stamps.where("scan IS NULL"))
    return kept.groupBy("user_id", "type").agg(F.count(F.lit(1)).alias("stamps"))


def latest_verifications(spark: SparkSession, d: str) -> DataFrame:
    """The latest five verifications of each user (the limit is the feature)."""
    w = Window.partitionBy("user").orderBy(F.desc("ts"), F.desc("event_id"))
    return votes(spark, d).withColumn("nth", F.row_number().over(w)).where("nth <= 5").select("user", "nth", "event_id", "kind")


def upserted(spark: SparkSession, d: str) -> DataFrame:
    """SNK1: newer rows replace older ones of the same key, as a new state; ``merged_table`` writes it."""
    old = load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    new = old.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), "c_acctbal")
    return keyed.upsert(old, new, ["c_custkey"])


def merged(spark: SparkSession, d: str) -> DataFrame:
    """SNK2, SNK4, SNK5: values of a newer table unless null; a null keeps or takes the other side's."""
    old = load(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 2 == 0, F.col("s_name")).alias("name"), F.when(F.col("s_suppkey") % 4 == 0, F.col("s_acctbal")).alias("height"))
    new = load(spark, d, "supplier").select((F.col("s_suppkey") + 20).alias("s_suppkey"), F.when(F.col("s_suppkey") % 3 == 0, F.lit("renamed")).alias("name"), F.col("s_acctbal").alias("height"))
    first = keyed.merge(old, new, ["s_suppkey"], prefer_new=True, insert=True)
    return keyed.merge(first, new.select("s_suppkey", F.lit("filled").alias("name")), ["s_suppkey"], prefer_new=False, insert=False)


def replaced(spark: SparkSession, d: str) -> DataFrame:
    """SNK6: all rows of the named partitions give way to new ones, as a new state; ``appended_log`` writes it."""
    old = load(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    new = old.where("o_custkey % 11 = 0 AND o_totalprice > 250000").withColumn("o_totalprice", F.lit(0.0))
    return keyed.replace_partitions(old, new, ["o_custkey"]).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def query_log(spark: SparkSession, d: str) -> DataFrame:
    """SNK13, STR37: log rows with ids as JSON, and the latest cached value of each query."""
    rows = load(spark, d, "events").select(F.concat(F.lit("q"), (F.col("event_id") % 97).cast("string")).alias("query"), F.get_json_object("props", "$.k").cast("int").alias("k"), "event_id")
    latest = keyed.best_per_key(rows, ["query"], F.desc("event_id"))
    return latest.select("query", F.to_json(F.struct("event_id", "k")).alias("payload"), "k")


def integrity(spark: SparkSession, d: str) -> DataFrame:
    """SNK12: rules and how many rows break each: unique keys but N/A, no dotted keys, ranges, foreign keys."""
    c = load(spark, d, "customer").withColumn("bin", F.when(F.col("c_custkey") % 7 == 0, "N/A").otherwise(F.concat(F.floor(F.col("c_custkey") / 2).cast("string"), F.when(F.col("c_custkey") % 5 == 0, ".0").otherwise(""))))
    told = [
        ("unique", keyed.violations(c, ["bin"], F.col("bin") == "N/A")),
        ("no_dot", c.where(F.col("bin").contains("."))),
        ("range", c.where(~F.col("c_nationkey").between(1, 23))),
        ("foreign", c.join(load(spark, d, "nation").where("n_nationkey < 20"), F.col("c_nationkey") == F.col("n_nationkey"), "left_anti")),
        ("not_null", c.where(F.col("c_name").isNull())),
    ]
    out = None
    for rule, rows in told:
        one = rows.agg(F.lit(rule).alias("rule"), F.count(F.lit(1)).alias("broken"))
        out = one if out is None else out.unionByName(one)
    return out


def shared_text(spark: SparkSession, d: str) -> DataFrame:
    """J26, X6, STR36: texts by hash, shared by how many documents, and whether that makes them specific."""
    docs = load(spark, d, "documents").select("doc_id", F.md5("text").alias("hash"))
    counts = docs.groupBy("hash").agg(F.count_distinct("doc_id").alias("shared"))
    return docs.join(counts, "hash").select("doc_id", "shared", F.when(F.col("shared") <= 2, "building").otherwise("district").alias("specificity"))


def prefer_known(spark: SparkSession, d: str) -> DataFrame:
    """SRC3, STR13, STR14, STR32, F11: first filled spelling, sentinels, keys and numbers of a text table."""
    k = F.col("c_custkey")
    raw = load(spark, d, "customer").select("c_custkey", F.when(k % 3 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(".0"))).alias("a"), F.when(k % 2 == 0, "  ").otherwise("none").alias("b"), F.format_number("c_acctbal", 2).alias("money"))
    return raw.select("c_custkey", T.first_filled(F.col("a"), F.col("b")).alias("first"), T.known(F.col("b"), "attribution").alias("known"), T.canonical_key(F.col("a")).alias("key"), T.lot_key(F.lit(1), F.col("c_custkey"), F.col("c_custkey") % 100).alias("lot"), F.round(T.number(F.col("money")), 2).alias("money"), T.number(F.lit("12.0"), "int").alias("twelve"))


QUERIES = {f.__name__: f for f in (contributions, last_votes, reliability, edit_votes, milestones, unique_stamps, latest_verifications, upserted, merged, replaced, query_log, integrity, shared_text, prefer_known)}

VOTES = "votes AS (SELECT event_id % 211 AS contribution, user_id AS \"user\", CASE WHEN event_type IN ('view', 'signup', 'purchase') THEN 'verified' ELSE 'disputed' END AS kind, ts, event_id FROM events WHERE event_id % 211 % 50 <> user_id)"
LAST = VOTES + ", lastv AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY contribution, \"user\" ORDER BY ts DESC, event_id DESC) = 1)"

ORACLE = {
    "contributions": """WITH f AS (SELECT p_partkey, p_partkey % 3 AS m3, CASE WHEN p_partkey % 3 <> 0 THEN '1 ' || p_name ELSE 'x' END AS address, 1700 + p_partkey % 400 AS y,
        (p_partkey % 2 = 0)::INT + (p_partkey % 5 = 0)::INT + (p_partkey % 7 = 0)::INT AS made, p_partkey % 5 = 0 AS top3, p_partkey % 4 = 0 AS arch, p_partkey % 6 = 0 AS st, p_partkey % 9 = 0 AS nt, p_name || p_brand AS notes, p_type, p_brand FROM part),
        g AS (SELECT *, (length(address) > 5)::INT + (arch AND length(p_brand) > 2)::INT + (y BETWEEN 1800 AND 2030)::INT + (st AND length(p_type) > 2)::INT + (nt AND length(notes) > 10)::INT + made AS fields FROM f),
        h AS (SELECT *, CASE WHEN fields = 0 THEN 'none' WHEN fields = 1 THEN 'address_only' WHEN fields <= 2 THEN 'partial' ELSE 'full' END AS type FROM g)
        SELECT p_partkey, type, (CASE type WHEN 'none' THEN 0 WHEN 'address_only' THEN 10 WHEN 'partial' THEN 15 ELSE 30 END + 5 * made + CASE WHEN NOT top3 AND type <> 'none' THEN 15 ELSE 0 END)::INT AS xp, fields::INT AS fields, NOT top3 AND type <> 'none' AS pioneer FROM h""",
    "last_votes": f'WITH {LAST} SELECT contribution, "user", kind, ts, event_id FROM lastv',
    "reliability": f"""WITH {LAST}, t AS (SELECT contribution, count(*) FILTER (kind = 'verified') AS verified, count(*) FILTER (kind = 'disputed') AS disputed, min(ts) AS created, max(ts) FILTER (kind = 'verified') AS l FROM lastv GROUP BY 1),
        s AS (SELECT *, CASE WHEN verified + disputed > 0 THEN verified::DOUBLE / (verified + disputed) * least((verified + disputed) / 3.0, 1.0) ELSE 0.0 END AS r,
        floor((epoch(TIMESTAMP '2024-06-01 00:00:00') - floor(epoch(coalesce(l - to_days((contribution % 200)::INT), created - to_days((contribution % 300)::INT))))) / 86400) AS days FROM t),
        u AS (SELECT *, CASE WHEN days < 90 THEN 1.0 ELSE greatest(0.5, 1 - (days - 90) / 365.0 * 0.5) END AS f FROM s)
        SELECT contribution, verified, disputed, round(r, 4) AS reliability, round(f, 4) AS decay, round(r * f, 4) AS effective, CASE WHEN r >= 0.9 THEN 'highly_verified' WHEN r >= 0.7 THEN 'verified' WHEN r >= 0.5 THEN 'partially_verified' ELSE 'unverified' END AS status FROM u""",
    "edit_votes": f"WITH {VOTES} SELECT contribution, count(*) FILTER (kind = 'verified') AS votes_for, count(*) FILTER (kind = 'disputed') AS votes_against, count(*) FILTER (kind = 'verified') >= 3 AND count(*) FILTER (kind = 'verified') >= 2 * count(*) FILTER (kind = 'disputed') AS accepted FROM votes GROUP BY 1",
    "milestones": "SELECT user_id, CASE n WHEN 10 THEN 'master_validator' ELSE 'database_legend' END AS title, CASE n WHEN 10 THEN 50 ELSE 100 END AS xp, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'purchase') WHERE n IN (10, 25)",
    "unique_stamps": "SELECT user_id, event_type AS type, count(DISTINCT CASE WHEN event_id % 4 <> 0 THEN event_id % 50 END) + count(*) FILTER (event_id % 4 = 0) AS stamps FROM events GROUP BY 1, 2",
    "latest_verifications": f'WITH {VOTES} SELECT "user", nth::INT AS nth, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY ts DESC, event_id DESC) AS nth FROM votes) WHERE nth <= 5',
    "upserted": "WITH n AS (SELECT c_custkey * 2 AS c_custkey, 'NEW' AS c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 = 0) SELECT c_custkey, c_mktsegment, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM n) UNION ALL FROM n",
    "merged": "WITH o AS (SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_name END AS name, CASE WHEN s_suppkey % 4 = 0 THEN s_acctbal END AS height FROM supplier), n AS (SELECT s_suppkey + 20 AS s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 'renamed' END AS name, s_acctbal AS height FROM supplier) SELECT s_suppkey, coalesce(n.name, o.name, CASE WHEN n.height IS NOT NULL THEN 'filled' END) AS name, coalesce(n.height, o.height) AS height FROM o FULL JOIN n USING (s_suppkey)",
    "replaced": "WITH n AS (SELECT o_orderkey, o_custkey, 0.0::DOUBLE AS o_totalprice FROM orders WHERE o_custkey % 11 = 0 AND o_totalprice > 250000) SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM n) UNION ALL FROM n) GROUP BY 1",
    "query_log": """SELECT query, '{"event_id":' || event_id || ',"k":' || k || '}' AS payload, k FROM (SELECT 'q' || (event_id % 97) AS query, (props->>'$.k')::INT AS k, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_id % 97 ORDER BY event_id DESC) = 1)""",
    "integrity": """WITH c AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN 'N/A' ELSE (c_custkey // 2)::VARCHAR || CASE WHEN c_custkey % 5 = 0 THEN '.0' ELSE '' END END AS bin FROM customer)
        SELECT 'unique' AS rule, count(*) AS broken FROM (SELECT bin FROM c WHERE bin <> 'N/A' GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'no_dot', count(*) FROM c WHERE bin LIKE '%.%' UNION ALL SELECT 'range', count(*) FROM c WHERE c_nationkey NOT BETWEEN 1 AND 23
        UNION ALL SELECT 'foreign', count(*) FROM c WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey < 20) UNION ALL SELECT 'not_null', count(*) FROM c WHERE c_name IS NULL""",
    "shared_text": "SELECT doc_id, n AS shared, CASE WHEN n <= 2 THEN 'building' ELSE 'district' END AS specificity FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents)",
    "prefer_known": "SELECT c_custkey, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey || '.0' WHEN c_custkey % 2 = 0 THEN NULL ELSE 'none' END AS first, NULL::VARCHAR AS known, CASE WHEN c_custkey % 3 = 0 THEN 'N/A' ELSE c_custkey::VARCHAR END AS key, '1' || lpad(c_custkey::VARCHAR, 5, '0') || lpad((c_custkey % 100)::VARCHAR, 4, '0') AS lot, round(c_acctbal, 2) AS money, 12 AS twelve FROM customer",
}
