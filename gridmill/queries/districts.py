"""Entries of reports in three layouts, made of the parts: one report for each brand, a hundred keys on a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.operators import extract
from gridmill.queries.base import load, spread

STREETS = {0: ("MAPLE STREET", "MAPLE STREET North Side"), 1: ("WALNUT AVENUE", "WALNUT AVENUE South Side (Nos. 1-99)")}
LOT = "Borough of Brooklyn Tax Map Block 45, Lot 7"


def laid_out(spark: SparkSession, d: str, rows: list[tuple[int, int, Column]], suffix: str = "") -> DataFrame:
    """Fragments: a street over each page, and for each part fragments (x, steps below, text)."""
    k = F.col("p_partkey")
    at = lambda x, y, text: F.struct(F.lit(x).alias("x"), y.alias("y"), text.alias("text"))
    part = load(spark, d, "part").select(F.concat("p_brand", F.lit(suffix)).alias("report"), F.floor(k / 100).cast("int").alias("page"), "p_partkey", "p_name", "p_type", "p_brand", "p_size")
    told = part.select("report", "page", F.explode(F.array(*[at(x, (20000 - k % 100 * 150 - below).cast("int"), text) for x, below, text in rows])).alias("f")).select("report", "page", "f.*")
    heads = part.select("report", "page").distinct().select("report", "page", F.lit(75).alias("x"), F.lit(21000).alias("y"), F.when(F.col("page") % 2 == 0, STREETS[0][1]).otherwise(STREETS[1][1]).alias("text"))
    return told.unionByName(heads)


def number() -> Column:
    return (F.col("p_partkey") % 90 + 1).cast("string")


def prose(spark: SparkSession, d: str, suffix: str = "") -> DataFrame:
    said = [
        F.concat(F.lit("No. "), number(), F.lit(". The house of lot "), F.col("p_partkey").cast("string"), F.lit(" in this row has a stoop")), F.concat(F.lit("and a cornice of the "), F.lower("p_type"), F.lit(" kind, and a door that its")),
        F.concat(F.lit("first owner, who dealt in "), F.col("p_name"), F.lit(", had carved. It resembles No. "), (F.col("p_partkey") * 7 % 90 + 1).cast("string")), F.concat(F.lit("in size and style. Rooms: "), F.col("p_size").cast("string"), F.lit(".")),
    ]
    return laid_out(spark, d, [(75, 12 * i, text) for i, text in enumerate(said)], suffix)


def marginal(spark: SparkSession, d: str, suffix: str = "") -> DataFrame:
    rows = [(40, -1, F.concat(F.lit("#"), number(), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("-"), (F.col("p_partkey") % 90 + 5).cast("string"))).otherwise(""))), (100, 0, F.concat(F.col("p_name"), F.lit(" of lot "), F.col("p_partkey").cast("string"))), (100, 12, F.lit("built to last"))]
    return laid_out(spark, d, rows, suffix)


def prose_houses(spark: SparkSession, d: str) -> DataFrame:
    """The houses of reports in running prose, with what is said of them and how surely."""
    told = extract.prose_entries(prose(spark, d)).where("kind = 'building'")
    return told.select("report", "street", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"), "tier", F.length("text").alias("chars"), F.md5("text").alias("hash"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"))


def marginal_houses(spark: SparkSession, d: str) -> DataFrame:
    """The houses of reports with numbers in the margin."""
    told = extract.marginal_entries(marginal(spark, d))
    return told.select("report", "street", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"), F.length("text").alias("chars"), F.md5("text").alias("hash"))


def report_layouts(spark: SparkSession, d: str) -> DataFrame:
    """The layout of each report, of reports of all three kinds."""
    lots = laid_out(spark, d, [(75, 0, F.concat("p_name", F.lit(" house"))), (75, 12, F.lit(LOT))], "/lots")
    return extract.layouts(prose(spark, d, "/prose").unionByName(marginal(spark, d, "/margin")).unionByName(lots))


def attached_entries(spark: SparkSession, d: str) -> DataFrame:
    """The first sure entry of each house, joined to addresses whose streets may be misspelt."""
    k = F.col("p_partkey")
    street = F.when(k % 3 == 0, "Mapel Street").when(k % 3 == 1, "Maple  Street").otherwise("Walnut Ave")
    buildings = load(spark, d, "part").select(k.alias("key"), F.col("p_brand").alias("report"), F.concat_ws(" ", (k % 45 + 1).cast("string"), street).alias("address"))
    # A house's text is hashed once, before it goes to each of its buildings.
    index = extract.entry_index(extract.prose_entries(prose(spark, d))).withColumn("text", F.md5("text"))
    return extract.attach(index, spread(buildings)).select("key", F.col("text").alias("hash"))


QUERIES = {f.__name__: f for f in (prose_houses, marginal_houses, report_layouts, attached_entries)}

ROWS = """rows AS (SELECT p_brand AS report, p_partkey AS k, p_partkey // 100 AS page, CASE WHEN p_partkey // 100 % 2 = 0 THEN 'MAPLE STREET' ELSE 'WALNUT AVENUE' END AS street, p_partkey % 90 + 1 AS n, p_partkey * 7 % 90 + 1 AS m, p_name,
    'No. ' || (p_partkey % 90 + 1) || '. The house of lot ' || p_partkey || ' in this row has a stoop and a cornice of the ' || lower(p_type) || ' kind, and a door that its first owner, who dealt in ' || p_name || ', had carved. It resembles No. ' || (p_partkey * 7 % 90 + 1) || ' in size and style. Rooms: ' || p_size || '.' AS body FROM part)"""
OWN = "own AS (SELECT report, street, n, string_agg(body, ' ' ORDER BY k) AS own FROM rows GROUP BY ALL)"
ORACLE = {
    "prose_houses": f"""WITH {ROWS}, {OWN}, more AS (SELECT DISTINCT report, street, m AS n, 'It resembles No. ' || m || ' in size and style.' AS said FROM rows WHERE m <> n),
        pages AS (SELECT report, street, n, array_to_string(list_sort(list(DISTINCT page)), ',') AS pages FROM (SELECT report, street, n, page FROM rows UNION ALL SELECT report, street, m, page FROM rows WHERE m <> n) GROUP BY ALL),
        t AS (SELECT report, street, n, own, concat_ws(' ', own, said) AS text FROM own FULL JOIN more USING (report, street, n))
        SELECT report, street, n::VARCHAR AS numbers, CASE WHEN own IS NULL THEN 'inline' ELSE 'head' END AS tier, length(text)::INT AS chars, md5(text) AS hash, pages FROM t JOIN pages USING (report, street, n)""",
    "marginal_houses": f"""WITH {ROWS}, t AS (SELECT report, street, CASE WHEN k % 3 = 0 THEN n || ',' || n + 2 || ',' || n + 4 ELSE n::VARCHAR END AS numbers, string_agg(p_name || ' of lot ' || k || ' built to last', ' ' ORDER BY k) AS text FROM rows GROUP BY ALL)
        SELECT report, street, numbers, length(text)::INT AS chars, md5(text) AS hash FROM t""",
    "report_layouts": """WITH p AS (SELECT p_brand, p_partkey // 100 AS page, count(*) AS c FROM part GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY page) - 1 AS i, count(*) OVER (PARTITION BY p_brand) AS n FROM p),
        s AS (SELECT p_brand, count(*) FILTER (i % greatest(n // 40, 1) = 0) AS sampled, sum(c) FILTER (i % greatest(n // 60, 1) = 0) AS cues FROM n GROUP BY 1)
        SELECT p_brand || '/prose' AS report, CASE WHEN cues > 3 THEN 'prose' ELSE 'legacy' END AS layout FROM s UNION ALL SELECT p_brand || '/margin', 'legacy' FROM s UNION ALL SELECT p_brand || '/lots', CASE WHEN sampled >= 2 THEN 'modern' ELSE 'legacy' END FROM s""",
    "attached_entries": f"""WITH {ROWS}, {OWN}, a AS (SELECT p_partkey AS key, p_brand AS report, p_partkey % 45 + 1 AS n, CASE WHEN p_partkey % 3 < 2 THEN 'MAPLE STREET' ELSE 'WALNUT AVENUE' END AS street FROM part)
        SELECT key, md5(own) AS hash FROM a JOIN own USING (report, street, n) WHERE length(own) >= 200""",
}
