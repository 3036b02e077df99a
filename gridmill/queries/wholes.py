"""Texts, web queries, folds and lookups over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import profiles, reports
from gridmill.operators import spatial
from gridmill.queries.base import LAT, LNG, lat, lng, load, spread
from gridmill.queries.buildings import FIELDS

#: What is known of the buildings that parts stand for, by key.
STYLES = ["Art Deco", "Unknown", "Italianate", None, "Gothic"]
TYPES = ["row house", None, "church", "0", "office"]
BOROUGHS = ["Manhattan", None, "Brooklyn"]
DISTRICTS = ["Gowanus", None]
ARCHITECTS = ["Cass Gilbert", "not determined", None, "Emery Roth"]
#: The glosses of these styles and types, in their order.
SAID = {"Art Deco": "deco jazz-age streamline", "Italianate": "brownstone prewar rowhouse walk-up classic New York townhouse", "row house": "brownstone prewar rowhouse walk-up classic New York townhouse", "church": "place of worship religious sacred"}


def pick(values: list[str | None], key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values) + 1).cast("int"))


def building_prose(spark: SparkSession, d: str) -> DataFrame:
    """STR24: the prose of every building, from whatever is known of it."""
    k = F.col("p_partkey")
    known = {
        "building_name": F.when(k % 4 == 0, F.initcap("p_name")).when(k % 4 == 1, F.lit("n/a")), "wiki_name": F.when(k % 3 == 0, F.col("p_brand")), "style": pick(STYLES, k), "building_type": pick(TYPES, F.floor(k / 5)), "borough_name": pick(BOROUGHS, k), "historic_district": pick(DISTRICTS, k),
        "architect": pick(ARCHITECTS, k), "year_built": F.when(k % 6 > 0, F.concat((1800 + k % 200).cast("string"), F.lit(".0"))), "era": F.when(k % 2 == 0, F.lit("Federal")), "mat_primary": F.when(k % 5 > 2, F.lit("brick")), "storytelling": F.when(k % 7 == 0, F.concat(F.lit(" "), "p_type", F.lit(" "))),
    }
    text = profiles.building_text({f: known.get(f, F.lit(None).cast("string")) for f in FIELDS})
    return load(spark, d, "part").select("p_partkey", text.alias("text"))


def building_searches(spark: SparkSession, d: str) -> DataFrame:
    """STR28, STR29: what to ask the web about every building, at most four queries, the most telling first."""
    k = F.col("p_partkey")
    name = F.when(k % 4 == 0, F.initcap("p_name")).when(k % 4 == 1, F.lit("0"))
    addr = F.when(k % 3 > 0, F.concat(k.cast("string"), F.lit(" Market Street")))
    cats = F.when(k % 2 == 0, F.array(F.lit("murals"), F.lit(" arches "), F.lit("murals"), F.lit("")))
    claim = F.when(k % 5 > 1, F.concat(F.lit("Stone, carved in 1901 by "), "p_type", F.lit(" masons!")))
    asked = reports.web_queries(name, addr, pick(ARCHITECTS, k), F.when(k % 7 > 0, 1800 + k % 200), cats, claim)
    return spread(load(spark, d, "part").select("p_partkey", "p_name", "p_type")).select("p_partkey", F.array_join(asked, "|").alias("queries"))


def streets_folded(spark: SparkSession, d: str) -> DataFrame:
    """STR10: damaged names of streets folded onto their frequent twins, within each of the reports."""
    k = F.col("p_partkey")
    damaged = F.when(k % 5 == 0, F.concat(F.substring("p_name", 1, 3), F.expr("substring(p_name, 5)"))).otherwise(F.col("p_name"))
    entries = load(spark, d, "part").select(F.col("p_brand").alias("report"), F.upper(damaged).alias("street"), F.sequence(F.lit(1), (k % 7 + 1).cast("int")).alias("numbers"))
    return reports.canonical_streets(entries)


#: Metres of a lookup and rows that it gives.
NEAR_M, MOST = 900.0, 4


def boxed_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The nearest parts in the box around each supplier, in flat metres; corners beyond the radius stay, as the box alone cuts."""
    own = load(spark, d, "supplier").select("s_suppkey", lat("s_suppkey").alias("lat"), lng("s_suppkey").alias("lng"))
    other = load(spark, d, "part").select("p_partkey", lat("p_partkey").alias("lat2"), lng("p_partkey").alias("lng2"))
    told = spatial.nearest_in_box(own, other, NEAR_M, ("lat", "lng"), ("lat2", "lng2"), "s_suppkey", "p_partkey", MOST)
    return told.select("s_suppkey", "nth", "p_partkey", F.round("flat_m", 1).alias("flat_m"))


def quality_examples(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each fault of the data has, and the first three of them."""
    k = F.col("c_custkey")
    issues = F.array(F.when(k % 10 == 0, "missing"), F.when(k % 10 == 1, "placeholder"), F.when(F.lower("c_mktsegment").rlike("build|house"), "public_space"), F.when(k % 7 == 0, "duplicate"))
    rows = load(spark, d, "customer").select(k, F.explode(F.filter(issues, lambda i: i.isNotNull())).alias("issue"))
    counts = rows.groupBy("issue").agg(F.count(F.lit(1)).alias("n"))
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("issue").orderBy("c_custkey"))).where("nth <= 3")
    shown = first.groupBy("issue").agg(F.array_join(F.transform(F.array_sort(F.collect_list("c_custkey")), lambda c: c.cast("string")), ",").alias("examples"))
    return counts.join(shown, "issue")


QUERIES = {f.__name__: f for f in (building_prose, building_searches, streets_folded, boxed_neighbours, quality_examples)}


def listed(values: list[str | None], key: str) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"]::VARCHAR[])[(({key}) % {len(values)} + 1)::INT]"


K = "p_partkey"
TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
STYLE, KIND, BOROUGH, DISTRICT, ARCHITECT = (f"CASE WHEN lower({x}) IN ('unknown', '0', 'not determined') THEN NULL ELSE {x} END" for x in (listed(STYLES, K), listed(TYPES, f"{K} // 5"), listed(BOROUGHS, K), listed(DISTRICTS, K), listed(ARCHITECTS, K)))
FLAT = f"sqrt(pow(({LAT.format(K)} - {LAT.format('s_suppkey')}) * 111320.0, 2) + pow(({LNG.format(K)} - {LNG.format('s_suppkey')}) * 111320.0 * cos(radians({LAT.format('s_suppkey')})), 2))"

ORACLE = {
    "building_prose": f"""WITH b AS (SELECT p_partkey, coalesce(CASE WHEN {K} % 4 = 0 THEN {TITLE} END, CASE WHEN {K} % 3 = 0 THEN p_brand END) AS name, {STYLE} AS style, {KIND} AS kind, {BOROUGH} AS borough, {DISTRICT} AS district, {ARCHITECT} AS architect,
            CASE WHEN {K} % 6 > 0 THEN 1800 + {K} % 200 END AS y, trim(CASE WHEN {K} % 7 = 0 THEN p_type END) AS story FROM part),
        c AS (SELECT *, nullif(concat_ws(' ', style, kind), '') AS what, CASE WHEN borough IS NOT NULL THEN ' in ' || borough || coalesce('''s ' || district, '') WHEN district IS NOT NULL THEN ' in the ' || district ELSE '' END AS place FROM b)
        SELECT p_partkey, concat_ws('. ', nullif(concat_ws(', ', name, CASE WHEN regexp_matches(lower(what), '^[aeiou]') THEN 'an ' ELSE 'a ' END || what || place), ''), 'designed by ' || architect, CASE WHEN y IS NOT NULL THEN 'built ' || y WHEN {K} % 2 = 0 THEN 'from the Federal era' END,
            CASE WHEN {K} % 5 > 2 THEN 'built of brick' END, nullif(concat_ws(' ', CASE WHEN style = 'Italianate' OR kind = 'row house' THEN '{SAID['row house']}' END, CASE WHEN style = 'Art Deco' THEN '{SAID['Art Deco']}' END, CASE WHEN kind = 'church' THEN '{SAID['church']}' END), ''), story) AS text FROM c""",
    "building_searches": f"""WITH b AS (SELECT p_partkey, CASE WHEN {K} % 4 = 0 THEN {TITLE} WHEN {K} % 4 = 1 THEN '0' ELSE '' END AS name, CASE WHEN {K} % 3 > 0 THEN {K} || ' Market Street' ELSE '' END AS addr, coalesce({ARCHITECT}, '') AS arch, {K} % 7 > 0 AS dated, 1800 + {K} % 200 AS y, {K} % 2 = 0 AS swept,
            CASE WHEN {K} % 5 > 1 THEN array_to_string(list_filter(['stone', 'carved', '1901', lower(p_type), 'masons'], lambda w: length(w) >= 4)[1:6], ' ') ELSE '' END AS terms FROM part),
        s AS (SELECT *, CASE WHEN name NOT IN ('', '0') THEN '"' || name || '"' WHEN addr <> '' THEN '"' || addr || '"' ELSE '' END AS subject FROM b),
        q AS (SELECT *, list_filter([CASE WHEN name NOT IN ('', '0') THEN '"' || name || '" New York building history' END, CASE WHEN subject <> '' AND terms <> '' THEN subject || ' New York ' || terms END,
            CASE WHEN arch <> '' AND (name <> '' OR addr <> '') THEN arch || ' architect "' || CASE WHEN name <> '' THEN name ELSE addr END || '"' END, CASE WHEN addr <> '' AND addr <> name THEN '"' || addr || '" New York City building history' END,
            CASE WHEN subject <> '' AND swept THEN subject || ' New York arches OR murals' END], lambda x: x IS NOT NULL) AS made FROM s)
        SELECT p_partkey, array_to_string(CASE WHEN len(made) = 0 AND dated THEN ['New York City building built ' || y || ' history'] ELSE made END[1:4], '|') AS queries FROM q""",
    "boxed_neighbours": f"""SELECT s_suppkey, row_number() OVER (PARTITION BY s_suppkey ORDER BY round(f, 3), p_partkey)::INT AS nth, p_partkey, round(f, 1) AS flat_m FROM (SELECT s_suppkey, p_partkey, {FLAT} AS f FROM supplier, part
        WHERE abs({LAT.format(K)} - {LAT.format('s_suppkey')}) <= {NEAR_M} / 111320.0 AND abs({LNG.format(K)} - {LNG.format('s_suppkey')}) <= {NEAR_M} / (111320.0 * cos(radians({LAT.format('s_suppkey')})))) QUALIFY nth <= {MOST}""",
    "quality_examples": """WITH i AS (SELECT c_custkey, unnest(list_filter([CASE WHEN c_custkey % 10 = 0 THEN 'missing' END, CASE WHEN c_custkey % 10 = 1 THEN 'placeholder' END, CASE WHEN regexp_matches(lower(c_mktsegment), 'build|house') THEN 'public_space' END, CASE WHEN c_custkey % 7 = 0 THEN 'duplicate' END], lambda x: x IS NOT NULL)) AS issue FROM customer)
        SELECT issue, count(*) AS n, array_to_string(list(c_custkey ORDER BY c_custkey)[1:3], ',') AS examples FROM i GROUP BY issue""",
}
