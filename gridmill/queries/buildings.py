"""Composed texts and small rules about buildings, on their own cases and on parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import profiles as P
from gridmill.queries.base import load
from gridmill.queries.texts import values

FIELDS = ["building_name", "wiki_name", "style", "style_secondary", "building_type", "use_original", "borough_name", "historic_district", "architect", "year_built", "era", "mat_primary", "colloquial", "primary_aesthetic", "secondary_aesthetic", "storytelling"]
BUILDINGS = [
    (dict(building_name="0", wiki_name="The Ansonia", style="Art Deco", building_type="apartment", borough_name="Manhattan", historic_district="Upper West Side", architect="Graves", year_built="1904.0", mat_primary="stone", storytelling="It began."), "The Ansonia, an Art Deco apartment in Manhattan's Upper West Side. designed by Graves. built 1904. built of stone. deco jazz-age streamline apartment residential. It began."),
    (dict(style="Unknown", use_original="church", historic_district="Gowanus", era="Federal", year_built="x", primary_aesthetic="romantic"), "a church in the Gowanus. from the Federal era. place of worship religious sacred. romantic character"),
    (dict(building_name="n/a"), ""),
]
TERMS = [("12 Elm Street", "Gage House", "12 Elm Street|12 Elm Street|Gage House|Gage"), ("", "Dakota", "Dakota"), ("Elm Street", "", "Elm Street")]
HITS = [("a", "flickr.com", "dakota", 0), ("a", "nytimes.com", "The Dakota story", 1), ("a", "x.org", "other", 0), ("b", "y.org", "nothing", 1), ("b", "zillow.com", "sale", 1)]


def building_texts(spark: SparkSession, d: str) -> DataFrame:
    """STR24: the prose of buildings, from whatever is known of them."""
    rows = spark.createDataFrame([(i, *[b.get(f) for f in FIELDS]) for i, (b, _) in enumerate(BUILDINGS)], "id int, " + ", ".join(f"{f} string" for f in FIELDS))
    return rows.select("id", P.building_text({f: F.col(f) for f in FIELDS}).alias("text"))


def lookup_terms(spark: SparkSession, d: str) -> DataFrame:
    """STR40: terms that a building is looked up by."""
    rows = spark.createDataFrame([t[:2] for t in TERMS], "address string, name string")
    return rows.select("address", "name", F.array_join(P.search_terms(F.col("address"), F.col("name")), "|").alias("terms"))


def relevant_results(spark: SparkSession, d: str) -> DataFrame:
    """results that name the subject, or all of a request if none does."""
    rows = spark.createDataFrame([h[:3] for h in HITS], "request string, host string, title string")
    return P.relevant(rows, F.array(F.lit("dakota")), ["flickr.com", "zillow.com"])


def tap_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of taps without a mask, and public places by their names."""
    k = F.col("p_partkey")
    return load(spark, d, "part").select("p_partkey", F.round(P.tap_score(k * 1.5, k % 300 * 1.0), 5).alias("score"), P.public_place(F.when(k % 3 == 0, F.concat("p_name", F.lit(" Plaza"))).otherwise(F.col("p_type")), F.lit("1 Elm")).alias("public"))


def projected(spark: SparkSession, d: str) -> DataFrame:
    """State plane feet to degrees; the origin and a step of a thousand feet north of it."""
    rows = spark.createDataFrame([(0, 984250.0, 0.0), (1, 984250.0, 1000.0)], "id int, x double, y double")
    at = P.state_plane(F.col("x"), F.col("y"))
    return rows.select("id", F.round(at["lng"], 5).alias("lng"), F.round(at["lat"], 4).alias("lat"))


def photo_keys(spark: SparkSession, d: str) -> DataFrame:
    """SRC10, J30: building, angle and pitch from the keys of an object store; other keys are dropped."""
    k = F.col("p_partkey")
    key = F.concat(k.cast("string"), F.lit("/"), (k % 360).cast("string"), F.lit("deg_"), (k % 30 - 15).cast("string"), F.when(k % 7 == 0, F.lit(".png")).otherwise("pitch.jpg"))
    shape = r"^(\d+)/(\d+)deg_(-?\d+)pitch\.jpg$"
    part = lambda i: F.regexp_extract("key", shape, i).cast("int")
    return load(spark, d, "part").select(key.alias("key")).where(F.col("key").rlike(shape)).select(part(1).alias("bin"), part(2).alias("angle"), part(3).alias("pitch"))


KNOWN_STYLES = ["Art Deco", "not determined", "Gothic Revival", "Federal, altered", "", "Neo-Grec", "Late Modern"]
KNOWN_ARCHITECTS = ["Emery Roth & Sons", "Unknown", "Cass Gilbert", None, "I.M. Pei"]
CLASSES = "ABDEKMOQRW"


def material_rules(spark: SparkSession, d: str) -> DataFrame:
    """The material of each part as a building, from style, architect, era and class."""
    k = F.col("p_partkey")
    pick = lambda values, key: F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))
    year = F.when(k % 13 == 0, "c. 1900").otherwise((1790 + k * 7 % 230).cast("string"))
    return load(spark, d, "part").select("p_partkey", P.material(pick(KNOWN_STYLES, k), pick(KNOWN_ARCHITECTS, F.floor(k / 7)), year, pick(list(CLASSES), k)).alias("material"))


def lore_gates(spark: SparkSession, d: str) -> DataFrame:
    """Tier and text of each part's lore, its block's comparison and whether it is due for a new text."""
    k = F.col("p_partkey")
    sources = {"chunks": F.when(k % 4 == 0, F.col("p_name")), "wikipedia": F.when(k % 3 == 0, " ").when(k % 3 == 1, F.col("p_type")), "web": F.when(k % 5 < 2, F.col("p_brand"))}
    told = P.lore(sources, F.concat(F.lit("block of "), "p_type"), k % 4, k % 6, F.when(k % 7 > 0, k % 5))
    return load(spark, d, "part").select("p_partkey", told.alias("l")).select("p_partkey", "l.*")


QUERIES = {f.__name__: f for f in (material_rules, lore_gates, building_texts, lookup_terms, relevant_results, tap_scores, projected, photo_keys)}

def listed(values: list[str | None], key: str) -> str:
    return "([" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + f"])[(({key}) % {len(values)} + 1)::INT]"


def named_sql(text: str, table: list[tuple[str, str]]) -> str:
    whens = " ".join(f"WHEN contains(lower({text}), '{part}') THEN '{value}'" for part, value in table)
    return f"CASE WHEN lower(trim(coalesce({text}, ''))) IN ('not determined', 'nd', 'unknown', '') THEN NULL {whens} END"


ERAS = " ".join(f"WHEN y >= {a} AND y < {b} AND {f'contains({chr(39)}{c}{chr(39)}, c)' if c else 'true'} THEN '{m}'" for a, b, c, m in P.ERA_MATERIALS)
ORACLE = {
    "material_rules": f"""WITH b AS (SELECT p_partkey, {listed(KNOWN_STYLES, 'p_partkey')} AS s, {listed(KNOWN_ARCHITECTS, 'p_partkey // 7')} AS a, {listed(list(CLASSES), 'p_partkey')} AS c, CASE WHEN p_partkey % 13 = 0 THEN 0 ELSE 1790 + p_partkey * 7 % 230 END AS y FROM part)
        SELECT p_partkey, coalesce({named_sql('s', [(k, m) for ks, m in P.STYLE_MATERIALS for k in ks])}, {named_sql('a', P.ARCHITECT_MATERIALS)}, CASE {ERAS} END) AS material FROM b""",
    "lore_gates": """SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'chunks' WHEN p_partkey % 3 = 1 THEN 'wikipedia' WHEN p_partkey % 5 < 2 THEN 'web' ELSE 'fields' END AS tier, CASE WHEN p_partkey % 4 = 0 THEN p_name WHEN p_partkey % 3 = 1 THEN p_type WHEN p_partkey % 5 < 2 THEN p_brand END AS text,
        CASE WHEN p_partkey % 4 >= 2 THEN 'block of ' || p_type END AS comparison, p_partkey % 7 = 0 OR p_partkey % 6 > p_partkey % 5 AS renew FROM part""",
    "photo_keys": "SELECT p_partkey::INT AS bin, (p_partkey % 360)::INT AS angle, (p_partkey % 30 - 15)::INT AS pitch FROM part WHERE p_partkey % 7 <> 0",
    "building_texts": values([(i, t) for i, (_, t) in enumerate(BUILDINGS)], "id, text"),
    "lookup_terms": values(TERMS, "address, name, terms"),
    "relevant_results": values([h[:3] for h in HITS if h[3]], "request, host, title"),
    "tap_scores": "SELECT p_partkey, round(0.6 * least(1.0, log10(greatest(p_partkey * 1.5, 50.0)) / log10(3000.0)) + 0.4 * CASE WHEN d BETWEEN 40 AND 150 THEN 1.0 WHEN d < 40 THEN greatest(0.0, d / 40.0) ELSE greatest(0.0, 1 - (d - 150) / 100.0) END, 5) AS score, regexp_matches(lower(CASE WHEN p_partkey % 3 = 0 THEN p_name || ' plaza' ELSE p_type END), 'park|pier|green|plaza|square|promenade|waterfront|beach|bridge|tunnel|highway|river|island|pool|playground|garden|fence|gate|wall|pavilion|reservoir|tract|lot|vacant|undeveloped') AS public FROM (SELECT *, p_partkey % 300 AS d FROM part)",
    "projected": "SELECT * FROM (VALUES (0::INT, -74.0::DOUBLE, 40.1667::DOUBLE), (1::INT, -74.0::DOUBLE, 40.1694::DOUBLE)) AS t(id, lng, lat)",
}
