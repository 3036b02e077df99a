"""The text and report rules over whole tables: addresses, dates, runs, streets, records and requests from their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import profiles, ranking
from gridmill.functions import reports as P
from gridmill.functions import text as T
from gridmill.queries.base import load, spread
from gridmill.queries.page import words

ORDINAL_WORDS = [*T.ORDINALS[:19], "twentieth", *[f"twenty-{w}" for w in T.ORDINALS[:9]], "thirtieth"]
SIDES = ["", " South Side (Betw. x)", " (North Side)"]
SHORT = {"Ave": "AVENUE", "Pl": "PLACE", "Sq": "SQUARE", "Rd": "ROAD", "St": "ST"}
ENDINGS = ["Building", "House", "Hotel", "Tower", "Company"]
BOROUGHS = ["Manhattan", "Bronx", "Brooklyn", "Queens", "Staten Island"]
STYLE, LOST, FIRE, DRAWN, PLACES = "gothic", "demolished", "fire", "architect", ["bar", "theatres", "galleries", "museum"]


def pick(values: list[str], key: Column | str) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def order_dates(spark: SparkSession, d: str) -> DataFrame:
    """STR31, STR32: dates in five spellings and one that is none, and amounts with thousands separators."""
    k, day = F.col("o_orderkey"), F.col("o_orderdate")
    said = F.when(k % 6 == 5, F.concat(F.lit("spring "), F.year(day).cast("string")))
    for i, form in enumerate(("yyyy-MM-dd", "M/d/yyyy", "M-d-yyyy", "yyyy/M/d", "MMMM d, yyyy")):
        said = said.when(k % 6 == i, F.date_format(day, form))
    rows = load(spark, d, "orders").select("o_orderkey", said.alias("said"), F.format_number("o_totalprice", 2).alias("money"))
    return rows.select("o_orderkey", T.any_date(F.col("said")).cast("string").alias("day"), T.number(F.col("money"), "int").alias("amount"))


def house_runs(spark: SparkSession, d: str) -> DataFrame:
    """STR6, STR11, STR12: single numbers, even and odd ranges, lists and damaged runs, one for each customer."""
    k = F.col("c_custkey")
    low, wide = k % 900 + 1, k % 70
    run = F.when(k % 6 == 0, F.format_string("%d Elm", low)).when(k % 6 == 1, F.format_string("%d-%d Elm", low, low + wide)).when(k % 6 == 2, F.format_string("%d, %d and %d", low, low + 2, low + 40))
    run = run.when(k % 6 == 3, F.format_string("%d~%d-%d", low, low + 4, low + 8)).when(k % 6 == 4, F.format_string("%d to %d", low, low - 1)).otherwise(F.format_string("%d-0%d Road", low % 100 + 1, k % 10))
    return load(spark, d, "customer").select("c_custkey", F.array_join(P.number_run(run).cast("array<string>"), ",").alias("numbers"))


def address_parts(spark: SparkSession, d: str) -> DataFrame:
    """STR3, STR4, STR5: ordinals folded, number and street words of each part's address."""
    k = F.col("p_partkey")
    address = F.concat_ws(" ", F.format_string("%d", k % 300 + 1), pick(["South", "East", "Old"], k), F.initcap(pick(ORDINAL_WORDS, k)), F.lit("Avenue"))
    return load(spark, d, "part").select("p_partkey", T.fold_ordinals(address).alias("folded"), T.house_number(address).alias("number"), F.array_join(F.sort_array(T.street_tokens(address)), ",").alias("street"))


def report_streets(spark: SparkSession, d: str) -> DataFrame:
    """STR7: each part's street as a report spells it, in the address table's spelling."""
    k = F.col("p_partkey")
    raw = F.concat(pick(["West  ", "Old ", ""], k), pick([w.upper() for w in ORDINAL_WORDS], k), F.lit(" Street."), pick(SIDES, k))
    return spread(load(spark, d, "part").select("p_partkey")).select("p_partkey", P.street(raw).alias("street"))


def table_streets(spark: SparkSession, d: str) -> DataFrame:
    """STR8: number and street of short addresses."""
    k = F.col("p_partkey")
    raw = F.concat_ws(" ", F.when(k % 7 != 0, (k % 300 + 1).cast("string")), pick(["E", "W", "So"], k), F.concat((k % 90 + 1).cast("string"), F.lit("th")), pick(list(SHORT), k))
    a = P.address(raw)
    return spread(load(spark, d, "part").select("p_partkey")).select("p_partkey", a["number"].alias("number"), a["street"].alias("street"))


def social_handles(spark: SparkSession, d: str) -> DataFrame:
    """STR26: a handle from each customer's link, mention or plain name."""
    k, name = F.col("c_custkey"), F.replace(F.col("c_name"), F.lit("#"), F.lit("."))
    raw = F.when(k % 4 == 0, F.concat(F.lit("https://www.instagram.com/"), name, F.lit("/?hl=en"))).when(k % 4 == 1, F.concat(F.lit(" @"), name)).when(k % 4 == 2, name).otherwise("@")
    return load(spark, d, "customer").select("c_custkey", P.handle(raw).alias("handle"))


def part_labels(spark: SparkSession, d: str) -> DataFrame:
    """STR25: leaf, labels and domains of each part's paths."""
    labels = F.array(F.concat_ws(" > ", "p_type", "p_brand", F.when(F.col("p_size") > 25, F.col("p_name"))), F.concat_ws(" > ", F.lower("p_type"), "p_name"), F.lit("Goods"))
    return load(spark, d, "part").select("p_partkey", P.category_leaf(labels).alias("leaf"), F.array_join(P.distinct_parts(labels, -1), ",").alias("leaves"), F.array_join(P.distinct_parts(labels, 1), ",").alias("domains"))


def part_terms(spark: SparkSession, d: str) -> DataFrame:
    """STR40: what each part is looked up by, as a building with an address and a name."""
    k = F.col("p_partkey")
    address = F.when(k % 4 != 0, F.concat((k % 90 + 1).cast("string"), F.when(k % 3 == 0, "B").otherwise(""), F.lit("  Elm Street"))).otherwise("Elm Street")
    name = F.when(k % 5 != 0, F.concat_ws(" ", F.initcap("p_name"), pick(ENDINGS, k)))
    return load(spark, d, "part").select("p_partkey", F.array_join(profiles.search_terms(address, name), "|").alias("terms"))


def page_results(spark: SparkSession, d: str) -> DataFrame:
    """pages that name the subject and aren't from a junk host; a request with none keeps all of its pages."""
    rows = load(spark, d, "pages").select((F.col("page_id") % 60).alias("request"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1).alias("host"), F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"), "page_id")
    return profiles.relevant(rows, F.array(F.lit("th"), F.lit("ou")), ["example.net"]).select("request", "page_id")


def surveyed(spark: SparkSession, d: str) -> DataFrame:
    """A point in state plane feet for each customer, in degrees."""
    k = F.col("c_custkey")
    at = degrees_of(980000 + k * 37 % 90000, 130000 + k * 53 % 130000)
    return load(spark, d, "customer").select("c_custkey", F.round(at["lng"], 6).alias("lng"), F.round(at["lat"], 6).alias("lat"))


def degrees_of(x: Column, y: Column) -> Column:
    return profiles.state_plane(x.cast("double"), y.cast("double"))


def lots_of_parts(spark: SparkSession, d: str) -> DataFrame:
    """A report for each brand with a record for each part: address, block and lot, fields that go on, a survey field."""
    k = F.col("p_partkey")
    said = [
        (0, F.concat((k % 90 + 1).cast("string"), F.lit(" Elm Street"))), (1, F.concat(F.lit("Borough of "), pick(BOROUGHS, k), F.lit(" Tax Map Block "), (k % 9000 + 1).cast("string"), F.lit(", Lot "), (k % 90 + 1).cast("string"))),
        (2, F.concat(F.lit("Architect: "), F.initcap("p_name"))), (3, F.lit("and others")), (4, F.concat(F.lit("Windows: "), "p_type")), (5, F.concat(F.lit("Date: "), (1850 + k % 100).cast("string"))),
    ]
    rows = load(spark, d, "part").select(F.col("p_brand").alias("report"), k.alias("page"), F.explode(F.array(*[F.struct(F.lit(i).alias("line"), t.alias("text")) for i, t in said])).alias("l"))
    told = P.lot_records(rows.select("report", F.col("page").cast("int").alias("page"), "l.line", "l.text"))
    return told.select("report", "nth", "page", "address", "bbl", "text")


def search_intents(spark: SparkSession, d: str) -> DataFrame:
    """The intent and place noun of a search from each part's words."""
    k = F.col("p_partkey")
    asked = F.concat_ws(
        " ", F.when(k % 11 == 0, (k % 90 + 1).cast("string")), F.when(k % 5 == 0, F.initcap("p_name")).otherwise(F.col("p_name")), F.when(k % 7 == 0, STYLE), F.when(k % 13 == 0, LOST),
        F.when(k % 17 == 0, FIRE), F.when(k % 19 == 0, DRAWN), F.when(k % 6 == 0, pick(PLACES, F.floor(k / 6))), F.when(k % 4 == 0, "that someone told me about last week"),
    )
    kind = ranking.intent(F.col("asked"))
    return load(spark, d, "part").select("p_partkey", asked.alias("asked")).select("p_partkey", kind.alias("intent"), F.when(kind == "poi", ranking.poi_noun(F.col("asked"))).alias("noun"))


QUERIES = {f.__name__: f for f in (order_dates, house_runs, address_parts, report_streets, table_streets, social_handles, part_labels, part_terms, page_results, surveyed, lots_of_parts, search_intents)}


def at(values: list[str], key: str) -> str:
    return f"({words(values)})[(({key}) % {len(values)} + 1)::INT]"


def run_of(low: str, high: str) -> str:
    return f"CASE WHEN {high} <= {low} OR {high} - {low} > 60 THEN [{low}] WHEN ({high} - {low}) % 2 = 0 THEN range({low}, {high} + 1, 2) ELSE [{low}, {high}] END"


def projection_sql(x: str, y: str) -> str:
    """Longitude and latitude of state plane feet; the cone's constants in SQL, latitude by five rounds."""
    e = f"sqrt({profiles_constant('ECCENTRICITY2')})"
    t = lambda p: f"(tan(pi() / 4 - ({p}) / 2) / pow((1 - {e} * sin({p})) / (1 + {e} * sin({p})), {e} / 2))"
    m = lambda p: f"(cos({p}) / sqrt(1 - {profiles_constant('ECCENTRICITY2')} * pow(sin({p}), 2)))"
    a, foot = profiles_constant("SEMI_MAJOR_M"), profiles_constant("FOOT_M")
    p1, p2 = profiles_constant("PARALLELS")
    steps, last = "", "l0"
    for i in range(5):
        steps += f", r{i + 1} AS (SELECT *, pi() / 2 - 2 * atan(h * pow((1 - {e} * sin({last})) / (1 + {e} * sin({last})), {e} / 2)) AS l{i + 1} FROM r{i})"
        last = f"l{i + 1}"
    return f"""WITH c AS (SELECT ln({m(f'radians({p1})')} / {m(f'radians({p2})')}) / ln({t(f'radians({p1})')} / {t(f'radians({p2})')}) AS n),
        f AS (SELECT n, {m(f'radians({p1})')} / (n * pow({t(f'radians({p1})')}, n)) AS f FROM c),
        g AS (SELECT n, f, {a} * f * pow({t(f"radians({profiles_constant('ORIGIN_LAT')})")}, n) AS r FROM f),
        q AS (SELECT c_custkey, n, f, {x}::DOUBLE * {foot} - {profiles_constant('FALSE_EASTING_M')}::DOUBLE AS x, r - {y}::DOUBLE * {foot} AS y FROM customer, g),
        h AS (SELECT *, pow(sqrt(x * x + y * y) / ({a} * f), 1 / n) AS h FROM q),
        r0 AS (SELECT *, pi() / 2 - 2 * atan(h) AS l0 FROM h){steps}
        SELECT c_custkey, round(degrees(atan2(x, y)) / n + {profiles_constant('ORIGIN_LNG')}, 6) AS lng, round(degrees({last}), 6) AS lat FROM r5"""


def profiles_constant(name: str):
    return getattr(profiles, name)


FOLDED = "['1st', '2nd', '3rd', '4th', '5th', '6th', '7th', '8th', '9th', '10th', '11th', '12th', '13th', '14th', '15th', '16th', '17th', '18th', '19th', '20th', '21st', '22nd', '23rd', '24th', '25th', '26th', '27th', '28th', '29th', '30th']"
TOLD = "list_filter(regexp_split_to_array(lower(q), '[^\\p{L}\\p{N}_''-]+'), lambda x: x <> '')"
ANY = lambda v: f"len(list_intersect({TOLD}, {words(v)})) > 0"

ORACLE = {
    "order_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 6 <> 5 THEN o_orderdate::DATE::VARCHAR END AS day, trunc(round(o_totalprice, 2))::INT AS amount FROM orders",
    "house_runs": f"""WITH r AS (SELECT c_custkey, c_custkey % 6 AS m, c_custkey % 900 + 1 AS low, c_custkey % 70 AS w FROM customer),
        n AS (SELECT c_custkey, CASE m WHEN 0 THEN [low] WHEN 1 THEN {run_of('low', 'low + w')} WHEN 2 THEN [low, low + 2, low + 40] WHEN 3 THEN [] WHEN 4 THEN [low] ELSE [low % 100 + 1] END AS l FROM r)
        SELECT c_custkey, array_to_string(list_sort(list_distinct(l)), ',') AS numbers FROM n""",
    "address_parts": f"""SELECT p_partkey, (p_partkey % 300 + 1) || ' ' || lower({at(['South', 'East', 'Old'], 'p_partkey')}) || ' ' || ({FOLDED})[(p_partkey % 30 + 1)::INT] || ' avenue' AS folded, (p_partkey % 300 + 1)::INT AS number,
        array_to_string(list_sort(list_filter([lower({at(['South', 'East', 'Old'], 'p_partkey')}), ({FOLDED})[(p_partkey % 30 + 1)::INT], 'avenue'], lambda w: NOT list_contains({words(sorted(T.STREET_TYPES))}, w))), ',') AS street FROM part""",
    "report_streets": f"SELECT p_partkey, {at(['WEST ', 'OLD ', ''], 'p_partkey')} || (p_partkey % 30 + 1) || ' STREET' AS street FROM part",
    "table_streets": f"SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_partkey % 300 + 1 END::INT AS number, CASE WHEN p_partkey % 7 <> 0 THEN {at(['EAST', 'WEST', 'SOUTH'], 'p_partkey')} || ' ' || (p_partkey % 90 + 1) || ' ' || {at(list(SHORT.values()), 'p_partkey')} END AS street FROM part",
    "social_handles": "SELECT c_custkey, CASE WHEN c_custkey % 4 < 3 THEN replace(c_name, '#', '.') END AS handle FROM customer",
    "part_labels": """WITH l AS (SELECT p_partkey, lower(p_type) AS low, p_type, p_name, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS one, CASE WHEN p_size > 25 THEN p_name ELSE greatest(p_type || ' > ' || p_brand, lower(p_type) || ' > ' || p_name) END AS top FROM part)
        SELECT p_partkey, regexp_extract(top, '([^>]+)$', 1).trim() AS leaf, CASE WHEN lower(one) = lower(p_name) THEN one ELSE one || ',' || p_name END || ',Goods' AS leaves, p_type || ',Goods' AS domains FROM l""",
    "part_terms": f"""WITH b AS (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN (p_partkey % 90 + 1) || CASE WHEN p_partkey % 3 = 0 THEN 'B' ELSE '' END END AS no, CASE WHEN p_partkey % 5 <> 0 THEN upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] END AS name, {at(ENDINGS, 'p_partkey')} AS ending FROM part)
        SELECT p_partkey, concat_ws('|', CASE WHEN no IS NULL THEN 'Elm Street' ELSE no || '  Elm Street' END, no || ' Elm Street', name || ' ' || ending, CASE WHEN ending <> 'Tower' THEN name END) AS terms FROM b""",
    "page_results": """WITH r AS (SELECT page_id % 60 AS request, page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages),
        g AS (SELECT *, NOT contains(host, 'example.net') AND (contains(lower(title || ' ' || host), 'th') OR contains(lower(title || ' ' || host), 'ou')) AS good FROM r)
        SELECT request, page_id FROM (SELECT *, bool_or(good) OVER (PARTITION BY request) AS found FROM g) WHERE good OR NOT found""",
    "surveyed": projection_sql("(980000 + c_custkey * 37 % 90000)", "(130000 + c_custkey * 53 % 130000)"),
    "lots_of_parts": f"""SELECT p_brand AS report, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS nth, p_partkey::INT AS page, (p_partkey % 90 + 1) || ' Elm Street' AS address, (p_partkey % 5 + 1) || lpad((p_partkey % 9000 + 1)::VARCHAR, 5, '0') || lpad((p_partkey % 90 + 1)::VARCHAR, 4, '0') AS bbl,
        'Architect: ' || upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] || ' and others Date: ' || (1850 + p_partkey % 100)
        || coalesce(' ' || (lead(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_partkey) % 90 + 1) || ' Elm Street', '') AS text FROM part""",
    "search_intents": f"""WITH a AS (SELECT p_partkey, concat_ws(' ', CASE WHEN p_partkey % 11 = 0 THEN (p_partkey % 90 + 1)::VARCHAR END, CASE WHEN p_partkey % 5 = 0 THEN upper(p_name[1]) || split_part(p_name, ' ', 1)[2:] || ' ' || upper(split_part(p_name, ' ', 2)[1]) || split_part(p_name, ' ', 2)[2:] ELSE p_name END,
          CASE WHEN p_partkey % 7 = 0 THEN '{STYLE}' END, CASE WHEN p_partkey % 13 = 0 THEN '{LOST}' END, CASE WHEN p_partkey % 17 = 0 THEN '{FIRE}' END, CASE WHEN p_partkey % 19 = 0 THEN '{DRAWN}' END, CASE WHEN p_partkey % 6 = 0 THEN {at(PLACES, 'p_partkey // 6')} END, CASE WHEN p_partkey % 4 = 0 THEN 'that someone told me about last week' END) AS q FROM part),
        b AS (SELECT p_partkey, q, len(string_split(q, ' ')) AS n, len(regexp_extract_all(q, '(^| )[A-Z]')) AS caps FROM a),
        c AS (SELECT p_partkey, q, CASE WHEN {ANY(ranking.EVENTS)} THEN 'event' WHEN {ANY(ranking.LORE)} THEN 'lore' WHEN {ANY(ranking.ARCHITECT_MARKERS)} THEN 'architect' WHEN {ANY(ranking.POI_NOUNS)} THEN 'poi' WHEN {ANY(ranking.STYLES)} THEN 'style'
          WHEN regexp_matches(q, '^[0-9]+ [A-Za-z]+( [A-Za-z]+){{0,2}}$') THEN 'address' WHEN n <= 6 THEN 'name' ELSE 'prose' END AS intent FROM b)
        SELECT p_partkey, intent, CASE WHEN intent = 'poi' THEN CASE WHEN contains(q, 'theatres') THEN 'theater' WHEN contains(q, 'galleries') THEN 'gallery' WHEN contains(q, 'museum') THEN 'museum' ELSE 'bar' END END AS noun FROM c""",
}
