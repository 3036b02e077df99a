"""Search queries: legs, fusion, ranking rules and what surrounds the hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import ranking as R
from gridmill.functions import text as T
from gridmill.operators import fusion
from gridmill.plans import search
from gridmill.queries.base import HAVERSINE, LAT, LNG, lat, lng, load
from gridmill.queries.texts import values

QUERY, LIMIT = "smal widgt", 20
AT_LAT, AT_LNG = 40.6, -74.0


def corpus(spark: SparkSession, d: str, name: str, key: str, said: str, fame: str, shift: int = 0) -> DataFrame:
    """(id, name, embedding, fame): a table's rows with the vectors of ``embeddings``, in turn."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    rows, n = load(spark, d, name), vectors.count()
    most = rows.agg(F.max(fame).alias("most"))
    return rows.select(F.col(key).alias("id"), F.col(said).alias("name"), F.col(fame).alias("f"), ((F.col(key) + shift) % n).alias("v")).join(vectors, "v").crossJoin(F.broadcast(most)).select("id", "name", "embedding", (F.col("f") / F.col("most")).alias("fame"))


def query_vector(spark: SparkSession, d: str, vec_id: int = 0) -> DataFrame:
    return load(spark, d, "embeddings").where(F.col("vec_id") == vec_id).select(F.col("embedding").alias("q"))


def search_fused(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over one corpus."""
    found = search.leg(corpus(spark, d, "part", "p_partkey", "p_name", "p_retailprice"), F.lit(QUERY), query_vector(spark, d), LIMIT)
    return found.select("id", F.round("cos", 4).alias("cos"), F.round("lex", 4).alias("lex"), F.round("score", 4).alias("score"))


def whole_corpus(spark: SparkSession, d: str) -> DataFrame:
    """(id, name, embedding, fame): every vector of ``embeddings``, with the parts' names and prices in turn."""
    part = load(spark, d, "part")
    told = part.agg(F.count(F.lit(1)).alias("parts"), F.max("p_retailprice").alias("most"))
    rows = load(spark, d, "embeddings").crossJoin(F.broadcast(told)).withColumn("p_partkey", F.col("vec_id") % F.col("parts"))
    # By the size of its packed file Spark would broadcast a table of parts that is ten times as large in the driver.
    named = rows.join(part.select("p_partkey", "p_name", "p_retailprice").hint("merge"), "p_partkey", "left")
    return named.select(F.col("vec_id").alias("id"), F.coalesce("p_name", F.lit("")).alias("name"), "embedding", (F.col("p_retailprice") / F.col("most")).alias("fame"))


def search_fused_whole(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid search over the whole table of vectors."""
    found = search.leg(whole_corpus(spark, d), F.lit(QUERY), query_vector(spark, d), LIMIT)
    return found.select("id", F.round("cos", 4).alias("cos"), F.round("lex", 4).alias("lex"), F.round("score", 4).alias("score"))


def vector_top(spark: SparkSession, d: str) -> DataFrame:
    """The 50 nearest vectors by cosine, and their dot products."""
    rows = load(spark, d, "embeddings").crossJoin(F.broadcast(query_vector(spark, d)))
    scored = rows.select("vec_id", R.cosine(F.col("embedding"), F.col("q")).alias("cos"), R.profile_similarity(F.col("embedding"), F.col("q")).alias("dot"))
    return fusion.top(scored, 50, F.round("cos", 9), "vec_id").select("vec_id", F.round("cos", 5).alias("cos"), F.round("dot", 5).alias("dot"))


def lexical_matches(spark: SparkSession, d: str) -> DataFrame:
    """Names by word similarity and trigram similarity, with the whole-word guard."""
    names = load(spark, d, "part").select("p_name").distinct()
    return names.select("p_name", F.round(T.word_similarity(F.lit(QUERY), F.col("p_name")), 4).alias("word"), F.round(T.trigram_similarity(F.lit(QUERY), F.col("p_name")), 4).alias("tri"), T.word_guard(F.col("p_name"), "red ring of").alias("guard"))


def legs(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    out = {}
    for name, table, key, shift in (("buildings", "part", "p_partkey", 0), ("venues", "supplier", "s_suppkey", 111), ("layers", "customer", "c_custkey", 222)):
        rows = load(spark, d, table).select(F.col(key).alias("id"), lat(key).alias("lat"), lng(key).alias("lng"), F.when(F.col(key) % 3 == 0, (F.col(key) % 10) / 10.0).alias("fame"))
        rows = rows.withColumn("score", F.round((F.col("id") * 7919 + shift) % 10007 / 10007.0, 9))
        best = fusion.top(rows, 40, F.col("score"), "id")
        out[name] = best.select("id", "score", "fame", search.distance_from(AT_LAT, AT_LNG).alias("dist_m"), F.when(F.col("id") % 2 == 0, (F.col("id") % 5) / 5.0).alias("dot"), (F.col("id") % 4 == 0).alias("novel"))
    return out


def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """Three legs fused, nudged, floored and cut to a page of 30."""
    return search.unified(legs(spark, d), "style", 30)


def recommended(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best buildings for a user's profile of nine values."""
    user = F.array(*[F.lit(x) for x in (11.0, 3.0, 5.0, 20.0, 1.0, 7.0, 9.0, 30.0, 14.0)])
    scored = load(spark, d, "embeddings").select("vec_id", R.recommendation(user, F.slice("embedding", 1, 9), F.when(F.col("vec_id") % 3 > 0, F.col("vec_id") % 100)).alias("score"))
    return fusion.top(scored, 50, F.round("score", 9), "vec_id").select("vec_id", F.round("score", 5).alias("score"))


def page_header(spark: SparkSession, d: str) -> DataFrame:
    """The line above a page of hits."""
    hits = load(spark, d, "part").where("p_size > 40").select(F.lower("p_type").alias("style"), F.when(F.col("p_partkey") % 3 == 0, "lore").otherwise("building").alias("type"), (1850 + F.col("p_partkey") % 150).alias("year"))
    return search.header(hits.withColumn("style", F.when(F.col("year") > 1860, "art deco").otherwise(F.col("style"))))


def page_facets(spark: SparkSession, d: str) -> DataFrame:
    """Facet chips from distinct values."""
    return search.facets(load(spark, d, "part").select(F.lower(F.concat("p_type", F.lit("_style"))).alias("style_family"), "p_brand"), ["style_family", "p_brand"])


def chunk_retrieval(spark: SparkSession, d: str) -> DataFrame:
    """Up to five chunks for each building, by key, else by name, of one specificity."""
    docs = load(spark, d, "documents")
    chunks = docs.select((F.col("doc_id") % 150).alias("bin"), F.concat(F.lit("Building "), (F.col("doc_id") % 170).cast("string")).alias("building_name"), F.col("doc_id").alias("chunk"), F.when(F.col("doc_id") % 4 == 0, "district").otherwise("building").alias("specificity"), (F.col("doc_id") % 7).alias("nth"))
    keys = spark.range(170).select(F.col("id").alias("bin"), F.concat(F.lit("BUILDING "), F.col("id").cast("string")).alias("name"))
    return search.chunks_by_key(chunks, keys, 5)


INTENTS = [
    ("350 Fifth Avenue", "address", None), ("art deco bar", "poi", "bar"), ("demolished theaters", "lore", None), ("1977 blackout", "event", None),
    ("5 best gothic churches", "style", None), ("1 south first", "address", None), ("", "prose", None), ("Chrysler Building", "name", None),
    ("buildings designed by cass gilbert", "architect", None), ("cozy cafes in the village", "poi", "cafe"), ("old theatres", "poi", "theater"),
    ("breweries", "poi", "brewery"), ("a quiet place where i can sit and read for hours", "prose", None), ("the dakota", "name", None), ("35-01 Broadway", "address", None),
]


def intents(spark: SparkSession, d: str) -> DataFrame:
    """The intent and place noun of queries."""
    rows = spark.createDataFrame([(q,) for q, _, _ in INTENTS], "query string")
    kind = R.intent(F.col("query"))
    return rows.select("query", kind.alias("intent"), F.when(kind == "poi", R.poi_noun(F.col("query"))).alias("noun"))


# (rule, query, name, other, noun, labels, expected): what each rule adds to a score.
RULES = [
    ("name", "chrysler building", "Chrysler Building", None, None, None, 0.30), ("name", "chrysler", "Chrysler Building", None, None, None, 0.20), ("name", "woolworth", "Chrysler Building", None, None, None, 0.0),
    ("house", "1 south 1st", "1-9 South 1st Street", None, None, None, 0.30), ("house", "1 south 1st", "1 South Oxford Street", None, None, None, 0.02), ("house", "broome", "1 Broome", None, None, None, 0.0), ("house", "471 broome", "Gunther", "469-475 Broome St", None, None, 0.30),
    ("architect", "cass gilbert", None, "Bradford Gilbert", None, None, 0.0), ("architect", "gilbert buildings", None, "Cass Gilbert", None, None, 0.30),
    ("poi", None, None, "Bar", "bar", "Art Gallery|Bar", 0.0), ("poi", None, None, "Bar", "bar", "Bar|Cocktail Bar", 0.15), ("poi", None, None, "Publisher", "bar", None, -0.06), ("poi", None, None, "Sushi Restaurant", "bar", None, -0.12), ("poi", None, None, "Art Gallery", "gallery", None, 0.15), ("poi", None, None, None, "bar", None, 0.0),
    ("hedged", "deco bar", None, "colonial revival or art deco", None, None, -0.10), ("hedged", "deco bar", None, "art deco/gothic", None, None, 0.0),
    ("decoy", "art deco bars", "Some Deco Gallery", "Gallery", "bar", None, -0.10), ("decoy", "art deco bars", "Deco Bar", "Bar", "bar", None, 0.0),
    ("coverage", "art deco bars", "Some Deco Bar", "art deco", None, None, 0.10), ("coverage", "art deco bars", "Harbour View", None, None, None, -0.25), ("coverage", "old theatres", "Old Theater", None, None, None, 0.10),
    ("venue", "deco bar", None, "Art Deco", None, None, 0.12), ("venue", "deco bar", None, "1931", None, None, 0.06), ("venue", "deco bar", None, "1850", None, None, 0.0),
]


def ranking_rules(spark: SparkSession, d: str) -> DataFrame:
    """Each re-ranking rule on its own cases."""
    rows = spark.createDataFrame([(i, *r[:6]) for i, r in enumerate(RULES)], "id int, rule string, q string, name string, other string, noun string, labels string")
    q, name, other, noun = (F.col(c) for c in ("q", "name", "other", "noun"))
    styles = R.style_tokens(q, noun)
    year = other.try_cast("int")
    told = {
        "name": R.exact_name(q, name), "house": R.house_number(q, name, other), "architect": R.architect_match(q, other), "poi": R.poi_category(other, noun, F.split("labels", r"\|")),
        "hedged": R.hedged_style(styles, other), "decoy": R.style_decoy(q, name, other, noun), "coverage": R.coverage(F.lit("poi"), q, name, other), "venue": R.venue_style(styles, other, year),
    }
    out = F.lit(None).cast("double")
    for rule, value in told.items():
        out = F.when(F.col("rule") == rule, value).otherwise(out)
    return rows.select("id", "rule", F.round(out, 4).alias("added"))


def explanations(spark: SparkSession, d: str) -> DataFrame:
    """The field that matched, the reason shown, and the lexical form of a query."""
    part = load(spark, d, "part")
    field = R.matched_field(F.lit("red economy ring"), F.col("p_name"), F.col("p_type"), F.lit(None).cast("string"), F.col("p_brand"))
    return part.select("p_partkey", field.alias("field"), R.why(field, F.col("p_size"), F.lower("p_type"), F.col("p_brand"), F.col("p_name")).alias("why"), T.lexical_query(F.concat(F.lit("show me the first "), "p_name")).alias("lexical"))


QUERIES = {f.__name__: f for f in (search_fused, search_fused_whole, vector_top, lexical_matches, unified_search, recommended, page_header, page_facets, chunk_retrieval, intents, ranking_rules, explanations)}


def grams(text: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


JACCARD = "(len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))))"
SIMS = f"""names AS (SELECT DISTINCT p_name, {grams('p_name')} AS t, list_distinct({grams(f"'{QUERY}'")}) AS q FROM part),
    sims AS (SELECT p_name, {JACCARD.format('q', 'list_distinct(t)')} AS tri,
      list_max(flatten(list_transform(range(1, len(t) + 1), lambda a: list_transform(range(a, len(t) + 1), lambda b: {JACCARD.format('q', 'list_distinct(t[a:b])')})))) AS word FROM names)"""
DIST = HAVERSINE.format(AT_LAT, AT_LNG, "lat", "lng")


def leg_sql(corpus_: str, nth: int, table: str, key: str, shift: int) -> str:
    return f"""SELECT '{corpus_}' AS corpus, {nth} AS nth, id, row_number() OVER (ORDER BY score DESC, id::VARCHAR) AS rank, CASE WHEN id % 3 = 0 THEN id % 10 / 10.0 END AS fame, {DIST} AS dist, CASE WHEN id % 2 = 0 THEN id % 5 / 5.0 END AS dot, id % 4 = 0 AS novel
        FROM (SELECT {key} AS id, round(({key} * 7919 + {shift}) % 10007 / 10007.0, 9) AS score, {LAT.format(key)} AS lat, {LNG.format(key)} AS lng FROM {table} ORDER BY score DESC, id LIMIT 40)"""


ORACLE = {
    "search_fused": f"""WITH {SIMS}, qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
        r AS (SELECT p_partkey AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], qv.q::DOUBLE[]), 9) AS cos, p_retailprice / (SELECT max(p_retailprice) FROM part) AS fame, word, tri FROM part JOIN embeddings e ON e.vec_id = p_partkey % (SELECT count(*) FROM embeddings) JOIN sims USING (p_name), qv),
        ids AS ((SELECT id FROM r ORDER BY cos DESC, id LIMIT 80) UNION (SELECT id FROM r WHERE word > 0.3 ORDER BY word DESC, id LIMIT 80) UNION (SELECT id FROM r WHERE tri > 0.2 ORDER BY tri DESC, id LIMIT 80) UNION (SELECT id FROM (SELECT * FROM r ORDER BY fame DESC, id LIMIT 1000) ORDER BY cos DESC, id LIMIT 40)),
        s AS (SELECT id, cos, greatest(word, tri) AS lex, 0.7 * cos + 0.3 * greatest(word, tri) + 0.15 * coalesce(fame, 0) AS score FROM r JOIN ids USING (id) ORDER BY round(score, 9) DESC, id LIMIT 20)
        SELECT id, round(cos, 4) AS cos, round(lex, 4) AS lex, round(score, 4) AS score FROM s""",
    "search_fused_whole": f"""WITH {SIMS}, qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
        r AS (SELECT e.vec_id AS id, round(list_cosine_similarity(e.embedding::DOUBLE[], qv.q::DOUBLE[]), 9) AS cos, p_retailprice / (SELECT max(p_retailprice) FROM part) AS fame, coalesce(word, 0) AS word, coalesce(tri, 0) AS tri FROM embeddings e LEFT JOIN part ON p_partkey = e.vec_id % (SELECT count(*) FROM part) LEFT JOIN sims USING (p_name) CROSS JOIN qv),
        ids AS ((SELECT id FROM r ORDER BY cos DESC, id LIMIT 80) UNION (SELECT id FROM r WHERE word > 0.3 ORDER BY word DESC, id LIMIT 80) UNION (SELECT id FROM r WHERE tri > 0.2 ORDER BY tri DESC, id LIMIT 80) UNION (SELECT id FROM (SELECT * FROM r ORDER BY fame DESC, id LIMIT 1000) ORDER BY cos DESC, id LIMIT 40)),
        s AS (SELECT id, cos, greatest(word, tri) AS lex, 0.7 * cos + 0.3 * greatest(word, tri) + 0.15 * coalesce(fame, 0) AS score FROM r JOIN ids USING (id) ORDER BY round(score, 9) DESC, id LIMIT 20)
        SELECT id, round(cos, 4) AS cos, round(lex, 4) AS lex, round(score, 4) AS score FROM s""",
    "vector_top": "SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cos, round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS dot FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id LIMIT 50",
    "lexical_matches": rf"WITH {SIMS} SELECT p_name, round(word, 4) AS word, round(tri, 4) AS tri, regexp_matches(lower(p_name), '\b(red|ring)\b') AS guard FROM sims",
    "unified_search": f"""WITH l AS ({leg_sql('buildings', 0, 'part', 'p_partkey', 0)} UNION ALL {leg_sql('venues', 1, 'supplier', 's_suppkey', 111)} UNION ALL {leg_sql('layers', 2, 'customer', 'c_custkey', 222)}),
        s AS (SELECT corpus, nth, id::VARCHAR AS key, rank, round([1.0, 0.5, 0.4][nth + 1] / (60 + rank) * 60 + coalesce(0.02 * dot, 0) + 0.01 * greatest(0, 1 - dist / 1500.0) + CASE WHEN novel THEN 0.02 ELSE 0 END + 0.02 * exp(-dist / 3000.0) + coalesce(0.12 * fame, 0), 5) AS score FROM l)
        SELECT corpus, key, score FROM s WHERE score >= 0.4 * (SELECT max(score) FROM s) ORDER BY score DESC, nth, rank LIMIT 30""",
    "recommended": "SELECT vec_id, round(s, 5) AS score FROM (SELECT vec_id, 0.6 * list_cosine_similarity(embedding[1:9]::DOUBLE[], [11.0, 3.0, 5.0, 20.0, 1.0, 7.0, 9.0, 30.0, 14.0]::DOUBLE[]) + 0.4 * CASE WHEN vec_id % 3 > 0 THEN vec_id % 100 ELSE 0 END / 100.0 AS s FROM embeddings) ORDER BY round(s, 9) DESC, vec_id LIMIT 50",
    "page_header": "SELECT count(*) || CASE WHEN 2 * count(*) FILTER (y > 1860) > count(*) THEN ' art deco' ELSE '' END || CASE WHEN count(*) FILTER (k % 3 = 0) > count(*) FILTER (k % 3 <> 0) THEN ' lore entries' ELSE ' buildings' END || ', ' || min(y) || '–' || max(y) AS header FROM (SELECT p_partkey AS k, 1850 + p_partkey % 150 AS y FROM part WHERE p_size > 40)",
    "page_facets": "SELECT DISTINCT 'style_family' AS kind, upper(left(p_type, 1)) || lower(substr(p_type, 2)) || ' Style' AS label, lower(p_type) || '_style' AS value FROM part UNION ALL SELECT DISTINCT 'p_brand', p_brand, p_brand FROM part",
    "chunk_retrieval": """WITH c AS (SELECT doc_id % 150 AS bin, doc_id % 170 AS nm, doc_id AS chunk, CASE WHEN doc_id % 4 = 0 THEN 'district' ELSE 'building' END AS sp, doc_id % 7 AS nth FROM documents),
        b AS (SELECT bin, chunk, sp, nth, 0 AS tier FROM c UNION ALL SELECT nm, chunk, sp, nth, 1 FROM c WHERE nm NOT IN (SELECT bin FROM c)),
        f AS (SELECT *, min(sp) OVER (PARTITION BY bin) AS best FROM b)
        SELECT bin, place::INT AS at, chunk, tier FROM (SELECT *, row_number() OVER (PARTITION BY bin ORDER BY nth, chunk) AS place FROM f WHERE sp = best) WHERE place <= 5""".replace(" AS at,", ' AS "at",'),
    "explanations": """WITH m AS (SELECT *, len(list_intersect(['red', 'economy', 'ring'], string_split(lower(p_name), ' '))) AS a, (lower(p_type) = 'economy')::INT AS b FROM part),
        f AS (SELECT *, CASE WHEN greatest(a, b) = 0 THEN 'semantic' WHEN a >= b THEN 'name' ELSE 'style' END AS field FROM m)
        SELECT p_partkey, field, lower(p_type) || ', ' || p_size || ', ' || p_brand || ' · matched: ' || field AS why, '1st ' || lower(p_name) AS lexical FROM f""",
    "intents": values(INTENTS, "query, intent, noun"),
    "ranking_rules": "SELECT id::INT AS id, rule, added::DOUBLE AS added FROM (VALUES " + ", ".join(f"({i}, '{r[0]}', {r[6]})" for i, r in enumerate(RULES)) + ") AS t(id, rule, added)",
}
