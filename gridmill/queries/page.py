"""The page of unified search: whole legs over three tables, all ranking terms, collapse, floor and limit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import ranking as R
from gridmill.operators import postings
from gridmill.plans import pages
from gridmill.queries.base import HAVERSINE, lat, lng, load
from gridmill.sources import index_store
from gridmill.sources.tables import stored

#: Searches, one of each kind of intent: a place, a name, an address, an architect, a style, a lost place.
SEARCHES = {"art deco bar": "poi", "Red Widget": "name", "12 red widget": "address", "gilbert architect": "architect", "gothic towers": "style", "demolished theaters": "lore"}
LEG_ROWS, PAGE_ROWS, AT, RADIUS = 20, 30, (40.7, -74.0), 25_000.0

# What the rows of the tables are called and where they stand, by key.
STYLES = ["art deco", "gothic revival or art deco", "beaux-arts", None, "gothic", "colonial revival / georgian", "moderne"]
CATEGORIES = ["Bar", "Art Gallery", "Cocktail Bar", "Sushi Restaurant", "Publisher", None]
LABELS = ["Bar", "Bar|Art Gallery", "Cocktail Bar|Bar", None]
ARCHITECTS = ["Cass Gilbert", "Bradford Gilbert and Sons", "Emery Roth", None]
VENUES = ["Deco Bar", "High Style Deco", "Red Widget", "Gothic Hall", "Velvet Room", "Art Bar"]
LAYERS = ["Red Widget mural", "Gilbert plaque", "Demolished theater", "Gothic towers", "Lost theatre sign"]
SNIPPETS = ["near the demolished wall", "a bar in two towers", "once a theatre", None]
LEGS = {"buildings": ("part", "p_partkey", 0), "venues": ("supplier", "s_suppkey", 3), "layers": ("customer", "c_custkey", 5)}


def pick(values: list[str | None], key: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (key % len(values) + 1).cast("int"))


def corpus(spark: SparkSession, d: str, name: str, vectors: DataFrame, n: int) -> DataFrame:
    """One leg's rows, whole table, with vectors in turn."""
    source, id_, shift = LEGS[name]
    k = F.col(id_)
    said = {
        "buildings": lambda: F.when(k % 3 == 0, F.concat(F.format_string("%d-%d ", 2 * (k % 9), 2 * (k % 9) + 4), "p_name")).otherwise(F.col("p_name")),
        "venues": lambda: pick(VENUES, k), "layers": lambda: pick(LAYERS, k),
    }[name]()
    rows = load(spark, d, source).select(
        k.alias("id"), said.alias("name"), pick(STYLES, k + shift).alias("style"), pick(CATEGORIES, k + shift).alias("category"), F.split(pick(LABELS, k), r"\|").alias("labels"),
        pick(ARCHITECTS, k + shift).alias("architect"), pick(SNIPPETS, k + shift).alias("snippet"), (1830 + k * 7 % 190).cast("int").alias("year"), lat(id_).alias("lat"), lng(id_).alias("lng"),
        F.when(k % 3 == 0, (k % 10) / 10.0).alias("fame"), F.when(k % 2 == 0, (k % 5) / 5.0).alias("dot"), (k % 4 == 0).alias("novel"), ((k + shift) % n).alias("v"),
    )
    return rows.join(vectors, "v").drop("v")


def unified_page(spark: SparkSession, d: str) -> DataFrame:
    """The pages of all searches in one run, with every term of the score."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("v"), "embedding")
    n, vector = vectors.count(), vectors.where("v = 1").select(F.col("embedding").alias("q"))
    said = spark.createDataFrame([(q,) for q in SEARCHES], "query string").join(F.broadcast(vector))
    asked = stored(pages.understood(said.select(F.col("query").alias("query_id"), "query", "q", *(F.lit(x).alias(c) for x, c in zip((*AT, RADIUS), ("lat", "lng", "metres"))))), "asked")
    sources = {name: corpus(spark, d, name, vectors, n) for name in LEGS}
    rows = {name: stored(source, "corpus") for name, source in sources.items()}
    names = reduce(DataFrame.unionByName, [r.select("name") for r in rows.values()])
    index = index_store.opened("page", list(sources.values()), f"{postings.BUCKETS} {VENUES} {LAYERS}", lambda path: postings.build(names, path))
    like = pages.likenesses(postings.Postings(spark, index), asked)
    found = {name: pages.legs(r, like, asked, LEG_ROWS, name == "buildings") for name, r in rows.items()}
    return pages.pages(found, asked, PAGE_ROWS).withColumnRenamed("query_id", "query")


QUERIES = {"unified_page": unified_page}


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value + "'"


def pick_sql(values: list[str | None], key: str) -> str:
    return f"([{', '.join(map(text, values))}])[(({key}) % {len(values)} + 1)::INT]"


def words(values: list[str]) -> str:
    return "[" + ", ".join(map(text, values)) + "]::VARCHAR[]"


def toks(value: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({value}, '')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_''-]+'), lambda x: x <> '')"


def hit(category: str, family: list[str]) -> str:
    single, phrases = [k for k in family if " " not in k], [k for k in family if " " in k]
    found = f"len(list_intersect(regexp_split_to_array(lower(coalesce({category}, '')), '[^\\w]+'), {words(single)})) > 0"
    return "(" + " OR ".join([found] + [f"contains(lower(coalesce({category}, '')), '{p}')" for p in phrases]) + ")"


def grams(value: str) -> str:
    return rf"flatten(list_transform(regexp_extract_all(lower({value}), '[\p{{L}}\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3))))"


SHARE = "(len(list_intersect({0}, {1}))::DOUBLE / len(list_distinct(list_concat({0}, {1}))))"
FAR = HAVERSINE.format(*AT, "lat", "lng")


def leg_sql(name: str, asked: str, intent: str) -> str:
    source, k, shift = LEGS[name]
    said = {"buildings": f"CASE WHEN {k} % 3 = 0 THEN (2 * ({k} % 9)) || '-' || (2 * ({k} % 9) + 4) || ' ' || p_name ELSE p_name END", "venues": pick_sql(VENUES, k), "layers": pick_sql(LAYERS, k)}[name]
    s, fame = f"{k} + {shift}", 0.15 if name == "buildings" and intent in R.FAME_INTENTS else 0.0
    cut = f"WHERE {FAR} <= {RADIUS}" if intent in R.HARD_RADIUS else ""
    return f"""{name}_rows AS (SELECT *, {FAR} AS dist_m FROM (SELECT {k} AS id, {said} AS name, {pick_sql(STYLES, s)} AS style, {pick_sql(CATEGORIES, s)} AS category, string_split({pick_sql(LABELS, k)}, '|') AS labels,
        {pick_sql(ARCHITECTS, s)} AS architect, {pick_sql(SNIPPETS, s)} AS snippet, 1830 + {k} * 7 % 190 AS year, 40.5 + ({k} % 997) / 2000.0 AS lat, -74.2 + ({k} % 1009) / 2000.0 AS lng,
        CASE WHEN {k} % 3 = 0 THEN ({k} % 10) / 10.0 END AS fame, CASE WHEN {k} % 2 = 0 THEN ({k} % 5) / 5.0 END AS dot, {k} % 4 = 0 AS novel, ({s}) % (SELECT count(*) FROM embeddings) AS v FROM {source}) {cut}),
    {name}_sims AS (SELECT name, {SHARE.format('q', 'list_distinct(t)')} AS tri, coalesce(list_max(flatten(list_transform(range(1, len(t) + 1), lambda a: list_transform(range(a, len(t) + 1), lambda b: {SHARE.format('q', 'list_distinct(t[a:b])')})))), 0) AS word
        FROM (SELECT DISTINCT name, {grams('name')} AS t, list_distinct({grams(text(asked))}) AS q FROM {name}_rows)),
    {name}_all AS (SELECT r.*, round(list_cosine_similarity(e.embedding::DOUBLE[], (SELECT embedding FROM embeddings WHERE vec_id = 1)::DOUBLE[]), 9) AS cos, word, tri FROM {name}_rows r JOIN embeddings e ON e.vec_id = r.v JOIN {name}_sims USING (name)),
    {name}_ids AS ((SELECT id FROM {name}_all ORDER BY cos DESC, id LIMIT 80) UNION (SELECT id FROM {name}_all WHERE word > 0.3 ORDER BY word DESC, id LIMIT 80) UNION (SELECT id FROM {name}_all WHERE tri > 0.2 ORDER BY tri DESC, id LIMIT 80)
        UNION (SELECT id FROM (SELECT * FROM {name}_all ORDER BY fame DESC NULLS LAST, id LIMIT 1000) ORDER BY cos DESC, id LIMIT 40)),
    {name}_leg AS (SELECT *, 0.7 * cos + 0.3 * greatest(word, tri) + {fame} * coalesce(fame, 0) AS score FROM {name}_all JOIN {name}_ids USING (id) ORDER BY round(score, 9) DESC, id LIMIT {LEG_ROWS})"""


def page_sql(asked: str, intent: str) -> str:
    said = asked.lower().split()
    content = [w for w in dict.fromkeys(said) if len(w) >= 3]
    noun = "bar" if intent == "poi" else None
    styles = [w for w in said if w in R.STYLES and w != noun]
    family, bar = R.FAMILIES["bar"], hit("category", R.FAMILIES["bar"])
    others = [f for f in R.FAMILIES.values() if f != family]
    apart = " OR ".join(hit("x", f) for f in others if not set(f) & set(family))
    eras = " OR ".join(f"year BETWEEN {R.ERAS[t][0]} AND {R.ERAS[t][1]}" for t in styles if t in R.ERAS) or "false"
    poi = f"""round(CASE WHEN coalesce(category, '') = '' THEN 0 WHEN {bar} THEN CASE WHEN len(list_filter(coalesce(labels, []), lambda x: {apart})) > 0 THEN 0 ELSE 0.15 END
            WHEN lower(trim(category)) IN ({', '.join(map(text, R.UNRELATED))}) OR {' OR '.join(hit('category', f) for f in others)} THEN -0.12 ELSE -0.06 END
        + CASE WHEN len(list_intersect({words(styles)}, {toks('style')})) > 0 THEN 0.12 WHEN {eras} THEN 0.06 ELSE 0 END
        + CASE WHEN NOT {bar} AND len(list_intersect({words(content)}, {toks('name')})) > 0 AND len(list_filter(list_intersect({words(content)}, {toks('name')}), lambda t: NOT list_contains({words(R.STYLES)}, t))) = 0 THEN -0.10 ELSE 0 END, 9)""" if noun else "0.0"
    legs = " UNION ALL ".join(f"SELECT '{name}' AS corpus, {i} AS nth, {R.WEIGHTS[intent][i]} AS weight, * EXCLUDE (score), {poi if name == 'venues' else '0.0'} AS poi, round(score + {poi if name == 'venues' else '0.0'}, 9) AS score FROM {name}_leg" for i, name in enumerate(LEGS))
    plain = lambda v: f"regexp_replace(regexp_replace(lower(trim(coalesce({v}, ''))), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', '', 'g'), '\\s+', ' ', 'g')"
    terms = [f"weight / (60 + rank) * 60 + coalesce(0.02 * dot, 0) + 0.01 * greatest(0, 1 - dist_m / 1500.0) + CASE WHEN novel THEN 0.02 ELSE 0 END + poi"]
    if intent not in R.HARD_RADIUS:
        terms.append("0.02 * exp(-dist_m / 3000.0)")
    if intent in R.FAME_INTENTS:
        terms.append("coalesce(0.12 * fame, 0)")
    if intent == "name":
        terms.append(f"CASE WHEN {plain('name')} = '{asked.lower()}' THEN 0.30 WHEN len(list_filter({words(content)}, lambda t: NOT list_contains({toks('name')}, t))) = 0 THEN 0.20 ELSE 0 END")
    if intent == "architect":
        asked_for = [w for w in content if w not in R.ARCHITECT_NOISE]
        terms.append(f"CASE WHEN len(list_filter({words(asked_for)}, lambda t: NOT list_contains({toks('architect')}, t))) = 0 THEN 0.30 ELSE 0 END")
    if intent == "address":
        number, street = said[0], said[1:]
        terms.append(f"""CASE WHEN corpus = 'buildings' AND regexp_matches(name, '^\\d') AND {number} BETWEEN regexp_extract(name, '^(\\d+)', 1)::INT AND regexp_extract(name, '^\\d+-(\\d+)', 1)::INT
            THEN CASE WHEN len(list_filter({words(street)}, lambda t: NOT list_contains({toks('name')}, t))) = 0 THEN 0.30 ELSE 0.02 END ELSE 0 END""")
    if intent in R.COVERAGE_INTENTS and len(content) >= 2:
        terms.append(f"CASE WHEN share >= 1 THEN 0.10 ELSE -least(0.25, 0.5 * (1 - share)) END")
    if styles:
        terms.append(f"CASE WHEN len(parts) > 1 AND len(list_intersect({words(styles)}, {toks('parts[1]')})) = 0 AND len(list_intersect({words(styles)}, {toks(chr(39).join(['array_to_string(parts[2:], ', ' ', ')']))})) > 0 THEN -0.10 ELSE 0 END")
    overlap = lambda v: f"len(list_intersect({words(content)}, list_filter({toks(v)}, lambda t: length(t) >= 3)))"
    other = "CASE WHEN category IS DISTINCT FROM style AND category IS DISTINCT FROM year::VARCHAR THEN category END"
    return f"""SELECT '{asked}' AS query, corpus, key, name, score, why FROM (WITH {', '.join(leg_sql(n, asked, intent) for n in LEGS)},
    l AS ({legs}), r AS (SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY score DESC, id::VARCHAR) AS rank,
        list_distinct(flatten([list_transform(f, lambda t: t), list_transform(f, lambda t: t || 's'), list_transform(f, lambda t: regexp_replace(t, 's$', ''))])) AS folded,
        list_filter(list_transform(regexp_split_to_array(coalesce(style, ''), '(?i)\\s+or\\s+|\\s*/\\s*|\\s*;\\s*|\\s*,\\s*'), lambda x: trim(x)), lambda x: x <> '') AS parts
        FROM (SELECT *, list_distinct(list_concat(w, list_transform(w, lambda t: CASE WHEN t LIKE '%re' THEN regexp_replace(t, 're$', 'er') WHEN t LIKE '%er' THEN regexp_replace(t, 'er$', 're') ELSE t END))) AS f
              FROM (SELECT *, {toks("concat_ws(' ', name, snippet, category, style)")} AS w FROM l))),
    c AS (SELECT *, len(list_filter({words(content)}, lambda t: list_contains(folded, t) OR list_contains(folded, regexp_replace(t, 's+$', ''))))::DOUBLE / {len(content)} AS share, {overlap('name')} AS m1, {overlap('architect')} AS m2, {overlap('style')} AS m3, {overlap('category')} AS m4 FROM r),
    s AS (SELECT *, round({' + '.join(terms)}, 5) AS total, {plain('name')} AS norm,
        concat_ws(' · ', coalesce(nullif(concat_ws(', ', style, year::VARCHAR, {other}), ''), left(trim(coalesce(snippet, '')), 60)),
          'matched: ' || CASE greatest(m1, m2, m3, m4) WHEN 0 THEN 'semantic' WHEN m1 THEN 'name' WHEN m2 THEN 'architect' WHEN m3 THEN 'style' ELSE 'category' END) AS said FROM c),
    o AS (SELECT *, row_number() OVER (ORDER BY total DESC, nth, rank) AS pos FROM s),
    g AS (SELECT list_transform(list({{'pos': pos, 'lat': lat, 'lng': lng}} ORDER BY pos), lambda h: [h]) AS hs FROM o GROUP BY norm),
    k AS (SELECT unnest(list_reduce(hs, lambda a, b: CASE WHEN len(list_filter(a, lambda x: {HAVERSINE.format('x.lat', 'x.lng', 'b[1].lat', 'b[1].lng')} <= 150)) > 0 THEN a ELSE list_concat(a, b) END)).pos AS pos FROM g),
    p AS (SELECT *, max(total) OVER () AS best, count(*) FILTER (total >= 0.4 * (SELECT max(total) FROM o)) OVER () AS passing, row_number() OVER (ORDER BY pos) AS place FROM o JOIN k USING (pos))
    SELECT corpus, id::VARCHAR AS key, name, total AS score, said AS why FROM p WHERE best <= 0 OR CASE WHEN passing < 3 THEN place <= 3 ELSE total >= 0.4 * best END ORDER BY pos LIMIT {PAGE_ROWS})"""


ORACLE = {"unified_page": " UNION ALL ".join(page_sql(q, i) for q, i in SEARCHES.items())}
