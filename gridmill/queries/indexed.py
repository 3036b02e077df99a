"""Queries over stored indexes: names by postings, vectors by blocks, places by layout, and a log of searches at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import geo
from gridmill.operators import placed, postings, vector_blocks
from gridmill.plans import search_log as log
from gridmill.queries import places
from gridmill.queries.base import lat, lng, load
from gridmill.queries.searches import JACCARD, grams, whole_corpus
from gridmill.sources import index_store

#: Every row whose key this divides is asked for.
ASKED = 50


def misspelt(name: str) -> F.Column:
    """A name without its fourth letter."""
    return F.concat(F.substring(name, 1, 3), F.expr(f"substring({name}, 5)"))


def name_postings(spark: SparkSession, d: str) -> postings.Postings:
    """The stored index over the names of parts: built over the even keys, then added to."""
    part = load(spark, d, "part")
    names = part.select(F.col("p_name").alias("name"), "p_partkey")

    def build(path: str) -> None:
        postings.add(postings.build(names.where("p_partkey % 2 = 0"), path), names)

    return postings.Postings(spark, index_store.opened("names", [part], f"trigrams {postings.BUCKETS}", build))


def names_by_postings(spark: SparkSession, d: str) -> DataFrame:
    """Names like misspelt ones, from stored trigram postings."""
    asked = load(spark, d, "part").where(F.col("p_partkey") % ASKED == 0).select(misspelt("p_name").alias("query")).distinct()
    found = postings.search(name_postings(spark, d), asked.withColumn("query_id", F.col("query")))
    return found.select(F.col("query_id").alias("query"), "name", F.round("word", 4).alias("word"), F.round("tri", 4).alias("tri"))


def vector_nearest(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors most like each asked one, from blocks that are skipped where their bound is too low."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    asked = vectors.where(F.col("id") % ASKED == 0).select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    hits = vector_blocks.nearest(vector_blocks.opened("vectors", vectors, []), asked, 10).hits
    return hits.select("query_id", "nth", "id", F.round("cos", 5).alias("cos"))


def search_log(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid searches of a whole log of queries, each with its vector, in one run."""
    rows = whole_corpus(spark, d)
    asked = rows.where(F.col("id") % ASKED == 0).select(F.col("id").alias("query_id"), misspelt("name").alias("query"), F.col("embedding").alias("q"))
    found = log.search(log.opened("corpus", rows), asked, 20)
    return found.select("query_id", "nth", "id", F.round("cos", 4).alias("cos"), F.round("lex", 4).alias("lex"), F.round("score", 4).alias("score"))


def radius_stored(spark: SparkSession, d: str) -> DataFrame:
    """Parts within 3 km of a point, from rows stored along a Z-order; the box reaches the scan."""
    part = load(spark, d, "part")
    rows = part.select("p_partkey", lat("p_partkey").alias("lat"), lng("p_partkey").alias("lng"))
    path = index_store.opened("places", [part], f"z {placed.BITS} {placed.GROUP_BYTES}", lambda p: placed.write_along(rows, p))
    found = placed.within(spark.read.parquet(path), places.AT_LAT, places.AT_LNG, 3000)
    return found.select("p_partkey", F.round("dist_m", 1).alias("dist_m"))


def block_context_stored(spark: SparkSession, d: str) -> DataFrame:
    """What stands out of its neighbours within 1 km, over two tables bucketed by cell."""
    own, other = places.block_sides(spark, d)
    pairs = placed.pairs(placed.opened_pair("blocks", own, other, 1000, ("lat", "lng"), ("lat2", "lng2")))
    return places.contrasts(pairs)


def polygons_stored(spark: SparkSession, d: str) -> DataFrame:
    """Which supplier's square each part lies in, over two tables bucketed by cell."""
    squares = places.places(spark, d, "supplier", "s_suppkey", "2").withColumn("ring", places.square(F.col("lat2"), F.col("lng2"), 0.0041))
    pairs = placed.pairs(placed.opened_pair("squares", places.places(spark, d, "part", "p_partkey"), squares, 700, ("lat", "lng"), ("lat2", "lng2")))
    return pairs.where(geo.in_ring(F.col("lat"), F.col("lng"), F.col("ring"))).select("p_partkey", "s_suppkey")


QUERIES = {f.__name__: f for f in (names_by_postings, vector_nearest, search_log, radius_stored, block_context_stored, polygons_stored)}

WORD = f"list_max(flatten(list_transform(range(1, len(t) + 1), lambda a: list_transform(range(a, len(t) + 1), lambda b: {JACCARD.format('q', 'list_distinct(t[a:b])')}))))"
ORACLE = {
    "radius_stored": places.ORACLE["radius_filter"],
    "block_context_stored": places.ORACLE["block_context"],
    "polygons_stored": places.ORACLE["point_in_polygon"],
    "search_log": f"""WITH c AS (SELECT e.vec_id AS id, coalesce(p_name, '') AS name, embedding::DOUBLE[] AS v, p_retailprice / (SELECT max(p_retailprice) FROM part) AS fame FROM embeddings e LEFT JOIN part ON p_partkey = e.vec_id % (SELECT count(*) FROM part)),
        a AS (SELECT id AS qid, left(name, 3) || substr(name, 5) AS query, v AS qv FROM c WHERE id % {ASKED} = 0),
        g AS (SELECT query, name, list_distinct({grams('query')}) AS q, {grams('name')} AS t FROM (SELECT DISTINCT query FROM a), (SELECT DISTINCT name FROM c)),
        l AS (SELECT query, name, coalesce({WORD}, 0) AS word, coalesce({JACCARD.format('q', 'list_distinct(t)')}, 0) AS tri FROM g),
        r AS (SELECT qid, id, round(list_cosine_similarity(v, qv), 9) AS cos, fame, word, tri FROM a CROSS JOIN c JOIN l ON l.query = a.query AND l.name = c.name),
        f AS (SELECT id FROM c ORDER BY fame DESC, id LIMIT 1000),
        n AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY cos DESC, id) <= 80 OR (word > 0.3 AND row_number() OVER (PARTITION BY qid, word > 0.3 ORDER BY word DESC, id) <= 80)
                  OR (tri > 0.2 AND row_number() OVER (PARTITION BY qid, tri > 0.2 ORDER BY tri DESC, id) <= 80) OR (id IN (FROM f) AND row_number() OVER (PARTITION BY qid, id IN (FROM f) ORDER BY cos DESC, id) <= 40) AS pooled FROM r),
        s AS (SELECT qid, id, cos, greatest(word, tri) AS lex, 0.7 * cos + 0.3 * greatest(word, tri) + 0.15 * coalesce(fame, 0) AS score FROM n WHERE pooled)
        SELECT qid AS query_id, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id)::INT AS nth, id, round(cos, 4) AS cos, round(lex, 4) AS lex, round(score, 4) AS score FROM s QUALIFY nth <= 20""",
    "vector_nearest": f"""SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) DESC, e.vec_id)::INT AS nth, e.vec_id AS id,
        round(list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS cos FROM embeddings q, embeddings e WHERE q.vec_id % {ASKED} = 0 QUALIFY nth <= 10""",
    "names_by_postings": f"""WITH a AS (SELECT DISTINCT left(p_name, 3) || substr(p_name, 5) AS query FROM part WHERE p_partkey % {ASKED} = 0), n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL),
        g AS (SELECT query, name, list_distinct({grams('query')}) AS q, {grams('name')} AS t FROM a, n), s AS (SELECT query, name, {WORD} AS word, {JACCARD.format('q', 'list_distinct(t)')} AS tri FROM g)
        SELECT query, name, round(word, 4) AS word, round(tri, 4) AS tri FROM s WHERE word > 0.3 OR tri > 0.2""",
}
