"""Many hybrid searches at once: every search of a table of queries against one stored corpus, in one run.

The corpus is an index: trigram postings of its names, its vectors in blocks, the most famous rows as a
block of their own, and its rows by name. All pools are top-k windows by query, so a search costs what
its own trigrams and blocks cost, and no search scans the corpus.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmill.functions import ranking as R
from gridmill.functions import text as T
from gridmill.operators import fusion, postings, vector_blocks
from gridmill.plans.search import FAMOUS, FAMOUS_KEPT, FUZZY_FLOOR, LEG_FAME, LEX_FLOOR, VECTOR_WEIGHT
from gridmill.sources import index_store
from gridmill.sources.tables import stored


CARRIED = ["name", "fame"]


class Corpus(NamedTuple):
    spark: SparkSession
    path: str
    fields: tuple[tuple[str, str], ...]
    schema: StructType

    @property
    def names(self) -> postings.Postings:
        return postings.Postings(self.spark, f"{self.path}/names")

    @property
    def vectors(self) -> vector_blocks.Blocks:
        return vector_blocks.Blocks(self.spark, f"{self.path}/vectors", self.fields)

    @property
    def famous(self) -> vector_blocks.Blocks:
        return vector_blocks.Blocks(self.spark, f"{self.path}/famous", self.fields)

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")


def build(rows: DataFrame, path: str) -> None:
    """Stores a corpus (id unique, name, embedding, fame) in a new folder."""
    rows = stored(rows, "corpus")  # read by each part of the index
    postings.build(rows.select("name"), f"{path}/names")
    vector_blocks.build(rows, f"{path}/vectors", CARRIED)
    vector_blocks.build(fusion.top(rows, FAMOUS, F.col("fame"), "id"), f"{path}/famous", CARRIED, blocks=1)
    postings.write(by_name(rows), f"{path}/rows", "name", "id")


def by_name(rows: DataFrame) -> DataFrame:
    return rows.select("id", "name", "fame", "embedding", postings.bucket_of(F.col("name"), postings.BUCKETS).alias("bucket"))


def opened(name: str, rows: DataFrame) -> Corpus:
    path = index_store.opened(name, [rows], f"corpus {postings.BUCKETS} {FAMOUS}", lambda p: build(rows, p))
    return Corpus(rows.sparkSession, path, vector_blocks.fields_of(rows, CARRIED), by_name(rows).schema)


def first_rows(df: DataFrame, n: int, *order: F.Column) -> DataFrame:
    """The first ``n`` rows of each query; Spark keeps n of a query in each task."""
    return df.withColumn("_nth", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("_nth") <= n).drop("_nth")


def lexical(corpus: Corpus, queries: DataFrame, pool: int) -> DataFrame:
    """(query_id, id, name, fame, cos): the best rows by word likeness and by trigram likeness.

    Both follow from the text alone, so queries of one text are searched for once, and meet their rows at the end.
    """
    texts = queries.select("query").distinct()
    found = stored(postings.search(corpus.names, texts.select(F.col("query").alias("query_id"), "query"), LEX_FLOOR, FUZZY_FLOOR), "likenesses")
    bucket = postings.bucket_of(F.col("name"), postings.BUCKETS)
    rows = postings.in_buckets(corpus.rows, found.select(bucket.alias("bucket")))
    told = rows.select("id", "name").join(found, "name")
    both = first_rows(told.where(F.col("word") > LEX_FLOOR), pool, F.desc("word"), F.asc("id")).unionByName(first_rows(told.where(F.col("tri") > FUZZY_FLOOR), pool, F.desc("tri"), F.asc("id")))
    chosen = both.select(F.col("query_id").alias("query"), "id", "name").distinct()
    vectors = stored(rows.select("id", "name", "fame", "embedding").join(chosen, ["id", "name"]), "by-text").join(queries.select("query_id", "query", "q"), "query")
    return vectors.select("query_id", "id", "name", "fame", F.round(R.cosine(F.col("embedding"), F.col("q")), vector_blocks.PLACES).alias("cos"))


def with_lex(rows: DataFrame) -> DataFrame:
    """``rows`` (query, name) with ``lex``, the better of both likenesses, which each pair of texts is asked for once, on all cores."""
    pairs = rows.select(F.col("query").alias("said"), F.col("name").alias("named")).distinct().repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)
    lex = F.greatest(T.word_similarity(F.col("said"), F.col("named")), T.trigram_similarity(F.col("said"), F.col("named")))
    same = F.col("query").eqNullSafe(F.col("said")) & F.col("name").eqNullSafe(F.col("named"))
    return rows.join(pairs.withColumn("lex", lex), same).drop("said", "named")


def search(corpus: Corpus, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, nth, id, cos, lex, score): the best ``limit`` rows for each query (query_id unique, query, q).

    Each as ``search.leg`` finds them for that query alone; equal scores are ordered by id.
    """
    pool = fusion.pool_size(limit)
    queries = stored(queries.select("query_id", "query", "q"), "queries")
    columns = ["query_id", "id", "name", "fame", "cos"]
    near = vector_blocks.nearest(corpus.vectors, queries, pool).hits.select(columns)
    famous = vector_blocks.nearest(corpus.famous, queries, FAMOUS_KEPT).hits.select(columns)
    pooled = near.unionByName(famous).unionByName(lexical(corpus, queries, pool))
    once = stored(pooled.groupBy("query_id", "id").agg(*[F.any_value(c).alias(c) for c in columns[2:]]).join(queries.select("query_id", "query"), "query_id"), "pooled")
    told = with_lex(once).withColumn("score", VECTOR_WEIGHT * F.col("cos") + (1 - VECTOR_WEIGHT) * F.col("lex") + LEG_FAME * F.coalesce("fame", F.lit(0.0)))
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "id")
    return told.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= limit).select("query_id", "nth", "id", "cos", "lex", "score")
