"""A stored trigram index over names: segments of postings, added to, refreshed and compacted, and searched by the page.

A segment holds ``names`` (name_id, name, live), ``postings`` (gram, name_id, size) and ``counts`` (gram,
n), all cut into buckets that are folders, so a search opens the buckets of its own trigrams only. Of a
query's trigrams the most frequent are not read at all: a name that reaches the threshold must share one
of the others. What the postings say bounds both likenesses from above, and only names that may reach
a threshold are fetched and measured.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import text as T
from gridmill.sources import index_store

#: Folders of a segment's tables.
BUCKETS = 64
#: Likenesses within this of a bound count as reaching it.
SLACK = 1e-9
NAMES, POSTINGS, COUNTS = "name_id long, name string, live boolean, bucket int", "gram string, name_id long, size int, bucket int", "gram string, n long, bucket int"


class Postings(NamedTuple):
    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def segments(self) -> list[str]:
        return index_store.children(self.spark, self.path)

    def table(self, name: str, schema: str) -> DataFrame:
        """One of the tables over all segments; the number of the segment is in ``segment``."""
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{s}/{name}").withColumn("segment", F.lit(int(s))) for s in self.segments()]
        out = parts[0] if parts else self.spark.createDataFrame([], schema).withColumn("segment", F.lit(0))
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    def live(self) -> DataFrame:
        """(name): what the index holds."""
        return latest(self.table("names", NAMES)).select("name")


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def latest(names: DataFrame) -> DataFrame:
    """The names whose newest segment has them live."""
    return names.groupBy("name").agg(F.max_by("live", "segment").alias("live")).where("live").select("name")


def write(df: DataFrame, path: str, *order: str) -> None:
    """In buckets, sorted; ranges over the order cut even one crowded bucket into several files."""
    df.repartitionByRange("bucket", *order).sortWithinPartitions("bucket", *order).write.partitionBy("bucket").parquet(path)


def add_segment(index: Postings, names: DataFrame, gone: DataFrame | None) -> bool:
    """Adds one segment with the new ``names`` and the ``gone`` ones; False if another one came first."""
    spark, number = index.spark, max(map(int, index.segments()), default=-1) + 1
    made = f"{index.path}.{uuid.uuid4().hex}"
    told = names.select("name", F.lit(True).alias("live"))
    if gone is not None:
        told = told.unionByName(gone.select("name", F.lit(False).alias("live")))
    told = told.withColumn("name_id", F.xxhash64("name")).withColumn("bucket", bucket_of(F.col("name_id"), index.buckets))
    write(told, f"{made}/names", "name_id")
    rows = spark.read.schema(NAMES).parquet(f"{made}/names").where("live")
    grams = F.array_distinct(T.trigrams(F.col("name")))
    listed = rows.select("name_id", F.size(grams).alias("size"), F.explode(grams).alias("gram"))
    write(listed.withColumn("bucket", bucket_of(F.col("gram"), index.buckets)), f"{made}/postings", "gram", "name_id")
    counted = spark.read.schema(POSTINGS).parquet(f"{made}/postings").groupBy("gram", "bucket").agg(F.count(F.lit(1)).alias("n"))
    write(counted, f"{made}/counts", "gram")
    return index_store.publish(spark, made, f"{index.path}/{number:06d}")


def filled(names: DataFrame) -> DataFrame:
    return names.select("name").where("name IS NOT NULL").distinct()


def build(names: DataFrame, path: str, buckets: int = BUCKETS) -> Postings:
    """An index over the distinct names that are not null, in a new folder."""
    index = Postings(names.sparkSession, path, buckets)
    add_segment(index, filled(names), None)
    return index


def add(index: Postings, names: DataFrame) -> bool:
    """Adds the names that the index does not hold; the same names again change nothing."""
    new = filled(names).join(index.live(), "name", "left_anti")
    return add_segment(index, new, None) if not new.isEmpty() else True


def refresh(index: Postings, names: DataFrame) -> bool:
    """Makes the index hold exactly ``names``: new ones are added, those that went are marked."""
    wanted, have = filled(names), index.live()
    new, gone = wanted.join(have, "name", "left_anti"), have.join(wanted, "name", "left_anti")
    return add_segment(index, new, gone) if not (new.isEmpty() and gone.isEmpty()) else True


def compact(index: Postings, path: str) -> Postings:
    """One segment with all that is live, in a new folder; the old one serves on until it is deleted."""
    return build(index.live(), path, index.buckets)


def in_buckets(df: DataFrame, asked: DataFrame) -> DataFrame:
    """The rows of the buckets that stand in ``asked``: at most as many numbers as the index has buckets."""
    return df.where(F.col("bucket").isin([r.bucket for r in asked.select("bucket").distinct().collect()]))


def search(index: Postings, queries: DataFrame, word_floor: float = 0.3, tri_floor: float = 0.2) -> DataFrame:
    """(query_id, name, word, tri): every name of the index whose word or trigram likeness to a query is over its floor.

    The same rows as a comparison of every query with every name. ``queries`` has query_id and query;
    null and blank queries find nothing.
    """
    grams = F.array_distinct(T.trigrams(F.col("query")))
    asked = queries.select("query_id", "query", grams.alias("grams")).withColumn("n_q", F.size("grams")).where("n_q > 0")
    each = asked.select("query_id", "n_q", F.explode("grams").alias("gram")).withColumn("bucket", bucket_of(F.col("gram"), index.buckets))
    counts = in_buckets(index.table("counts", COUNTS), each).groupBy("gram").agg(F.sum("n").alias("n"))
    # A name needs ``need`` shared trigrams for either likeness, so it has one of the others' rarest.
    need = F.floor(min(word_floor, tri_floor) * F.col("n_q") + SLACK) + 1
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.coalesce("n", F.lit(0)), "gram"))
    read = each.join(counts, "gram", "left").withColumn("skipped", (need - 1).cast("int")).withColumn("rank", rank).where(F.col("rank") <= F.col("n_q") - F.col("skipped"))
    read = read.where("n > 0").select("query_id", "n_q", "gram", "bucket", "skipped")
    listed = in_buckets(index.table("postings", POSTINGS), read).select("gram", "bucket", "name_id", "size")
    # Names of different segments with one number are counted together: a bound may grow, never fall.
    shared = listed.join(read, ["gram", "bucket"]).groupBy("query_id", "n_q", "skipped", "name_id", "size").agg(F.count(F.lit(1)).alias("s"))
    most = F.col("s") + F.col("skipped")
    may = (most > word_floor * F.col("n_q") - SLACK) | (most > tri_floor * (F.col("n_q") + F.col("size")) / (1 + tri_floor) - SLACK)
    found = shared.where(may).select("query_id", "name_id").distinct().withColumn("bucket", bucket_of(F.col("name_id"), index.buckets))
    names = in_buckets(index.table("names", NAMES), found).join(found.select("name_id").distinct(), "name_id", "left_semi")
    live = latest(names).withColumn("name_id", F.xxhash64("name"))
    pairs = found.select("query_id", "name_id").join(live, "name_id").join(queries.select("query_id", "query"), "query_id")
    pairs = pairs.repartition(4 * index.spark.sparkContext.defaultParallelism)  # they are few bytes, their likeness is slow
    told = pairs.select("query_id", "name", T.word_similarity(F.col("query"), F.col("name")).alias("word"), T.trigram_similarity(F.col("query"), F.col("name")).alias("tri"))
    return told.where((F.col("word") > word_floor) | (F.col("tri") > tri_floor))
