"""Candidate pools, rank fusion and the relevance floor."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridmill.functions import ranking as R


def pool_size(limit: int) -> int:
    return min(max(4 * limit, 40), 200)


def top(df: DataFrame, n: int, score: Column, tie: str) -> DataFrame:
    """The ``n`` best rows; Spark keeps n rows for each partition and merges these."""
    return df.orderBy(score.desc(), tie).limit(n)


def union_pools(pools: list[DataFrame], key: str) -> DataFrame:
    """The distinct keys of several pools; each pool has few rows."""
    return reduce(DataFrame.unionByName, [p.select(key) for p in pools]).distinct()


def ranked(leg: DataFrame, corpus: str, key: str, score: str) -> DataFrame:
    """(corpus, key, rank) of one leg of at most some hundred rows; rows without a key use up their rank."""
    order = Window.partitionBy("corpus").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last())
    rows = leg.select(F.lit(corpus).alias("corpus"), F.col(key).cast("string").alias("key"), F.col(score).alias("score"))
    return rows.withColumn("rank", F.row_number().over(order)).where("key IS NOT NULL")


def fuse(legs: list[DataFrame], weight: Column) -> DataFrame:
    """Reciprocal-rank fusion: (corpus, key, rank, fused) with the weight of each corpus."""
    rows = reduce(DataFrame.unionByName, legs)
    return rows.groupBy("corpus", "key").agg(F.sum(weight / (R.K + F.col("rank"))).alias("fused"), F.min("rank").alias("rank"))


def relevance_floor(hits: DataFrame, order: list[Column], page: str) -> DataFrame:
    """Per page: rows of 0.40 of the best score or more, at least the first three; all if the best is 0 or less."""
    w = Window.partitionBy(page)
    nth = F.row_number().over(w.orderBy(*order))
    told = hits.withColumn("_best", F.max("score").over(w)).withColumn("_nth", nth).withColumn("_pass", F.coalesce(F.col("score"), F.lit(0.0)) >= F.col("_best") * R.FLOOR)
    told = told.withColumn("_n", F.count_if("_pass").over(w))
    kept = told.where((F.col("_best") <= 0) | F.when(F.col("_n") < R.MIN_KEEP, F.col("_nth") <= R.MIN_KEEP).otherwise(F.col("_pass")))
    return kept.drop("_best", "_nth", "_pass", "_n")
