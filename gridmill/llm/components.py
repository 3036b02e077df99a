"""Connected components of a distributed graph, by alternating star operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridmill.llm.common import materialize


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node links its larger neighbours, or its smaller ones and itself, to its least neighbour.

    Least neighbours come from a pre-aggregated minimum that is joined back, so no neighbourhood is
    ever gathered, however large.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def flat(edges: DataFrame) -> bool:
    """Whether every node that has a parent has one, and is nobody's parent."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("child"), F.lit(0).alias("parent")), F.struct(F.col("v").alias("x"), F.lit(0).alias("child"), F.lit(1).alias("parent")))).alias("e"))
    return ends.groupBy("e.x").agg(F.sum("e.child").alias("child"), F.max("e.parent").alias("parent")).where("child + parent > 1 AND child > 0").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of ``edges`` (u, v); the component is its least node."""
    now = materialize(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    while not flat(now):
        now = materialize(star(star(now, True), False), "edges")
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
