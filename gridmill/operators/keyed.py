"""Tables with keys: newest or best row, upserts of several kinds, replaced partitions, integrity checks.

All are pure functions of DataFrames; each shuffles on the key once for each input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order, which should be total."""
    ranked = df.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_nth = 1").drop("_nth")


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``source`` replace those of ``target`` with the same keys; the rest stay."""
    return target.join(source, keys, "left_anti").unionByName(source)


def merge(target: DataFrame, source: DataFrame, keys: list[str], prefer_new: bool = True, insert: bool = True) -> DataFrame:
    """Upsert by column: the preferred side's value unless it is null. Without ``insert`` only known keys stay."""
    old, new = target.alias("t"), source.alias("s")
    on = [F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys]
    joined = old.join(new, on, "full" if insert else "left")
    values = [F.coalesce(*([F.col(f"s.{c}"), F.col(f"t.{c}")] if prefer_new else [F.col(f"t.{c}"), F.col(f"s.{c}")])).alias(c) if c in source.columns else F.col(f"t.{c}") for c in target.columns]
    return joined.select(*values)


def insert_missing(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the rows of ``source`` whose keys are new; null keys never conflict."""
    return target.unionByName(source.join(target, keys, "left_anti"))


def replace_partitions(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Drops all rows of the keys that ``source`` holds, then adds ``source``."""
    return target.join(source.select(*keys).distinct(), keys, "left_anti").unionByName(source)


def violations(df: DataFrame, unique: list[str], exempt: Column | None = None) -> DataFrame:
    """Keys that stand more than once, besides exempt rows; empty for a sound table."""
    rows = df if exempt is None else df.where(~F.coalesce(exempt, F.lit(False)))
    return rows.groupBy(*unique).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
