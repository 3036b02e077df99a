"""Sources and sinks: text tables, optional columns, resumable logs, paged JSON, tiles and scratch folders."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Iterator
from urllib.request import urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def home(spark: SparkSession) -> str:
    """The shared checkpoint folder; a local session without one gets a folder of its own, a cluster its warehouse."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        base = os.path.join(tempfile.gettempdir(), "gridmill-scratch") if conf.get("spark.master", "").startswith("local[") else spark.conf.get("spark.sql.warehouse.dir")
    return base.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder in ``home``."""
    return f"{home(spark)}/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` into scratch once and returns a scan of it, for rows that several branches read.

    The folder goes when the application ends, as a result that is still to run may read it until then.
    """
    path = scratch(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    where = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).deleteOnExit(where)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_text_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV with a header, all columns as strings, a byte-order mark taken off the first name."""
    df = spark.read.option("header", True).option("sep", sep).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿").strip().lower().replace(" ", "_") for c in df.columns])


def with_columns_of(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``: those that ``df`` lacks are null, text ones are cast where they can be."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*[F.col(have[f.name.lower()]).try_cast(f.dataType).alias(f.name) if f.name.lower() in have else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def unfinished(work: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """The work whose keys are not in the log yet; a failed run resumes where its log ends."""
    return work.join(log.select(*keys).distinct(), keys, "left_anti")


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_shards(spark: SparkSession, paths: list[str], columns: list[str], condition: Column | None = None) -> DataFrame:
    """Some columns of the rows of several Parquet shards that hold a condition; the scan prunes and filters."""
    rows = spark.read.parquet(*paths)
    return (rows if condition is None else rows.where(condition)).select(*columns)


def read_landed_json(spark: SparkSession, path: str, schema: T.StructType | str, field: str | None = None) -> DataFrame:
    """Records of JSON answers that were landed whole, one to a file: the answers, or the list in ``field`` of each.

    Missing values are null; an answer without the list has no records.
    """
    if field is None:
        return spark.read.schema(schema).option("multiLine", True).json(path)
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = spark.read.schema(T.StructType().add(field, T.ArrayType(kind))).option("multiLine", True).json(path)
    return rows.select(F.explode(field).alias("r")).select("r.*")


def accepted(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, rejected): rows in which every required column is filled, and the others."""
    filled = F.lit(True)
    for c in required:
        filled = filled & F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False))
    return rows.where(filled), rows.where(~filled)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """One gzip JSON line for each (cell, json) row, in as many files as there are partitions."""
    tiles.select("json").write.mode("overwrite").option("compression", "gzip").text(path)


class Page(InputPartition):
    def __init__(self, offset: int) -> None:
        self.offset = offset


class PagedJsonReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[Page]:
        step, total = int(self.options.get("limit", 1000)), int(self.options["total"])
        return [Page(o) for o in range(0, total, step)]

    def read(self, partition: Page) -> Iterator[tuple]:
        url = self.options["url"].format(limit=self.options.get("limit", 1000), offset=partition.offset)
        with urlopen(url, timeout=60) as answer:
            for row in json.load(answer):
                yield tuple(None if row.get(f.name) is None else str(row[f.name]) for f in self.schema.fields)


class PagedJson(DataSource):
    """``spark.read.format("paged_json")``: a REST table read page by page, one task for each page.

    Options: ``url`` with ``{limit}`` and ``{offset}``, ``limit``, ``total``. All columns are strings.
    """

    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: T.StructType) -> PagedJsonReader:
        return PagedJsonReader(schema, self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedJson)
