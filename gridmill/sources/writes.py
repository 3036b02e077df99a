"""Writes that can be repeated: batches appended once, partitions replaced in place, staged loads that swap whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import IntegerType, StructField, StructType

from gridmill.operators import keyed
from gridmill.sources import index_store
from gridmill.sources.tables import stored

#: Partitions of a table that is merged into, by key.
BUCKETS = 32


def replace_in_place(df: DataFrame, path: str, by: list[str]) -> None:
    """Writes ``df`` over the partitions that it has rows of; all other partitions stay untouched.

    The partitions come in with the commit of the job, so a job that fails changes nothing, and the same
    rows again give the same table.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_once(df: DataFrame, path: str, batch: int | str) -> None:
    """Appends the rows as the batch of this name; the same batch again takes the place of the first."""
    replace_in_place(df.withColumn("batch", F.lit(str(batch))), path, ["batch"])


def append_stream(rows: DataFrame, path: str, checkpoint: str, available: bool = True) -> StreamingQuery:
    """Appends a stream batch by batch; a batch that is run again after a failure is not doubled."""
    out = rows.writeStream.foreachBatch(lambda df, n: append_once(df, path, n)).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available else out).start()


def bucketed(df: DataFrame, keys: list[str], buckets: int) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int"))


class Table:
    """A table of versions: each is a folder that appears whole, and readers take the last one.

    ``load`` stages rows, keeps those that hold the rule, transforms them and swaps them in as a new
    version. ``merge`` rewrites the buckets of the keys that come in and takes over the others.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str], buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.schema, self.keys, self.buckets = spark, path.rstrip("/"), schema, keys, buckets

    def versions(self) -> list[int]:
        return [int(v) for v in index_store.children(self.spark, f"{self.path}/versions")]

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the last or the given version; none before the first."""
        known = self.versions()
        if not known:
            return self.spark.createDataFrame([], self.schema)
        return self.parts(max(known) if version is None else version).drop("bucket")

    def parts(self, version: int) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, StructField("bucket", IntegerType())])).parquet(f"{self.path}/versions/{version:06d}")

    def swap(self, rows: DataFrame, after: int) -> int:
        """Stores ``rows`` (with bucket) as the version after ``after``; refused if another writer was first."""
        made = f"{self.path}/made-{uuid.uuid4().hex}"
        rows.repartition("bucket").write.partitionBy("bucket").parquet(made)
        if not index_store.publish(self.spark, made, f"{self.path}/versions/{after + 1:06d}"):
            raise RuntimeError(f"version {after + 1} of {self.path} has come meanwhile")
        return after + 1

    def load(self, raw: DataFrame, transform: Callable[[DataFrame], DataFrame], rule: Column | None = None) -> tuple[int, DataFrame]:
        """(version, rejected): the whole table anew. Rows of ``raw`` that break ``rule`` are rejected; of equal keys the last by all columns stays."""
        staged = stored(raw, "staged")
        good = F.lit(True) if rule is None else F.coalesce(rule, F.lit(False))
        told = transform(staged.where(good)).select(self.schema.names)
        once = keyed.best_per_key(told, self.keys, *[F.desc_nulls_last(c) for c in self.schema.names if c not in self.keys])
        return self.swap(bucketed(once, self.keys, self.buckets), max(self.versions(), default=0)), staged.where(~good)

    def merge(self, rows: DataFrame, prefer_new: bool = True) -> int:
        """Upserts by column: new values unless null, or old ones unless null; other rows and buckets stay. The same rows again change nothing.

        Buckets without new rows are copied as they are.
        """
        last = max(self.versions(), default=0)
        new = stored(bucketed(rows.select(self.schema.names), self.keys, self.buckets), "incoming")
        asked = [r.bucket for r in new.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        old = self.parts(last) if last else bucketed(self.spark.createDataFrame([], self.schema), self.keys, self.buckets)
        touched = keyed.merge(old.where(F.col("bucket").isin(asked)), new, [*self.keys, "bucket"], prefer_new)
        whole = touched.unionByName(old.where(~F.col("bucket").isin(asked)))
        return self.swap(whole, last)

    def clean(self, keep: int = 2) -> None:
        """Deletes all versions but the last ``keep``, and what failed writes have left."""
        for v in sorted(self.versions())[:-keep]:
            index_store.delete(self.spark, f"{self.path}/versions/{v:06d}")
        for name in index_store.children(self.spark, self.path):
            if name.startswith("made-"):
                index_store.delete(self.spark, f"{self.path}/{name}")
