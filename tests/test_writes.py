"""Writes that are repeated, fail, or meet other writers give the same tables."""

import pytest
from pyspark.sql import functions as F

from gridmill.sources import writes

SCHEMA = "k int, name string, height double"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def table(spark, path, buckets=4):
    return writes.Table(spark, str(path), frame(spark, []).schema, ["k"], buckets)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_the_same_batch_twice_is_one_batch(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch in (1, 2, 1, 2, 2):
        writes.append_once(spark.range(batch * 10).withColumn("n", F.lit(batch)), path, batch)
    assert spark.read.parquet(path).count() == 30


def test_a_failed_write_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "log")
    writes.append_once(spark.range(5), path, "a")

    def fail(batches):
        for b in batches:
            if 3 in b.column(0).to_pylist():
                raise ValueError("lost")
            yield b

    with pytest.raises(Exception, match="lost"):
        writes.append_once(spark.range(9).repartition(4).mapInArrow(fail, "id long"), path, "a")
    assert spark.read.parquet(path).count() == 5
    writes.append_once(spark.range(9), path, "a")
    assert spark.read.parquet(path).count() == 9


def test_partitions_are_replaced_in_place(spark, tmp_path):
    path = str(tmp_path / "t")
    writes.replace_in_place(frame(spark, [(1, "a", 1.0), (2, "a", 2.0), (3, "b", 3.0)]), path, ["name"])
    writes.replace_in_place(frame(spark, [(9, "a", 9.0)]), path, ["name"])
    assert sorted((r.k, r["name"]) for r in spark.read.parquet(path).collect()) == [(3, "b"), (9, "a")]


def test_a_stream_resumes_without_doubles(spark, tmp_path):
    source, path, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    spark.range(10).write.parquet(source)
    for n in (10, 10, 25):
        if n == 25:
            spark.range(10, 25).write.mode("append").parquet(source)
        writes.append_stream(spark.readStream.schema("id long").parquet(source), path, check).awaitTermination()
        assert sorted(r.id for r in spark.read.parquet(path).collect()) == list(range(n))
    # The last batch run again, as after a failure between its write and its commit.
    writes.append_once(spark.range(10, 25), path, 1)
    assert spark.read.parquet(path).count() == 25


def test_loads_and_merges_swap_versions(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    assert t.read().count() == 0
    raw = frame(spark, [(1, " a ", 1.0), (2, "b", None), (None, "x", 1.0), (2, "b", 5.0)])
    version, rejected = t.load(raw, lambda df: df.withColumn("name", F.trim("name")), F.col("k").isNotNull())
    assert version == 1 and rows_of(rejected) == [(None, "x", 1.0)] and rows_of(t.read()) == [(1, "a", 1.0), (2, "b", 5.0)]
    new = frame(spark, [(2, None, 7.0), (3, "c", None)])
    for _ in range(2):
        t.merge(new)
        assert rows_of(t.read()) == [(1, "a", 1.0), (2, "b", 7.0), (3, "c", None)]
    t.merge(frame(spark, [(3, "kept", 2.0), (4, None, None)]), prefer_new=False)
    assert rows_of(t.read()) == [(1, "a", 1.0), (2, "b", 7.0), (3, "c", 2.0), (4, None, None)]
    assert rows_of(t.read(1)) == [(1, "a", 1.0), (2, "b", 5.0)]
    t.clean(1)
    assert t.versions() == [4] and t.read().count() == 4


def test_a_late_writer_is_refused(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(frame(spark, [(1, "a", 1.0)]))
    with pytest.raises(RuntimeError):
        t.swap(writes.bucketed(frame(spark, [(9, "z", 9.0)]), ["k"], 4), 0)
    assert rows_of(t.read()) == [(1, "a", 1.0)]


def test_a_load_that_fails_leaves_the_table(spark, tmp_path):
    t = table(spark, tmp_path / "t")
    t.merge(frame(spark, [(1, "a", 1.0)]))
    with pytest.raises(Exception, match="lost"):
        t.load(frame(spark, [(2, "b", 2.0)]), lambda df: df.withColumn("name", F.raise_error(F.lit("lost")).cast("string")))
    assert t.versions() == [1] and rows_of(t.read()) == [(1, "a", 1.0)]
    t.clean()
    assert rows_of(t.read()) == [(1, "a", 1.0)]
