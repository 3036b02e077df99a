"""Stored place layouts: what they find, and how little of them is read."""

import glob
import math
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from gridmill.operators import placed, spatial


def metres(a, b):
    p, q, dl = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(dl / 2) ** 2
    return 2 * 6371000 * math.asin(min(1, math.sqrt(x)))


def test_a_radius_reads_a_part_of_the_row_groups(spark, tmp_path):
    rows = spark.range(200_000).select("id", (40 + F.rand(1)).alias("lat"), (-75 + F.rand(2)).alias("lng"))
    path = str(tmp_path / "z")
    placed.write_along(rows, path, group_bytes=64 << 10, file_rows=50_000)
    stored = spark.read.parquet(path)
    got = placed.within(stored, 40.5, -74.5, 2000)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = got._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(lat" in plan and "LessThanOrEqual(lng" in plan
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert {r.id for r in got.collect()} == {r.id for r in stored.collect() if metres((r.lat, r.lng), (40.5, -74.5)) <= 2000}
    (south, north, west, east), = placed.boxes(40.5, -74.5, 2000)
    read = total = 0
    for name in glob.glob(f"{path}/*.parquet"):
        told = pq.ParquetFile(name).metadata
        for g in range(told.num_row_groups):
            s = {told.row_group(g).column(c).path_in_schema: told.row_group(g).column(c).statistics for c in range(told.num_columns)}
            total += 1
            read += s["lat"].max >= south and s["lat"].min <= north and s["lng"].max >= west and s["lng"].min <= east
    assert total > 10 and read < total / 3


@pytest.mark.parametrize("at", [(0.0, 179.99), (0.0, -179.99), (89.99, 10.0), (-89.995, 0.0), (60.0, 0.0)])
def test_boxes_hold_all_that_is_near(spark, tmp_path, at):
    rng = random.Random(2)
    rows = []
    for i in range(3000):
        lat = max(-90.0, min(90.0, at[0] + rng.uniform(-0.05, 0.05)))
        rows.append((i, lat, rng.uniform(-180, 180) if abs(lat) > 89 else (at[1] + rng.uniform(-0.1, 0.1) + 180) % 360 - 180))
    placed.write_along(spark.createDataFrame([*rows, (-1, None, 0.0)], "id long, lat double, lng double"), str(tmp_path / "z"))
    got = {r.id for r in placed.within(spark.read.parquet(str(tmp_path / "z")), *at, 3000).collect()}
    assert got == {i for i, *p in rows if metres(p, at) <= 3000} and got


def sides(spark, n=300):
    rng = random.Random(6)
    spot = lambda: (rng.choice([40.0, 70.0, -89.99]) + rng.uniform(0, 0.01), (rng.choice([179.99, 10.0]) + rng.uniform(0, 0.02) + 180) % 360 - 180)
    left = [(i, *spot()) for i in range(n)] + [(900, None, 1.0)]
    right = [(i, *spot()) for i in range(n)] + [(901, 1.0, None)]
    return left, right, spark.createDataFrame(left, "a long, lat double, lng double"), spark.createDataFrame(right, "b long, lat2 double, lng2 double")


def test_bucketed_sides_meet_without_an_exchange(spark, tmp_path, monkeypatch):
    left, right, a, b = sides(spark)
    want = {(x[0], y[0]) for x in left[:-1] for y in right[:-1] if metres(x[1:], y[1:]) <= 400}
    at = (("lat", "lng"), ("lat2", "lng2"))
    assert {(r.a, r.b) for r in spatial.cell_join(a, b, 400, *at).collect()} == want
    stored = placed.store_pair(a, b, str(tmp_path / "p"), 400, *at, 8)
    got = placed.pairs(stored)
    assert sorted((r.a, r.b) for r in got.collect()) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    monkeypatch.setattr(placed, "MOST_PAIRS", 0)
    assert sorted((r.a, r.b) for r in placed.pairs(stored).collect()) == sorted(want)
    assert "Exchange" in placed.pairs(stored)._jdf.queryExecution().executedPlan().toString()


def test_empty_sides(spark, tmp_path):
    _, _, a, b = sides(spark, 5)
    stored = placed.store_pair(a.where("false"), b, str(tmp_path / "p"), 400, ("lat", "lng"), ("lat2", "lng2"), 4)
    assert placed.pairs(stored).count() == 0
