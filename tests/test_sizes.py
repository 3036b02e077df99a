"""What larger tables bring: longer keys, points that only touch, crowded places, and expressions that are worked out once."""

import math
import os
import random
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from gridmill import registry
from gridmill.functions import geo, reports
from gridmill.operators import chunking, extract, rays, simplify, spatial, vector_blocks
from gridmill.queries import districts

D = "/root/testdata/sf0.001"
KEYS = {"part": "p_partkey", "supplier": "s_suppkey", "customer": "c_custkey"}


def enlarged(path, times: dict[str, int]) -> str:
    """The smallest tables in a new folder, some of them repeated with shifted keys."""
    con = duckdb.connect()
    for name in os.listdir(D):
        if name[:-8] not in times:
            os.symlink(f"{D}/{name}", path / name)
    for name, n in times.items():
        con.execute(f"COPY (SELECT t.* REPLACE (t.{KEYS[name]} + i * (SELECT max({KEYS[name]}) + 1 FROM '{D}/{name}.parquet') AS {KEYS[name]}) FROM '{D}/{name}.parquet' t, range({n}) r(i)) TO '{path}/{name}.parquet'")
    return str(path)


def same_as_sql(spark, d: str, name: str) -> int:
    con = duckdb.connect()
    for file in os.listdir(d):
        con.execute(f"CREATE VIEW {file[:-8]} AS SELECT * FROM '{d}/{file}'")
    told = con.execute(registry.oracle_sql()[name])
    names = [c[0] for c in told.description]
    want = sorted(repr([str(v) for v in row]) for row in told.fetchall())
    assert sorted(repr([str(r[c]) for c in names]) for r in registry.queries()[name](spark, d).collect()) == want
    return len(want)


def test_keys_of_six_digits(spark, tmp_path):
    part = pq.read_table(f"{D}/part.parquet")
    d = enlarged(tmp_path, {"part": 600})
    assert same_as_sql(spark, d, "lore_tiers") == 600 * part.num_rows > 100_000


def test_a_ray_that_touches_a_corner(spark, tmp_path):
    assert same_as_sql(spark, enlarged(tmp_path, {"supplier": 600}), "ray_hits") == 82


@pytest.mark.parametrize("made", [reports.street, lambda raw: reports.address(raw)["street"]])
def test_a_street_is_read_once(spark, made):
    # Each mention of a column is worked out anew; the list of ordinal words once repeated all patterns for each of its words.
    assert str(made(F.col("raw_street"))).count("raw_street") <= 2


def test_a_geodesic_works_out_its_angles_once(spark):
    assert str(geo.spheroid_distance(F.lit(40.7), F.lit(-74.0), F.col("to_lat"), F.col("to_lng"))).count("to_lat") == 2


def test_crowded_places_meet_few_rows(spark, monkeypatch):
    rng = random.Random(5)
    spots = lambda n: [(i, 40.7 + rng.gauss(0, 0.001), -74.0 + rng.gauss(0, 0.001)) for i in range(n)] + [(n, 40.75, -74.05), (n + 1, None, 1.0)]
    own, other = spots(800), spots(1500)
    left, right = spark.createDataFrame(own, "a long, lat double, lng double"), spark.createDataFrame(other, "b long, lat2 double, lng2 double")
    met, join = [], spatial.cell_join

    def counted(*args):
        pairs = join(*args)
        met.append(pairs.count())
        return pairs

    monkeypatch.setattr(spatial, "cell_join", counted)
    got = {(r.a, r.nth): (r.b, round(r.dist_m, 3)) for r in spatial.nearest(left, right, 2000, ("lat", "lng"), ("lat2", "lng2"), "a", "b", 4).collect()}

    def metres(p, q):
        x = math.sin(math.radians(q[0] - p[0]) / 2) ** 2 + math.cos(math.radians(p[0])) * math.cos(math.radians(q[0])) * math.sin(math.radians(q[1] - p[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(x))

    want = {}
    for a, *p in own[:-1]:
        near = sorted((metres(p, q), b) for b, *q in other[:-1])
        want |= {(a, i + 1): (b, round(d, 3)) for i, (d, b) in enumerate(near[:4]) if d <= 2000}
    assert got == want
    assert sum(met) < 0.4 * len(own) * len(other)


def test_web_queries_trim_once(spark):
    asked = reports.web_queries(*map(F.col, ("name", "addr", "raw_architect", "year", "categories", "raw_claim")))
    assert str(asked).count("raw_architect") == 1 and str(asked).count("raw_claim") == 1


def test_a_sample_of_vectors_by_hash(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 9 > 0, F.array(F.col("id").cast("float"))).alias("embedding"))
    want = [r.id for r in rows.where("embedding IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(200).collect()]
    assert vector_blocks.sample_of(rows, 200).column("id").to_pylist() == want
    assert vector_blocks.sample_of(rows, 9000).num_rows == 4444
    assert vector_blocks.least_hash(1 << 40, 1 << 16) < -(1 << 63) + (1 << 64) * 1.2 / (1 << 24)


def test_equal_footprints_are_met_once(spark, monkeypatch):
    met, join = [], rays.footprints_met

    def counted(shot, cells, *args):
        met.append(shot.join(cells, F.lit(True)).count())
        return join(shot, cells, *args)

    monkeypatch.setattr(rays, "footprints_met", counted)
    ring = lambda y, x, h: [[(x - h, y - h), (x - h, y + h), (x + h, y + h), (x + h, y - h), (x - h, y - h)]]
    shapes = [(k, ring(40.7, -74.0, 0.0003)) for k in range(9, 400)] + [(500, ring(40.7, -73.999, 0.0003)), (3, ring(40.7002, -74.0, 0.0003))]
    shot = [(1, 40.7001, -74.0001, 40.7002, -74.0002), (2, 40.7, -74.0005, 40.7, -74.0001), (3, 40.7001, -73.9985, 40.7001, -73.9988), (4, 40.7, -74.0, 40.7, -74.0)]
    rows = rays.first_footprint(spark.createDataFrame(shot, "ray int, lat double, lng double, hit_lat double, hit_lng double"), spark.createDataFrame(shapes, "k int, rings array<array<struct<lng:double,lat:double>>>"), "k").collect()
    assert {r.ray: r.k for r in rows} == {1: 3, 2: 3, 3: 500} and {r.ray for r in rows if r.dist_m == 0} == {1}
    assert sum(met) < 100


def test_arcs_are_tables_of_numbers(spark, monkeypatch):
    # Points as Python objects, one dictionary each, took most of the time.
    shapes = spark.createDataFrame([(1, [[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.5, 1.0), (0.0, 1.0), (0.0, 0.0)]]), (2, [[(1.0, 0.0), (2.0, 0.0), (1.0, 1.0), (1.0, 0.0)]])], "k int, rings array<array<struct<lng:double,lat:double>>>")
    told = {(r.k, r.nth): (r.back, [tuple(p) for p in r.points]) for r in simplify.cut(shapes, "k").collect()}
    assert told == {
        (1, 0): (False, [(1.0, 0.0), (1.0, 1.0)]), (1, 1): (True, [(1.0, 0.0), (0.0, 0.0), (0.0, 1.0), (0.5, 1.0), (1.0, 1.0)]),
        (2, 0): (False, [(1.0, 0.0), (2.0, 0.0), (1.0, 1.0)]), (2, 1): (True, [(1.0, 0.0), (1.0, 1.0)]),
    }
    assert simplify.thinned(np.array([(0.0, 0.0), (0.5, 0.01), (1.0, 0.0)]), 0.1).tolist() == [True, False, True]


def test_batches_of_chunks_are_bounded(spark):
    docs = SimpleNamespace(sparkSession=spark, schema={"id": SimpleNamespace(dataType=LongType())}, select=lambda *_: docs, mapInArrow=lambda run, _: run)
    run = chunking.chunks(docs, "id", "t", chunking.by_words)
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(40), pa.int64()), "t": ["ab " * 150_000] * 39 + [None]})
    told = list(run(iter([batch])))
    assert max(sum(map(len, b.column(2).to_pylist())) for b in told) < chunking.HELD + 1501 and sum(b.num_rows for b in told) == 39 * 300
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") in (str(1 << 22), "4194304b")


def test_repeated_sentences_of_an_entry_are_grouped(spark):
    # Distinct items of an array of structs are found by comparing all pairs.
    told = extract.prose_entries(districts.prose(spark, D))
    assert "array_distinct(transform" not in told._jdf.queryExecution().optimizedPlan().toString()


def test_points_and_rings_of_one_place_are_met_once(spark):
    rng = random.Random(8)
    places = [(40.7 + rng.uniform(0, 0.02), -74 + rng.uniform(0, 0.02)) for _ in range(40)]
    points = [(i, *rng.choice(places)) for i in range(3000)] + [(9000, None, 1.0)]
    ring = lambda y, x, h: [(x - h, y - h), (x - h, y + h), (x + h, y + h), (x + h, y - h), (x - h, y - h)]
    spots = [(*rng.choice(places), rng.choice([0.0003, 0.003, 0.012])) for _ in range(25)]
    rings = [(i, ring(*rng.choice(spots))) for i in range(120)]
    inside = spatial.points_in_rings(spark.createDataFrame(points, "a int, lat double, lng double"), spark.createDataFrame(rings, "b int, ring array<struct<lng:double,lat:double>>"), "a", "b")
    got = sorted((r.a, r.b) for r in inside.collect())
    assert got == sorted((a, b) for a, y, x in points[:-1] for b, r in rings if abs(y - (r[0][1] + r[1][1]) / 2) < (r[1][1] - r[0][1]) / 2 and abs(x - (r[0][0] + r[2][0]) / 2) < (r[2][0] - r[0][0]) / 2) and len(got) > 1000


def test_areas_of_lots_near_a_half(spark, tmp_path):
    # Far up the plan 4.5 times 2,000 square metres are crossed, where the points between a lot's corners decided.
    d = enlarged(tmp_path, {"part": 1})
    part = pq.read_table(f"{d}/part.parquet")
    pq.write_table(part.set_column(0, "p_partkey", pa.array(range(142500, 142500 + part.num_rows), pa.int64())), f"{d}/part.parquet")
    assert same_as_sql(spark, d, "lots_simplified") == part.num_rows

def test_runs_of_one_side_join_no_texts(spark):
    # Each misspelt address met all that share a few letters of its number, or the end of it.
    kinds = ["machinery", "furniture", "household"]
    known = [(f"customer#{k * 7919 % 100000:09d} {kinds[k % 3]} street",) for k in range(1500)]
    asked = [(f"custmer#{k * 7919 % 100000:09d} machinery  street",) for k in range(0, 1500, 10)]
    names, streets = spark.createDataFrame(asked, "name string"), spark.createDataFrame(known, "street string")
    measured = reports.like_pairs(names, streets, 0.94, lambda a, b: F.lit(1.0), ".").count()
    got = {(r.name, r.street) for r in reports.like_pairs(names, streets, 0.94, reports.edit_ratio, ".").collect()}

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    assert got == {(a, b) for (a,) in asked[:] for (b,) in known if "mach" in b and 2 * common(a, b) / (len(a) + len(b)) >= 0.94}
    assert len(got) <= measured < 6 * len(got)


def test_equal_buildings_are_looked_at_once(spark, monkeypatch):
    met, within = [], spatial.lines_within
    monkeypatch.setattr(spatial, "lines_within", lambda left, *rest: met.append(left.count()) or within(left, *rest))
    point = lambda y, x: (x, y)
    box = lambda y, x: [point(y - 0.0002, x - 0.0003), point(y - 0.0002, x + 0.0003), point(y + 0.0002, x + 0.0003), point(y + 0.0002, x - 0.0003), point(y - 0.0002, x - 0.0003)]
    buildings = [(k, 40.7 + k % 2 * 0.001, -74.0, box(40.7 + k % 2 * 0.001, -74.0)) for k in range(60)]
    streets = [(s, point(40.699 + s * 0.0004, -74.001), point(40.699 + s * 0.0004, -73.999)) for s in range(9)]
    kind = "struct<lng:double,lat:double>"
    rows = spatial.camera_poses(spark.createDataFrame(buildings, f"building int, lat double, lng double, ring array<{kind}>"), spark.createDataFrame(streets, f"street int, a {kind}, b {kind}"), 600.0, 340.0).collect()
    poses = {(r.building, r.by): r[1:-1] for r in rows}
    assert len(rows) == len(poses) == 180 and all(poses[k, by] == poses[k % 2, by] for k in range(60) for by in ("near", "parallel", "front"))
    assert max(met) <= 2
