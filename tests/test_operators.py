import json
import math
import random
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridmill.functions import camera, community, geo
from gridmill.functions import text as X
from gridmill.operators import chunking, fusion, keyed, spatial
from gridmill.sources import tables


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_trigram_anchors(spark):
    assert round(one(spark, X.trigram_similarity(F.lit("chrylser"), F.lit("Chrysler Building"))), 4) == 0.2273
    assert one(spark, X.word_similarity(F.lit("chrysler"), F.lit("Chrysler Building"))) == 1.0
    assert one(spark, X.word_similarity(F.lit(""), F.lit("x"))) == 0.0


def test_cell_join_is_the_full_join_cut_at_the_radius(spark):
    rng = random.Random(1)
    a = [(i, 40 + rng.random() / 50, -74 + rng.random() / 50) for i in range(120)]
    b = [(i, 40 + rng.random() / 50, -74 + rng.random() / 50) for i in range(120)] + [(500, None, None)]
    left, right = spark.createDataFrame(a, "a long, y double, x double"), spark.createDataFrame(b, "b long, y2 double, x2 double")
    got = {(r.a, r.b) for r in spatial.cell_join(left, right, 250, ("y", "x"), ("y2", "x2")).collect()}
    full = left.crossJoin(right).where(geo.haversine(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")) <= 250)
    assert got == {(r.a, r.b) for r in full.collect()} and got


@pytest.mark.parametrize("lat", [40.0, 75.0, 89.9, -89.99])
def test_cell_join_holds_at_any_latitude_and_across_the_date_line(spark, lat):
    rng = random.Random(2)
    spread = 0.004 / max(0.0005, math.cos(math.radians(lat)))
    wrapped = lambda x: (x + 180) % 360 - 180
    points = lambda n: [(i, max(-90.0, min(90.0, lat + (rng.random() - 0.5) / 120)), wrapped(180 + (rng.random() - 0.5) * spread)) for i in range(n)]
    left, right = spark.createDataFrame(points(90), "a long, y double, x double"), spark.createDataFrame(points(90), "b long, y2 double, x2 double")
    got = [(r.a, r.b) for r in spatial.cell_join(left, right, 250, ("y", "x"), ("y2", "x2")).collect()]
    full = left.crossJoin(right).where(geo.haversine(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")) <= 250)
    assert sorted(got) == sorted((r.a, r.b) for r in full.collect()) and got


def test_collapse_walks_in_order_within_a_page(spark):
    rows = [(0, "dakota", 40.0, -74.0, 0.9), (1, "dakota", 40.001, -74.0, 0.8), (2, "dakota", 40.0022, -74.0, 0.7), (3, "", 40.0, -74.0, 0.6), (4, "dakota", None, -74.0, 0.5), (5, "plaza", 40.0, -74.0, 0.4)]
    hits = spark.createDataFrame([(p, *r) for p in (1, 2) for r in rows], "page int, pos int, norm_name string, lat double, lng double, score double").where("page = 1 OR pos = 1")
    assert sorted((r.page, r.pos) for r in spatial.collapse_near(hits).collect()) == [(1, 0), (1, 2), (1, 3), (1, 4), (1, 5), (2, 1)]


def test_geodesics_and_missing_places(spark):
    metres = lambda *at: one(spark, geo.spheroid_distance(*map(F.lit, at)))
    assert math.isclose(metres(-37.95103341666667, 144.42486788888888, -37.65282113888889, 143.92649552777777), 54972.271, abs_tol=0.01)
    assert metres(40.0, -74.0, 40.0, -74.0) == 0.0 and math.isclose(metres(0.0, 0.0, 0.0, 1.0), 111319.491, abs_tol=0.01)
    assert one(spark, geo.haversine(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0))) is None


@pytest.mark.parametrize("scores, kept", [([1.0, 0.9, 0.5, 0.35, 0.2, 0.05], 3), ([1.0, 0.1, 0.1, 0.1], 3), ([0.0, -1.0, -2.0, -3.0], 4), ([1.0, 0.9, 0.8, 0.4], 4)])
def test_relevance_floor(spark, scores, kept):
    hits = spark.createDataFrame([(1, float(s)) for s in scores], "page int, score double")
    assert fusion.relevance_floor(hits, [F.desc("score")], "page").count() == kept


def test_keyed_tables_and_nulls(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 2), (None, "n", 3)], "k int, v string, w int")
    new = spark.createDataFrame([(2, "b", None), (3, "c", 5)], "k int, v string, w int")
    assert {tuple(r) for r in keyed.merge(old, new, ["k"]).collect()} == {(1, "a", 1), (2, "b", 2), (None, "n", 3), (3, "c", 5)}
    assert {tuple(r) for r in keyed.upsert(old, new, ["k"]).collect()} == {(1, "a", 1), (None, "n", 3), (2, "b", None), (3, "c", 5)}
    assert keyed.insert_missing(old, old, ["k"]).where("k IS NULL").count() == 2


def test_decay_counts_whole_days(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    decay = lambda since: one(spark, community.decay(at(since), F.lit(None).cast("timestamp"), at("2024-06-01 00:00:00")))
    assert decay("2024-03-04 00:00:01") == 1.0 and decay("2024-03-03 00:00:00") == 1.0 and decay("2020-01-01") == 0.5
    assert math.isclose(decay("2023-08-07 00:00:00"), 1 - (299 - 90) / 365 * 0.5)


def test_geometry(spark):
    ring = F.array(*[F.struct(F.lit(x).alias("lng"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (0.01, 0.0), (0.01, 0.01), (0.0, 0.01), (0.0, 0.0))])
    assert one(spark, geo.in_ring(F.lit(0.005), F.lit(0.005), ring)) and not one(spark, geo.in_ring(F.lit(0.02), F.lit(0.005), ring))
    assert abs(one(spark, geo.ring_area(ring)) / (0.01 * geo.DEGREE_M) ** 2 - 1) < 1e-3
    assert len(one(spark, geo.view_cone(F.lit(40.0), F.lit(-74.0), F.lit(90.0), F.lit(100.0), F.lit(60.0)))) == 15
    assert round(one(spark, geo.bearing_gap(F.lit(350.0), F.lit(10.0)))) == 20


def test_camera():
    square = [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)]
    assert camera.hull([*square, (1.0, 1.0)]) == square and camera.area(square) == 4
    assert math.isclose(camera.overlap(square, [(1.0, 0.0), (3.0, 0.0), (3.0, 2.0), (1.0, 2.0)]), 1 / 3)
    assert camera.project(40.001, -74.0, camera.EYE_M, (40.0, -74.0), 0, 0, 90) == (512.0, 384.0)
    assert camera.project(39.999, -74.0, 1.6, (40.0, -74.0), 0, 0, 90) is None


def test_chunks_cover_the_text(spark):
    text = "A sentence stands here. " * 400 + "\n\n" + "Another one follows. " * 300
    whole = list(chunking.by_characters(text))
    assert whole[0] == text[: len(whole[0])] and all(len(c) <= 1500 for c in whole) and text.strip().endswith(whole[-1])
    assert " ".join(chunking.by_words(text)).split() == text.split()
    df = spark.createDataFrame([(1, text), (2, None), (3, "short")], "id long, t string")
    assert {r.id for r in chunking.chunks(df, "id", "t", chunking.by_characters).collect()} == {1}
    assert {r.id for r in chunking.chunks(df, "id", "t", chunking.by_words).collect()} == {1, 3}
    assert all(100 < len(c) <= 2000 for c in chunking.by_pages(text))


def test_text_tables_logs_and_optional_columns(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('﻿BIN,Year Built\n100,"1,931"\n101,x\n', encoding="utf-8")
    df = tables.read_text_table(spark, str(path))
    assert df.columns == ["bin", "year_built"]
    shaped = tables.with_columns_of(df, T.StructType().add("bin", T.IntegerType()).add("year_built", T.IntegerType()).add("style", "string"))
    assert {tuple(r) for r in shaped.collect()} == {(100, None, None), (101, None, None)}
    log = str(tmp_path / "log")
    tables.append_log(df.where("bin = '100'"), log)
    assert [r.bin for r in tables.unfinished(df, spark.read.json(log), ["bin"]).collect()] == ["101"]


def test_shards_landed_json_and_rejected_rows(spark, tmp_path):
    for i in range(3):
        spark.range(10).selectExpr(f"id + {10 * i} AS id", "id % 2 AS odd", "'x' AS unused").write.parquet(f"{tmp_path}/s{i}")
    rows = tables.read_shards(spark, [f"{tmp_path}/s{i}" for i in (0, 2)], ["id"], F.col("odd") == 1)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.id for r in rows.collect()) == [1, 3, 5, 7, 9, 21, 23, 25, 27, 29]
    assert "unused" not in plan and "PushedFilters: [IsNotNull(odd), EqualTo(odd,1)]" in plan
    (tmp_path / "landed").mkdir()
    (tmp_path / "landed" / "a.json").write_text(json.dumps({"n": 2, "features": [{"bin": "1", "year": 1900}, {"bin": " "}]}, indent=1))
    (tmp_path / "landed" / "b.json").write_text(json.dumps({"n": 0}))
    found = tables.read_landed_json(spark, str(tmp_path / "landed"), "bin string, year int", "features")
    kept, rejected = tables.accepted(found, ["bin"])
    assert [tuple(r) for r in kept.collect()] == [("1", 1900)] and rejected.count() == 1
    assert sorted(r.n for r in tables.read_landed_json(spark, str(tmp_path / "landed"), "n int").collect()) == [0, 2]


def test_paged_source_reads_every_page_once(spark):
    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            offset, limit = (int(x) for x in self.path.strip("/").split("-"))
            body = json.dumps([{"id": i, "name": f"n{i}"} for i in range(offset, min(25, offset + limit))]).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    tables.register(spark)
    df = spark.read.format("paged_json").schema("id string, name string").option("url", f"http://127.0.0.1:{server.server_port}/{{offset}}-{{limit}}").option("limit", 10).option("total", 25).load()
    assert sorted(int(r.id) for r in df.collect()) == list(range(25))
    server.shutdown()


def test_streamed_events_are_counted_once(spark, tmp_path):
    from gridmill.streaming import daily

    rows = [(1, "2024-01-01 10:00:00"), (1, "2024-01-01 10:05:00"), (2, "2024-01-02 09:00:00")]
    source = str(tmp_path / "in")
    spark.createDataFrame(rows, "event_id long, t string").select("event_id", F.col("t").cast("timestamp").alias("ts")).write.parquet(source)
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(source)
    daily.run_available(daily.unique(stream), str(tmp_path / "out"), "append")
    assert sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out/rows")).collect()) == [1, 2]


def test_visible_area_of_squares_in_a_cone(spark):
    p = lambda x, y: {"lng": -74.0 + x, "lat": float(y)}
    ring = lambda x, y: [p(x - 1e-4, y - 1e-4), p(x + 1e-4, y - 1e-4), p(x + 1e-4, y + 1e-4), p(x - 1e-4, y + 1e-4), p(x - 1e-4, y - 1e-4)]
    cone = [p(0, 0), p(-0.01, 0.01), p(0.01, 0.01), p(0, 0)]
    rows = spark.createDataFrame([(1, ring(0, 0.005), cone), (2, ring(0.005, 0.005), cone), (3, ring(0.01, 0.0), cone)], "k int, ring array<struct<lng:double,lat:double>>, cone array<struct<lng:double,lat:double>>")
    got = {r.k: r.visible_m2 for r in camera.visible_areas(rows, "k").collect()}
    full = (2e-4 * geo.DEGREE_M) ** 2
    assert math.isclose(got[1], full, rel_tol=1e-6) and math.isclose(got[2], full / 2, rel_tol=1e-6) and got[3] == 0
