"""Rays, common parts and masks against plain brute force."""

import base64
import math
import random

import pytest

from gridmill.functions import camera, masks, overlay
from gridmill.operators import rays


def star(rng, x, y, r, n):
    """A ring around a point that may be concave, but does not cross itself."""
    turns = sorted(rng.uniform(0, 2 * math.pi) for _ in range(n))
    return [(x + (q := r * rng.uniform(0.3, 1)) * math.cos(t), y + q * math.sin(t)) for t in turns]


def holds(rings, x, y):
    odd = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
            odd ^= (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax
    return odd


def test_common_area_is_that_of_a_fine_grid():
    rng = random.Random(4)
    shapes = {
        "l": [[(0, 0), (4, 0), (4, 1), (1, 1), (1, 3), (0, 3)]], "u": [[(0, 0), (4, 0), (4, 4), (3, 4), (3, 1), (1, 1), (1, 4), (0, 4)]],
        "yard": [[(0, 0), (4, 0), (4, 4), (0, 4)], [(1, 1), (3, 1), (3, 3), (1, 3)]], "parts": [[(0, 0), (1, 0), (1, 1)], [(2, 2), (4, 2), (3, 4)]],
    }
    for _ in range(8):
        shapes[f"star{_}"] = [star(rng, 2, 2, 2, 11), star(rng, 2, 2, 0.5, 5)]
    cones = [[[(0.5, -1), (6, 1.5), (5, 4), (2, 5)]], [star(rng, 2, 2, 3, 9)], [[(0, 0), (4, 0), (4, 4), (0, 4)]], [[(9, 9), (10, 9), (9, 10)]]]
    centres = [0.02 + 0.04 * i for i in range(100)]
    for a in shapes.values():
        for b in cones:
            grid = sum(holds(a, x, y) and holds(b, x, y) for x in centres for y in centres) * 0.04**2
            got = overlay.common_area(a, b)
            assert abs(got - grid) < 0.12, (got, grid)
            assert abs(overlay.common_area(b, a) - got) < 1e-9
    assert overlay.common_area(shapes["yard"], cones[2]) == pytest.approx(12)
    assert overlay.common_area(shapes["l"], shapes["yard"]) == pytest.approx(6)
    assert overlay.common_area([], cones[0]) == overlay.common_area([[(0, 0)]], cones[0]) == 0


def test_areas_of_footprints_without_rings(spark):
    cone = [(0.0, 0.0), (0.001, 0.001), (-0.001, 0.001), (0.0, 0.0)]
    rows = spark.createDataFrame([(1, None, cone), (2, [], cone), (3, [[]], cone), (4, [cone], cone)], "k int, rings array<array<struct<lng:double,lat:double>>>, cone array<struct<lng:double,lat:double>>")
    got = {r.k: r.visible_m2 for r in camera.areas_in(rows, "k").collect()}
    assert got[1] == got[2] == got[3] == 0 and got[4] == pytest.approx(111.32**2, rel=1e-6)


def meets(p, q, a, b):
    cross = lambda o, u, v: (u[0] - o[0]) * (v[1] - o[1]) - (u[1] - o[1]) * (v[0] - o[0])
    return cross(a, b, p) * cross(a, b, q) <= 0 and cross(p, q, a) * cross(p, q, b) <= 0


def apart(x, y, a, b):
    k = math.cos(math.radians(y)) * 111320
    (ax, ay), (bx, by) = (((u - x) * k, (v - y) * 111320.0) for u, v in (a, b))
    dx, dy = bx - ax, by - ay
    t = max(0, min(1, -(ax * dx + ay * dy) / (dx * dx + dy * dy)))
    return math.hypot(ax + t * dx, ay + t * dy)


def test_rays_meet_what_all_pairs_meet(spark):
    rng = random.Random(9)
    shapes = {}
    for k in range(300):
        x, y = -74 + rng.uniform(0, 0.02), 40.7 + rng.uniform(0, 0.02)
        r = rng.choice([0.0001, 0.0003, 0.001, 0.006])
        shapes[k] = [star(rng, x, y, r, 9)] + ([star(rng, x, y, r / 4, 4)] if k % 3 == 0 else [])
    shots = [(i, 40.7 + rng.uniform(0, 0.02), -74 + rng.uniform(0, 0.02)) for i in range(250)]
    shots = [(i, y, x, y + rng.uniform(-0.001, 0.001), x + rng.uniform(-0.001, 0.001) * (i % 4 > 0)) for i, y, x in shots] + [(900, 40.7, -74.0, 40.7, -74.0), (901, None, -74.0, 40.7, -74.0), (902, 10.0, 10.0, 10.001, 10.0)]
    ring = lambda pts: [*pts, pts[0]]
    got = {
        r.ray: (r.k, r.dist_m)
        for r in rays.first_footprint(
            spark.createDataFrame(shots, "ray int, lat double, lng double, hit_lat double, hit_lng double"),
            spark.createDataFrame([(k, [ring(r) for r in rings]) for k, rings in shapes.items()] + [(990, []), (991, None)], "k int, rings array<array<struct<lng:double,lat:double>>>"), "k",
        ).collect()
    }
    want = {}
    for i, y, x, hy, hx in shots:
        if y is None:
            continue
        seg = math.hypot((hy - y) * 111000, (hx - x) * 111000 * math.cos(math.radians(y)))
        if seg < 0.5:
            continue
        q = (x + (hx - x) * (seg + 30) / seg, y + (hy - y) * (seg + 30) / seg)
        found = []
        for k, rings in shapes.items():
            edges = [e for r in rings for e in zip(r, r[1:] + r[:1])]
            if holds(rings, x, y):
                found.append((0.0, k))
            elif any(meets((x, y), q, a, b) for a, b in edges):
                found.append((round(min(apart(x, y, a, b) for a, b in edges), 2), k))
        if found and min(found)[0] <= 200:
            want[i] = min(found)[::-1]
    assert len(want) > 100 and got == want


def test_a_long_ray_and_no_footprints(spark):
    shot = spark.createDataFrame([(1, 40.0, -75.0, 41.0, -74.0)], "ray int, lat double, lng double, hit_lat double, hit_lng double")
    ring = [(-74.4999, 40.5), (-74.4999, 40.5003), (-74.5003, 40.5003), (-74.5003, 40.5), (-74.4999, 40.5)]
    shape = spark.createDataFrame([(7, [ring])], "k int, rings array<array<struct<lng:double,lat:double>>>")
    assert rays.first_footprint(shot, shape, "k").count() == 0  # met, but too far from the origin
    assert rays.first_footprint(shot, shape, "k", farthest_m=1e6).first().k == 7
    assert rays.first_footprint(shot, shape.where("false"), "k").count() == 0


def test_runs_count_what_pixels_count(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for k in range(60):
        w, h = rng.randint(1, 20), rng.randint(1, 20)
        data = bytes(rng.choice([0, 127, 128, 255]) for _ in range(w * h))
        shape = [(rng.uniform(-0.2, 1.2), rng.uniform(-0.2, 1.2)) for _ in range(rng.randint(3, 7))]
        rows.append((k, base64.b64encode(data).decode(), w, h, shape))
        pixels = sum(b >= 128 for b in data)
        hits = sum(data[y * w + x] >= 128 and holds([shape], (x + 0.5) / w, (y + 0.5) / h) for y in range(h) for x in range(w))
        union = pixels + max(0, masks.area(shape) * w * h - hits)
        want[k] = (pixels, hits, pytest.approx(hits / union if pixels else 0.0))
    odd = [(90, None, 3, 3, shape), (91, "!", 3, 3, shape), (92, base64.b64encode(b"xx").decode(), 3, 3, shape), (93, base64.b64encode(b"\xff").decode(), 1, 1, None), (94, "", 0, 0, [])]
    df = spark.createDataFrame(rows + odd, "k int, mask string, width int, height int, shape array<struct<x:double,y:double>>")
    got = {r.k: (r.pixels, r.hits, r.overlap) for r in masks.mask_overlaps(df, "k").collect()}
    assert {k: v for k, v in got.items() if k < 90} == want
    assert [got[k] for k in (90, 91, 92, 93, 94)] == [(None, None, 0.0)] * 3 + [(1, 0, 0.0), (None, None, 0.0)]
    assert masks.box_overlap([(0, 0), (2, 2)], [(1, 1), (3, 3)]) == pytest.approx(1 / 7) and masks.box_overlap([(0, 0), (1, 1)], [(1, 1), (3, 3)]) == 0
