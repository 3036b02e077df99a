"""Camera geometry: projection of footprints into a picture, hulls and overlaps. Small helpers for Arrow batches."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gridmill.functions import overlay

# Metres of a degree, picture size, eye height.
DEGREE_M, WIDTH, HEIGHT, EYE_M = 111320.0, 1024, 768, 1.6

Point = tuple[float, float]


def project(lat: float, lng: float, height: float, at: Point, yaw: float, pitch: float, fov: float) -> Point | None:
    """Pixel of a point ``height`` metres above the ground as seen from ``at`` (lat, lng); None behind the camera."""
    east, north = (lng - at[1]) * DEGREE_M * math.cos(math.radians(at[0])), (lat - at[0]) * DEGREE_M
    y, p = math.radians(yaw), math.radians(pitch)
    right, ahead, up = east * math.cos(y) - north * math.sin(y), east * math.sin(y) + north * math.cos(y), height - EYE_M
    depth, rise = ahead * math.cos(p) + up * math.sin(p), up * math.cos(p) - ahead * math.sin(p)
    if depth <= 0.1:
        return None
    f = WIDTH / 2 / math.tan(math.radians(fov) / 2)
    return WIDTH / 2 + f * right / depth, HEIGHT / 2 - f * rise / depth


def hull(points: list[Point]) -> list[Point]:
    """Convex hull, counterclockwise, by the monotone chain."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts
    turn = lambda o, a, b: (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])
    chains = []
    for order in (pts, pts[::-1]):
        chain: list[Point] = []
        for p in order:
            while len(chain) > 1 and turn(chain[-2], chain[-1], p) <= 0:
                chain.pop()
            chain.append(p)
        chains.append(chain[:-1])
    return chains[0] + chains[1]


def area(ring: list[Point]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1]))) / 2


def clip(ring: list[Point], by: list[Point]) -> list[Point]:
    """The part of ``ring`` inside the convex counterclockwise ring ``by``."""
    out = ring
    for a, b in zip(by, by[1:] + by[:1]):
        side = lambda p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])  # noqa: B023, E731
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1]):
            if side(p) >= 0:
                out.append(p)
            if side(p) * side(q) < 0:
                t = side(p) / (side(p) - side(q))
                out.append((p[0] + t * (q[0] - p[0]), p[1] + t * (q[1] - p[1])))
    return out


def overlap(a: list[Point], b: list[Point]) -> float:
    """Intersection over union of two convex rings."""
    if len(a) < 3 or len(b) < 3:
        return 0.0
    common = area(clip(a, b))
    return common / (area(a) + area(b) - common)


def picture_overlap(rows: DataFrame, at: Point, yaw: float, pitch: float, fov: float, mask: list[Point], key: str) -> DataFrame:
    """(key, pixels, overlap): each building's hull in the picture against a convex mask.

    Needs key, ring (array of lng, lat) and height in metres; buildings behind the camera have no hull.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, shares = [], []
            for ring, tall in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen = [project(p["lat"], p["lng"], h, at, yaw, pitch, fov) for p in ring or [] for h in (0.0, tall or 9.0)]
                shape = hull([p for p in seen if p])
                sizes.append(area(shape) if len(shape) > 2 else 0.0)
                shares.append(overlap(shape, hull(mask)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.float64()), pa.array(shares, pa.float64())], names=[key, "pixels", "overlap"])

    return rows.select(key, "ring", "height").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, pixels double, overlap double")


def visible_areas(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``visible_m2``: what of each ring lies in the convex ring ``cone``, both arrays of (lng, lat).

    Both are laid on the plane that touches the earth at the cone's apex, its first point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ring, cone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                apex = cone[0]
                wide = DEGREE_M * math.cos(math.radians(apex["lat"]))
                flat = lambda pts: [((p["lng"] - apex["lng"]) * wide, (p["lat"] - apex["lat"]) * DEGREE_M) for p in pts]  # noqa: B023, E731
                shape = clip(flat(ring[:-1]), hull(flat(cone)))
                out.append(area(shape) if len(shape) > 2 else 0.0)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[key, "visible_m2"])

    return rows.select(key, "ring", "cone").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, visible_m2 double")


def areas_in(rows: DataFrame, key: str) -> DataFrame:
    """(key, visible_m2): what of each footprint, an array of rings, lies in the ring ``cone``; concave rings, holes and several parts count as they are.

    Both are laid on the plane that touches the earth at the cone's apex, its first point.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rings, cone in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                apex = cone[0]
                wide = DEGREE_M * math.cos(math.radians(apex["lat"]))
                flat = lambda pts: [((p["lng"] - apex["lng"]) * wide, (p["lat"] - apex["lat"]) * DEGREE_M) for p in pts]  # noqa: B023, E731
                out.append(overlay.common_area([flat(r) for r in rings or [] if r], [flat(cone)]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.float64())], names=[key, "visible_m2"])

    return rows.select(key, "rings", "cone").mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, visible_m2 double")
