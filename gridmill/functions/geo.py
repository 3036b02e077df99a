"""Geometry on the sphere and the plane as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridmill.functions.bind import bind

# Radius of the earth in metres, metres of a degree of latitude.
EARTH_M, DEGREE_M = 6371000.0, 111320.0


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.when(a > 1, 1.0).otherwise(F.sqrt(a)))  # least() would turn a null into the farthest point


def flat_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Equirectangular metres, good for short ways."""
    return F.sqrt(F.pow((lat2 - lat1) * DEGREE_M, 2) + F.pow((lng2 - lng1) * DEGREE_M * F.cos(F.radians(lat1)), 2))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Forward bearing on the sphere, 0 to 360."""
    d = F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def planar_azimuth(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Azimuth in the plane of degrees, 0 to 360; differs from ``bearing`` off the cardinal axes."""
    return F.pmod(F.degrees(F.atan2(lng2 - lng1, lat2 - lat1)) + 360, F.lit(360.0))


def bearing_gap(a: Column, b: Column) -> Column:
    return F.abs(F.pmod(a - b + 540, F.lit(360.0)) - 180)


def cell(value: Column, size: float) -> Column:
    return F.floor(value / size)


def destination(lat: Column, lng: Column, towards: Column, metres: Column) -> Column:
    """(lng, lat) of the point that lies ``metres`` away in direction ``towards``."""
    d, b, p = metres / EARTH_M, F.radians(towards), F.radians(lat)
    q = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(b))
    dl = F.atan2(F.sin(b) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(q))
    return F.struct((lng + F.degrees(dl)).alias("lng"), F.degrees(q).alias("lat"))


def view_cone(lat: Column, lng: Column, towards: Column, metres: Column, angle: Column, steps: int = 12) -> Column:
    """The ring of a view cone: the apex, steps + 1 points of the arc, the apex again."""
    apex = F.array(F.struct(lng.alias("lng"), lat.alias("lat")))
    arc = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: destination(lat, lng, towards - angle / 2 + angle * i / steps, metres))
    return F.concat(apex, arc, apex)


def edges(ring: Column) -> Column:
    return F.zip_with(F.slice(ring, 1, F.size(ring) - 1), F.slice(ring, 2, F.size(ring) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))


def in_ring(lat: Column, lng: Column, ring: Column) -> Column:
    """Even-odd test of a point against a closed ring of (lng, lat)."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > lat) != (b["lat"] > lat)
        at = (b["lng"] - a["lng"]) * F.try_divide(lat - a["lat"], b["lat"] - a["lat"]) + a["lng"]
        return spans & F.coalesce(lng < at, F.lit(False))

    return F.size(F.filter(edges(ring), crosses)) % 2 == 1


def crosses(ring: Column, e: Column) -> Column:
    """Cross product of an edge, taken from the ring's first point so that no digits are lost."""
    o = ring[0]
    return (e["a"]["lng"] - o["lng"]) * (e["b"]["lat"] - o["lat"]) - (e["b"]["lng"] - o["lng"]) * (e["a"]["lat"] - o["lat"])


def ring_area(ring: Column, lat0: Column | None = None) -> Column:
    """Square metres of a closed ring, by the shoelace rule on the plane at the latitude ``lat0``, or else its points' mean."""
    if lat0 is None:
        lat0 = F.aggregate(ring, F.lit(0.0), lambda s, p: s + p["lat"]) / F.size(ring)
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + crosses(ring, e))
    return F.abs(twice) / 2 * DEGREE_M * DEGREE_M * F.cos(F.radians(lat0))


def ring_centroid(ring: Column) -> Column:
    """(lng, lat) of the area's centre; degenerate rings have none."""
    o = ring[0]
    twice = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + crosses(ring, e))
    lng = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["lng"] + e["b"]["lng"] - 2 * o["lng"]) * crosses(ring, e))
    lat = F.aggregate(edges(ring), F.lit(0.0), lambda s, e: s + (e["a"]["lat"] + e["b"]["lat"] - 2 * o["lat"]) * crosses(ring, e))
    return F.when(twice != 0, F.struct((o["lng"] + lng / (3 * twice)).alias("lng"), (o["lat"] + lat / (3 * twice)).alias("lat")))


def longest_edge(ring: Column) -> Column:
    """(metres, azimuth) of a ring's longest edge."""
    told = F.transform(edges(ring), lambda e: F.struct(flat_distance(e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"]).alias("metres"), bearing(e["a"]["lat"], e["a"]["lng"], e["b"]["lat"], e["b"]["lng"]).alias("azimuth")))
    return F.array_max(told)


def segment_distance(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """Metres from a point to the segment a-b, on the point's tangent plane."""
    k = F.cos(F.radians(lat)) * DEGREE_M
    ax, ay, bx, by = (a["lng"] - lng) * k, (a["lat"] - lat) * DEGREE_M, (b["lng"] - lng) * k, (b["lat"] - lat) * DEGREE_M
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide(-(ax * dx + ay * dy), dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt(F.pow(ax + t * dx, 2) + F.pow(ay + t * dy, 2))


def segments_meet(p: Column, q: Column, a: Column, b: Column) -> Column:
    """Whether the segments p-q and a-b have a point in common."""
    side = lambda u, v, w: F.signum((v["lng"] - u["lng"]) * (w["lat"] - u["lat"]) - (v["lat"] - u["lat"]) * (w["lng"] - u["lng"]))
    within = lambda u, v, w: (w["lng"].between(F.least(u["lng"], v["lng"]), F.greatest(u["lng"], v["lng"]))) & (w["lat"].between(F.least(u["lat"], v["lat"]), F.greatest(u["lat"], v["lat"])))
    s1, s2, s3, s4 = side(a, b, p), side(a, b, q), side(p, q, a), side(p, q, b)
    return ((s1 != s2) & (s3 != s4)) | ((s1 == 0) & within(a, b, p)) | ((s2 == 0) & within(a, b, q)) | ((s3 == 0) & within(p, q, a)) | ((s4 == 0) & within(p, q, b))


def border_met(lat: Column, lng: Column, dlat: float, dlng: float, south: Column, north: Column, west: Column, east: Column) -> Column:
    """Whether the segment from a point to one ``dlat`` and ``dlng`` from it meets the border of a box; touching counts, lying inside does not.

    The shares of the segment at which it enters and leaves the box in either direction tell it.
    """

    def span(at: Column, d: float, low: Column, high: Column) -> tuple[Column, Column]:
        if d == 0:
            within = at.between(low, high)
            return F.when(within, float("-inf")).otherwise(float("inf")), F.when(within, float("inf")).otherwise(float("-inf"))
        first, last = (low, high) if d > 0 else (high, low)
        return (first - at) / d, (last - at) / d

    (x1, x2), (y1, y2) = span(lng, dlng, west, east), span(lat, dlat, south, north)
    enters, leaves = F.greatest(x1, y1), F.least(x2, y2)
    return (F.greatest(enters, F.lit(0.0)) <= F.least(leaves, F.lit(1.0))) & ~((enters < 0) & (leaves > 1))


def visibility(dist: Column, gap: Column, cone: Column, visible_m2: Column, area_sqft: Column, height_ft: Column) -> Column:
    """Score 0 to 100 of a building in a view cone; a missing area counts as fully visible, a missing height as 30 ft."""
    share = F.try_divide(visible_m2, F.nullif(area_sqft, F.lit(0.0)) * 0.0929)
    return 100 * (
        0.40 * F.exp(-dist / 30.0)
        + 0.30 * F.greatest(F.lit(0.0), 1 - gap / (cone / 2))
        + 0.20 * F.coalesce(F.least(F.lit(1.0), share), F.lit(1.0))
        + 0.10 * F.least(F.lit(1.0), F.coalesce(height_ft, F.lit(30.0)) / 200.0)
    )


def height_bonus(score: Column, pitch: Column, height_ft: Column) -> Column:
    """The score when the camera looks up by more than 20 degrees."""
    return F.when(pitch > 20, F.least(F.lit(100.0), score + height_ft / 200 * ((pitch - 20) / 70) * 10)).otherwise(score)


def reach_deg(metres: float, lat: float = 40.7) -> tuple[float, float]:
    """Degrees of (lat, lng) that ``metres`` span at a latitude, with a margin of a fiftieth."""
    return 1.02 * metres / DEGREE_M, 1.02 * metres / (DEGREE_M * math.cos(math.radians(lat)))


def widest_lng(lat: float, metres: float) -> float:
    """Degrees of longitude that a circle around a point spans on each side; 180 if it holds a pole."""
    angle = metres / EARTH_M
    if abs(math.radians(lat)) + angle >= math.pi / 2:
        return 180.0
    return math.degrees(math.asin(math.sin(angle) / math.cos(math.radians(lat))))


def rings_of_wkt(wkt: Column) -> Column:
    """Outer and inner rings, arrays of (lng, lat), of a POLYGON or MULTIPOLYGON in WKT."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def point(pair: Column) -> Column:
        xy = F.split(F.trim(pair), r"\s+")
        return F.struct(xy[0].cast("double").alias("lng"), xy[1].cast("double").alias("lat"))

    return F.transform(rings, lambda r: F.transform(F.split(r, ","), point))


# The ellipsoid WGS 84.
SEMI_MAJOR_M, FLATTENING = 6378137.0, 1 / 298.257223563


def spheroid_distance(lat1: Column, lng1: Column, lat2: Column, lng2: Column, rounds: int = 10) -> Column:
    """Metres of the geodesic on the ellipsoid, by Vincenty's inverse formula; points nearly opposite do not converge."""
    minor = SEMI_MAJOR_M * (1 - FLATTENING)
    u1, u2 = (F.atan((1 - FLATTENING) * F.tan(F.radians(p))) for p in (lat1, lat2))
    given = F.struct(F.sin(u1).alias("s1"), F.cos(u1).alias("c1"), F.sin(u2).alias("s2"), F.cos(u2).alias("c2"), F.radians(lng2 - lng1).alias("apart"))

    def arc(g: Column, lam: Column, body: Callable[[Column], Column]) -> Column:
        """``body`` of sine and cosine of the arc, the arc, sine of the azimuth at the equator, its squared cosine, cosine of twice the middle."""
        s1, c1, s2, c2 = g["s1"], g["c1"], g["s2"], g["c2"]
        turned = F.struct(F.sin(lam).alias("s"), F.cos(lam).alias("c"))
        arcs = lambda t: F.struct(F.sqrt(F.pow(c2 * t["s"], 2) + F.pow(c1 * s2 - s1 * c2 * t["c"], 2)).alias("sine"), (s1 * s2 + c1 * c2 * t["c"]).alias("cosine"), t["s"].alias("s"))
        leant = lambda a: F.struct(a["sine"].alias("sine"), a["cosine"].alias("cosine"), F.coalesce(F.try_divide(c1 * c2 * a["s"], a["sine"]), F.lit(0.0)).alias("azimuth"))
        flat = lambda a: F.struct(a["sine"].alias("sine"), a["cosine"].alias("cosine"), a["azimuth"].alias("azimuth"), (1 - a["azimuth"] * a["azimuth"]).alias("flat"))
        middle = lambda a: F.struct(a["sine"].alias("sine"), a["cosine"].alias("cosine"), a["azimuth"].alias("azimuth"), a["flat"].alias("flat"), F.atan2(a["sine"], a["cosine"]).alias("sigma"), (a["cosine"] - F.coalesce(F.try_divide(2 * s1 * s2, a["flat"]), F.lit(0.0))).alias("middle"))
        return bind(turned, lambda t: bind(arcs(t), lambda a: bind(leant(a), lambda b: bind(flat(b), lambda c: bind(middle(c), body)))))

    def step(g: Column, lam: Column) -> Column:
        def next_(t: Column) -> Column:
            more = FLATTENING / 16 * t["flat"] * (4 + FLATTENING * (4 - 3 * t["flat"]))
            return bind(more, lambda c: g["apart"] + (1 - c) * FLATTENING * t["azimuth"] * (t["sigma"] + c * t["sine"] * (t["middle"] + c * t["cosine"] * (2 * t["middle"] * t["middle"] - 1))))

        return arc(g, lam, next_)

    def metres(t: Column) -> Column:
        u = t["flat"] * (SEMI_MAJOR_M**2 - minor**2) / minor**2
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        m, cosine, sine = t["middle"], t["cosine"], t["sine"]
        bend = b * sine * (m + b / 4 * (cosine * (2 * m * m - 1) - b / 6 * m * (4 * sine * sine - 3) * (4 * m * m - 3)))
        return minor * a * (t["sigma"] - bend)

    return bind(given, lambda g: bind(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), g["apart"], lambda lam, _: step(g, lam)), lambda lam: arc(g, lam, metres)))


def ground_point(across: Column, down: Column, lat: Column, lng: Column, yaw: Column, pitch: Column, focal: float, size: tuple[int, int], depth: Column, eye: float = 1.6, most: float = 150.0) -> Column:
    """(lat, lng) of what a pixel, as shares of the picture's width and height, shows; null if that can't be told.

    With a depth the ray ends there. Without one it ends on flat ground below the eye, so it must fall. A
    positive pitch is tilted up. Beyond ``most`` nothing is told: metres of a given depth, and without one
    times the ray's length to the picture, as the product has it.
    """
    right, below = (across - 0.5) * size[0], (down - 0.5) * size[1]
    p, y = F.radians(pitch), F.radians(yaw)
    up, ahead = focal * F.sin(p) - below * F.cos(p), below * F.sin(p) + focal * F.cos(p)
    east, north = right * F.cos(y) + ahead * F.sin(y), ahead * F.cos(y) - right * F.sin(y)
    deep = depth / F.sqrt(east * east + north * north + up * up)
    flat = F.when(up < -1e-3, F.try_divide(F.lit(-eye), up))
    times = F.when(depth > 0, F.when(depth <= most, deep)).otherwise(F.when(flat.between(0, most), flat))
    shown = across.between(0, 1) & down.between(0, 1) & times.isNotNull()
    return F.when(shown, F.struct((lat + F.degrees(times * north / EARTH_M)).alias("lat"), (lng + F.degrees(times * east / (EARTH_M * F.cos(F.radians(lat))))).alias("lng")))


def facade_score(ring: Column, lat: Column, lng: Column, left: Column, right: Column) -> Column:
    """Mean metres between the ends of a facade and of the ring's edge nearest the camera, either way round; infinite without a ring."""
    middle = lambda e: flat_distance(lat, lng, (e["a"]["lat"] + e["b"]["lat"]) / 2, (e["a"]["lng"] + e["b"]["lng"]) / 2)
    front = F.array_min(F.transform(edges(ring), lambda e: F.struct(middle(e).alias("far"), e["a"].alias("a"), e["b"].alias("b"))))
    ends = lambda p, q: (haversine(left["lat"], left["lng"], p["lat"], p["lng"]) + haversine(right["lat"], right["lng"], q["lat"], q["lng"])) / 2
    return F.coalesce(F.least(ends(front["a"], front["b"]), ends(front["b"], front["a"])), F.lit(float("inf")))


def segment_gap(a: Column, b: Column, p: Column, q: Column) -> Column:
    """Metres between two segments of (lng, lat), 0 where they meet."""
    apart = F.least(*[segment_distance(x["lat"], x["lng"], y, z) for x, y, z in ((a, p, q), (b, p, q), (p, a, b), (q, a, b))])
    return F.when(segments_meet(a, b, p, q), 0.0).otherwise(apart)


def closest_on_segment(lat: Column, lng: Column, a: Column, b: Column) -> Column:
    """(lng, lat) of the point of a segment that is nearest to a point, in the plane of degrees."""
    dx, dy = b["lng"] - a["lng"], b["lat"] - a["lat"]
    t = F.coalesce(F.try_divide((lng - a["lng"]) * dx + (lat - a["lat"]) * dy, dx * dx + dy * dy), F.lit(0.0))
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), t))
    return F.struct((a["lng"] + t * dx).alias("lng"), (a["lat"] + t * dy).alias("lat"))
