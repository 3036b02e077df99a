"""Geometry beyond the sphere and the plan: geodesics, pixels on the ground, facades, camera poses, first rings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.functions import geo
from gridmill.operators import spatial
from gridmill.queries.base import HAVERSINE, LAT, LNG, lat, lng, load, spread

PICTURE, FOCAL = (1024, 768), 691.9
STREET_M, REACH_M = 340.0, 600.0


def point(lat_: Column, lng_: Column) -> Column:
    return F.struct(lat_.alias("lat"), lng_.alias("lng"))


def geodesics(spark: SparkSession, d: str) -> DataFrame:
    """Metres on the ellipsoid from each customer's place, anywhere on earth, to New York."""
    k = F.col("c_custkey")
    there = (k * 37 % 161 - 80).cast("double"), (k * 53 % 200 - 174).cast("double")
    return spread(load(spark, d, "customer").select("c_custkey")).select("c_custkey", F.round(geo.spheroid_distance(F.lit(40.7), F.lit(-74.0), *there), 3).alias("metres"))


def pixels_placed(spark: SparkSession, d: str) -> DataFrame:
    """The ground that a pixel of each supplier's picture shows, with a depth or on flat ground."""
    k = F.col("s_suppkey")
    depth = F.when(k % 3 == 0, (k * 7 % 170).cast("double"))
    at = geo.ground_point(k % 11 / 10, k % 7 / 6, lat("s_suppkey"), lng("s_suppkey"), k * 37 % 360, k % 40 - 25, FOCAL, PICTURE, depth)
    return load(spark, d, "supplier").select("s_suppkey", at.alias("at")).select("s_suppkey", F.round("at.lat", 6).alias("lat"), F.round("at.lng", 6).alias("lng"))


def box(lat_: Column, lng_: Column, tall: float, wide: Column | float) -> Column:
    corner = lambda y, x: F.struct((lng_ + x * wide).alias("lng"), (lat_ + y * tall).alias("lat"))
    return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1))


def facades(spark: SparkSession, d: str) -> DataFrame:
    """How far a tapped facade is from the side of each supplier's building that faces the camera."""
    k = F.col("s_suppkey")
    ring = F.when(k % 9 != 0, box(lat("s_suppkey"), lng("s_suppkey"), 0.0002, 0.0003))
    left, right = (point(lat("s_suppkey") - 0.0002 + s * 0.00001, lng("s_suppkey") + s * 0.0002) for s in (-1, 1))
    score = geo.facade_score(ring, lat("s_suppkey") - 0.001, lng("s_suppkey") + (k % 5) * 0.0005, left, right)
    return load(spark, d, "supplier").select("s_suppkey", F.round(F.when(score < float("inf"), score), 3).alias("score_m"))


def camera_poses(spark: SparkSession, d: str) -> DataFrame:
    """Where to look at each part's building from, by distance, by parallel side and by frontage."""
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    upright = k % 3 == 0
    ring = F.when(upright, box(lat("p_partkey"), lng("p_partkey"), 0.0009, 0.0003)).otherwise(box(lat("p_partkey"), lng("p_partkey"), 0.0002, 0.0009))
    buildings = load(spark, d, "part").select(k.alias("building"), lat("p_partkey").alias("lat"), lng("p_partkey").alias("lng"), ring.alias("ring"))
    half_lat, half_lng = F.when(s % 2 == 0, 0.0015).otherwise(0.0), F.when(s % 2 == 0, 0.0).otherwise(0.002)
    ends = [F.struct((lng("s_suppkey") + sign * half_lng).alias("lng"), (lat("s_suppkey") + sign * half_lat).alias("lat")).alias(n) for sign, n in ((-1, "a"), (1, "b"))]
    told = spatial.camera_poses(buildings, load(spark, d, "supplier").select(s.alias("street"), *ends), REACH_M, STREET_M)
    return told.select("building", "by", "street", F.round("lat", 5).alias("lat"), F.round("lng", 5).alias("lng"), F.round("heading", 2).alias("heading"), F.round("off", 1).alias("off"))


def first_rings(spark: SparkSession, d: str) -> DataFrame:
    """For each supplier what the smallest ring of 150 to 300 metres, by 50, that sees anything sees, in a cone of 90 degrees."""
    own = load(spark, d, "supplier").select("s_suppkey", lat("s_suppkey").alias("lat"), lng("s_suppkey").alias("lng"), (F.col("s_suppkey") * 41 % 360).alias("towards"))
    other = load(spark, d, "customer").select("c_custkey", (lat("c_custkey") + 0.0003).alias("lat2"), (lng("c_custkey") + 0.0002).alias("lng2"))
    seen = spatial.cell_join(own, other, 300, ("lat", "lng"), ("lat2", "lng2"))
    seen = seen.where(geo.bearing_gap(geo.bearing(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), F.col("towards")) <= 45)
    ring = F.greatest(F.lit(150), (F.ceil(F.col("dist_m") / 50) * 50)).cast("int")
    first = seen.groupBy("s_suppkey").agg(F.min(ring).alias("ring"))
    return seen.join(first, "s_suppkey").where("dist_m <= ring").select("s_suppkey", "ring", "c_custkey", F.round("dist_m", 2).alias("dist_m"))


QUERIES = {f.__name__: f for f in (geodesics, pixels_placed, facades, camera_poses, first_rings)}

M = 111320.0


def geodesic_sql(rounds: int = 10) -> str:
    f = geo.FLATTENING
    b = geo.SEMI_MAJOR_M * (1 - f)
    arcs = """sqrt(pow(c2 * sin({0}), 2) + pow(c1 * s2 - s1 * c2 * cos({0}), 2)) AS sine, s1 * s2 + c1 * c2 * cos({0}) AS cosine"""
    more = "atan2(sine, cosine) AS sigma, CASE WHEN sine = 0 THEN 0 ELSE c1 * c2 * sin({0}) / sine END AS az"
    mid = "CASE WHEN 1 - az * az = 0 THEN cosine ELSE cosine - 2 * s1 * s2 / (1 - az * az) END AS mid, 1 - az * az AS flat"
    told, steps = "SELECT *, l AS lam0 FROM u", ""
    for i in range(rounds + 1):
        given = f"SELECT *, {mid} FROM (SELECT *, {more.format(f'lam{i}')} FROM (SELECT *, {arcs.format(f'lam{i}')} FROM ({told})))"
        if i == rounds:
            told = given
        else:
            c = f"({f} / 16 * flat * (4 + {f} * (4 - 3 * flat)))"
            told = f"SELECT c_custkey, s1, c1, s2, c2, l, l + (1 - {c}) * {f} * az * (sigma + {c} * sine * (mid + {c} * cosine * (2 * mid * mid - 1))) AS lam{i + 1} FROM ({given})"
    u = f"(flat * {(geo.SEMI_MAJOR_M**2 - b**2) / b**2})"
    return f"""WITH p AS (SELECT c_custkey, atan({1 - f} * tan(radians(40.7))) AS u1, atan({1 - f} * tan(radians(c_custkey * 37 % 161 - 80))) AS u2, radians(c_custkey * 53 % 200 - 174 + 74.0) AS l FROM customer),
        u AS (SELECT c_custkey, l, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2 FROM p), g AS ({told}),
        h AS (SELECT *, 1 + {u} / 16384 * (4096 + {u} * (-768 + {u} * (320 - 175 * {u}))) AS big, {u} / 1024 * (256 + {u} * (-128 + {u} * (74 - 47 * {u}))) AS small FROM g)
        SELECT c_custkey, round({b} * big * (sigma - small * sine * (mid + small / 4 * (cosine * (2 * mid * mid - 1) - small / 6 * mid * (4 * sine * sine - 3) * (4 * mid * mid - 3)))), 3) AS metres FROM h"""


def pair(lat1: str, lng1: str, lat2: str, lng2: str) -> str:
    return HAVERSINE.format(lat1, lng1, lat2, lng2)


ORACLE = {
    "geodesics": geodesic_sql(),
    "pixels_placed": f"""WITH s AS (SELECT s_suppkey, {LAT.format('s_suppkey')} AS lat, {LNG.format('s_suppkey')} AS lng, (s_suppkey % 11 / 10.0 - 0.5) * 1024 AS x, (s_suppkey % 7 / 6.0 - 0.5) * 768 AS y, radians(s_suppkey * 37 % 360) AS a, radians(s_suppkey % 40 - 25) AS p, CASE WHEN s_suppkey % 3 = 0 THEN s_suppkey * 7 % 170 END AS depth FROM supplier),
        r AS (SELECT *, {FOCAL} * sin(p) - y * cos(p) AS up, y * sin(p) + {FOCAL} * cos(p) AS ahead FROM s), e AS (SELECT *, x * cos(a) + ahead * sin(a) AS east, ahead * cos(a) - x * sin(a) AS north FROM r),
        t AS (SELECT *, CASE WHEN depth > 0 THEN CASE WHEN depth <= 150 THEN depth / sqrt(east * east + north * north + up * up) END WHEN up < -0.001 AND 1.6 / -up <= 150 THEN 1.6 / -up END AS t FROM e)
        SELECT s_suppkey, round(lat + degrees(t * north / 6371000.0), 6) AS lat, round(lng + degrees(t * east / (6371000.0 * cos(radians(lat)))), 6) AS lng FROM t""",
    "facades": f"""WITH s AS (SELECT s_suppkey, {LAT.format('s_suppkey')} AS y, {LNG.format('s_suppkey')} AS x, s_suppkey % 5 * 0.0005 AS o FROM supplier),
        e AS (SELECT *, unnest([[-1, -1, -1, 1], [-1, 1, 1, 1], [1, 1, 1, -1], [1, -1, -1, -1]]) AS c FROM s),
        m AS (SELECT *, y + c[1] * 0.0002 AS ay, x + c[2] * 0.0003 AS ax, y + c[3] * 0.0002 AS b_y, x + c[4] * 0.0003 AS bx FROM e),
        f AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY sqrt(pow((ay + b_y) / 2 - (y - 0.001), 2) + pow(((ax + bx) / 2 - (x + o)) * cos(radians(y - 0.001)), 2))) AS nth FROM m)
        SELECT s_suppkey, CASE WHEN s_suppkey % 9 <> 0 THEN round(least({pair('(y - 0.00021)', '(x - 0.0002)', 'ay', 'ax')} + {pair('(y - 0.00019)', '(x + 0.0002)', 'b_y', 'bx')}, {pair('(y - 0.00021)', '(x - 0.0002)', 'b_y', 'bx')} + {pair('(y - 0.00019)', '(x + 0.0002)', 'ay', 'ax')}) / 2, 3) END AS score_m FROM f WHERE nth = 1""",
    "camera_poses": f"""WITH p AS (SELECT p_partkey AS building, s_suppkey AS street, {LAT.format('p_partkey')} AS y, {LNG.format('p_partkey')} AS x, {LAT.format('s_suppkey')} AS sy, {LNG.format('s_suppkey')} AS sx, CASE WHEN s_suppkey % 2 = 0 THEN 0.0015 ELSE 0 END AS hy, CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 0.002 END AS hx,
          CASE WHEN p_partkey % 3 = 0 THEN 0.0009 ELSE 0.0002 END AS by_, CASE WHEN p_partkey % 3 = 0 THEN 0.0003 ELSE 0.0009 END AS bx_ FROM part, supplier),
        q AS (SELECT *, greatest(sy - hy, least(sy + hy, y)) AS py, greatest(sx - hx, least(sx + hx, x)) AS px FROM p),
        r AS (SELECT *, round(sqrt(pow((py - y) * {M}, 2) + pow((px - x) * cos(radians(y)) * {M}, 2)), 2) AS off, CASE WHEN (building % 3 = 0) = (street % 2 = 0) THEN 0.0 ELSE 90.0 END AS facing,
          sqrt(pow(greatest(0.0, abs(sy - y) - hy - by_) * {M}, 2) + pow(greatest(0.0, abs(sx - x) - hx - bx_) * cos(radians(y)) * {M}, 2)) AS gap FROM q), o AS (SELECT * FROM r WHERE off <= {REACH_M}),
        b AS (SELECT *, row_number() OVER (PARTITION BY building ORDER BY off, street) AS n, row_number() OVER (PARTITION BY building ORDER BY facing + off / 2, street) AS m, row_number() OVER (PARTITION BY building ORDER BY round(gap, 1), off, street) AS f FROM o)
        SELECT building, unnest(CASE WHEN n = 1 THEN ['near'] ELSE [] END || CASE WHEN m = 1 THEN ['parallel'] ELSE [] END || CASE WHEN f = 1 THEN ['front'] ELSE [] END) AS "by", street, round(py, 5) AS lat, round(px, 5) AS lng, round(fmod(degrees(atan2(x - px, y - py)) + 360, 360), 2) AS heading, round(off, 1) AS off FROM b""",
    "first_rings": f"""WITH p AS (SELECT s_suppkey, c_custkey, s_suppkey * 41 % 360 AS towards, {LAT.format('s_suppkey')} AS y, {LNG.format('s_suppkey')} AS x, {LAT.format('c_custkey')} + 0.0003 AS y2, {LNG.format('c_custkey')} + 0.0002 AS x2 FROM supplier, customer),
        d AS (SELECT *, {pair('y', 'x', 'y2', 'x2')} AS dm, fmod(degrees(atan2(sin(radians(x2 - x)) * cos(radians(y2)), cos(radians(y)) * sin(radians(y2)) - sin(radians(y)) * cos(radians(y2)) * cos(radians(x2 - x)))) + 360, 360) AS b FROM p),
        s AS (SELECT *, min(greatest(150, ceil(dm / 50) * 50)) OVER (PARTITION BY s_suppkey) AS ring FROM d WHERE dm <= 300 AND abs(fmod(b - towards + 540, 360) - 180) <= 45)
        SELECT s_suppkey, ring::INT AS ring, c_custkey, round(dm, 2) AS dist_m FROM s WHERE dm <= ring""",
}
