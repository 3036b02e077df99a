"""Rays against footprints: the cells that a segment crosses meet those that a footprint covers in an equi-join.

Cells come in levels, each twice as wide as the one before. A footprint is kept at the level whose cells
are as wide as its box, so it lies in nine cells at most however large it is; a ray is followed through
the cells of every level that some footprint has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmill.functions import geo
from gridmill.sources.tables import stored

#: Degrees of a cell of level 0, and levels up to the whole globe.
CELL, LEVELS = 0.0005, 20
#: Degrees by which boxes are widened, for rays that only touch.
EDGE = 1e-9
#: Degrees around a ray's origin that hold all that is 0.00 m away, up to the latitude POLAR.
TOUCH, POLAR = 1e-6, 80.0
#: Metres of a degree in a ray's own length, metres it goes on past the hit, farthest footprint, shortest ray.
RAY_DEGREE_M, EXTEND_M, FARTHEST_M, SHORTEST_M = 111000.0, 30.0, 200.0, 0.5


def all_edges(rings: Column) -> Column:
    """The edges of all rings of a footprint, outer ones and holes alike."""
    return F.flatten(F.transform(rings, geo.edges))


def inside(lat: Column, lng: Column, edges: Column) -> Column:
    """Even-odd test against all edges of a footprint, so what lies in a hole is outside."""

    def crosses(e: Column) -> Column:
        a, b = e["a"], e["b"]
        at = (b["lng"] - a["lng"]) * F.try_divide(lat - a["lat"], b["lat"] - a["lat"]) + a["lng"]
        return ((a["lat"] > lat) != (b["lat"] > lat)) & F.coalesce(lng < at, F.lit(False))

    return F.size(F.filter(edges, crosses)) % 2 == 1


def whole_numbers(a: Column, b: Column) -> Column:
    """The whole numbers from the lesser to the greater of two."""
    low, high = F.ceil(F.least(a, b)), F.floor(F.greatest(a, b))
    return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))


def crossed(p: Column, q: Column, size: float) -> Column:
    """The cells (x, y) that the segment from p to q, points of (lng, lat), goes through.

    Where it crosses the lines of the grid it is cut, and the middle of each piece tells the cell.
    """
    x0, y0, x1, y1 = p["lng"] / size, p["lat"] / size, q["lng"] / size, q["lat"] / size
    along = lambda a, b: F.transform(whole_numbers(a, b), lambda k: F.coalesce(F.try_divide(k - a, b - a), F.lit(0.0)))
    cuts = F.array_sort(F.concat(F.array(F.lit(0.0), F.lit(1.0)), along(x0, x1), along(y0, y1)))
    middles = F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: (a + b) / 2)
    return F.array_distinct(F.transform(middles, lambda t: F.struct(F.floor(x0 + t * (x1 - x0)).alias("x"), F.floor(y0 + t * (y1 - y0)).alias("y"))))


def cells_at(p: Column, q: Column, level: int) -> Column:
    """(level, x, y) of the cells of one level that a segment goes through; where its box has four cells at most, or one row of them, all of these."""
    size = CELL * 2.0**level
    low, high = ([F.floor(f(p[c] / size, q[c] / size)) for c in ("lng", "lat")] for f in (F.least, F.greatest))
    wide, tall = (b - a + 1 for a, b in zip(low, high))
    cell = lambda x, y: F.struct(F.lit(level).alias("level"), x.alias("x"), y.alias("y"))
    box = F.flatten(F.transform(F.sequence(low[0], high[0]), lambda x: F.transform(F.sequence(low[1], high[1]), lambda y: cell(x, y))))
    return F.when((wide * tall <= 4) | (wide == 1) | (tall == 1), box).otherwise(F.transform(crossed(p, q, size), lambda c: cell(c["x"], c["y"])))


def covered(footprints: DataFrame, finer: int = 0) -> DataFrame:
    """``footprints`` (rings) with ``level``, ``x`` and ``y`` of each cell that their box touches, ``finer`` levels below their own; those without a ring are left out."""
    points = F.flatten("rings")
    low, high = ({c: f(points[c]) for c in ("lng", "lat")} for f in (F.array_min, F.array_max))
    wide = F.greatest(high["lng"] - low["lng"], high["lat"] - low["lat"], F.lit(CELL)) + 2 * EDGE
    boxed = footprints.where(F.size("rings") > 0).withColumn("level", F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(wide / CELL))) - finer).cast("int"))
    size = CELL * F.pow(F.lit(2.0), F.col("level"))
    span = lambda c: F.sequence(F.floor((low[c] - EDGE) / size), F.floor((high[c] + EDGE) / size))
    return boxed.withColumn("x", F.explode(span("lng"))).withColumn("y", F.explode(span("lat")))


def extended(rays: DataFrame, extend_m: float) -> DataFrame:
    """``rays`` (lat, lng, hit_lat, hit_lng) with p and q: from the origin through the hit and ``extend_m`` past it."""
    dlat, dlng = F.col("hit_lat") - F.col("lat"), F.col("hit_lng") - F.col("lng")
    metres = F.sqrt(F.pow(dlat * RAY_DEGREE_M, 2) + F.pow(dlng * RAY_DEGREE_M * F.cos(F.radians("lat")), 2))
    scale = (metres + extend_m) / metres
    p = F.struct("lng", "lat")
    q = F.struct((F.col("lng") + dlng * scale).alias("lng"), (F.col("lat") + dlat * scale).alias("lat"))
    return rays.where(metres >= SHORTEST_M).withColumn("p", p).withColumn("q", q)


def first_footprint(rays: DataFrame, footprints: DataFrame, key: str, extend_m: float = EXTEND_M, farthest_m: float = FARTHEST_M) -> DataFrame:
    """(ray, key, dist_m): of the footprints that a ray meets the one nearest its origin, if it is near enough.

    ``rays`` has ray, lat, lng, hit_lat and hit_lng, ``footprints`` the key and rings, arrays of closed
    rings of (lng, lat). The distance is 0 inside and rounds to centimetres; ties go to the lower key.
    Rays of less than half a metre and rays that meet nothing have no row; touching counts.
    """
    points = F.flatten("rings")
    sides = {name: f(points[c]) + w for name, f, c, w in (("west", F.array_min, "lng", -EDGE), ("east", F.array_max, "lng", EDGE), ("south", F.array_min, "lat", -EDGE), ("north", F.array_max, "lat", EDGE))}
    # Equal footprints are met once, as the one with the lowest key.
    cells = stored(covered(footprints.groupBy("rings").agg(F.min(key).alias(key))).withColumns(sides), "cells")
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # LEVELS + 1 numbers at most
    each = lambda p, q: F.concat(*[cells_at(p, q, n) for n in levels]) if levels else F.array().cast("array<struct<level:int,x:bigint,y:bigint>>")
    shot = extended(rays, extend_m).select("ray", "p", "q")
    p, q = F.col("p"), F.col("q")
    beside = lambda d: F.struct((p["lng"] + d).alias("lng"), (p["lat"] + d).alias("lat"))
    through = each(F.col("u"), F.col("v"))
    # Most rays of a crowded place begin in a footprint, and nothing is nearer than that.
    begun = footprints_met(shot.where(F.abs(p["lat"]) <= POLAR).withColumns({"u": beside(-TOUCH), "v": beside(TOUCH)}), cells, key, through).where("dist_m = 0")
    begun = stored(begun.groupBy("ray").agg(F.min(key).alias(key), F.min("dist_m").alias("dist_m")), "begun").select("ray", key, "dist_m")
    told = footprints_met(shot.join(begun.select("ray"), "ray", "left_anti").withColumns({"u": p, "v": q}), cells, key, through)
    best = told.groupBy("ray").agg(F.min(F.struct("dist_m", key)).alias("b")).select("ray", "b.*")
    return begun.unionByName(best.select("ray", key, "dist_m")).where(F.col("dist_m") <= farthest_m)


def footprints_met(shot: DataFrame, cells: DataFrame, key: str, through: Column) -> DataFrame:
    """(ray, key, dist_m): the footprints in ``cells`` that rays (ray, p, q) meet, of those that lie in the cells ``through`` and touch the box from u to v."""
    low, high = ({c: f(F.col("u")[c], F.col("v")[c]) for c in ("lng", "lat")} for f in (F.least, F.greatest))
    followed = shot.withColumns({"w": low["lng"], "e": high["lng"], "s": low["lat"], "n": high["lat"]}).withColumn("c", F.explode(through)).select("ray", "p", "q", "w", "e", "s", "n", "c.*")
    met = followed.join(cells, ["level", "x", "y"]).where("w <= east AND e >= west AND s <= north AND n >= south").withColumn("edges", all_edges(F.col("rings")))
    p, q = F.col("p"), F.col("q")
    within = inside(p["lat"], p["lng"], F.col("edges"))
    hit = within | F.exists("edges", lambda e: geo.segments_meet(p, q, e["a"], e["b"]))
    far = F.array_min(F.transform("edges", lambda e: geo.segment_distance(p["lat"], p["lng"], e["a"], e["b"])))
    return met.where(hit).select("ray", key, F.round(F.when(within, 0.0).otherwise(far), 2).alias("dist_m"))
