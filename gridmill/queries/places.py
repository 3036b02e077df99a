"""Geospatial queries on places that follow from keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.functions import camera, geo
from gridmill.functions import text as T
from gridmill.operators import spatial
from gridmill.queries.base import HAVERSINE, LAT, LNG, lat, lng, load

# The point that radius and cone queries look from, and where to.
AT_LAT, AT_LNG, TOWARDS, CONE, REACH = 40.55, -74.15, 45.0, 75.0, 2000.0
# Metres that a street of 0.004 degrees of longitude is long at most, here.
STREET_M = 340.0


def places(spark: SparkSession, d: str, name: str, key: str, suffix: str = "") -> DataFrame:
    return load(spark, d, name).select(F.col(key), lat(key).alias(f"lat{suffix}"), lng(key).alias(f"lng{suffix}"))


def radius_filter(spark: SparkSession, d: str) -> DataFrame:
    """Everything within 3 km of a point, nearest first; the box is on computed columns, ``radius_stored`` has it in the scan."""
    dy, dx = geo.reach_deg(3000)
    p = places(spark, d, "part", "p_partkey").where(F.col("lat").between(AT_LAT - dy, AT_LAT + dy) & F.col("lng").between(AT_LNG - dx, AT_LNG + dx))
    dist = geo.haversine(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng"))
    return p.select("p_partkey", F.round(dist, 1).alias("dist_m")).where(dist <= 3000)


def bearings(spark: SparkSession, d: str) -> DataFrame:
    """Two kinds of bearing and their gap to a heading, and the flat distance."""
    p = places(spark, d, "supplier", "s_suppkey")
    b = geo.bearing(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng"))
    return p.select("s_suppkey", F.round(b, 4).alias("bearing"), F.round(geo.planar_azimuth(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng")), 4).alias("azimuth"), F.round(geo.bearing_gap(b, F.lit(TOWARDS)), 4).alias("gap"), F.round(geo.flat_distance(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng")), 3).alias("flat_m"))


def nearest_structure(spark: SparkSession, d: str) -> DataFrame:
    """J9, J10, G27, SNK8: the nearest part within 400 m of each customer, if any."""
    pairs = spatial.nearest(places(spark, d, "customer", "c_custkey"), places(spark, d, "part", "p_partkey", "2"), 400, ("lat", "lng"), ("lat2", "lng2"), "c_custkey", "p_partkey")
    return pairs.select("c_custkey", "p_partkey", F.round("dist_m", 2).alias("dist_m"))


def block_sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Suppliers with year and height, and parts as what stands around them."""
    own = load(spark, d, "supplier").select("s_suppkey", lat("s_suppkey").alias("lat"), lng("s_suppkey").alias("lng"), (1850 + F.col("s_suppkey") * 7 % 150).alias("year"), (10 + F.col("s_suppkey") * 13 % 400).alias("height"))
    other = load(spark, d, "part").select("p_partkey", lat("p_partkey").alias("lat2"), lng("p_partkey").alias("lng2"), (1650 + F.col("p_partkey") * 11 % 370).alias("year2"), (F.col("p_size") * 5).alias("height2"))
    return own, other


def contrasts(pairs: DataFrame) -> DataFrame:
    """What is told of each supplier and its neighbours."""
    told = pairs.where("s_suppkey <> p_partkey").groupBy("s_suppkey", "year", "height").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("year2") > 1700, F.col("year2"))), 2).alias("mean_year"), F.min(F.when(F.col("year2") > 1700, F.col("year2"))).alias("oldest"), F.max("height2").alias("tallest"))
    gap = F.col("year") - F.col("mean_year")
    said = F.concat_ws("; ", F.when((F.col("n") >= 5) & (F.abs(gap) >= 20), F.when(gap > 0, "newer than its block").otherwise("older than its block")), F.when(F.col("height") > 1.5 * F.col("tallest"), "towers over its block"))
    return told.select("s_suppkey", "n", "mean_year", "oldest", "tallest", said.alias("contrast"))


def block_context(spark: SparkSession, d: str) -> DataFrame:
    """Neighbours of each supplier within 1 km: how many, mean year, tallest, and what stands out."""
    own, other = block_sides(spark, d)
    return contrasts(spatial.cell_join(own, other, 1000, ("lat", "lng"), ("lat2", "lng2")))


def neighbour_stories(spark: SparkSession, d: str) -> DataFrame:
    """Up to four neighbours of each supplier, those with a story first, then the nearest."""
    own = places(spark, d, "supplier", "s_suppkey")
    other = load(spark, d, "part").select("p_partkey", lat("p_partkey").alias("lat2"), lng("p_partkey").alias("lng2"), (F.col("p_type") == "PROMO").alias("story"))
    kinds = [other.where(F.col("story").eqNullSafe(F.lit(kind).cast("boolean"))) for kind in (True, False, None)]
    pairs = reduce(DataFrame.unionByName, [spatial.nearest(own, rows, 800, ("lat", "lng"), ("lat2", "lng2"), "s_suppkey", "p_partkey", 4, 3) for rows in kinds])
    w = Window.partitionBy("s_suppkey").orderBy(F.desc("story"), F.round("dist_m", 3), "p_partkey")
    return pairs.withColumn("nth", F.row_number().over(w)).where("nth <= 4").select("s_suppkey", "nth", "p_partkey", "story")


def walk_marks(spark: SparkSession, d: str) -> DataFrame:
    """Parts within 250 m of any supplier are marked."""
    marked = spatial.cell_join(places(spark, d, "supplier", "s_suppkey", "2"), places(spark, d, "part", "p_partkey"), 250, ("lat2", "lng2"), ("lat", "lng")).select("p_partkey", F.lit(True).alias("near")).distinct()
    return load(spark, d, "part").select("p_partkey").join(marked, "p_partkey", "left").select("p_partkey", F.coalesce("near", F.lit(False)).alias("walk"))


def cone_points(spark: SparkSession, d: str) -> DataFrame:
    """Buildings in a view cone by their centres, scored, with the smallest ring that holds them."""
    p = load(spark, d, "part").select("p_partkey", "p_size", lat("p_partkey").alias("lat"), lng("p_partkey").alias("lng"))
    dist, gap = geo.haversine(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng")), geo.bearing_gap(geo.bearing(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng")), F.lit(TOWARDS))
    seen = p.withColumn("dist", dist).withColumn("gap", gap).where((F.col("dist") <= REACH) & (F.col("gap") <= CONE / 2))
    score = geo.visibility(F.col("dist"), F.col("gap"), F.lit(CONE), F.lit(50.0), F.when(F.col("p_partkey") % 5 != 0, F.col("p_size") * 100.0).otherwise(0.0), F.when(F.col("p_partkey") % 3 != 0, F.col("p_size") * 5.0))
    ring = F.ceil(F.greatest(F.lit(0.0), F.col("dist") - 150) / 50) * 50 + 150
    return seen.select("p_partkey", F.round("dist", 2).alias("dist_m"), F.round("gap", 3).alias("gap"), F.round(score, 3).alias("score"), F.round(geo.height_bonus(score, F.lit(35.0), F.col("p_size") * 5.0), 3).alias("boosted"), ring.cast("int").alias("ring_m"))


def square(lat_: Column, lng_: Column, half: float) -> Column:
    corner = lambda dy, dx: F.struct((lng_ + dx * half).alias("lng"), (lat_ + dy * half).alias("lat"))
    return F.array(corner(-1, -1), corner(-1, 1), corner(1, 1), corner(1, -1), corner(-1, -1))


def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    """Which supplier's square each part lies in, by cells and an even-odd test."""
    squares = places(spark, d, "supplier", "s_suppkey").select("s_suppkey", square(F.col("lat"), F.col("lng"), 0.0041).alias("ring"))
    return spatial.points_in_rings(places(spark, d, "part", "p_partkey"), squares, "p_partkey", "s_suppkey")


def ring_measures(spark: SparkSession, d: str) -> DataFrame:
    """Area, centre and longest edge of rings read from WKT."""
    s = places(spark, d, "supplier", "s_suppkey")
    wkt = F.format_string("POLYGON((%.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f, %.6f %.6f))", *[x for dy, dx in ((0, 0), (0, 2), (1, 2), (1, 0), (0, 0)) for x in (F.col("lng") + dx * 0.001, F.col("lat") + dy * 0.001)])
    ring = geo.rings_of_wkt(wkt)[0]
    told = s.select("s_suppkey", ring.alias("ring"))
    centre, edge = geo.ring_centroid(F.col("ring")), geo.longest_edge(F.col("ring"))
    return told.select("s_suppkey", F.round(geo.ring_area(F.col("ring")) / 100).alias("area_100m2"), F.round(centre["lat"], 4).alias("lat"), F.round(centre["lng"], 4).alias("lng"), F.round(edge["metres"], 1).alias("longest_m"))


def nearest_street(spark: SparkSession, d: str) -> DataFrame:
    """The nearest street, a west-east segment for each supplier, within 300 m of each part."""
    streets = places(spark, d, "supplier", "s_suppkey", "2").select("s_suppkey", "lat2", "lng2", F.struct((F.col("lng2") - 0.002).alias("lng"), F.col("lat2").alias("lat")).alias("a"), F.struct((F.col("lng2") + 0.002).alias("lng"), F.col("lat2").alias("lat")).alias("b"))
    told = spatial.nearest_lines(places(spark, d, "part", "p_partkey"), streets, 300, STREET_M, "p_partkey", "s_suppkey")
    return told.select("p_partkey", F.col("s_suppkey").alias("street"), F.col("off").alias("off_m"))


def ray_hits(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers' squares that one ray meets, with the distance of their centres; ``ray_buildings`` has the whole of J17 and G15."""
    y, x = F.col("lat"), F.col("lng")
    met = places(spark, d, "supplier", "s_suppkey").where(geo.border_met(F.lit(AT_LAT), F.lit(AT_LNG), 0.15, 0.2, y - 0.004, y + 0.004, x - 0.004, x + 0.004))
    return met.select("s_suppkey", F.round(geo.haversine(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng")), 1).alias("dist_m"))


def tiles(spark: SparkSession, d: str) -> DataFrame:
    """SNK9, A19, G25: one JSON array for each cell of 0.005 degrees, without empty names and heights."""
    p = load(spark, d, "part").select(lat("p_partkey").alias("lat"), lng("p_partkey").alias("lng"), F.col("p_partkey").alias("id"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("h"))
    cell = F.concat_ws("_", geo.cell(F.col("lat"), 0.005).cast("string"), geo.cell(F.col("lng"), 0.005).cast("string"))
    told = p.groupBy(cell.alias("cell")).agg(F.sort_array(F.collect_list(F.struct("id", "h"))).alias("rows"))
    return told.select("cell", F.to_json("rows").alias("json"))


def names_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """A page of 300 hits without near-identical ones: same name within 150 m of a better hit."""
    w = Window.orderBy(F.desc("p_retailprice"), "p_partkey")
    page = load(spark, d, "part").orderBy(F.desc("p_retailprice"), "p_partkey").limit(300)
    hits = page.select("p_partkey", F.row_number().over(w).alias("pos"), T.normal_name(F.col("p_type")).alias("norm_name"), (F.lit(40.7) + (F.col("p_partkey") % 13) / 2000).alias("lat"), (F.lit(-74.0) + (F.col("p_partkey") % 7) / 2000).alias("lng"), F.col("p_retailprice").alias("score"), F.lit(1).alias("page"))
    return spatial.collapse_near(hits).select("p_partkey", "pos")


def picture_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Buildings projected into a picture, and the overlap of their hulls with a mask."""
    near = places(spark, d, "part", "p_partkey").where(F.col("lat").between(AT_LAT - 0.01, AT_LAT + 0.01) & F.col("lng").between(AT_LNG - 0.01, AT_LNG + 0.01))
    rows = near.select("p_partkey", square(F.col("lat"), F.col("lng"), 0.0002).alias("ring"), F.lit(20.0).alias("height"))
    told = camera.picture_overlap(rows, (AT_LAT, AT_LNG), TOWARDS, 5.0, 73.0, [(300.0, 200.0), (700.0, 200.0), (700.0, 600.0), (300.0, 600.0)], "p_partkey")
    return told.select("p_partkey", F.round("pixels", 1).alias("pixels"), F.round("overlap", 4).alias("overlap"))


def cone_footprints(spark: SparkSession, d: str) -> DataFrame:
    """Footprints that a view cone meets, with the area in it and the visibility score."""
    near = places(spark, d, "part", "p_partkey").join(load(spark, d, "part").select("p_partkey", "p_size"), "p_partkey")
    dist = geo.haversine(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng"))
    cone = geo.view_cone(F.lit(AT_LAT), F.lit(AT_LNG), F.lit(TOWARDS), F.lit(REACH), F.lit(CONE))
    rows = near.withColumn("dist", dist).where(F.col("dist") <= REACH + 100).withColumn("ring", square(F.col("lat"), F.col("lng"), 0.0003)).withColumn("cone", cone)
    seen = rows.join(camera.visible_areas(rows, "p_partkey"), "p_partkey").where("visible_m2 > 0")
    gap = geo.bearing_gap(geo.planar_azimuth(F.lit(AT_LAT), F.lit(AT_LNG), F.col("lat"), F.col("lng")), F.lit(TOWARDS))
    score = geo.visibility(F.col("dist"), gap, F.lit(CONE), F.col("visible_m2"), F.lit(4000.0 / 0.0929), F.col("p_size") * 5.0)
    return seen.select("p_partkey", F.round("visible_m2", 0).alias("visible_m2"), F.round(score, 2).alias("score"))


QUERIES = {f.__name__: f for f in (cone_footprints, picture_overlap, radius_filter, bearings, nearest_structure, block_context, neighbour_stories, walk_marks, cone_points, point_in_polygon, ring_measures, nearest_street, ray_hits, tiles, names_collapsed)}


def between(a: str, b: str) -> str:
    return HAVERSINE.format(LAT.format(a), LNG.format(a), LAT.format(b), LNG.format(b))


FROM = HAVERSINE.format(AT_LAT, AT_LNG, "lat", "lng")
BEARING = f"fmod(degrees(atan2(sin(radians(lng - {AT_LNG})) * cos(radians(lat)), cos(radians({AT_LAT})) * sin(radians(lat)) - sin(radians({AT_LAT})) * cos(radians(lat)) * cos(radians(lng - {AT_LNG})))) + 360, 360)"


def at(name: str, key: str) -> str:
    return f"(SELECT *, {LAT.format(key)} AS lat, {LNG.format(key)} AS lng FROM {name})"


ORACLE = {
    "radius_filter": f"SELECT p_partkey, round({FROM}, 1) AS dist_m FROM {at('part', 'p_partkey')} WHERE {FROM} <= 3000",
    "bearings": f"SELECT s_suppkey, round({BEARING}, 4) AS bearing, round(fmod(degrees(atan2(lng - {AT_LNG}, lat - {AT_LAT})) + 360, 360), 4) AS azimuth, round(abs(fmod({BEARING} - {TOWARDS} + 540, 360) - 180), 4) AS gap, round(sqrt(pow((lat - {AT_LAT}) * 111320, 2) + pow((lng - {AT_LNG}) * 111320 * cos(radians({AT_LAT})), 2)), 3) AS flat_m FROM {at('supplier', 's_suppkey')}",
    "nearest_structure": f"SELECT c_custkey, p_partkey, round(dm, 2) AS dist_m FROM (SELECT c_custkey, p_partkey, {between('c_custkey', 'p_partkey')} AS dm FROM customer, part WHERE dm <= 400) QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY dm, p_partkey) = 1",
    "block_context": f"""WITH t AS (SELECT s_suppkey, 1850 + s_suppkey * 7 % 150 AS year, 10 + s_suppkey * 13 % 400 AS height, count(*) AS n, round(avg(CASE WHEN y2 > 1700 THEN y2 END), 2) AS mean_year, min(CASE WHEN y2 > 1700 THEN y2 END) AS oldest, max(h2) AS tallest
        FROM supplier, (SELECT p_partkey, 1650 + p_partkey * 11 % 370 AS y2, p_size * 5 AS h2 FROM part) WHERE s_suppkey <> p_partkey AND {between('s_suppkey', 'p_partkey')} <= 1000 GROUP BY 1)
        SELECT s_suppkey, n, mean_year, oldest, tallest, concat_ws('; ', CASE WHEN n >= 5 AND abs(year - mean_year) >= 20 THEN CASE WHEN year > mean_year THEN 'newer than its block' ELSE 'older than its block' END END, CASE WHEN height > 1.5 * tallest THEN 'towers over its block' END) AS contrast FROM t""",
    "neighbour_stories": f"SELECT s_suppkey, nth::INT AS nth, p_partkey, story FROM (SELECT s_suppkey, p_partkey, p_type = 'PROMO' AS story, row_number() OVER (PARTITION BY s_suppkey ORDER BY p_type = 'PROMO' DESC, round({between('s_suppkey', 'p_partkey')}, 3), p_partkey) AS nth FROM supplier, part WHERE {between('s_suppkey', 'p_partkey')} <= 800) WHERE nth <= 4",
    "walk_marks": f"SELECT p_partkey, EXISTS (SELECT 1 FROM supplier WHERE {between('s_suppkey', 'p_partkey')} <= 250) AS walk FROM part",
    "cone_points": f"""WITH s AS (SELECT *, {FROM} AS dist, abs(fmod({BEARING} - {TOWARDS} + 540, 360) - 180) AS gap FROM {at('part', 'p_partkey')}),
        v AS (SELECT *, 100 * (0.4 * exp(-dist / 30.0) + 0.3 * greatest(0.0, 1 - gap / ({CONE} / 2)) + 0.2 * coalesce(least(1.0, 50.0 / (CASE WHEN p_partkey % 5 <> 0 THEN p_size * 100.0 END * 0.0929)), 1.0) + 0.1 * least(1.0, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_size * 5.0 END, 30.0) / 200.0)) AS sc FROM s WHERE dist <= {REACH} AND gap <= {CONE} / 2)
        SELECT p_partkey, round(dist, 2) AS dist_m, round(gap, 3) AS gap, round(sc, 3) AS score, round(least(100.0, sc + p_size * 5.0 / 200 * (15.0 / 70) * 10), 3) AS boosted, (ceil(greatest(0.0, dist - 150) / 50) * 50 + 150)::INT AS ring_m FROM v""",
    "point_in_polygon": f"SELECT p_partkey, s_suppkey FROM part, supplier WHERE abs({LAT.format('p_partkey')} - {LAT.format('s_suppkey')}) < 0.0041 AND abs({LNG.format('p_partkey')} - {LNG.format('s_suppkey')}) < 0.0041",
    "ring_measures": f"SELECT s_suppkey, round(0.001 * 0.002 * 111320.0 * 111320.0 * cos(radians(lat + 0.0004)) / 100) AS area_100m2, round(lat + 0.0005, 4) AS lat, round(lng + 0.001, 4) AS lng, round(0.002 * 111320 * cos(radians(lat)), 1) AS longest_m FROM {at('supplier', 's_suppkey')}",
    "nearest_street": f"""WITH p AS (SELECT p_partkey, s_suppkey, ({LAT.format('s_suppkey')} - {LAT.format('p_partkey')}) * 111320.0 AS y, ({LNG.format('s_suppkey')} - {LNG.format('p_partkey')}) * cos(radians({LAT.format('p_partkey')})) * 111320.0 AS x, 0.002 * cos(radians({LAT.format('p_partkey')})) * 111320.0 AS h FROM part, supplier),
        o AS (SELECT p_partkey, s_suppkey, round(sqrt(y * y + pow(greatest(0.0, abs(x) - h), 2)), 2) AS off FROM p)
        SELECT p_partkey, s_suppkey AS street, off AS off_m FROM o WHERE off <= 300 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY off, s_suppkey) = 1""",
    "ray_hits": f"""WITH s AS (SELECT *, (lng - 0.004 - {AT_LNG}) / 0.2 AS x1, (lng + 0.004 - {AT_LNG}) / 0.2 AS x2, (lat - 0.004 - {AT_LAT}) / 0.15 AS y1, (lat + 0.004 - {AT_LAT}) / 0.15 AS y2 FROM {at('supplier', 's_suppkey')})
        SELECT s_suppkey, round({FROM}, 1) AS dist_m FROM s WHERE greatest(x1, y1, 0) <= least(x2, y2, 1) AND NOT (0 > greatest(x1, y1) AND 1 < least(x2, y2))""",
    "names_collapsed": f"""WITH p AS (SELECT * FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 300),
        h AS (SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey)::INT AS pos, lower(p_type) AS name, 40.7 + (p_partkey % 13) / 2000.0 AS lat, -74.0 + (p_partkey % 7) / 2000.0 AS lng FROM p),
        g AS (SELECT list_transform(list({{'key': p_partkey, 'pos': pos, 'lat': lat, 'lng': lng}} ORDER BY pos), lambda x: [x]) AS hs FROM h GROUP BY name),
        k AS (SELECT unnest(list_reduce(hs, lambda a, b: CASE WHEN len(list_filter(a, lambda x: {HAVERSINE.format('x.lat', 'x.lng', 'b[1].lat', 'b[1].lng')} <= 150)) > 0 THEN a ELSE list_concat(a, b) END)) AS s FROM g)
        SELECT s.key AS p_partkey, s.pos AS pos FROM k""",
    "tiles": f"""SELECT floor(lat / 0.005)::BIGINT || '_' || floor(lng / 0.005)::BIGINT AS cell, '[' || string_agg('{{"id":' || p_partkey || CASE WHEN p_size > 25 THEN ',"h":' || p_size ELSE '' END || '}}', ',' ORDER BY p_partkey) || ']' AS json FROM {at('part', 'p_partkey')} GROUP BY 1""",
}
