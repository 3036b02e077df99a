"""Stored place layouts: rows along a Z-order for box and radius filters, and tables bucketed by cell for distance joins."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmill.functions import geo
from gridmill.operators import spatial
from gridmill.sources import index_store

#: Bits of each axis in the Z-order, bytes of a row group, and rows of a file.
BITS, GROUP_BYTES, FILE_ROWS = 16, 1 << 20, 1 << 22
#: Pairs of places that one cell may hold before a join falls back on an exchange that splits crowded cells.
MOST_PAIRS = 50_000_000


def spread_bits(x: Column) -> Column:
    """The 16 low bits of a number, each followed by an empty one."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def z_order(lat: Column, lng: Column) -> Column:
    """The place of a point on the Z-order curve over the globe; null without a place."""
    step = lambda v, low, wide: F.least(F.lit((1 << BITS) - 1), F.greatest(F.lit(0), F.floor((v - low) / wide * (1 << BITS)))).cast("long")
    z = spread_bits(step(lng, -180.0, 360.0)).bitwiseOR(F.shiftleft(spread_bits(step(lat, -90.0, 180.0)), 1))
    return F.when(lat.isNotNull() & lng.isNotNull(), z)


def write_along(df: DataFrame, path: str, at: tuple[str, str] = ("lat", "lng"), group_bytes: int = GROUP_BYTES, file_rows: int = FILE_ROWS) -> None:
    """Stores rows along the Z-order, so the statistics of files and row groups are narrow boxes."""
    files = max(1, -(-df.count() // file_rows))
    laid = df.withColumn("z", z_order(F.col(at[0]), F.col(at[1])))
    laid.repartitionByRange(files, "z", *at).sortWithinPartitions("z", *at).write.option("parquet.block.size", group_bytes).parquet(path)


def boxes(lat: float, lng: float, metres: float) -> list[tuple[float, float, float, float]]:
    """(south, north, west, east) around all that is within ``metres`` of a point: two boxes across the date line, all longitudes at a pole."""
    dy = 1.0001 * metres / geo.EARTH_M * 180 / 3.141592653589793
    south, north = lat - dy, lat + dy
    if south <= -90 or north >= 90:
        return [(max(south, -90.0), min(north, 90.0), -180.0, 180.0)]
    dx = geo.widest_lng(lat, metres) * 1.0001
    west, east = lng - dx, lng + dx
    if dx >= 180:
        return [(south, north, -180.0, 180.0)]
    if west < -180:
        return [(south, north, -180.0, east), (south, north, west + 360, 180.0)]
    if east > 180:
        return [(south, north, west, 180.0), (south, north, -180.0, east - 360)]
    return [(south, north, west, east)]


def within(places: DataFrame, lat: float, lng: float, metres: float, at: tuple[str, str] = ("lat", "lng")) -> DataFrame:
    """The stored rows within ``metres`` of a point, with ``dist_m``; the box reaches the scan as filters on stored columns."""
    y, x = F.col(at[0]), F.col(at[1])
    inside = F.lit(False)
    for south, north, west, east in boxes(lat, lng, metres):
        inside = inside | (y.between(south, north) & x.between(west, east))
    told = places.where(inside).withColumn("dist_m", geo.haversine(F.lit(lat), F.lit(lng), y, x))
    return told.where(F.col("dist_m") <= metres)


class Placed(NamedTuple):
    """Two tables with places, stored for joins within ``metres``: left rows in their cell and those around it, right rows in theirs."""

    spark: SparkSession
    path: str
    metres: float
    at_left: tuple[str, str]
    at_right: tuple[str, str]
    buckets: int
    #: The columns of each side, with ``cell``.
    schemas: dict[str, StructType]

    def plain(self, side: str) -> DataFrame:
        return self.spark.read.schema(self.schemas[side]).parquet(f"{self.path}/{side}")

    def table(self, side: str) -> DataFrame:
        """One side; the session learns how it is bucketed from a table that stands on the folder."""
        name = f"gridmill_{side}_{abs(hash(self.path)):x}"
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schemas[side])
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (cell) SORTED BY (cell) INTO {self.buckets} BUCKETS LOCATION '{self.path}/{side}'")
        return self.spark.table(name)


def write_bucketed(df: DataFrame, path: str, buckets: int) -> None:
    name = f"gridmill_made_{abs(hash(path)):x}"
    df.repartition(buckets, "cell").write.format("parquet").bucketBy(buckets, "cell").sortBy("cell").option("path", path).saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay


def celled(left: DataFrame, right: DataFrame, metres: float, at_left: tuple[str, str], at_right: tuple[str, str]) -> dict[str, DataFrame]:
    """Both sides with ``cell``. Rows without a place are left out, as no join finds them."""
    near = spatial.cells_near(left, metres, at_left).withColumn("cell", F.explode("_cells")).drop("_cells")
    own = spatial.cell_of_own(right, metres, at_right).withColumnRenamed("_cell", "cell").where("cell IS NOT NULL")
    return {"left": near, "right": own}


def store_pair(left: DataFrame, right: DataFrame, path: str, metres: float, at_left: tuple[str, str], at_right: tuple[str, str], buckets: int) -> Placed:
    """Writes both sides in a new folder."""
    told = celled(left, right, metres, at_left, at_right)
    for side, df in told.items():
        write_bucketed(df, f"{path}/{side}", buckets)
    stored = Placed(left.sparkSession, path, metres, at_left, at_right, buckets, {side: df.schema for side, df in told.items()})
    crowd = stored.plain("left").groupBy("cell").count().join(stored.plain("right").groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell")
    crowd.agg(F.coalesce(F.max(F.col("count") * F.col("n")), F.lit(0)).alias("pairs")).coalesce(1).write.parquet(f"{path}/crowd")
    return stored


def opened_pair(name: str, left: DataFrame, right: DataFrame, metres: float, at_left: tuple[str, str], at_right: tuple[str, str], buckets: int = 64) -> Placed:
    told = celled(left, right, metres, at_left, at_right)
    schemas = {side: df.schema for side, df in told.items()}
    settings = f"pair {metres} {at_left} {at_right} {buckets} {[t.simpleString() for t in schemas.values()]}"
    path = index_store.opened(name, [left, right], settings, lambda p: store_pair(left, right, p, metres, at_left, at_right, buckets))
    return Placed(left.sparkSession, path, metres, at_left, at_right, buckets, schemas)


def pairs(stored: Placed) -> DataFrame:
    """All pairs within the layout's distance, with ``dist_m``: cells meet in their buckets, without an exchange.

    Where one cell holds more than MOST_PAIRS, the same join runs over an exchange, which AQE can split.
    """
    left, right = stored.table("left"), stored.table("right")
    if stored.spark.read.parquet(f"{stored.path}/crowd").first().pairs > MOST_PAIRS:
        left, right = stored.plain("left"), stored.plain("right")
    (lat1, lng1), (lat2, lng2) = stored.at_left, stored.at_right
    met = left.hint("merge").join(right, "cell").drop("cell")
    return met.withColumn("dist_m", geo.haversine(F.col(lat1), F.col(lng1), F.col(lat2), F.col(lng2))).where(F.col("dist_m") <= stored.metres)
