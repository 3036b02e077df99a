"""Sharding by fixed virtual slots and a versioned slot-to-shard map.

Records are hashed into thousands of virtual slots, whose number never changes. The bytes of each
slot are summed, and a small map gives every slot a shard: the heaviest slots first, each to the
lightest shard. The map is a table with a version; rebalancing edits the entries of the fewest
bytes it needs and writes the next version, and no record is hashed anew.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridmill.llm.common import dropping, materialize, scratch_path, table

SLOTS, SHARDS = 8192, 8


def records(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, copy and virtual slot of each row; null text has no bytes.

    The slot is a hash of doc_id, checksum and copy, the number of the row among rows with the same two, so
    repeated rows spread over slots like others. Copies are numbered within the input's partitions and
    these by their counts, so no task holds all rows of a key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.spark_partition_id().alias("part"))
    sized = materialize(sized, "sizes")
    key = ["doc_id", "text_crc32"]
    counts = sized.groupBy(*key, "part").agg(F.count(F.lit(1)).alias("n"))
    ahead = counts.withColumn("ahead", F.sum("n").over(Window.partitionBy(*key).orderBy("part")) - F.col("n")).where("ahead > 0").drop("n")
    within = F.row_number().over(Window.partitionBy(*key, "part").orderBy("size")) - 1
    rows = sized.withColumn("within", within)
    rows = rows.join(ahead, [rows[c].eqNullSafe(ahead[c]) for c in (*key, "part")], "left").select(*[rows[c] for c in ("doc_id", "size", "text_crc32")], (F.col("within") + F.coalesce("ahead", F.lit(0))).alias("copy"))
    return rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id", "text_crc32", "copy"), F.lit(slots)).cast("int"))


def assign(slot_bytes: dict[int, int], shards: int, slots: int = SLOTS) -> dict[int, int]:
    """Slot-to-shard map: heaviest slot first, each to the shard with the fewest bytes so far."""
    load = [(0, s) for s in range(shards)]
    found = {}
    for slot in sorted(range(slots), key=lambda v: (-slot_bytes.get(v, 0), v)):
        total, shard = heapq.heappop(load)
        found[slot] = shard
        heapq.heappush(load, (total + slot_bytes.get(slot, 0), shard))
    return found


def rebalance(slot_map: dict[int, int], slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """The map edited for ``shards`` shards: slots move only from shards above the mean to those below.

    Slots of shards that no longer exist move first; a slot moves only if that brings its two
    shards nearer to each other.
    """
    new = dict(slot_map)
    load = dict.fromkeys(range(shards), 0)
    for slot, shard in new.items():
        if shard < shards:
            load[shard] += slot_bytes.get(slot, 0)
    for slot in sorted((v for v, s in new.items() if s >= shards), key=lambda v: (-slot_bytes.get(v, 0), v)):
        new[slot] = min(load, key=lambda s: (load[s], s))
        load[new[slot]] += slot_bytes.get(slot, 0)
    mean = sum(load.values()) / shards
    for slot in sorted(new, key=lambda v: (-slot_bytes.get(v, 0), v)):
        size, source = slot_bytes.get(slot, 0), new[slot]
        if size and load[source] > mean:
            target = min(load, key=lambda s: (load[s], s))
            if load[target] + size <= mean:  # a shard that is full takes nothing more
                new[slot], load[source], load[target] = target, load[source] - size, load[target] + size
    return new


def settled(slot_map: dict[int, int], slot_bytes: dict[int, int], shards: int) -> dict[int, int]:
    """The map rebalanced until nothing moves any more; every move brings two shards nearer, so that comes."""
    while (new := rebalance(slot_map, slot_bytes, shards)) != slot_map:
        slot_map = new
    return slot_map


def slot_table(spark: SparkSession, slot_map: dict[int, int], version: int) -> DataFrame:
    """The map as rows (version, vslot, shard); its size is the fixed number of slots."""
    return spark.createDataFrame([(version, v, s) for v, s in sorted(slot_map.items())], "version int, vslot int, shard int")


def save_map(spark: SparkSession, slot_map: dict[int, int], version: int, path: str) -> None:
    """Adds one version to the stored map; earlier versions stay readable, and none is written twice."""
    slot_table(spark, slot_map, version).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{path}/version={version}")


def load_map(spark: SparkSession, path: str, version: int | None = None) -> tuple[int, dict[int, int]]:
    """(version, map) of the latest or the given version."""
    stored = spark.read.schema("vslot int, shard int, version int").parquet(path)
    version = version if version is not None else stored.agg(F.max("version")).first()[0]
    return version, {r.vslot: r.shard for r in stored.where(F.col("version") == version).collect()}


def latest_version(spark: SparkSession, path: str) -> int:
    """The latest version of the stored map; 0 without one."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [f.getPath().getName() for f in files.listStatus(where)] if files.exists(where) else []
    return max((int(n.partition("=")[2]) for n in names if n.startswith("version=")), default=0)


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None, version: int | None = None) -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot, grown_shard, vslot, version.

    The law is ``bytes``: the shards' sizes are near equal. Where ``map_path`` holds no map, one is made and
    stored as version 1. Where it does, the latest version, or ``version``, is edited for ``shards`` shards
    and the bytes of today and stored as the version after the latest, unless nothing changes; records
    follow it, so only records of the edited slots move. A ``version`` that is not stored is refused before
    any work, a map of another number of slots too. So the same call again, as after a failure, gives the same rows. ``slot`` numbers the rows of a shard from 0 without gaps, ordered by
    virtual slot, doc_id, checksum and copy. Null text has size 1, null doc_ids come first, texts of any
    length count whole, an empty table gives an empty result, and columns besides doc_id and text are not
    read. The driver sees ``slots`` totals and nothing else.
    """
    spark, path = docs.sparkSession, map_path or scratch_path(docs.sparkSession, "slot-map")
    latest = latest_version(spark, path)
    if version is not None and not 0 < version <= latest:
        raise ValueError(f"no version {version} of the map at {path}; the latest is {latest}")
    version, followed = (0, None) if not latest else load_map(spark, path, version or latest)
    if followed is not None and set(followed) != set(range(slots)):
        raise ValueError(f"the map at {path} has other slots than 0 to {slots - 1}")
    with dropping():
        rows = materialize(records(docs, slots), "shards", keep=True)
    totals = {r.vslot: (r.bytes, r.n) for r in rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()}
    slot_bytes = {v: b for v, (b, _) in totals.items()}
    slot_map = settled(assign(slot_bytes, shards, slots) if followed is None else followed, slot_bytes, shards)
    if slot_map != followed:
        version = latest + 1
        save_map(spark, slot_map, version, path)
    first, ahead = {}, [0] * shards
    for v in sorted(slot_map):
        first[v], ahead[slot_map[v]] = ahead[slot_map[v]], ahead[slot_map[v]] + totals.get(v, (0, 0))[1]
    places = spark.createDataFrame([(v, s, first[v]) for v, s in slot_map.items()], "vslot int, shard int, first long")
    within = Window.partitionBy("vslot").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "copy")
    # The map has exactly `slots` rows, so it may be broadcast at any input size.
    placed = rows.withColumn("nth", F.row_number().over(within) - 1).join(F.broadcast(places), "vslot")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("nth")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", F.lit(version).alias("version"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
