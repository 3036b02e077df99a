"""Units of documents, and questions about keys that units ask each other.

A unit is a run of documents of one input partition with a bounded number of bytes; a text that is
longer is a unit alone. Neighbouring units share a home, a run with about as many bytes as every other
home, and all units are written once to a table bucketed by home, so that every later round reads them
where they lie and no text is shuffled. In a round each unit sends its distinct keys, packed as arrays,
to buckets of the key space; a bucket answers for each key how the key stands among all units, and the
answers, a few bits a key, go back to the unit. Duplicates inside a unit are settled there, so a key of
any frequency reaches its bucket once from each unit.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm.common import binary, buffers, delete, drop_later, map_arrow, materialize, scratch_path, set_for_block

#: Bytes of text of a unit, of a home, and for each bucket of the key space; homes that a table may have.
UNIT_BYTES, HOME_BYTES, BUCKET_BYTES, MOST_HOMES = 6 << 20, 48 << 20, 32 << 20, 100_000
MAIL = "bucket long, home long, unit long, data binary"
MAIL_SCHEMA = pa.schema([("bucket", pa.int64()), ("home", pa.int64()), ("unit", pa.int64()), ("data", pa.binary())])
#: Stands for a null doc_id, which comes before all others.
NO_ID = np.iinfo(np.int64).min


@dataclass
class Units:
    docs: DataFrame
    buckets: int


def home_keys(spark: SparkSession, homes: int) -> list[int]:
    """For each bucket of a table with ``homes`` buckets a number that Spark puts into it."""
    tried = spark.range(int(homes * (math.log(homes) + 12)))
    return [r.id for r in tried.groupBy(F.pmod(F.hash("id"), F.lit(homes)).alias("at")).agg(F.min("id").alias("id")).orderBy("at").collect()]


def units_of(docs: DataFrame) -> Units:
    """Writes (home, unit, row, doc_id, text) of ``docs`` as a table bucketed by home.

    The number of homes follows the bytes of all texts, and homes are dealt out to the buckets in turn.
    """
    spark = docs.sparkSession
    # The home stands for the unit as well, so both sides of a round may be placed by it alone.
    set_for_block(spark, "spark.sql.requireAllClusterKeysForCoPartition", "false")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    told = texts.select(F.octet_length("text").cast("long").alias("n"), F.spark_partition_id().alias("part")).agg(F.sum("n").alias("bytes"), F.max("part").alias("last")).first()
    total, partitions = told.bytes or 0, int(spark.conf.get("spark.sql.shuffle.partitions"))
    homes = min(MOST_HOMES, max(partitions, -(-total // HOME_BYTES)))
    # A home has a whole unit at least: small units would send each bucket as many letters with little in them.
    keys, each = home_keys(spark, homes), max(UNIT_BYTES, -(-total // homes))
    step = max(1, -(-homes // ((told["last"] or 0) + 1)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        row = unit = home = in_unit = in_home = 0
        for batch in batches:
            sizes = np.diff(buffers(binary(batch.column(1)))[1]).tolist()
            at, units = [], []
            for size in sizes:
                if in_home and in_home + size > each:
                    home, unit, in_home, in_unit = home + 1, unit + 1, 0, 0
                elif in_unit and in_unit + size > UNIT_BYTES:
                    unit, in_unit = unit + 1, 0
                in_home, in_unit = in_home + size, in_unit + size
                at.append(keys[(part * step + home) % homes])
                units.append(part << 33 | unit)
            rows = np.arange(row, row + len(sizes)) + (part << 33)
            row += len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(units, pa.int64()), pa.array(rows), batch.column(0), batch.column(1)], names=["home", "unit", "row", "doc_id", "text"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = map_arrow(texts, place, f"home long, unit long, row long, doc_id {kind}, text string")
    name, path = f"units_{uuid.uuid4().hex}", scratch_path(spark, "units")
    rows.write.bucketBy(homes, "home").sortBy("home", "unit").option("compression", "zstd").option("path", path).saveAsTable(name)
    drop_later(lambda: (spark.sql(f"DROP TABLE IF EXISTS {name}"), delete(spark, path)))
    return Units(spark.table(name), max(4 * partitions, -(-total // BUCKET_BYTES)))


class Unit:
    """The documents of one unit in the order of (doc_id, row)."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column("doc_id").combine_chunks().cast(pa.int64()).fill_null(NO_ID)
        rows = table.column("row").combine_chunks()
        order = np.lexsort((rows.to_numpy(zero_copy_only=False), ids.to_numpy(zero_copy_only=False)))
        self.home, self.number = table.column("home")[0].as_py(), table.column("unit")[0].as_py()
        self.ids = ids.to_numpy(zero_copy_only=False)[order]
        self.doc_ids = table.column("doc_id").combine_chunks().take(pa.array(order))
        self.texts = binary(table.column("text")).take(pa.array(order))


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each key; it grows with the key."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def mail(unit: Unit, cuts: np.ndarray, parts: Callable[[int, int], bytes], state: bytes) -> pa.Table:
    """A letter to each bucket with keys, and the unit's state, which comes back with the answers."""
    full = np.flatnonzero(np.diff(cuts))
    data = [parts(int(cuts[b]), int(cuts[b + 1])) for b in full]
    own = [pa.array([x] * (len(data) + 1), pa.int64()) for x in (unit.home, unit.number)]
    return pa.Table.from_arrays([pa.array([*full.tolist(), -1 - unit.number], pa.int64()), *own, pa.array([*data, state], pa.binary())], schema=MAIL_SCHEMA)


def answered(letters: DataFrame, answer: Callable[[list[int], list[bytes]], list[bytes]], label: str) -> DataFrame:
    """The letters with their data replaced by the bucket's answers; states pass through."""

    def run(group: pa.Table) -> pa.Table:
        if group.column("bucket")[0].as_py() < 0:
            return group
        told = answer(group.column("unit").to_pylist(), group.column("data").to_pylist())
        return pa.Table.from_arrays([*(group.column(c) for c in ("bucket", "home", "unit")), pa.array(told, pa.binary())], schema=MAIL_SCHEMA)

    return materialize(letters.groupBy("bucket").applyInArrow(run, MAIL), label)


def opened(answers: pa.Table) -> tuple[bytes, list[bytes]]:
    """(state, answers in the order of the buckets) of a unit's letters."""
    order = np.argsort(answers.column("bucket").to_numpy(), kind="stable")
    data = answers.column("data").to_pylist()
    return data[order[0]], [data[i] for i in order[1:]]


def pack(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unpack(data: bytes, n: int, at: int = 0) -> np.ndarray:
    """``n`` flags of ``data``, the ones that ``pack`` wrote at byte ``at``."""
    return np.unpackbits(np.frombuffer(data, np.uint8, -(-n // 8), at), count=n).astype(bool)


def first_round(units: Units, ask: Callable[[Unit], pa.Table]) -> DataFrame:
    return units.docs.groupBy("home", "unit").applyInArrow(lambda t: ask(Unit(t)), MAIL)


def next_round(units: Units, answers: DataFrame, ask: Callable[[Unit, pa.Table], pa.Table], schema: str = MAIL) -> DataFrame:
    return units.docs.groupBy("home", "unit").cogroup(answers.groupBy("home", "unit")).applyInArrow(lambda docs, told: ask(Unit(docs), told), schema)


def letters_of(unit: Unit, key: np.ndarray, other: np.ndarray, doc: np.ndarray, buckets: int, state: bytes) -> pa.Table:
    """Letters that ask which of distinct keys (``key``, ``other``), sorted by bucket, come first of all.

    ``doc`` is the place in the unit of the document that holds each key; runs of it are sent once.
    """
    cuts = np.searchsorted(bucket_of(key, buckets), np.arange(buckets + 1, dtype=np.uint64))

    def part(a: int, b: int) -> bytes:
        change = np.flatnonzero(np.diff(doc[a:b], prepend=-1))
        sizes = np.diff(np.append(change, b - a))
        return b"".join((np.array([b - a, len(change)], np.int64).tobytes(), self_ids[doc[a:b][change]].tobytes(), sizes.astype(np.int32).tobytes(), key[a:b].tobytes(), other[a:b].tobytes()))

    self_ids = unit.ids
    return mail(unit, cuts, part, state)


def read_letter(data: bytes, kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, other, doc_id) of a letter that ``letters_of`` wrote."""
    n, runs = np.frombuffer(data, np.int64, 2)
    ids = np.frombuffer(data, np.int64, runs, 16)
    sizes = np.frombuffer(data, np.int32, runs, 16 + 8 * runs)
    at = 16 + 12 * int(runs)
    return np.frombuffer(data, np.uint64, n, at), np.frombuffer(data, kind, n, at + 8 * int(n)), np.repeat(ids, sizes)


def ranked(units: list[int], letters: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """(order, new key, new pair, sizes) of all keys of a bucket, in the order key, other, doc_id, unit.

    The flags tell where in that order another key and another (key, other) begins.
    """
    read = [read_letter(d, kind) for d in letters]
    key, other, ids = (np.concatenate([r[k] for r in read]) for k in range(3))
    sizes = [len(r[0]) for r in read]
    order = np.lexsort((np.repeat(units, sizes), ids, other, key))
    key, other = key[order], other[order]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    return order, new_key, new_key | np.concatenate([[True], other[1:] != other[:-1]]), sizes


def split(flags: np.ndarray, sizes: list[int]) -> list[np.ndarray]:
    return np.split(flags, np.cumsum(sizes)[:-1])


def not_first(units: list[int], letters: list[bytes]) -> list[bytes]:
    """The bucket's answer to ``letters_of``: a flag for each key that stands elsewhere earlier."""
    order, _, new, sizes = ranked(units, letters, np.uint32)
    later = np.empty(len(order), bool)
    later[order] = ~new
    return [pack(f) for f in split(later, sizes)]


def distinct_first(key: np.ndarray, other: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, which): the first place of each distinct (key, other), sorted by bucket and place, and for
    every place the number of its key in that list."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((other, key))  # stable, so places of equal keys stay in order
    k, o = key[order], other[order]
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])
    first = order[new]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    sent = np.lexsort((first, bucket_of(key[first], buckets)))
    back = np.empty(len(sent), np.int64)
    back[sent] = np.arange(len(sent))
    return first[sent], back[number]
