"""Helpers that the corpus operators share: columns, scratch tables and Arrow batches."""

from __future__ import annotations

import contextlib
import contextvars
import ctypes
import functools
import gc
import hashlib
import os
import string
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes of an Arrow batch that goes to a Python worker.
ARROW_BYTES = 4 << 20
#: Lower-cases A-Z only and keeps every other byte.
LOWER = bytes.maketrans(string.ascii_uppercase.encode(), string.ascii_lowercase.encode())


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only. Pure ASCII texts take the fast built-in, others a character map."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    )


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder for a table that cuts lineage.

    On a cluster it lies in the shared ``spark.checkpoint.dir``. Only a local master without that
    setting gets a folder of its own; elsewhere the shared warehouse serves.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir", None)
    if not base:
        if conf.get("spark.master", "").startswith("local["):
            base = os.path.join(tempfile.gettempdir(), "gridmill-scratch")
        else:
            base = spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


#: For each open ``dropping`` block of this thread or task what it has to delete, the innermost block last.
OPEN: contextvars.ContextVar[tuple[list[Callable[[], object]], ...]] = contextvars.ContextVar("OPEN", default=())


@contextlib.contextmanager
def dropping() -> Iterator[None]:
    """Deletes the scratch tables that are written inside when the block ends, but for those kept.

    What leaves the block must not read them any more: it is written inside, with ``keep``.
    """
    mine: list[Callable[[], object]] = []
    before = OPEN.set((*OPEN.get(), mine))
    try:
        yield
    finally:
        OPEN.reset(before)
        for drop in mine:
            drop()


def drop_later(drop: Callable[[], object], keep: bool = False) -> None:
    """Hands a deletion to the innermost open block, or with ``keep`` to the one around it; without one nothing is deleted."""
    blocks = OPEN.get()
    if len(blocks) > keep:
        blocks[-1 - keep].append(drop)


def set_for_block(spark: SparkSession, key: str, value: str) -> None:
    """Sets an option of the session until the innermost ``dropping`` block ends; without one it stays set, as a result that is still to run needs it."""
    before = spark.conf.get(key, None)
    if before != value:
        spark.conf.set(key, value)
        drop_later(lambda: spark.conf.unset(key) if before is None else spark.conf.set(key, before))


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def materialize(df: DataFrame, label: str, keep: bool = False) -> DataFrame:
    """Writes ``df`` once into scratch and returns a scan of it, so later uses do not recompute it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    drop_later(functools.partial(delete, spark, path), keep)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str = "row", label: str = "numbered") -> DataFrame:
    """``docs`` with a number in column ``name``, written once.

    Numbers taken again on a second reading may differ, as splits of the input follow the executors
    that are there; every later step reads these rows and their numbers from the written table.
    """
    return materialize(docs.withColumn(name, F.monotonically_increasing_id()), label)


#: Row numbers that one broadcast may hold, some 32 MB in each executor.
MOST_IDS = 1 << 20


def by_number(rows: DataFrame, numbers: DataFrame, name: str, how: str) -> DataFrame:
    """The ``rows`` whose number is among the distinct ``numbers`` (left_semi), or is not (left_anti).

    Up to MOST_IDS numbers travel to the rows, which then stay where they are; more meet them in a shuffle.
    """
    numbers = materialize(numbers.select(name), "numbers")
    return rows.join(F.broadcast(numbers) if numbers.count() <= MOST_IDS else numbers, name, how)


def give_back() -> None:
    """Returns freed memory to the system; a worker lives on beside those of other stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # a C library without it keeps its memory
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches of at most about ARROW_BYTES, as ``set_for_block`` sets it.

    Spark's own bound is 64 MB and 10,000 rows; a batch stands in the executor and in its Python worker
    at once, for every task and every step of a stage.
    """
    set_for_block(df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BYTES))

    def all_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return df.mapInArrow(all_of, schema)


def sealed(rows: DataFrame, key: str, order: str, line: str, between: str, name: str) -> DataFrame:
    """(key, ``name``): the SHA-256 in hex of each key's lines by ``order``, nulls first, with ``between`` between them.

    Lines stream through in order; a task holds one batch, however many lines a key has. Null lines count as empty.
    """
    laid = rows.select(key, order, line).repartition(key).sortWithinPartitions(F.asc_nulls_first(key), F.asc_nulls_first(order)).select(key, F.coalesce(line, F.lit("")).alias(line))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state = None, None
        for batch in batches:
            keys, lines = batch.column(0), batch.column(1).to_pylist()
            values = keys.to_pylist()
            cuts = [0, *(i for i in range(1, len(values)) if values[i] != values[i - 1]), len(values)]
            done, hashes = [], []
            for i, j in zip(cuts[:-1], cuts[1:]):
                if i == j:
                    continue
                if state is not None and values[i] == held:
                    state.update((between + between.join(lines[i:j])).encode())
                    continue
                if state is not None:
                    done.append(held)
                    hashes.append(state.hexdigest())
                held, state = values[i], hashlib.sha256(between.join(lines[i:j]).encode())
            yield pa.RecordBatch.from_arrays([pa.array(done, keys.type), pa.array(hashes, pa.string())], names=[key, name])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([held], keys.type), pa.array([state.hexdigest()], pa.string())], names=[key, name])

    return map_arrow(laid, run, f"{key} {rows.schema[key].dataType.simpleString()}, {name} string")


def fresh(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores put before it until no column of ``frames`` has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def binary(array: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The UTF-8 bytes of a string or binary column, null as empty, with 64-bit offsets."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    return array.fill_null(b"") if array.null_count else array


def buffers(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a large_binary array without nulls; offsets start at 0."""
    offsets = np.frombuffer(array.buffers()[1], np.int64, len(array) + 1 + array.offset)[array.offset :]
    if array.buffers()[2] is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), offsets - offsets[0]
    data = np.frombuffer(array.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def pieces(array: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of rows with about ``most`` bytes together; a longer text is a run of its own."""
    _, offsets = buffers(array)
    i, n = 0, len(array)
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def spread(array: pa.Array, mapped: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, each byte mapped, with a blank before and after each text."""
    data, offsets = buffers(array)
    n = len(array)
    out = np.full(len(data) + 2 * n, 32, np.uint8)
    at = offsets[:-1] + 2 * np.arange(n) + 1
    if len(data):
        out[np.arange(len(data)) + np.repeat(at - offsets[:-1], np.diff(offsets))] = np.frombuffer(mapped, np.uint8)[data]
    return out, np.append(at - 1, len(out))
