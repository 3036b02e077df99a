"""A stored vector index with exact answers: blocks around centroids, skipped where their bound can't reach the k-th best.

Vectors are normed once and stored by block, some hundred to a row as one matrix, with the columns that
hits have to carry. A block has a centroid and the widest angle of its vectors to it, so no vector of it
is nearer to a query than their angle less that width. A search first reads, for each query, the blocks
of the best bounds that hold k vectors together; the k-th best of these is a floor, and only blocks
whose bound reaches it are read after that.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from gridmill.sources import index_store
from gridmill.sources.tables import stored

#: Centroids come from a bounded sample of vectors: SAMPLE for each of at most MOST_BLOCKS blocks.
MOST_BLOCKS, SAMPLE, ROUNDS = 4096, 16, 4
#: Vectors of a stored row, queries of a row that meets it, groups of blocks for each core.
CHUNK, TOGETHER, GROUPS = 512, 512, 4
#: What rounding may take from a bound.
SLACK = 1e-9
#: Places to which likenesses are compared; equal ones go by id.
PLACES = 9


class Blocks(NamedTuple):
    spark: SparkSession
    path: str
    #: Names and types of the id and of what hits carry.
    fields: tuple[tuple[str, str], ...]

    def vectors(self) -> DataFrame:
        lists = ", ".join(f"{n} array<{t}>" for n, t in self.fields)
        return self.spark.read.schema(f"angle double, units binary, {lists}, block int").parquet(f"{self.path}/vectors")

    def blocks(self) -> DataFrame:
        return self.spark.read.schema("block int, angle double, n long, centroid array<double>").parquet(f"{self.path}/blocks")


def fields_of(vectors: DataFrame, carried: list[str]) -> tuple[tuple[str, str], ...]:
    return tuple((n, vectors.schema[n].dataType.simpleString()) for n in ("id", *carried))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as unit vectors; zero ones stay zero. Lists of another length, and null, are NaN."""
    out = np.full((len(column), width), np.nan)
    lengths = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    good = np.flatnonzero(lengths == width)
    if len(good):
        flat = column.take(pa.array(good)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        out[good] = flat.reshape(len(good), width)
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norms, out=out, where=norms != 0)


def centroids_of(units: np.ndarray, n: int) -> np.ndarray:
    """``n`` unit centroids of a sample, by some rounds of spherical k-means from its first vectors."""
    units = units[np.isfinite(units).all(axis=1) & units.any(axis=1)]
    if not len(units):
        return np.zeros((0, units.shape[1]))
    c = units[:n].copy()
    for _ in range(ROUNDS):
        # All likenesses at once would be SAMPLE numbers for the square of the blocks: 2 GB for the most of them.
        nearest = np.concatenate([np.argmax(units[at : at + CHUNK] @ c.T, axis=1) for at in range(0, len(units), CHUNK)])
        sums = np.zeros_like(c)
        np.add.at(sums, nearest, units)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        c = np.divide(sums, norms, out=c, where=norms > 1e-12)
    return c


def least_hash(n: int, most: int) -> int:
    """A hash that at least ``most`` of ``n`` rows are sure to stay under, and not many more: six deviations above their share."""
    share = (most + 6 * math.sqrt(most) + 36) / max(n, 1)
    return (1 << 63) - 1 if share >= 1 else int(-(1 << 63) + share * (1 << 64))


def sample_of(vectors: DataFrame, most: int) -> pa.Table:
    """The ``most`` vectors of the lowest hashes of their ids (unique), as (embedding, h, id).

    The executors drop what lies above the hash that so many rows stay under; a sort with a limit would
    send that many rows of every task to the driver.
    """
    rows = vectors.where("embedding IS NOT NULL").select("embedding", F.xxhash64("id").alias("h"), "id")
    told = rows.where(F.col("h") <= F.lit(least_hash(rows.count(), most))).toArrow()
    return told.sort_by([("h", "ascending"), ("id", "ascending")]).slice(0, most)


def build(vectors: DataFrame, path: str, carried: list[str], blocks: int | None = None) -> Blocks:
    """Stores ``vectors`` (id, embedding, and the columns ``carried``) by block in a new folder.

    The width is that of the first vector of the sample; vectors of another one, with null or with a
    value that is no number are not stored. Zero vectors have a block of their own, as like to any query as 0.
    """
    spark, n = vectors.sparkSession, vectors.count()
    blocks = blocks or max(1, min(MOST_BLOCKS, math.isqrt(n)))
    column = sample_of(vectors, SAMPLE * blocks).column("embedding").combine_chunks()
    width = len(column[0]) if len(column) else 0
    c = centroids_of(matrix(column, width), blocks)
    sent = spark.sparkContext.broadcast(c)  # at most MOST_BLOCKS rows
    types = {name: to_arrow_type(vectors.schema[name].dataType) for name in ("id", *carried)}
    index = Blocks(spark, path, fields_of(vectors, carried))
    ddl = dict(index.fields)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = sent.value
        for batch in batches:
            units = matrix(batch.column(len(types)), width)
            good = np.isfinite(units).all(axis=1)
            batch, units = batch.filter(pa.array(good)), units[good]
            cos = units @ c.T if len(c) else np.zeros((len(units), 1))
            block = np.where(units.any(axis=1), np.argmax(cos, axis=1), len(c))
            angle = np.arccos(np.clip(cos[np.arange(len(units)), np.minimum(block, cos.shape[1] - 1)], -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(types)], pa.array(block, pa.int32()), pa.array(angle), pa.array([u.tobytes() for u in units], pa.binary())], names=[*types, "block", "angle", "unit"])

    told = vectors.select(*types, "embedding").mapInArrow(assign, ", ".join(f"{n} {t}" for n, t in ddl.items()) + ", block int, angle double, unit binary")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block that follow each other become one row."""
        for batch in batches:
            block = batch.column("block").to_numpy()
            cuts = np.unique(np.concatenate([[0, len(block)], np.flatnonzero(np.diff(block)) + 1, np.arange(0, len(block), CHUNK)])) if len(block) else []
            spans = [batch.slice(a, b - a) for a, b in zip(cuts[:-1], cuts[1:])]
            lists = [pa.array([s.column(name).to_pylist() for s in spans], pa.list_(t)) for name, t in types.items()]
            yield pa.RecordBatch.from_arrays([pa.array([s.column("block")[0].as_py() for s in spans], pa.int32()), pa.array([max(s.column("angle").to_pylist()) for s in spans], pa.float64()), pa.array([b"".join(s.column("unit").to_pylist()) for s in spans], pa.binary()), *lists], names=["block", "angle", "units", *types])

    laid = told.repartitionByRange("block", "id").sortWithinPartitions("block", "id")
    laid.mapInArrow(pack, "block int, angle double, units binary, " + ", ".join(f"{n} array<{t}>" for n, t in ddl.items())).write.partitionBy("block").parquet(f"{path}/vectors")
    sent.unpersist()
    sizes = index.vectors().groupBy("block").agg(F.max("angle").alias("angle"), F.sum(F.size("id")).alias("n"))
    middles = spark.createDataFrame([(k, [float(x) for x in row]) for k, row in enumerate(c)] + [(len(c), [0.0] * width)], "block int, centroid array<double>")
    sizes.join(F.broadcast(middles), "block").write.parquet(f"{path}/blocks")
    return index


def bounds(queries: DataFrame, table: pa.Table, k: int) -> DataFrame:
    """``queries`` (query_id, q, a unit vector as bytes) with ``asked``, the blocks to read for each, and ``floor``.

    Those of the best bounds that hold k vectors together; where the queries have ``done``, blocks that were
    read, and the ``floor`` that these gave, the others whose bound reaches it. ``table`` has MOST_BLOCKS rows at most.
    """
    numbers, width, n = (table.column(c).to_numpy() for c in ("block", "angle", "n"))
    c = np.array(table.column("centroid").to_pylist(), float).reshape(len(numbers), -1) if len(numbers) else np.zeros((0, 0))
    sent = queries.sparkSession.sparkContext.broadcast((numbers, width, n, c))
    again = "done" in queries.columns
    kind = queries.schema["query_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, width, n, c = sent.value
        zero = ~c.any(axis=1)
        for batch in batches:
            out = []
            for r, q in enumerate(batch.column("q").to_pylist()):
                if not len(numbers):
                    out.append([])
                    continue
                v = np.frombuffer(q)
                bound = np.cos(np.maximum(0, np.arccos(np.clip(c @ v, -1, 1)) - width - SLACK)) + SLACK
                bound[zero | ~v.any()] = SLACK
                order = np.lexsort((numbers, -bound))
                if again:
                    # Without a floor fewer than k vectors were found: all that there are.
                    least = batch.column("floor")[r].as_py()
                    chosen = np.setdiff1d(numbers[order if least is None else order[bound[order] >= least - SLACK]], batch.column("done")[r].values.to_numpy())
                else:
                    chosen = numbers[order[: int(np.searchsorted(np.cumsum(n[order]), k)) + 1]]
                out.append(chosen.tolist())
            floors = batch.column("floor") if again else pa.nulls(len(out), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(out, pa.list_(pa.int32())), floors], names=["query_id", "q", "asked", "floor"])

    return queries.mapInArrow(run, f"query_id {kind}, q binary, asked array<int>, floor double")


def lots(queries: DataFrame, groups: int) -> DataFrame:
    """(grp, most, query_ids, qs, floors, wanted): up to TOGETHER queries and the blocks that they ask for of one group, for all groups that have some.

    Block b is of group b % groups, and ``wanted`` has a bit for each query and each ``most`` blocks of the group.
    So a query's vector goes to each group once, not to each block.
    """
    kind = queries.schema["query_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                lot = batch.slice(at, TOGETHER)
                asked = lot.column("asked")
                row, block = np.repeat(np.arange(lot.num_rows), pc.list_value_length(asked).to_numpy()), asked.flatten().to_numpy()
                if not len(block):
                    continue
                of, nth = block % groups, block // groups
                wanted = np.zeros((groups, lot.num_rows, int(nth.max()) + 1), bool)
                wanted[of, row, nth] = True
                for g in np.unique(of).tolist():
                    some = np.flatnonzero(wanted[g].any(axis=1))
                    kept = lot.take(pa.array(some))
                    one = lambda x, t: pa.array([x], t)
                    columns = [one(g, pa.int32()), one(wanted.shape[2], pa.int32()), one(kept.column("query_id").to_pylist(), pa.list_(to_arrow_type(kind))), one(b"".join(kept.column("q").to_pylist()), pa.binary())]
                    columns += [one(kept.column("floor").to_pylist(), pa.list_(pa.float64())), one(np.packbits(wanted[g][some]).tobytes(), pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=["grp", "most", "query_ids", "qs", "floors", "wanted"])

    return queries.select("query_id", "q", "asked", "floor").mapInArrow(run, f"grp int, most int, query_ids array<{kind.simpleString()}>, qs binary, floors array<double>, wanted binary")


def likest_of(cos: np.ndarray, floors: np.ndarray, k: int, numbers: Callable[[], np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, rounded) of up to ``k`` likenesses of each row that may be among the best, of its floor or more; floors rise to the k-th of a row.

    Equal ones go by ``numbers``, which are asked for only where more than k are left.
    """
    may = cos >= floors[:, None] - 2 * SLACK
    over = np.flatnonzero(may.sum(axis=1) > k)
    if len(over):
        some = cos[over]
        floors[over] = np.maximum(floors[over], np.partition(some, some.shape[1] - k, axis=1)[:, some.shape[1] - k])
        may[over] = some >= floors[over, None] - 2 * SLACK
        for r in over[may[over].sum(axis=1) > k]:
            at = np.flatnonzero(may[r])
            may[r, at[np.lexsort((numbers()[at], -np.round(cos[r, at], PLACES)))[k:]]] = False
    row, column = np.nonzero(may)
    return row, column, np.round(cos[row, column], PLACES)


def measured(index: Blocks, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, cos, id, carried ...): of each stored row that a query (query_id, q, asked, floor) asks for up to k vectors, of its floor or more."""
    vectors = index.vectors()
    names = [n for n, _ in index.fields]
    asked = [r.block for r in queries.select(F.explode("asked").alias("block")).distinct().collect()]  # MOST_BLOCKS at most
    kind = queries.schema["query_id"].dataType
    groups = max(1, min(len(asked), GROUPS * queries.sparkSession.sparkContext.defaultParallelism))
    rows = vectors.where(F.col("block").isin(asked)).withColumn("grp", (F.col("block") % groups).cast("int")).repartition(groups, "grp")
    # Of neither side Spark knows the size before it is there, and a broadcast of either would go through the driver.
    met = lots(queries, groups).repartition(groups, "grp").join(rows.hint("merge"), "grp").select("query_ids", "qs", "floors", "wanted", "most", (F.col("block") / groups).cast("int").alias("nth"), "units", *names)
    ddl = {n: vectors.schema[n].dataType.elementType for n in names}
    types = [to_arrow_type(kind), pa.float64(), *(to_arrow_type(t) for t in ddl.values())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, marks, floors = None, b"", np.zeros(0)
        for batch in batches:
            for r in range(batch.num_rows):
                ids, floor, qs, wanted = batch.column(0)[r].values, batch.column(2)[r].values, batch.column(1)[r].as_py(), batch.column(3)[r].as_py()
                # The rows that a lot meets follow each other, and what one gives is a floor for the next; the same queries may ask for other blocks of another group.
                if lot is None or wanted != marks or not lot.equals(ids):
                    lot, marks, floors = ids, wanted, pc.fill_null(floor, -2.0).to_numpy(zero_copy_only=False).copy()
                    q, told = np.frombuffer(qs).reshape(len(ids), -1), np.unpackbits(np.frombuffer(wanted, np.uint8), count=len(ids) * batch.column(4)[r].as_py()).reshape(len(ids), -1)
                nth = batch.column(5)[r].as_py()
                own = np.flatnonzero(told[:, nth]) if nth < told.shape[1] else np.zeros(0, int)
                if not len(own):
                    continue
                carried = [batch.column(7 + j)[r].values for j in range(len(names))]
                least = floors[own]
                row, column, cos = likest_of(q[own] @ np.frombuffer(batch.column(6)[r].as_py()).reshape(-1, q.shape[1]).T, least, k, lambda: np.array(carried[0].to_pylist()))  # noqa: B023
                floors[own] = least
                at = pa.array(column)
                columns = [ids.take(pa.array(own[row])), pa.array(cos), *(c.take(at) for c in carried)]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, types)], names=["query_id", "cos", *names])

    return met.mapInArrow(run, f"query_id {kind.simpleString()}, cos double, " + ", ".join(f"{n} {t.simpleString()}" for n, t in ddl.items()))


def best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("cos"), "id")
    return rows.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k)


def unit_queries(queries: DataFrame, width: int) -> DataFrame:
    """(query_id, q) as bytes of unit vectors; queries without a vector of the index's width are left out."""
    kind = queries.schema["query_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = matrix(batch.column(1), width)
            good = np.isfinite(units).all(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([u.tobytes() for u in units[good]], pa.binary())], names=["query_id", "q"])

    return queries.select("query_id", "q").mapInArrow(run, f"query_id {kind.simpleString()}, q binary")


class Found(NamedTuple):
    #: (query_id, nth, id, cos, carried ...)
    hits: DataFrame
    #: (query_id, block) of all that was read.
    read: DataFrame


def nearest(index: Blocks, queries: DataFrame, k: int) -> Found:
    """The k vectors most like each query (query_id unique, q), by likeness in nine places, then by id: the same as a scan finds."""
    blocks = index.blocks().toArrow()  # MOST_BLOCKS rows at most
    width = len(blocks.column("centroid")[0]) if len(blocks) else 0
    asked = unit_queries(queries, width)
    first = stored(bounds(asked, blocks, k), "first-blocks")
    hits = stored(best(measured(index, first, k), k).drop("nth"), "first-hits")
    floor = hits.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("cos")).alias("floor"))
    again = first.select("query_id", "q", F.col("asked").alias("done")).join(floor.hint("merge"), "query_id", "left")
    rest = stored(bounds(again, blocks, k), "other-blocks")
    both = hits.unionByName(measured(index, rest, k))
    read = first.unionByName(rest).select("query_id", F.explode("asked").alias("block"))
    return Found(best(both, k).select("query_id", "nth", "id", "cos", *[c for c in hits.columns if c not in ("query_id", "id", "cos")]), read)


def opened(name: str, vectors: DataFrame, carried: list[str]) -> Blocks:
    path = index_store.opened(name, [vectors], f"vectors {MOST_BLOCKS} {SAMPLE} {CHUNK} {','.join(carried)}", lambda p: build(vectors, p, carried))
    return Blocks(vectors.sparkSession, path, fields_of(vectors, carried))
