"""Near-duplicate detection: one-permutation hashing, banded buckets and star-shaped candidate edges.

One hash of each shingle fills the bins of a signature with their least members, and optimal
densification fills empty bins from full ones, picked by a hash of the bin alone. Bands of the
signature name buckets. In a bucket every document is paired with one centre of each of its two size
bands, not with every other, so a bucket of n makes less than 2 n pairs. Pairs that can be links by
their sizes are confirmed on full shingle sets, and components follow.
Links between documents that share a bucket but not its centre are found by their differences from
what most of their block has in common; see ``resolve``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.common import binary, by_number, dropping, fresh, map_arrow, materialize, numbered, pieces, table
from gridmill.llm.components import components
from gridmill.llm.words import mix, powers, shingle_sets

WORDS = 5
#: A pair at a similarity of 0.8 shares no bucket with a chance of about 3e-6, at 0.85 of 7e-9.
BANDS, ROWS = 32, 5
BINS = BANDS * ROWS
BLOCK_BYTES = 1 << 20


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets x BINS) densified one-permutation signatures of non-empty sets."""
    sig = np.zeros((len(sets), BINS), np.uint64)
    full = np.zeros((len(sets), BINS), bool)
    for i, members in enumerate(sets):
        bins = ((members >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)  # grows with the member
        first = np.flatnonzero(np.diff(bins.astype(np.int64), prepend=-1))
        sig[i, bins[first]] = members[first]
        full[i, bins[first]] = True
    at, empty = np.nonzero(~full)
    attempt = 0
    while len(at):
        attempt += 1
        source = (mix(empty.astype(np.uint64) * np.uint64(1 << 20) + np.uint64(attempt)) % np.uint64(BINS)).astype(np.int64)
        found = full[at, source]
        sig[at[found], empty[found]] = sig[at[found], source[found]]
        at, empty = at[~found], empty[~found]
    return sig


def bands_of(sig: np.ndarray) -> np.ndarray:
    """(sets x BANDS) names of the buckets; bands never share a name on purpose."""
    weights = powers(ROWS, np.uint64(0xD6E8FEB86659FD93))
    total = (sig.reshape(len(sig), BANDS, ROWS) * weights).sum(axis=2, dtype=np.uint64)
    return mix(total + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def sketch(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """(row, doc_id, n_shingles, digest, bands) of (row, doc_id, text): digest names the whole set, bands are null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(2))
            for i, j in pieces(texts, BLOCK_BYTES):
                sets = shingle_sets(texts.slice(i, j - i), words)
                some = [k for k, s in enumerate(sets) if len(s)]
                names: list[list[int] | None] = [None] * len(sets)
                for k, row in zip(some, bands_of(signatures([sets[k] for k in some])).view(np.int64).tolist() if some else ()):
                    names[k] = row
                yield pa.RecordBatch.from_pydict(
                    {
                        "row": batch.column(0).slice(i, j - i),
                        "doc_id": batch.column(1).slice(i, j - i),
                        "n_shingles": pa.array([len(s) for s in sets], pa.int64()),
                        "digest": pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                        "bands": pa.array(names, pa.list_(pa.int64())),
                    }
                )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return map_arrow(rows.select("row", "doc_id", "text"), run, f"row long, doc_id {kind}, n_shingles long, digest binary, bands array<long>")


def similar(pairs: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """The pairs (u, v, text_u, text_v) with 100 * intersection >= percent * union of full sets, as (u, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, held = None, None
        for batch in batches:
            u, v = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            left, right = binary(batch.column(2)), binary(batch.column(3))
            keep = []
            for i, j in pieces(right, BLOCK_BYTES):
                for k, own in zip(range(i, j), shingle_sets(right.slice(i, j - i), words)):
                    if u[k] != centre:
                        centre, held = u[k], shingle_sets(left.slice(k, 1), words)[0]
                    common = len(np.intersect1d(held, own, assume_unique=True))
                    keep.append(100 * common >= percent * (len(held) + len(own) - common))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_pydict({"u": batch.column(0).filter(mask), "v": batch.column(1).filter(mask)})

    return map_arrow(pairs.select("u", "v", "text_u", "text_v"), run, "u long, v long")


def confirm(pairs: DataFrame, texts: DataFrame, percent: int, words: int) -> DataFrame:
    """The links among candidate ``pairs`` (u, v); ``texts`` (node, text) holds the candidates' texts."""
    own = pairs.join(texts.select(F.col("node").alias("v"), F.col("text").alias("text_v")), "v")
    return similar(own.join(texts.select(F.col("node").alias("u"), F.col("text").alias("text_u")), "u"), percent, words)


def link(rows: DataFrame, percent: int, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(sketches, labels) of (row, doc_id, text): a row per document, and (node, component) of the linked representatives."""
    seen = materialize(sketch(rows, words), "sketches")
    classes = materialize(seen.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("row", "n_shingles", "bands")).alias("best")).drop("digest"), "classes")
    nodes = classes.select(F.col("best.row").alias("node"), F.col("best.n_shingles").alias("n"), F.explode("best.bands").alias("bucket"))
    # Sizes within the ratio lie in one step of its logarithm or in two neighbouring ones, so they share a band of two steps.
    step = F.floor(F.log("n") / (math.log(100 / percent) + 1e-9))
    # One number names a bucket and a size band; a clash only adds an edge, which is confirmed like others.
    banded = nodes.select("node", F.explode(F.array(F.xxhash64("bucket", step), F.xxhash64("bucket", step + 1))).alias("key"))
    # The least of a struct is found by sorting, which spills; a hash table of mostly single keys would fill the heap.
    centres = banded.groupBy("key").agg(F.min(F.struct("node")).alias("least"), F.count(F.lit(1)).alias("members")).where("members > 1").select("key", F.col("least.node").alias("u"))
    stars = banded.join(centres, "key").where("node <> u").select("u", F.col("node").alias("v")).distinct()
    sizes = classes.select(F.col("best.row").alias("node"), F.col("best.n_shingles").alias("n"))
    n_u, n_v = (sizes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}")) for c in ("u", "v"))
    # Every edge of a star makes blocks; only one within the ratio can be a link.
    near = F.lit(100) * F.least("n_u", "n_v") >= F.lit(percent) * F.greatest("n_u", "n_v")
    edges = materialize(stars.join(n_u, "u").join(n_v, "v").select("u", "v", near.alias("near")), "edges")
    pairs = edges.where("near").drop("near")
    wanted = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = materialize(by_number(rows.select(F.col("row").alias("node"), "text"), wanted, "node", "left_semi"), "texts")
    links = materialize(confirm(pairs, texts, percent, words), "links")
    return seen, resolve(texts, edges.drop("near"), links, percent, words)


def reach(n: Column, other: Column, percent: int) -> Column:
    """How many shingles two sets of these sizes may differ in at most."""
    return F.lit((100 - percent) / (100 + percent)) * (n + other) + 1e-6


def resolve(texts: DataFrame, pairs: DataFrame, links: DataFrame, percent: int, words: int) -> DataFrame:
    """(node, component) over all links among candidates, also those that the stars have missed.

    A block is a component of the candidate pairs; what may still be missed lies in blocks of several
    labels. A block's consensus is the set of shingles that over half of its documents hold. Two sets
    differ exactly where their differences from the consensus do, so

    - the document nearest the consensus is paired with the others first, and
    - a pair that is left either has differences so small that it is a link, or must share some: then a
      prefix of the rarest ones of the smaller difference meets the other, and an equi-join finds it.

    In a group of copies with edits of their own the rarest differences stand once, and the join is
    empty, however large the group is.
    """
    blocks = components(pairs).withColumnRenamed("component", "block")

    def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
        return rows.join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    labels = components(links)
    told = materialize(labelled(blocks, labels), "blocks")
    mixed = materialize(told.groupBy("block").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("a"), F.max("label").alias("b")).where("size > 2 AND a <> b").select("block", "size"), "mixed")
    if mixed.isEmpty():
        return labels
    sets = materialize(shingles(told.drop("label").join(mixed, "block").join(texts, "node"), words), "sets")
    counted = sets.select("block", "size", F.explode("tokens").alias("token")).groupBy("block", "size", "token").agg(F.count(F.lit(1)).alias("n"))
    consensus = counted.where("2 * n > size").groupBy("block").agg(F.collect_list("token").alias("held"))
    held = F.coalesce("held", F.array().cast("array<long>"))
    differ = F.concat(F.array_except("tokens", held), F.transform(F.array_except(held, F.col("tokens")), lambda x: F.bitwise_not(x)))
    deltas = sets.join(consensus, "block", "left").select("block", "node", F.size("tokens").alias("n"), differ.alias("delta"))
    deltas = materialize(deltas.withColumn("d", F.size("delta")), "deltas")
    rows = deltas.drop("delta")

    near = F.lit(100) * F.least("n", "n2") >= F.lit(percent) * F.greatest("n", "n2")
    fits = (F.col("label") != F.col("label2")) & near & (F.abs(F.col("d") - F.col("d2")) <= reach(F.col("n"), F.col("n2"), percent))
    pair = (F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v"))

    def second(side: DataFrame) -> DataFrame:
        return side.select("block", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "d", "label")])

    now = materialize(labelled(rows, labels), "labels")
    best = now.groupBy("block").agg(F.min(F.struct("d", "node", "n", "label")).alias("m")).select("block", "m.*")
    stars = now.join(second(best), "block").where(fits).select(*pair).distinct().join(pairs, ["u", "v"], "left_anti")
    new = materialize(confirm(stars, texts, percent, words), "links")
    if not new.isEmpty():
        links = links.unionByName(new)
        labels = components(links)
        now = materialize(labelled(rows, labels), "labels")
    parts = now.groupBy("block", "label").agg(F.count(F.lit(1)).alias("members"), F.min("d").alias("d"), F.max("n").alias("n"))
    largest = parts.groupBy("block").agg(F.max(F.struct("members", "label")).alias("m"), F.max("n").alias("most"), F.count(F.lit(1)).alias("labels")).where("labels > 1").select("block", F.col("m.label").alias("largest"), "most")
    outside = parts.join(largest, "block").where("label <> largest").groupBy("block").agg(F.min("d").alias("outer_d"))
    frame = largest.join(outside, "block")
    now = materialize(now.join(frame, "block"), "strays")
    # Differences so small that they need share nothing: one of the two lies outside the largest component.
    small = second(now.where((F.col("label") != F.col("largest")) & (F.col("d") <= reach(F.col("n"), F.least(F.col("n") * 100 / percent, F.col("most")), percent))))
    little = now.join(small, "block").where(fits & (F.col("d") + F.col("d2") <= reach(F.col("n"), F.col("n2"), percent))).select(*pair)
    # The others: the smaller difference's prefix of the rarest tokens against whole differences.
    tokens = now.join(deltas.select("block", "node", F.explode("delta").alias("token")), ["block", "node"])
    often = tokens.groupBy("block", "token").agg(F.count(F.lit(1)).alias("often")).where("often > 1")
    shared = materialize(tokens.join(often, ["block", "token"]), "shared")
    partner = F.when(F.col("label") == F.col("largest"), F.greatest("d", "outer_d")).otherwise(F.col("d"))
    length = F.floor((F.col("d") - partner + reach(F.col("n"), F.least(F.col("n") * 100 / percent, F.col("most")), percent)) / 2) + 1
    alone = now.join(shared.groupBy("block", "node").agg(F.count(F.lit(1)).alias("common")), ["block", "node"]).select("block", "node", (F.col("d") - F.col("common")).alias("alone"))
    rank = Window.partitionBy("block", "node").orderBy("often", "token")
    ranked = shared.withColumn("nth", F.row_number().over(rank)).join(alone, ["block", "node"])
    prefix = ranked.where(F.col("nth") + F.col("alone") <= length).select("block", "token", "node", "n", "d", "label")
    whole = shared.select("block", "token", *[F.col(c).alias(f"{c}2") for c in ("node", "n", "d", "label")])
    met = prefix.join(whole, ["block", "token"]).where(fits & (F.col("d2") >= F.col("d"))).select(*pair)
    more = little.unionByName(met).distinct().join(pairs, ["u", "v"], "left_anti")
    new = materialize(confirm(more, texts, percent, words), "links")
    return labels if new.isEmpty() else components(links.unionByName(new))


def shingles(rows: DataFrame, words: int) -> DataFrame:
    """(block, node, size, tokens) of rows with these columns and text: the shingle sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = binary(batch.column(3))
            for i, j in pieces(texts, BLOCK_BYTES):
                sets = shingle_sets(texts.slice(i, j - i), words)
                ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*[batch.column(k).slice(i, j - i) for k in range(3)], pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], names=["block", "node", "size", "tokens"])

    return map_arrow(rows.select("block", "node", "size", "text"), run, "block long, node long, size long, tokens array<long>")


def groups_of(rows: DataFrame, percent: int, words: int = WORDS) -> DataFrame:
    """``near_groups`` of written rows (row, doc_id, text)."""
    with dropping():
        return materialize(told_groups(rows, percent, words), "groups", keep=True)


def told_groups(rows: DataFrame, percent: int, words: int) -> DataFrame:
    seen, labels = link(rows, percent, words)
    nodes = seen.where("n_shingles > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("first"))
    labelled = nodes.join(labels, "node", "left").select("digest", "first", F.coalesce("component", "node").alias("component"))
    heads = labelled.groupBy("component").agg(F.min("first").alias("head"))
    told = labelled.join(heads, "component").select("digest", "head")
    out = seen.drop("bands").join(told, "digest", "left")
    component = F.when(F.col("head").isNull(), F.col("doc_id")).otherwise(F.col("head.doc_id"))
    return out.select("row", "doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.coalesce(F.col("row") == F.col("head.row"), F.lit(True)).alias("head"))


def near_groups(docs: DataFrame, percent: int = 85, words: int = WORDS) -> DataFrame:
    """One row per input row: row, doc_id, n_shingles, component_id, kept, head.

    ``component_id`` is the smallest doc_id reachable over links, and ``kept`` tells the rows with that
    doc_id; of them, repeated rows or not, exactly one is the ``head``. Documents without words, null
    ones too, are linked with nothing and heads. A null doc_id is larger than all others. Only doc_id
    and text are read, texts of any length whole; an empty table gives an empty result. Equal sets are
    one node, so copies of a text add no pairs.
    """
    return groups_of(numbered(docs.select("doc_id", "text")), percent, words)


#: The stage takes the usual similarity of 0.8.
STAGE_PERCENT = 80


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, the ``head``, with all columns of ``docs``.

    Nulls, empty and long texts, ties and repeated rows are judged as ``near_groups`` says.
    """
    row = fresh("row", docs)
    held = numbered(docs, row)
    gone = groups_of(held.select(F.col(row).alias("row"), "doc_id", "text"), STAGE_PERCENT).where(~F.col("head")).select(F.col("row").alias(row))
    return by_number(held, gone, row, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).drop("row")
