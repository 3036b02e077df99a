"""Benchmark decontamination by Wu-Manber search over words.

The patterns are the word windows of the benchmark items. Patterns of one length share tables: the
shift table tells from a block of two words how far the search may skip, and where it may not, the
bucket of that block, split by the pattern's first block, holds the patterns to compare word by word.
Items shorter than a window have tables for their own length, so they don't shorten the skips of the
others. The documents stay where they are; the tables travel in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridmill.llm.common import ascii_lower, binary, dropping, fresh, map_arrow, materialize, numbered, table

WINDOW = 10
#: Bytes of patterns in one broadcast; more patterns are searched in several blocks.
TABLE_BYTES = 32 << 20
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: A-Z become a-z, other ASCII that stands in no word becomes a blank, other bytes stay.
WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

Words = tuple[bytes, ...]
#: Hashes a block; the upper bits of the product in 64 bits are its place.
MIX, ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Tables:
    """Shift and bucket tables of patterns with one length, in words, as arrays.

    Words are numbered, a block is two numbers in one, shifts stand by the hash of a block, and the patterns are rows of numbers in the order
    of their last and first blocks, so a bucket is a run of rows. ``items`` of a row are a run of names.
    """

    def __init__(self, patterns: dict[Words, list[str]], numbers: dict[bytes, int] | None = None) -> None:
        self.length = m = len(next(iter(patterns)))
        self.numbers = {} if numbers is None else numbers
        rows = np.array([[self.numbers.setdefault(w, len(self.numbers) + 1) for w in words] for words in patterns], np.uint32)
        blocks = self.blocks(rows)
        # Eight places a block; blocks that fall together share the lesser shift, which only looks once more.
        self.bits = np.uint64(min(26, max(8, int(blocks.size * 8).bit_length())))
        table = np.full(1 << int(self.bits), blocks.shape[1], np.uint8 if m < 256 else np.int64)
        for k in range(blocks.shape[1]):  # the block that ends k words before a pattern's end lets the search skip k words
            at = self.place(blocks[:, blocks.shape[1] - 1 - k])
            table[at] = np.minimum(table[at], k)
        self.steps: bytes | list[int] = table.tobytes() if m < 256 else table.tolist()
        order = np.lexsort((blocks[:, 0], blocks[:, -1]))
        self.rows, self.last, self.first = array("I", rows[order].ravel().tobytes()), array("Q", blocks[order, -1].tobytes()), array("Q", blocks[order, 0].tobytes())
        names = list(patterns.values())
        self.cuts = array("Q", np.cumsum([0, *(len(names[i]) for i in order)], dtype=np.uint64).tobytes())
        self.names = [x for i in order for x in names[i]]

    def blocks(self, rows: np.ndarray) -> np.ndarray:
        """The blocks of two words of each row; of single words where the patterns have no more."""
        return rows.astype(np.uint64) if self.length == 1 else rows[:, :-1].astype(np.uint64) << np.uint64(32) | rows[:, 1:]

    def place(self, blocks: np.ndarray) -> np.ndarray:
        return (blocks * np.uint64(MIX)) >> (np.uint64(64) - self.bits)

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(start, items) of every occurrence, overlapping ones too; only the words where a skip ends are looked up."""
        m, steps, n, down, number = self.length, self.steps, len(words), 64 - int(self.bits), self.numbers.get
        pairs, end = m > 1, m
        while end <= n:
            block = number(words[end - 2], 0) << 32 | number(words[end - 1], 0) if pairs else number(words[end - 1], 0)
            if step := steps[(block * MIX & ALL) >> down]:
                end += step
                continue
            low, high = bisect_left(self.last, block), bisect_right(self.last, block)
            if low < high:  # else another block has this place
                text = array("I", [number(w, 0) for w in words[end - m : end]])
                first = text[0] << 32 | text[1] if pairs else text[0]
                low, high = bisect_left(self.first, first, low, high), bisect_right(self.first, first, low, high)
                for row in range(low, high):
                    if self.rows[row * m : row * m + m] == text:
                        yield end - m, self.names[self.cuts[row] : self.cuts[row + 1]]
            end += 1


class Searcher:
    """The tables of all lengths over one numbering of words; 0 stands for words that no pattern has."""

    def __init__(self, patterns: list[dict[Words, list[str]]]) -> None:
        self.numbers: dict[bytes, int] = {}
        self.tables = [Tables(p, self.numbers) for p in patterns]

    def search(self, words: list[bytes]) -> Iterator[tuple[int, int, list[str]]]:
        """(start, length, items) of every occurrence."""
        for t in self.tables:
            for start, items in t.search(words):
                yield start, t.length, items


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(window array<string>, items array<string>): each distinct window once, with all its items.

    An item of fewer words than ``size`` is one window, one without words has none. A null item_id
    adds its windows, but no item.
    """
    words = F.regexp_extract_all(ascii_lower(F.coalesce(F.col("text"), F.lit(""))), F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - size + 1, F.lit(1)))
    return (
        benchmark.select(F.col("item_id").cast("string").alias("item"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice("words", i, size))).alias("window"))
        .groupBy("window")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )


def tables_of(found: DataFrame) -> Searcher:
    by_length: dict[int, dict[Words, list[str]]] = {}
    for r in found.toLocalIterator():
        by_length.setdefault(len(r.window), {})[tuple(w.encode() for w in r.window)] = list(r["items"])
    return Searcher([patterns for _, patterns in sorted(by_length.items())])


def weight() -> Column:
    return F.octet_length(F.concat_ws(" ", "window")) + F.octet_length(F.concat_ws(",", "items"))


def parts_of(benchmark: DataFrame, most: int = TABLE_BYTES, size: int = WINDOW) -> list[DataFrame]:
    """The windows in parts of about ``most`` bytes each; one part for benchmarks up to that size."""
    found = materialize(windows(benchmark, size), "windows")
    total = found.agg(F.sum(weight()).alias("bytes")).first().bytes or 0
    n = max(1, -(-total // most))
    return [found] if n == 1 else [found.where(F.pmod(F.xxhash64("window"), F.lit(n)) == k) for k in range(n)]


def runs(texts: list[bytes], most: int = 2 << 20) -> Iterator[list[bytes]]:
    held: list[bytes] = []
    size = 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, items array<string>, contaminated boolean"


def result(doc_id: pa.Array, n_words: list[int], n_hit: list[int], items: list[list[str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(
        {
            "doc_id": doc_id,
            "n_words": pa.array(n_words, pa.int64()),
            "n_hit": pa.array(n_hit, pa.int64()),
            "n_items": pa.array([len(x) for x in items], pa.int64()),
            "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in items], pa.string()),
            "items": pa.array(items, pa.list_(pa.string())),
            "contaminated": pa.array([h > 0 for h in n_hit], pa.bool_()),
        }
    )


#: What an earlier pass found in a document: windows as (start, length), and items.
HITS, ITEMS = "array<struct<start:int,length:int>>", "array<string>"


def search(texts: list[bytes], tables: Searcher) -> Iterator[tuple[list[bytes], set[tuple[int, int]], set[str]]]:
    """The words of each text, the (start, length) of its windows, and the items with occurring windows."""
    for text in texts:
        words = words_of(text)
        found = list(tables.search(words))
        yield words, {(start, n) for start, n, _ in found}, {x for *_, items in found for x in items}


def searched(docs: DataFrame, benchmark: DataFrame, finish: Callable[[pa.RecordBatch, list], pa.RecordBatch], schema: str | StructType, most: int, size: int) -> DataFrame:
    """``finish`` of the batches of ``docs`` and, for each row, its words, windows and items; scratch goes with the last part."""
    with dropping():
        rows, last, several = prepared(docs, benchmark, finish, most, size)
        if several:
            return materialize(map_arrow(rows, last, schema), "searched", keep=True)
    return map_arrow(rows, last, schema)


def prepared(docs: DataFrame, benchmark: DataFrame, finish: Callable[[pa.RecordBatch, list], pa.RecordBatch], most: int, size: int) -> tuple[DataFrame, Callable, bool]:
    """(rows, the function for their last pass, whether there were several) of a search.

    A part of the benchmark takes one pass; its tables leave the executors before the next part's come.
    Every pass but the last writes the hits of hit documents alone, by row number, and the last takes them up.
    """
    context, told = docs.sparkSession.sparkContext, None
    parts = parts_of(benchmark, most, size)
    row, hits_name, items_name = (fresh(n, docs) for n in ("row", "hits", "items"))
    rows = numbered(docs, row) if len(parts) > 1 else docs
    for part in parts[:-1]:
        sent = context.broadcast(tables_of(part))

        def find(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                number, hits, items = [], [], []
                for texts in runs(binary(batch.column(1)).to_pylist()):
                    for k, (_, places, found) in enumerate(search(texts, sent.value), len(number)):
                        number.append(batch.column(0)[k].as_py())
                        hits.append([{"start": s, "length": n} for s, n in places])
                        items.append(list(found))
                hit = pa.array([bool(h) for h in hits], pa.bool_())
                places = pa.array(hits, pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())])))
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()).filter(hit), places.filter(hit), pa.array(items, pa.list_(pa.string())).filter(hit)], names=["row", "hits", "items"])

        hit = materialize(map_arrow(rows.select(row, "text"), find, f"row long, hits {HITS}, items {ITEMS}"), "hits")
        sent.unpersist(blocking=True)
        told = hit if told is None else told.unionByName(hit)
    if told is None:
        rows = rows.select(*docs.columns, F.lit(None).cast(HITS).alias(hits_name), F.lit(None).cast(ITEMS).alias(items_name))
    else:
        grouped = told.groupBy(F.col("row").alias(row)).agg(F.flatten(F.collect_list("hits")).alias(hits_name), F.flatten(F.collect_list("items")).alias(items_name))
        rows = rows.join(grouped, row, "left").select(*docs.columns, hits_name, items_name)
    sent = context.broadcast(tables_of(parts[-1]))
    at = rows.columns.index("text")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [f for texts in runs(binary(batch.column(at)).to_pylist()) for f in search(texts, sent.value)]
            for (_, places, items), hits, more in zip(found, batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                places |= {(h["start"], h["length"]) for h in hits or ()}
                items |= set(more or ())
            yield finish(batch, found)

    return rows, last, len(parts) > 1


def contamination(docs: DataFrame, benchmark: DataFrame, most: int = TABLE_BYTES, size: int = WINDOW) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, n_items, items_sha256, items, contaminated.

    A null text has no words and no hits, an empty one neither; a text of any length is searched whole.
    Repeated rows, ties and null doc_ids are judged like others; further columns are not read. An empty
    benchmark hits nothing, an empty documents table gives an empty result.
    """

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        n_hit = []
        for words, places, _ in found:
            covered = np.zeros(len(words) if places else 0, bool)
            for start, n in places:
                covered[start : start + n] = True
            n_hit.append(int(covered.sum()))
        return result(batch.column(0), [len(w) for w, *_ in found], n_hit, [sorted(i) for *_, i in found])

    return searched(docs.select("doc_id", "text"), benchmark, finish, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {RESULT}", most, size)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents in which no benchmark window occurs, with all columns of ``docs``.

    Null and empty texts hold none and stay; long texts are searched whole; repeated rows share their fate.
    """

    def finish(batch: pa.RecordBatch, found: list) -> pa.RecordBatch:
        return batch.select(names).filter(pa.array([not places for _, places, _ in found], pa.bool_()))

    names = docs.columns
    return searched(docs, table(spark, sf_dir, "benchmark"), finish, docs.schema, TABLE_BYTES, WINDOW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items")


ORACLE = r"""
WITH fold AS (
  SELECT 'd' AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 'b', item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT side, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM fold),
pats AS (SELECT DISTINCT id AS item, w[i : i + 9] AS p, least(len(w), 10) AS m
         FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM words WHERE side = 'b' AND len(w) > 0)),
places AS (SELECT d.id, s.m, i, d.w[i : i + s.m - 1] AS p
           FROM words d, (SELECT DISTINCT m FROM pats) s, unnest(range(1, len(d.w) - s.m + 2)) AS u(i) WHERE d.side = 'd' AND len(d.w) >= s.m),
hits AS (SELECT l.id, l.i, l.m, q.item FROM places l JOIN pats q ON l.p = q.p),
covered AS (SELECT id, count(DISTINCT i + o) AS n_hit FROM (SELECT DISTINCT id, i, m FROM hits), unnest(range(0, m)) AS u(o) GROUP BY id),
items AS (SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM hits) GROUP BY id)
SELECT w.id AS doc_id, len(w.w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words w LEFT JOIN covered c ON c.id = w.id LEFT JOIN items t ON t.id = w.id WHERE w.side = 'd'
"""
