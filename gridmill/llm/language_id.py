"""Language identification with language-bitmask n-gram filters.

All languages share one bit-sliced Bloom filter: a slot holds a mask with one bit for each language,
an n-gram sets its languages' bits at a few hashed slots, and the AND of these slots tells at once
every language that contains it. A text's n-grams are looked up, the bits are counted language by
language, each count is corrected for that language's false-positive rate, and the largest wins.
Training counts n-grams on Spark over a bounded sample of labelled texts; the filter has a fixed size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.common import binary, dropping, map_arrow, materialize, pieces, spread, table

#: Bytes of an n-gram; labelled texts of each language to learn from, about.
GRAM, SAMPLE = 4, 20_000
#: An n-gram belongs to a language if it is at least this frequent there, and not far rarer than elsewhere.
RARE, SHARE = 2e-6, 0.25
SLOTS, HASHES = 1 << 20, 3
#: Bits of a mask; more languages take several masks for each slot.
BITS = 64
#: Texts whose best language covers less of them than this are rejected in the pipeline.
ACCEPT = 0.2

#: A-Z become a-z, other ASCII becomes a blank, other bytes stay.
LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
MIX = (np.uint32(2654435761), np.uint32(2246822519), np.uint32(3266489917))


def grams(data: np.ndarray) -> np.ndarray:
    """The code of the n-gram that starts at each byte; the last GRAM - 1 bytes start none."""
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32)
    codes = data[:n].astype(np.uint32)
    for i in range(1, GRAM):
        codes = (codes << np.uint32(8)) | data[i : i + n]
    return codes


def letters(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts, letters alone; a blank leads and follows each text."""
    return spread(array, LETTERS)


def slots(codes: np.ndarray, size: int = SLOTS) -> list[np.ndarray]:
    shift = np.uint32(32 - (size.bit_length() - 1))
    return [((codes ^ (codes >> np.uint32(15))) * m) >> shift for m in MIX[:HASHES]]


@dataclass
class Filter:
    """Languages in the order of their bits, the masks of the slots, and each language's share of set slots."""

    languages: list[str]
    masks: list[np.ndarray]  # the n-th holds the bits of languages from n * BITS on
    false_rate: np.ndarray
    fallback: int  # the language of texts without any known n-gram

    def masks_of(self, codes: np.ndarray) -> list[np.ndarray]:
        """For each n-gram the languages that contain it: the AND of its slots."""
        places = slots(codes, len(self.masks[0]))
        out = []
        for mask in self.masks:
            found = mask[places[0]]
            for at in places[1:]:
                found &= mask[at]
            out.append(found)
        return out

    def shares(self, array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows x languages) corrected shares of each text's n-grams, and the number of n-grams."""
        data, offsets = letters(array)
        found = self.masks_of(grams(data))
        ends = np.maximum(offsets[1:] - GRAM + 1, offsets[:-1])  # n-grams stay within a text
        total = ends - offsets[:-1]
        out = np.zeros((len(array), len(self.languages)))
        for k in range(len(self.languages)):
            masks = found[k // BITS]
            hits = np.zeros(len(data) + 1, np.int64)
            np.cumsum((masks >> masks.dtype.type(k % BITS)) & masks.dtype.type(1), out=hits[1 : len(masks) + 1], dtype=np.int64)
            hits[len(masks) + 1 :] = hits[len(masks)]
            raw = (hits[ends] - hits[offsets[:-1]]) / np.maximum(total, 1)
            rate = self.false_rate[k]
            out[:, k] = np.clip((raw - rate) / max(1e-9, 1 - rate), 0, 1)
        return out, total


def filter_of(languages: list[str], totals: list[int], masks: list[np.ndarray]) -> Filter:
    """The filter of slot masks; texts without any known n-gram get the language with most n-grams, the first by name."""
    size = len(masks[0])
    rates = np.array([np.count_nonzero(masks[k // BITS] >> np.uint64(k % BITS) & np.uint64(1)) / size for k in range(len(languages))])
    masks = [m.astype(np.uint8) for m in masks] if len(languages) <= 8 else masks  # an eighth of the memory to look through
    return Filter(languages, masks, rates**HASHES, max(range(len(languages)), key=lambda k: (totals[k], -k), default=0))


def chosen(counted: DataFrame) -> DataFrame:
    """(lang, gram) of the n-grams that belong to a language, from all counts (lang, gram, n)."""
    totals = counted.groupBy("lang").agg(F.sum("n").alias("total"))  # a row for each language
    share = counted.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))
    best = F.max("share").over(Window.partitionBy("gram"))  # a gram has a row for each language
    return share.withColumn("best", best).where(F.col("share") >= F.greatest(F.lit(RARE), SHARE * F.col("best"))).select("lang", "gram")


def slot_masks(grams_: DataFrame, languages: list[str], size: int = SLOTS) -> list[np.ndarray]:
    """The masks of all slots, ORed together on the executors; ``size`` numbers for every BITS languages arrive here."""
    place = {l: k for k, l in enumerate(languages)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([place[l] for l in batch.column(0).to_pylist()], np.int64)
            codes = batch.column(1).to_numpy(zero_copy_only=False).astype(np.uint32)
            for at in slots(codes, size):
                mask = (np.uint64(1) << (bits % BITS).astype(np.uint64)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(bits // BITS), pa.array(at.astype(np.int64)), pa.array(mask)], names=["part", "slot", "mask"])

    masks = [np.zeros(size, np.uint64) for _ in range(max(1, -(-len(languages) // BITS)))]
    told = map_arrow(grams_.select("lang", "gram"), run, "part long, slot long, mask long").groupBy("part", "slot").agg(F.bit_or("mask").alias("mask")).toArrow()
    part, slot, mask = (told.column(k).to_numpy() for k in range(3))
    for k in range(len(masks)):
        masks[k][slot[part == k]] = mask[part == k].astype(np.int64).view(np.uint64)
    return masks


def train(docs: DataFrame, size: int = SLOTS) -> Filter:
    """Learns from the rows of ``docs``, doc_id, text and lang, whose lang is not null.

    Of a language with more than SAMPLE texts, a part chosen by a hash of doc_id is read, about SAMPLE
    texts. Every n-gram of these texts is counted, and which language has it is decided by shares alone,
    so at most 1 / RARE n-grams belong to one. Any number of languages may be learned; 64 of them take
    8 MB. Null texts, repeated rows and null doc_ids (in the part that is read) count like others; without
    any labelled row nothing is learned.
    """
    known = docs.where(F.col("lang").isNotNull())
    sizes = {r.lang: r.n for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Filter([], [np.zeros(size, np.uint64)], np.zeros(0), 0)
    part = F.create_map(*[x for l, n in sizes.items() for x in (F.lit(l), F.lit(min(1.0, SAMPLE / n)))])
    sample = known.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            texts = binary(batch.column(1))
            for lang in sorted(set(langs)):
                own = texts.take(pa.array(np.flatnonzero(langs == lang)))
                for i, j in pieces(own, 2 << 20):
                    data, _ = letters(own.slice(i, j - i))
                    codes, n = np.unique(grams(data), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    with dropping():
        return learned(sorted(sizes), map_arrow(sample.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), size)


def learned(languages: list[str], counted: DataFrame, size: int) -> Filter:
    """The filter of the counts (lang, gram, n)."""
    counted = materialize(counted, "grams")
    totals = {r.lang: r.n for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    return filter_of(languages, [totals.get(l, 0) for l in languages], slot_masks(chosen(counted), languages, size))


def has_letter(text: bytes) -> bool:
    return re.search(rb"[A-Za-z]", text) is not None or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def predictor(spark: SparkSession, model: Filter) -> Callable[[pa.Array], tuple[list[str], list[float]]]:
    """A function of a column of texts to its languages and scores; the filter travels as a broadcast."""
    sent = spark.sparkContext.broadcast(model)

    def predict(column: pa.Array) -> tuple[list[str], list[float]]:
        model, texts = sent.value, binary(column)
        names: list[str] = []
        scores: list[float] = []
        for i, j in pieces(texts, 1 << 20):
            block = texts.slice(i, j - i)
            shares, total = model.shares(block) if model.languages else (np.zeros((j - i, 1)), np.zeros(j - i))
            best = np.argmax(shares, axis=1)
            top = shares[np.arange(j - i), best]
            for raw, k, score in zip(block.to_pylist(), best, top):
                if not model.languages or not has_letter(raw):
                    names.append("und")
                    scores.append(0.0)
                else:
                    names.append(model.languages[k if score > 0 else model.fallback])
                    scores.append(float(score))
        return names, scores

    return predict


def identify(docs: DataFrame, model: Filter) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``.

    ``lang_pred`` is a learned language, or ``und`` with score 0 if the text is null, empty, has no
    letter, or nothing was learned. A text with letters but no known n-gram gets the most frequent
    language and score 0. Ties go to the language that is first by name. Texts of any length are read whole; a null
    doc_id, repeated rows and further columns change nothing. An empty table gives an empty result.
    """
    predict = predictor(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(1))
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())})

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing is learned from; a null doc_id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents in no learned language: no letter, or less than ACCEPT of their n-grams known.

    Null, empty and letterless texts are dropped with them; long texts are judged whole, repeated rows alike.
    """
    predict = predictor(spark, train(docs))
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, scores = predict(batch.column(at))
            yield batch.filter(pa.array([n != "und" and s >= ACCEPT for n, s in zip(names, scores)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def crc_fold(doc_id: int) -> int:
    """The fold of a document, as the query computes it; for tests."""
    return zlib.crc32(str(doc_id).encode()) % 5
