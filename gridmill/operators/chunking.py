"""Chunks of texts: overlapping windows that end at breaks, pages, and runs of whole words."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def ending(text: str, begin: int, size: int, breaks: dict[str, int]) -> int:
    """Where a chunk from ``begin`` ends: after the last break in its second half, the first kind that is there.

    ``breaks`` gives for each break how many of its characters the chunk keeps.
    """
    limit = begin + size
    if limit >= len(text):
        return limit
    places = ((text.rfind(mark, begin, limit), kept) for mark, kept in breaks.items())
    return next((at + kept for at, kept in places if at - begin > size / 2), limit)


def overlapping(text: str, size: int, overlap: int, breaks: dict[str, int], to_the_end: bool) -> Iterator[str]:
    """Chunks that share ``overlap`` characters; the last one ends the text, or a short tail may follow it."""
    begin = 0
    while begin < len(text):
        stop = ending(text, begin, size, breaks)
        yield text[begin:stop].strip()
        if to_the_end and stop >= len(text):
            return
        begin = max(stop - overlap, begin + 1)


def by_characters(text: str, size: int = 1500, overlap: int = 150, least: int = 80) -> Iterator[str]:
    """Chunks that end at a paragraph, a line or a sentence; short ones are dropped."""
    yield from (c for c in overlapping(text, size, overlap, {"\n\n": 2, "\n": 1, ". ": 2}, True) if len(c) >= least)


def by_pages(text: str, size: int = 2000, overlap: int = 200, least: int = 100) -> Iterator[str]:
    """Chunks of a page that end at a sentence; only those over ``least`` characters stay."""
    yield from (c for c in overlapping(text, size, overlap, {". ": 1}, False) if len(c) > least)


def by_words(text: str, size: int = 1500) -> Iterator[str]:
    held: list[str] = []
    n = 0
    for word in (m.group() for m in re.finditer(r"\S+", text)):
        if held and n + len(word) + 1 > size:
            yield " ".join(held)
            held, n = [], 0
        held.append(word)
        n += len(word) + 1
    if held:
        yield " ".join(held)


#: Characters of the chunks that a batch holds before it is handed on.
HELD = 1 << 22


def chunks(docs: DataFrame, key: str, text: str, cut: Callable[[str], Iterator[str]]) -> DataFrame:
    """(key, nth, chunk) of every text, cut where it lies; null texts have no chunks.

    Texts become Python strings one at a time, and batches are handed on when they hold HELD characters,
    so a task holds one batch of Spark's, one of its own and one text, however many rows it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[int] = []
            nth: list[int] = []
            out: list[str] = []
            held = 0

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(nth, pa.int32()), pa.array(out, pa.string())], names=[key, "nth", "chunk"])

            for row, value in enumerate(batch.column(1)):
                for i, chunk in enumerate(cut(value.as_py() or "")):
                    rows.append(row)
                    nth.append(i)
                    out.append(chunk)
                    held += len(chunk)
                    if held >= HELD:
                        yield told()
                        rows, nth, out, held = [], [], [], 0
            yield told()

    # A batch of Spark's own size may hold 10,000 whole texts; the session keeps this setting, as the result is still to run.
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 22)
    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, nth int, chunk string")
