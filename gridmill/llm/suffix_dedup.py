"""Substring dedup over bytes by prefix-free parsing.

Rolling hashes of short byte grams trigger phrases: the trigger of a window is its least gram hash, the
first of equals, so it depends on the window's bytes alone, and a phrase is the longest stretch whose
windows share their trigger. Neighbouring phrases overlap by a window less one byte, so every suffix
of a phrase that starts a window holds the whole window. The dictionary is the set of distinct
phrases, the parse the order in which the corpus goes through them.

- A phrase that the parse has met before repeats all of its windows.
- A dictionary phrase that no other one shares its trigger with repeats none.
- Only the rest needs the order of suffixes: the suffixes of the dictionary phrases are sorted by their
  windows, within their buckets, and equal ones by the parse, so the first of each run is the first
  in the corpus, and the others are repeats.

That is the suffix array of the dictionary, cut at the window's length and combined with the parse,
without a suffix of the whole corpus ever being made. Texts stay in their units.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridmill.llm.common import buffers, dropping, materialize, table
from gridmill.llm.units import Unit, answered, distinct_first, first_round, letters_of, next_round, not_first, opened, pack, ranked, split, units_of, unpack
from gridmill.llm.units import bucket_of
from gridmill.llm.words import mix, powers

#: Bytes of a window and of a trigger gram, and places that are parsed at a time.
WINDOW, GRAM, CHUNK = 100, 32, 1 << 20
BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SALT = mix(np.arange(1, 257, dtype=np.uint64))


def least(keys: np.ndarray, width: int) -> np.ndarray:
    """The least key of the ``width`` keys from each place on."""
    n = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Parse:
    """The phrases of a unit: trigger hash, phrase hash, first and last window, in the unit's order."""

    def __init__(self, unit: Unit, window: int = WINDOW, gram: int = GRAM) -> None:
        self.data, self.offsets = buffers(unit.texts)
        self.window, self.gram = window, gram
        parts = [self.chunk(s) for s in range(0, max(0, len(self.data) - window + 1), CHUNK)]
        self.trigger, self.phrase, self.low, self.high = (np.concatenate([p[k] for p in parts] or [np.zeros(0, np.int64)]) for k in range(4))
        self.trigger, self.phrase = self.trigger.astype(np.uint64), self.phrase.astype(np.uint64)

    def sums(self, start: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """(prefix sums, inverse powers) of the bytes start to stop, from which any stretch's hash follows."""
        total = np.zeros(stop - start + 1, np.uint64)
        np.cumsum(SALT[self.data[start:stop]] * powers(stop - start, BASE), out=total[1:])
        return total, powers(stop - start + 1, INVERSE)

    def starts(self, start: int, stop: int) -> np.ndarray:
        """The places from start to stop, counted from start, whose windows lie in one document."""
        a = np.maximum(self.offsets[:-1], start)
        b = np.minimum(self.offsets[1:] - self.window + 1, stop)
        a, b = a[b > a], b[b > a]
        edge = np.zeros(stop - start + 1, np.int8)
        np.add.at(edge, a - start, 1)
        np.add.at(edge, b - start, -1)
        return np.flatnonzero(np.cumsum(edge[:-1]))

    def chunk(self, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        stop = min(start + CHUNK, len(self.data) - self.window + 1)
        total, back = self.sums(start, stop + self.window - 1)
        grams = mix((total[self.gram :] - total[: -self.gram]) * back[: -self.gram])
        keys = (grams & ~np.uint64((1 << 21) - 1)) | np.arange(len(grams), dtype=np.uint64)
        places = self.starts(start, stop)
        triggers = (least(keys, self.window - self.gram + 1)[places] & np.uint64((1 << 21) - 1)).astype(np.int64)
        if not len(places):
            return (np.zeros(0, np.int64),) * 4
        # A phrase ends where the trigger changes or the places have a gap, as between documents.
        change = np.concatenate([[True], (triggers[1:] != triggers[:-1]) | (np.diff(places) != 1)])
        first = np.flatnonzero(change)
        low, high = places[first], places[np.append(first[1:], len(places)) - 1]
        phrase = mix((total[high + self.window] - total[low]) * back[low] + (high - low).astype(np.uint64))
        return grams[triggers[first]], phrase, low + start, high + start

    def windows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(key, other, place) of all windows of the flagged phrases."""
        out = []
        low, high = self.low[which], self.high[which]
        for start in range(0, max(0, len(self.data) - self.window + 1), CHUNK):
            a, b = np.searchsorted(low, [start, start + CHUNK])
            if a == b:
                continue
            n = high[a:b] - low[a:b] + 1
            places = np.repeat(low[a:b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            total, back = self.sums(start, min(start + CHUNK + self.window - 1, len(self.data)))
            at = places - start
            key = (total[at + self.window] - total[at]) * back[at]
            out.append((mix(key), (self.second(places) >> np.uint64(32)).astype(np.uint32), places))
        return tuple(np.concatenate([o[k] for o in out] or [np.zeros(0, (np.uint64, np.uint32, np.int64)[k])]) for k in range(3))

    def second(self, places: np.ndarray) -> np.ndarray:
        """Another hash of the windows, from eight bytes at a time."""
        total = np.zeros(len(places), np.uint64)
        for k in range(0, self.window, 8):
            word = np.zeros(len(places), np.uint64)
            for i in range(k, min(k + 8, self.window)):
                word = (word << np.uint64(8)) | self.data[places + i]
            total = mix(total ^ word)
        return total

    def doc(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, places, "right") - 1


def ask_phrases(unit: Unit, parse: Parse, buckets: int) -> pa.Table:
    """Letters with the unit's distinct phrases by trigger."""
    first, _ = distinct_first(parse.trigger, parse.phrase, buckets)
    return letters_of(unit, parse.trigger[first], parse.phrase[first], parse.doc(parse.low[first]), buckets, b"")


def met_or_shared(units: list[int], letters: list[bytes]) -> list[bytes]:
    """Two flags for each phrase: the parse met it before; it is the first but shares its trigger."""
    order, new_key, new, sizes = ranked(units, letters, np.uint64)
    group = np.cumsum(new_key) - 1
    phrases = np.bincount(group, weights=new)
    met, shared = np.empty(len(order), bool), np.empty(len(order), bool)
    met[order] = ~new
    shared[order] = new & (phrases[group] > 1)
    return [pack(m) + pack(s) for m, s in zip(split(met, sizes), split(shared, sizes))]


def sorted_out(parse: Parse, answers: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the unit's phrases: all windows are repeats; the windows must be sorted."""
    first, which = distinct_first(parse.trigger, parse.phrase, buckets)
    if not len(first):
        return np.zeros(0, bool), np.zeros(0, bool)
    sizes = np.diff(np.searchsorted(bucket_of(parse.trigger[first], buckets), np.arange(buckets + 1, dtype=np.uint64)))
    sizes = sizes[sizes > 0].tolist()
    met = np.concatenate([unpack(a, n) for a, n in zip(answers, sizes)])
    shared = np.concatenate([unpack(a, n, -(-n // 8)) for a, n in zip(answers, sizes)])
    here_first = first[which] == np.arange(len(which))
    return met[which] | ~here_first, shared[which] & here_first


def ask_windows(unit: Unit, told: pa.Table, buckets: int) -> pa.Table:
    """Letters with the windows of the phrases that need sorting; the state keeps the flags of the phrases."""
    parse = Parse(unit)
    met, shared = sorted_out(parse, opened(told)[1], buckets)
    key, other, places = parse.windows(shared)
    first, _ = distinct_first(key, other, buckets)
    return letters_of(unit, key[first], other[first], parse.doc(places[first]), buckets, pack(met) + pack(shared))


def removed(parse: Parse, told: pa.Table, buckets: int) -> np.ndarray:
    """A flag for every byte of the unit: whether a window over it stands earlier."""
    state, answers = opened(told)
    n = len(parse.low)
    met, shared = unpack(state, n), unpack(state, n, -(-n // 8))
    key, other, places = parse.windows(shared)
    first, which = distinct_first(key, other, buckets)
    edge = np.zeros(len(parse.data) + 1, np.int32)
    np.add.at(edge, parse.low[met], 1)
    np.add.at(edge, parse.high[met] + parse.window, -1)
    if len(places):
        sizes = np.diff(np.searchsorted(bucket_of(key[first], buckets), np.arange(buckets + 1, dtype=np.uint64)))
        later = np.concatenate([unpack(a, int(s)) for a, s in zip(answers, sizes[sizes > 0])])
        gone = places[later[which] | (first[which] != np.arange(len(places)))]
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + parse.window, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, keep_bytes: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and kept if asked for.

    Null text counts as empty. Of equal strings the one of the smallest doc_id stays, a null doc_id
    before all others; rows with one doc_id are ordered as they are read. Texts under 100 bytes stay
    whole. Columns besides doc_id and text are not read, an empty table gives an empty result.
    """
    with dropping():
        return materialize(told_repeats(docs, keep_bytes), "removed-bytes", keep=True)


def told_repeats(docs: DataFrame, keep_bytes: bool) -> DataFrame:
    units = units_of(docs)
    buckets = units.buckets
    phrases = answered(first_round(units, lambda unit: ask_phrases(unit, Parse(unit), buckets)), met_or_shared, "phrases")
    told = answered(next_round(units, phrases, lambda unit, came: ask_windows(unit, came, buckets)), not_first, "windows")

    def finish(unit: Unit, came: pa.Table) -> pa.Table:
        parse = Parse(unit)
        gone = removed(parse, came, buckets)
        n_removed, n_spans, digests, kept = [], [], [], []
        for a, b in zip(parse.offsets[:-1].tolist(), parse.offsets[1:].tolist()):
            flags = gone[a:b]
            n = int(np.count_nonzero(flags))
            left = parse.data[a:b][~flags].tobytes() if n else parse.data[a:b].tobytes()
            n_removed.append(n)
            n_spans.append(int(np.count_nonzero(np.diff(flags.astype(np.int8), prepend=0) == 1)) if n else 0)
            digests.append(hashlib.sha256(left).hexdigest())
            if keep_bytes:
                kept.append(left)
        columns = [unit.doc_ids, pa.array(np.diff(parse.offsets)), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
        return pa.Table.from_arrays(columns + ([pa.array(kept, pa.binary())] if keep_bytes else []), names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * keep_bytes)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_bytes
    return next_round(units, told, finish, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))
