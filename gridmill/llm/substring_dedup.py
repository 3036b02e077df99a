"""Substring dedup over words by level-wise doubling.

Windows of the base length that stand more than once are candidates. A window of twice the length can
stand more than once only if both of its halves do, so each level asks about the windows whose halves
survived, and what is repeated there goes on to the next length, until the wanted length is reached or
no candidate survives. The last level also tells which window stands first. All windows of all
documents take part; between the levels go hashes and flags, never texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gridmill.llm.common import dropping, materialize, pieces, table
from gridmill.llm.units import Unit, answered, bucket_of, distinct_first, first_round, letters_of, mail, next_round, not_first, opened, pack, split, units_of, unpack
from gridmill.llm.words import KEEP, run_hashes, word_hashes

#: Words of the windows at the first level and at the last, which is the first one doubled some times.
BASE_WORDS, WORDS = 5, 20
PIECE_BYTES = 4 << 20


class Sequence:
    """The words of a unit's documents in one row, as hashes."""

    def __init__(self, unit: Unit) -> None:
        hashes, firsts, ahead = [], [np.zeros(1, np.int64)], 0
        for i, j in pieces(unit.texts, PIECE_BYTES):
            words, first = word_hashes(unit.texts.slice(i, j - i), fold=False)
            hashes.append(words)
            firsts.append(first[1:] + ahead)
            ahead += len(words)
        self.words = np.concatenate([*hashes, np.zeros(0, np.uint64)])
        self.first = np.concatenate(firsts)
        self.left = np.repeat(self.first[1:], np.diff(self.first)) - np.arange(len(self.words))  # words to the document's end

    def fits(self, n: int) -> np.ndarray:
        """The places from which ``n`` words lie in one document."""
        return np.flatnonzero(self.left >= n)

    def hashes(self, places: np.ndarray, n: int) -> np.ndarray:
        return run_hashes(self.words, n)[places]


def ask_repeated(unit: Unit, seq: Sequence, places: np.ndarray, n: int, buckets: int) -> pa.Table:
    """Letters that ask which windows of ``n`` words at ``places`` stand in other units; the state keeps the places."""
    keys = np.unique(seq.hashes(places, n))
    cuts = np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64))
    low = keys.astype(np.uint32)  # a bucket holds few enough keys; what collides is one candidate more
    flags = np.zeros(len(seq.words), bool)
    flags[places] = True
    return mail(unit, cuts, lambda a, b: low[a:b].tobytes(), pack(flags))


def elsewhere(units: list[int], letters: list[bytes]) -> list[bytes]:
    """For each key whether it came more than once."""
    keys = [np.frombuffer(d, np.uint32) for d in letters]
    _, which, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    return [pack(f) for f in split(n[which] > 1, [len(k) for k in keys])]


def repeated(seq: Sequence, told: pa.Table, n: int, buckets: int) -> np.ndarray:
    """A flag for every place: whether the window of ``n`` words there was asked about and is repeated."""
    state, answers = opened(told)
    places = np.flatnonzero(unpack(state, len(seq.words)))
    keys, which, local = np.unique(seq.hashes(places, n), return_inverse=True, return_counts=True)
    sizes = np.diff(np.searchsorted(bucket_of(keys, buckets), np.arange(buckets + 1, dtype=np.uint64)))
    found = np.concatenate([unpack(a, int(s)) for a, s in zip(answers, sizes[sizes > 0])] + [np.zeros(0, bool)])
    flags = np.zeros(len(seq.words), bool)
    flags[places] = (found | (local > 1))[which] if len(places) else False
    return flags


def last_keys(seq: Sequence, places: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    other = run_hashes(seq.words, n, np.uint64(0x8EBC6AF09C88C6E3))[places]
    return seq.hashes(places, n), (other >> np.uint64(32)).astype(np.uint32)


def ask_first(unit: Unit, seq: Sequence, places: np.ndarray, n: int, buckets: int) -> pa.Table:
    """Letters that ask which windows of ``n`` words at ``places`` stand earlier elsewhere."""
    key, other = last_keys(seq, places, n)
    first, _ = distinct_first(key, other, buckets)
    doc = np.searchsorted(seq.first, places[first], "right") - 1
    flags = np.zeros(len(seq.words), bool)
    flags[places] = True
    return letters_of(unit, key[first], other[first], doc, buckets, pack(flags))


def removed(seq: Sequence, told: pa.Table, n: int, buckets: int) -> np.ndarray:
    """A flag for every word: whether a window over it stands earlier elsewhere."""
    state, answers = opened(told)
    places = np.flatnonzero(unpack(state, len(seq.words)))
    key, other = last_keys(seq, places, n)
    first, which = distinct_first(key, other, buckets)
    sizes = np.diff(np.searchsorted(bucket_of(key[first], buckets), np.arange(buckets + 1, dtype=np.uint64)))
    later = np.concatenate([unpack(a, int(s)) for a, s in zip(answers, sizes[sizes > 0])] + [np.zeros(0, bool)])
    gone = places[later[which] | (first[which] != np.arange(len(places)))] if len(places) else places
    edge = np.zeros(len(seq.words) + 1, np.int32)
    np.add.at(edge, gone, 1)
    np.add.at(edge, gone + n, -1)
    return np.cumsum(edge[:-1]) > 0


def repeats(docs: DataFrame, words: int = WORDS, base: int = BASE_WORDS, keep_text: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256, and the kept text if asked for.

    Null text has no words. Of equal windows the one of the smallest doc_id stays, a null doc_id
    before all others; rows with one doc_id are ordered as they are read. Documents shorter than a
    window stay whole. Columns besides doc_id and text are not read, an empty table gives none.
    """
    with dropping():
        return materialize(told_repeats(docs, words, base, keep_text), "removed-words", keep=True)


def told_repeats(docs: DataFrame, words: int, base: int, keep_text: bool) -> DataFrame:
    units = units_of(docs)
    buckets = units.buckets
    if words < base or words % base or (words // base) & (words // base - 1):
        raise ValueError("the window must be the base length doubled some times")

    def start(unit: Unit) -> pa.Table:
        seq = Sequence(unit)
        return (ask_repeated if base < words else ask_first)(unit, seq, seq.fits(base), base, buckets)

    length = base
    told = answered(first_round(units, start), elsewhere if base < words else not_first, "level")
    while length < words:

        def step(unit: Unit, came: pa.Table, n: int = length) -> pa.Table:
            seq = Sequence(unit)
            again = repeated(seq, came, n, buckets)
            places = seq.fits(2 * n)
            places = places[again[places] & again[places + n]]
            return (ask_repeated if 2 * n < words else ask_first)(unit, seq, places, 2 * n, buckets)

        length *= 2
        told = answered(next_round(units, told, step), elsewhere if length < words else not_first, "level")

    def finish(unit: Unit, came: pa.Table) -> pa.Table:
        seq = Sequence(unit)
        gone = removed(seq, came, words, buckets)
        out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        for text, a, b in zip(unit.texts, seq.first[:-1].tolist(), seq.first[1:].tolist()):
            own, flags = text.as_py().translate(KEEP).split(b" "), gone[a:b]
            own = [w for w in own if w]
            n = int(np.count_nonzero(flags))
            kept = b" ".join([w for w, g in zip(own, flags.tolist()) if not g] if n else own)
            out["n_words"].append(b - a)
            out["n_removed"].append(n)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            out["kept"].append(kept)
        columns = [unit.doc_ids, pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept_sha256"], pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if keep_text:
            columns.append(pa.array(out["kept"], pa.binary()).cast(pa.string()))
            names.append("kept")
        return pa.Table.from_arrays(columns, names=names)

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return next_round(units, told, finish, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
places AS (SELECT doc_id, i, w[i : i + 19] AS p FROM words, unnest(range(1, len(w) - 18)) AS u(i) WHERE len(w) >= 20),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY p ORDER BY doc_id, i) AS nth FROM places) WHERE nth > 1),
covered AS (SELECT DISTINCT doc_id, i + o AS i FROM gone, unnest(range(0, 20)) AS u(o)),
flat AS (SELECT doc_id, i, w[i] AS word FROM words, unnest(range(1, len(w) + 1)) AS u(i)),
kept AS (SELECT f.doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY f.i) AS t FROM flat f ANTI JOIN covered c ON c.doc_id = f.doc_id AND c.i = f.i GROUP BY f.doc_id)
SELECT w.doc_id, len(w.w)::BIGINT AS n_words, len(w.w)::BIGINT - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON k.doc_id = w.doc_id
"""
