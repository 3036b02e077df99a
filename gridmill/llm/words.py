"""Words of blocks of texts as 64-bit hashes, and hashes of runs of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from gridmill.llm.common import LOWER, spread

#: Words are separated by \x20 and \x09-\x0D. The second table lower-cases A-Z as well.
KEEP = bytes(32 if 9 <= b <= 13 else b for b in range(256))
FOLD = bytes(LOWER[b] for b in KEEP)
BASE, OTHER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits; one-to-one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = BASE) -> np.ndarray:
    return np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(max(0, n - 1), base, np.uint64)]))


def word_hashes(array: pa.Array, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of the texts in order, number of the first word of each text and the end)."""
    data, offsets = spread(array, FOLD if fold else KEEP)
    in_word = data != 32
    edge = np.flatnonzero(in_word[1:] != in_word[:-1]) + 1 if len(data) else np.zeros(0, np.int64)
    starts, ends = edge[::2], edge[1::2]
    first = np.searchsorted(starts, offsets)
    if not len(starts):
        return np.zeros(0, np.uint64), first
    lengths = ends - starts
    letters = data[in_word].astype(np.uint64) + np.uint64(1)
    begin = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    within = np.arange(len(letters)) - np.repeat(begin, lengths)
    letters *= powers(int(lengths.max()))[within]
    return mix(np.add.reduceat(letters, begin) ^ lengths.astype(np.uint64)), first


def run_hashes(words: np.ndarray, n: int, base: np.uint64 = OTHER) -> np.ndarray:
    """The hash of the ``n`` words from each place; the last n - 1 places have none."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k, p in enumerate(powers(n, base)):
        total += words[k : k + m] * p
    return mix(total)


def shingle_sets(array: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's runs of ``n`` folded words.

    A text of fewer words, but not none, has the one run of all its words.
    """
    words, first = word_hashes(array, fold=True)
    runs = run_hashes(words, n)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= n:
            out.append(np.unique(runs[a : b - n + 1]))
        elif b > a:
            out.append(run_hashes(words[a:b], b - a) ^ np.uint64(b - a))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
