"""Byte-level BPE by merge replay over all distinct words of a block at once.

Words of more than LONG bytes are replayed as a corpus: an inverted index leads from the rank of each
pair's merge to the places where the pair stands, a heap hands out the ranks in order, and only the
neighbours that a merge touches are posted anew. For the many short words that index costs three times
as much as arrays (figures in the README), so they advance in rounds: a round finds the lowest rank of
every word among the places that are left, applies these merges all at once, and ranks only the
neighbours that they touch anew. Merges of different words never meet, so each word sees its own merges
one by one as it would alone. Ranks are a broadcast of fixed size; the documents never move.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from gridmill.llm.common import binary, map_arrow, pieces, table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Encoded words that a worker keeps in each of two generations, and bytes of a word beyond which it goes to the heap.
KEPT, LONG = 60_000, 64
#: Characters of texts that are split and encoded together; longer texts are cut where no match can cross.
BLOCK_CHARS = 1 << 20
#: Bytes of texts that leave Arrow together.
BATCH_BYTES = 4 << 20
CUT = regex.compile(r"(?<=\S)\s")
#: Ids are below 2 ** SHIFT; a pair without a merge has the rank NONE.
SHIFT, NONE = 20, (1 << 31) - 1


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Merges:
    """Ids of the single bytes, and the rank of the merge of any two tokens, as sorted arrays."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        if lacking := [b for b in range(256) if bytes([b]) not in ranks]:
            raise ValueError(f"the vocabulary has no token for the bytes {lacking}")
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        keys, found, of = [], [], ranks.get
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (left := of(token[:i])) is not None and (right := of(token[i:])) is not None:
                    keys.append(left << SHIFT | right)
                    found.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], -1)  # the last one answers for keys beyond all others
        self.ranks = np.append(np.array(found, np.int64)[order], NONE)
        self.of_bytes = self.rank(np.repeat(self.single, 256), np.tile(self.single, 256))

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << SHIFT | right
        at = np.searchsorted(self.keys[:-1], key)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def table(self) -> dict[int, int]:
        return dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist()))


def replay(words: list[bytes], merges: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all words one after another, number of ids of each) by rounds over all words together."""
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    n = len(data)
    sizes = np.array([len(w) for w in words], np.int64)
    starts = np.cumsum(sizes) - sizes
    token = np.append(merges.single[data], 0)  # at place n is nothing
    after, before = np.arange(1, n + 2), np.arange(-1, n)
    after[starts + sizes - 1] = before[starts] = n
    rank = np.append(merges.of_bytes[data[:-1] << 8 | data[1:]], (NONE, NONE))
    rank[starts + sizes - 1] = NONE
    alive = np.ones(n, bool)

    places, first = np.arange(n), starts  # places of words that may still have a merge, and each such word's first
    while len(places):
        lowest = np.minimum.reduceat(rank[places] << 32 | places, first)
        going = lowest < NONE << 32
        at = lowest[going] & 0xFFFFFFFF
        right = after[at]
        follow, left = after[right], before[at]
        token[at], alive[right], after[at], before[follow] = rank[at], False, follow, at
        rank[right] = NONE
        rank[at] = np.where(follow < n, merges.rank(token[at], token[follow]), NONE)
        inner = left < n
        rank[left[inner]] = merges.rank(token[left[inner]], token[at[inner]])
        counts = np.diff(np.append(first, len(places)))
        stay = np.repeat(going, counts) & alive[places]
        counts = counts[going] - 1
        places, first = places[stay], np.cumsum(counts) - counts
    return token[:n][alive], np.add.reduceat(alive, starts, dtype=np.int64) if n else sizes


def replay_long(words: Iterable[bytes], merges: Merges) -> list[list[int]]:
    """The ids of each word, however long, with an index whose ranks a heap hands out in order.

    A merge that makes a pair of a lower rank stops the replay of its word until that pair has had its turn.
    """
    token: list[int] = []  # id at each place, -1 where a merge has taken it; a merge leaves its id at the left place
    after: list[int] = []
    before: list[int] = []
    word_of: list[int] = []
    starts: list[int] = []
    index: dict[int, list[int]] = {}  # rank of a pair's merge -> left places
    single, merge = merges.single.tolist(), merges.table().get

    for word in words:
        first, n = len(token), len(word)
        starts.append(first)
        token += [single[b] for b in word]
        after += range(first + 1, first + n + 1)
        after[-1] = -1
        before += range(first - 1, first + n - 1)
        before[first] = -1
        word_of += [len(starts)] * n
        for at in range(first, first + n - 1):
            if (rank := merge(token[at] << SHIFT | token[at + 1])) is not None:
                index.setdefault(rank, []).append(at)

    def post(rank: int, at: int) -> None:
        if rank not in index:
            index[rank] = []
            heapq.heappush(heap, rank)
        index[rank].append(at)

    heap = list(index)
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        places, held = index.pop(rank), 0
        places.sort()
        for at in places:
            right = after[at]
            if right < 0 or token[at] < 0 or merge(token[at] << SHIFT | token[right]) != rank:
                continue  # an earlier merge has taken one of the two
            if held and word_of[at] == held:  # a lower pair of this word goes first
                post(rank, at)
                continue
            token[at], token[right] = rank, -1
            after[at] = follow = after[right]
            left = before[at]
            if follow >= 0:
                before[follow] = at
            for start, key in ((at, rank << SHIFT | token[follow]) if follow >= 0 else (at, -1), (left, token[left] << SHIFT | rank) if left >= 0 else (left, -1)):
                if key >= 0 and (new := merge(key)) is not None:
                    post(new, start)
                    if new < rank:
                        held = word_of[at]
    found = []
    for at in starts:
        ids = []
        while at >= 0:
            ids.append(token[at])
            at = after[at]
        found.append(ids)
    return found


class Encoder:
    """Encodes and decodes texts, with two generations of encoded words of bounded size."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks, self.split, self.merges = ranks, regex.compile(public_tokenizers.PATTERN).findall, Merges(ranks)
        self.tokens = {b"%d" % rank: token for token, rank in ranks.items()}
        self.decimal = {rank: decimal for decimal, rank in zip(self.tokens, ranks.values())}
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.size = 0  # of the young generation: a word counts once, and once more for every LONG bytes

    def learn(self, words: set[str]) -> None:
        """Puts the ids of all ``words`` into the young generation; a full one grows old first."""
        if self.size > KEPT:
            self.young, self.old, self.size = {}, self.young, 0
        young, old, short, long = self.young, self.old, [], []
        before = len(young)
        for word in words:
            if word in young:
                continue
            if (ids := old.get(word)) is not None:
                young[word] = ids
            elif (rank := self.ranks.get(raw := word.encode())) is not None:
                young[word] = self.decimal[rank]
            else:
                (short if len(raw) <= LONG else long).append((word, raw))
        if short:
            ids, sizes = replay([raw for _, raw in short], self.merges)
            coded, a = list(map(self.decimal.__getitem__, ids.tolist())), 0
            for (word, _), size in zip(short, sizes.tolist()):
                young[word] = b",".join(coded[a : a + size])
                a += size
        if long:
            for (word, raw), found in zip(long, replay_long([raw for _, raw in long], self.merges)):
                young[word] = b",".join(map(self.decimal.__getitem__, found))
                self.size += len(raw) // LONG
        self.size += len(young) - before

    def block(self, texts: list[str]) -> Iterator[bytes]:
        words = [self.split(t) for t in texts]
        self.learn(set().union(*words))
        for found in words:
            yield b",".join(map(self.young.__getitem__, found))

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text in decimal, joined by commas; only a text longer than a block is cut."""
        for held in blocks(texts):
            if len(held[0]) > BLOCK_CHARS:
                yield b",".join(part for run in cut(held[0]) for part in self.block([run]))
            else:
                yield from self.block(held)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.split(b","))) if ids else b""


def cut(text: str) -> Iterator[str]:
    """``text`` in runs; each but the last ends before a white space that follows none.

    Of the pattern's alternatives none goes on from another character to white space, and the one that
    looks ahead stands at white space, so no match crosses a cut.
    """
    start = 0
    while start < len(text):
        found = CUT.search(text, start + BLOCK_CHARS)
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts with at most BLOCK_CHARS characters together; a longer text is a run of its own."""
    held, size = [], 0
    for t in texts:
        if held and size + len(t) > BLOCK_CHARS:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


#: The encoder of this worker process and its vocabulary's name; later tasks go on with the words of earlier ones.
HELD: list = [None, None]


def held_encoder(name: str, ranks: Broadcast) -> Encoder:
    if HELD[0] != name:
        HELD[:] = [name, Encoder(ranks.value)]
    return HELD[1]


def share(spark: SparkSession, vocabulary: str | None) -> tuple[Broadcast, str]:
    """The ranks as a broadcast, and a name that tells this vocabulary from others."""
    ranks = load_ranks(vocabulary or public_tokenizers.path(VOCABULARY))
    return spark.sparkContext.broadcast(ranks), hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()


def encode(docs: DataFrame, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """One row per input row: doc_id, n_tokens, ids_sha256, decoded_sha256, and ids if asked for.

    Null text counts as empty and has no tokens. Repeated rows, ties and null doc_ids are encoded like
    any other row; columns besides doc_id and text are not read. An empty table gives an empty result.
    A very long text is encoded whole, in runs; a word of any length is replayed whole.
    """
    spark = docs.sparkSession
    # The vocabulary is a file of fixed size, about 1 MB, whatever the input.
    ranks, name = share(spark, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = held_encoder(name, ranks)
        for batch in batches:
            texts = binary(batch.column(1))
            for i, j in pieces(texts, BATCH_BYTES):
                ids_of: list[list[int]] = []
                n_tokens, digests, decoded = [], [], []
                for ids in coder.encode(texts.slice(i, j - i).cast(pa.large_string()).to_pylist()):
                    n_tokens.append(ids.count(b",") + 1 if ids else 0)
                    digests.append(hashlib.sha256(ids).hexdigest())
                    decoded.append(hashlib.sha256(coder.decode(ids)).hexdigest())
                    if with_ids:
                        ids_of.append(list(map(int, ids.split(b","))) if ids else [])
                columns = [batch.column(0).slice(i, j - i), pa.array(n_tokens, pa.int64()), pa.array(digests, pa.string()), pa.array(decoded, pa.string())]
                columns += [pa.array(ids_of, pa.list_(pa.int32()))] * with_ids
                yield pa.RecordBatch.from_arrays(columns, names=names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    return map_arrow(docs.select("doc_id", "text"), run, schema)


def decode(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text, bytes) from rows with doc_id and ids, as the bytes that the ids stand for.

    Bytes that aren't whole UTF-8 are replaced in ``text`` alone. Null ids count as none; an id that the
    vocabulary lacks, or a null one, makes text and bytes null. An empty table gives an empty result.
    """
    ranks, _ = share(encoded.sparkSession, vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: raw for raw, rank in ranks.value.items()}
        for batch in batches:
            found = [list(map(token.get, ids or ())) for ids in batch.column(1).to_pylist()]
            raw = [None if None in f else b"".join(f) for f in found]
            texts = [None if r is None else r.decode("utf-8", "replace") for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(raw, pa.binary())], names=["doc_id", "text", "bytes"])

    return map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string, bytes binary")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: the tokens of every document of ``docs``, nulls and repeats as ``encode`` says."""
    return encode(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
