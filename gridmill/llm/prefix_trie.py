"""Conversation prefix trie by LCP-aware external mergesort.

A turn is the SHA-256 of its role and text, a conversation the string of its turns' digests; texts
themselves are not moved. Equal conversations become one sequence before anything is sorted. Tasks form
sorted runs that carry, with each sequence, how many turns it shares with the one before it. Runs are
dealt by ranges of sequences; for each range a loser tree merges its pieces of all runs, skipping the
turns that are known to be shared, and the merged stream closes the nodes of an open path. A node that
lies on the first or last path of its range may go on in the neighbours: its parts are added, and what
two neighbours both counted is taken back.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.common import dropping, map_arrow, materialize, sealed, table

#: Bytes of a turn's digest.
TURN = 32
#: Bytes of sequences in a run, and in a range: small ranges up to MANY of them, larger ones beyond.
RUN_BYTES, SMALL_BYTES, RANGE_BYTES, MANY = 16 << 20, 1 << 20, 16 << 20, 2000
#: Stands for the id of conversations without one: above every other.
NO_ID = (1 << 63) - 1
NO_ENDS = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, n, id, chars): the rows of each conversation, numbered from 1 by turn, role and digest, null turns first."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    told = rows.select("conv_id", "turn", role.alias("role"), digest.alias("id"), F.length(text).alias("chars"))
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "id")
    return told.select("conv_id", F.row_number().over(order).alias("n"), "id", "chars")


def sequences(places: DataFrame) -> DataFrame:
    """(conv_id, path, chars) of conversations given as (conv_id, n, id, chars); n = 0 stands for the conversation itself."""
    listed = F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.struct("n", "id", "chars"))))
    return places.groupBy("conv_id").agg(listed.alias("turns")).select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda t: t["id"]), "")).alias("path"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


def distinct_sequences(found: DataFrame) -> DataFrame:
    """(path, chars, least, n, ends): each sequence once, with its smallest conversation, how many there are, and their ids' digest."""
    members = found.withColumn("whole", F.sha2("path", 256))
    ends = sealed(members.select("whole", "conv_id", F.col("conv_id").cast("string").alias("line")), "whole", "conv_id", "line", ",", "ends")
    once = members.groupBy("whole").agg(F.any_value("path").alias("path"), F.any_value("chars").alias("chars"), F.coalesce(F.min("conv_id"), F.lit(NO_ID)).alias("least"), F.count(F.lit(1)).alias("n"))
    return once.join(ends, "whole").select("path", "chars", "least", "n", "ends")


def shared(a: bytes, b: bytes, known: int = 0) -> int:
    """How many turns ``a`` and ``b`` begin alike; the first ``known`` are not read."""
    most = min(len(a), len(b)) // TURN
    while known < most and a[known * TURN : (known + 1) * TURN] == b[known * TURN : (known + 1) * TURN]:
        known += 1
    return known


SEQUENCE = "path binary, chars array<int>, least long, n long, ends string"


def runs(found: DataFrame, most: int = RUN_BYTES) -> DataFrame:
    """The sequences as sorted runs: run, at (the place in it), lcp (turns shared with the one before)."""

    def sorted_run(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        paths = rows.column(0).to_pylist()
        order = sorted(range(len(paths)), key=paths.__getitem__)
        lcps = [0, *(shared(paths[a], paths[b]) for a, b in zip(order, order[1:]))]
        rows = rows.take(pa.array(order))
        return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().bytes] * len(order)), pa.array(range(len(order)), pa.int32()), pa.array(lcps, pa.int32()), *rows.columns], names=["run", "at", "lcp", *rows.schema.names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= most:
                yield sorted_run(held)
                held, size = [], 0
        if held:
            yield sorted_run(held)

    return map_arrow(found, run, f"run binary, at int, lcp int, {SEQUENCE}")


class Merge:
    """Loser tree over sorted runs of (lcp, path, row), each lcp with the run's sequence before.

    A head's lcp is held with the last sequence that won. Of two heads the one that shares more with
    it is the smaller; equal ones are compared from that turn on, and the loser keeps what it shares
    with the winner. ``compared`` counts the turns that were read.
    """

    def __init__(self, given: list[list[tuple[int, bytes, int]]]) -> None:
        self.given = [iter(r) for r in given]
        self.heads: list[tuple[int, bytes, int] | None] = [next(r, None) for r in self.given]
        # Nothing has won yet, and nothing is shared with it.
        self.heads = [h and (0, *h[1:]) for h in self.heads]
        self.compared = 0
        self.size = len(given)
        self.losers = [-1] * self.size
        self.winner = self.build(1) if self.size > 1 else 0

    def build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        return self.play(node, self.build(2 * node), self.build(2 * node + 1))

    def play(self, node: int, a: int, b: int) -> int:
        """The winner of runs ``a`` and ``b``; the loser stays at ``node``."""
        first, second = self.heads[a], self.heads[b]
        if first is None or second is None:
            won = b if first is None else a
        elif first[0] != second[0]:
            won = a if first[0] > second[0] else b
        else:
            h = shared(first[1], second[1], first[0])
            self.compared += h - first[0] + 1
            won = a if first[1][h * TURN :] < second[1][h * TURN :] else b
            lost = b if won == a else a
            self.heads[lost] = (h, *self.heads[lost][1:])
        self.losers[node] = b if won == a else a
        return won

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        while self.size and (head := self.heads[self.winner]) is not None:
            yield head
            k = self.winner
            self.heads[k] = next(self.given[k], None)
            node = (k + self.size) // 2
            while node:
                k = self.play(node, k, self.losers[node])
                node //= 2
            self.winner = k


def prefix_keys(path: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` turns."""
    state, out = hashlib.sha256(), [hashlib.sha256().digest()]
    for d in range(depth):
        state.update(path[d * TURN : (d + 1) * TURN])
        out.append(state.copy().digest())
    return out


class Nodes:
    """The nodes of one range, grown from its sequences in order; node 0 is the root."""

    def __init__(self) -> None:
        self.depth, self.parent, self.chars, self.least, self.n, self.children, self.leaves, self.saved, self.ends = [0], [-1], [0], [NO_ID], [0], [0], [0], [0], [NO_ENDS]
        self.path = [0]

    def close(self) -> None:
        """Ends the deepest open node and adds it to its parent."""
        k = self.path.pop()
        self.leaves[k] += not self.children[k]
        self.saved[k] += (self.n[k] - 1) * self.chars[k]
        p = self.parent[k]
        if p >= 0:
            self.children[p] += 1
            self.leaves[p] += self.leaves[k]
            self.saved[p] += self.saved[k]
            self.n[p] += self.n[k]
            self.least[p] = min(self.least[p], self.least[k])

    def add(self, lcp: int, chars: list[int], least: int, n: int, ends: str) -> None:
        while len(self.path) > lcp + 1:
            self.close()
        for d in range(lcp, len(chars)):
            self.depth.append(d + 1)
            self.parent.append(self.path[-1])
            self.chars.append(chars[d])
            for column, value in ((self.least, NO_ID), (self.n, 0), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.ends, NO_ENDS)):
                column.append(value)
            self.path.append(len(self.depth) - 1)
        k = self.path[-1]
        self.n[k] += n
        self.least[k] = min(self.least[k], least)
        self.ends[k] = ends


#: Node rows; those with a key are open to the neighbours. A row without a depth holds the edges of its range.
NODE = "part int, serial int, parent int, depth int, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, parent_key binary, first binary, last binary, first_chars array<int>"
TYPES = [pa.int32()] * 4 + [pa.int64()] * 6 + [pa.string()] + [pa.binary()] * 4 + [pa.list_(pa.int32())]
NAMES = [c.split()[0] for c in NODE.split(", ")]


def merged(part: int, rows: pa.Table) -> tuple[pa.RecordBatch, pa.RecordBatch]:
    """The node rows of one range, and its row of edges."""
    run, at, lcp, path, chars, least, n, ends = (c.to_pylist() for c in rows.columns)
    pieces: dict[bytes, list[tuple[int, int, bytes, int]]] = {}
    for k, name in enumerate(run):
        pieces.setdefault(name, []).append((at[k], lcp[k], path[k], k))
    nodes, order = Nodes(), []
    # Of a run, a range holds neighbours; only the first one's lcp is with a sequence of another range.
    for shares, _, k in Merge([[row[1:] for row in sorted(p)] for p in pieces.values()]):
        nodes.add(shares, chars[k], least[k], n[k], ends[k])
        order.append(k)
    last_path = list(nodes.path)
    while nodes.path:
        nodes.close()
    first, last = path[order[0]], path[order[-1]]
    keys: list[bytes | None] = [None] * len(nodes.depth)
    parents: list[bytes | None] = [None] * len(nodes.depth)
    # The first sequence made the nodes 1, 2, ... in order; the last one left the open path.
    for on, of in ((range(len(first) // TURN + 1), first), (last_path, last)):
        told = prefix_keys(of, len(on) - 1)
        for d, k in enumerate(on):
            keys[k], parents[k] = told[d], told[d - 1] if d else None
    above = [nodes.least[p] if p >= 0 and keys[p] is None else None for p in nodes.parent]
    m = len(nodes.depth)
    columns = [[part] * m, range(m), nodes.parent, nodes.depth, nodes.least, above, nodes.n, nodes.children, nodes.leaves, nodes.saved, nodes.ends, keys, parents, [None] * m, [None] * m, [None] * m]
    edge = [[part]] + [[None]] * 12 + [[first], [last], [chars[order[0]]]]
    return tuple(pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(x, TYPES)], names=NAMES) for x in (columns, edge))


def merge(given: DataFrame) -> DataFrame:
    """Merges the pieces of runs that lie in each partition, a range of sequences, into nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            yield from merged(TaskContext.get().partitionId(), pa.Table.from_batches(held))

    return map_arrow(given, run, NODE)


def taken_back(edges: DataFrame) -> DataFrame:
    """(key, n_children, n_leaves, saved_tokens) to add where two neighbouring ranges share nodes.

    A shared node was a child twice and its first copy was charged twice. The last sequence of a range
    that the next one extends was counted as a leaf.
    """
    pairs = edges.select("first", "first_chars", F.lag("last").over(Window.orderBy("first")).alias("before")).where("before IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, chars, before in zip(*(c.to_pylist() for c in batch.columns)):
                most = shared(before, first)
                saved = [sum(chars[:most])]
                for c in chars[:most]:
                    saved.append(saved[-1] - c)
                # The node at depth d is charged again itself: what lies at d and below, the root has no text.
                saved = [saved[0], *saved[:-1]]
                leaf = -int(len(before) == most * TURN)
                yield pa.RecordBatch.from_arrays([pa.array(prefix_keys(first, most), pa.binary()), pa.array([-1] * most + [0], pa.int64()), pa.array([leaf] * (most + 1), pa.int64()), pa.array(saved, pa.int64())], names=["key", "n_children", "n_leaves", "saved_tokens"])

    return map_arrow(pairs, run, "key binary, n_children long, n_leaves long, saved_tokens long")


def ranges_for(given: DataFrame) -> int:
    total = given.agg(F.sum(F.octet_length("path") + 64)).first()[0] or 0
    return max(1, min(-(-total // SMALL_BYTES), MANY), -(-total // RANGE_BYTES))


RESULT = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def with_ids(rows: DataFrame) -> DataFrame:
    real = lambda name: F.nullif(name, F.lit(NO_ID)).alias(name)
    return rows.select(real("conv_id"), F.col("depth").cast("long").alias("depth"), real("parent_conv_id"), *RESULT[3:])


def trie(places: DataFrame, run_bytes: int = RUN_BYTES, ranges: int | None = None) -> DataFrame:
    """The nodes of the trie of conversations given as (conv_id long, n, id, chars), see ``sequences``.

    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256; a node is
    told by its depth and its smallest conversation. Conversations without turns end at the root. A null
    conv_id is one conversation, which is no node's smallest unless it is alone there, and empty among the
    ends. No conversations, no nodes. A conversation's digests are held in one task, a range's too;
    the ids of equal conversations stream through one.
    """
    laid = materialize(runs(distinct_sequences(sequences(places)), run_bytes), "runs")
    nodes = materialize(merge(laid.repartitionByRange(ranges or ranges_for(laid), "path")), "nodes")
    opened, closed = nodes.where("key IS NOT NULL"), nodes.where("depth IS NOT NULL AND key IS NULL")
    sums = ["n_children", "n_leaves", "saved_tokens"]
    both = opened.select("key", "parent_key", "depth", "conv_id", "n_convs", *sums, "ends_sha256").unionByName(taken_back(nodes.where("depth IS NULL")), allowMissingColumns=True)
    ends = F.coalesce(F.max(F.nullif("ends_sha256", F.lit(NO_ENDS))), F.lit(NO_ENDS))
    top = materialize(both.groupBy("key").agg(F.max("parent_key").alias("parent_key"), F.max("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs"), *(F.sum(n).alias(n) for n in sums), ends.alias("ends_sha256")), "open-nodes")
    ids = top.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("parent_conv_id"))
    known = opened.select("part", F.col("serial").alias("parent"), F.col("key").alias("parent_key")).join(ids, "parent_key").drop("parent_key")
    return with_ids(
        top.join(ids, "parent_key", "left").select(RESULT)
        .unionByName(closed.where("parent_conv_id IS NOT NULL").select(RESULT))
        .unionByName(closed.where("parent_conv_id IS NULL").drop("parent_conv_id").join(known, ["part", "parent"]).select(RESULT))
    )


def prefix_trie(rows: DataFrame) -> DataFrame:
    """The trie of conversations (conv_id, turn, role, text) as they are; null role or text is empty, null turns come first."""
    with dropping():
        told = materialize(turns(rows), "turns")
        return materialize(trie(told.unionByName(itself(told))), "trie", keep=True)


def itself(told: DataFrame) -> DataFrame:
    """One row with n = 0 for each conversation."""
    return told.where("n = 1").select("conv_id", F.lit(0).alias("n"), F.lit("").alias("id"), F.lit(0).alias("chars"))


#: Conversations come in hundreds, and take up to five turns of the first one.
HUNDRED, MOST = 100, 6


def taken() -> Column:
    return F.coalesce(F.crc32(F.col("conv_id").cast("string").cast("binary")) % MOST, F.lit(0))


def rebuilt(told: DataFrame) -> DataFrame:
    """The ``turns`` as the contract rebuilds them: h of the conversation that heads the hundred, then the own ones after h."""
    convs = told.where("n = 1").select("conv_id", taken().alias("h"), (F.col("conv_id") - F.col("conv_id") % HUNDRED).alias("head"))
    heads = told.where(F.col("n") < MOST).withColumnRenamed("conv_id", "of")
    given = convs.join(heads, (F.col("head") == F.col("of")) & (F.col("n") <= F.col("h")))
    own = told.where(F.col("n") > taken())
    columns = ["conv_id", "n", "id", "chars"]
    return given.select(columns).unionByName(own.select(columns)).unionByName(itself(told))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuilt_trie(table(spark, sf_dir, "conversations"))


def rebuilt_trie(rows: DataFrame, run_bytes: int = RUN_BYTES, ranges: int | None = None) -> DataFrame:
    with dropping():
        told = materialize(turns(rows), "turns")
        return materialize(trie(rebuilt(told), run_bytes, ranges), "trie", keep=True)


ORACLE = """
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role)::VARCHAR || ':' || role || text)) AS n,
             sha256(length(role)::VARCHAR || ':' || role || text) AS id, length(text) AS chars FROM r),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS head, (4294967295 - list_reduce([unicode(x)::BIGINT for x in string_split(conv_id::VARCHAR, '')],
        lambda acc, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(acc, b)), 4294967295::BIGINT)) % 6 AS h FROM t),
places AS (SELECT c.conv_id, t.n, t.id, t.chars FROM c JOIN t ON t.conv_id = c.head AND t.n <= c.h
           UNION ALL SELECT c.conv_id, t.n, t.id, t.chars FROM c JOIN t ON t.conv_id = c.conv_id AND t.n > c.h),
seqs AS (SELECT c.conv_id, coalesce(list(id ORDER BY n) FILTER (id IS NOT NULL), []) AS ids, coalesce(list(p.chars ORDER BY n) FILTER (id IS NOT NULL), []) AS chars FROM c LEFT JOIN places p ON p.conv_id = c.conv_id GROUP BY c.conv_id),
prefixes AS (SELECT conv_id, d, ids[1:d] AS key, ids[1:d-1] AS up, CASE WHEN d = 0 THEN 0 ELSE chars[d] END AS last, len(ids) AS size FROM seqs, unnest(range(0, len(ids) + 1)) u(d)),
nodes AS (SELECT d, key, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(last) AS own, bool_and(size = d) AS leaf,
                 sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM prefixes GROUP BY d, key),
sums AS (SELECT a AS d, key[1:a] AS key, count(*) FILTER (leaf) AS n_leaves, sum(own)::BIGINT AS saved_tokens, count(*) FILTER (d = a + 1) AS n_children FROM nodes, unnest(range(0, d + 1)) u(a) GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, s.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.d = n.d AND s.key = n.key LEFT JOIN nodes p ON p.d = n.d - 1 AND p.key = n.up
"""
