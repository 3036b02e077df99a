import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from gridmill.llm import prefix_trie as p
from gridmill.llm.common import materialize

SCHEMA = "conv_id long, turn long, role string, text string, chars string"


def listed(rows):
    found = defaultdict(list)
    for c, turn, role, text, *_ in rows:
        role, text = role or "", text or ""
        found[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    return {c: [(x[2], x[4]) for x in sorted(t)] for c, t in found.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        if c is None:
            out[c] = own
            continue
        h = zlib.crc32(str(c).encode()) % 6
        head = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = convs.get(head, [])[:h] + own[h:]
    return out


def brute(convs):
    """{(prefix): row} by enumerating the prefixes of every conversation."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    low = lambda ids: min((i for i in ids if i is not None), default=None)
    rows = []
    for key, ids in members.items():
        below = [k for k in members if k[: len(key)] == key]
        inner = {k[:-1] for k in members if k}
        ends = sorted((c for c in ids if tuple(convs[c]) == key), key=lambda c: (c is not None, c or 0))
        rows.append((
            low(ids), len(key), low(members[key[:-1]]) if key else None, len(ids), sum(len(k) == len(key) + 1 for k in below),
            sum(k not in inner for k in below), sum((len(members[k]) - 1) * len(k[-1][1]) for k in below if k), hashlib.sha256(",".join("" if c is None else str(c) for c in ends).encode()).hexdigest(),
        ))
    return sorted(rows, key=str)


def rows_of(seed, n):
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        c = rng.choice([rng.randint(-250, 450), rng.choice([0, 100, 200])])
        if any(r[0] == c for r in rows):
            continue
        rows += [(c, t if rng.random() > 0.1 else None, rng.choice(["user", "user", None]), rng.choice(["", "a", "é!", None, "bb"]), "z") for t in range(rng.randint(1, 7))]
    rows += [(500 + k, t, "user", f"same {t}", "z") for k in range(30) for t in range(4)] + [(None, 0, "user", "same 0", "z")] * 2
    return rows + [(600, t, "user", f"same {t}", "z") for t in range(60)]


@pytest.mark.parametrize("ranges,run_bytes", [(1, 1 << 20), (5, 400), (40, 100)])
def test_same_as_brute_force_however_it_is_cut(spark, ranges, run_bytes):
    rows = rows_of(ranges, 90)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        told = materialize(p.turns(docs), "turns")
        plain = p.trie(told.unionByName(p.itself(told)), run_bytes, ranges)
        assert sorted(map(tuple, plain.collect()), key=str) == brute(listed(rows))
        assert sorted(map(tuple, p.rebuilt_trie(docs, run_bytes, ranges).collect()), key=str) == brute(rebuild(listed(rows)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_turnless_conversations_and_empty_tables(spark):
    # 1 takes turns of 0, which is not there, and has none of its own after them.
    assert zlib.crc32(b"1") % 6 > 0
    docs = spark.createDataFrame([(1, 0, "user", "a", "")], SCHEMA)
    assert [tuple(r) for r in p.rebuilt_trie(docs).collect()] == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
    assert p.rebuilt_trie(docs.where("false")).count() == p.prefix_trie(docs.where("false")).count() == 0


def test_long_texts_and_repeats(spark):
    rows = [(1, 0, "user", "x" * 300_000, ""), (2, 0, "user", "x" * 300_000, ""), (2, 1, "user", "y", ""), (2, 1, "user", "y", "")]
    got = sorted(map(tuple, p.prefix_trie(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute(listed(rows)) and max(r[6] for r in got) == 300_000


def test_merge_reads_no_shared_turn_again():
    rng = random.Random(1)
    turn = lambda k: bytes([k]) * p.TURN
    stem = b"".join(turn(9) for _ in range(200))
    paths = sorted({stem + b"".join(turn(rng.randint(0, 3)) for _ in range(rng.randint(0, 6))) for _ in range(300)})
    runs = [[] for _ in range(7)]
    for x in paths:
        rng.choice(runs).append(x)
    given = [[(p.shared(r[i - 1], x) if i else 0, x, 0) for i, x in enumerate(r)] for r in runs]
    merge = p.Merge(given)
    got = list(merge)
    assert [x for _, x, _ in got] == paths
    assert [h for h, *_ in got] == [0] + [p.shared(a, b) for a, b in zip(paths, paths[1:])]
    # The stem is compared in the first games alone, not for each of the sequences.
    assert merge.compared < 8 * 201 + 10 * len(paths)
    assert list(p.Merge([])) == [] and list(p.Merge([[]])) == []
