import zlib
from collections import defaultdict

import pytest

from gridmill.llm import sharding


def test_rows_sizes_and_places(edge, empty):
    rows = sharding.shard(edge).collect()
    texts = defaultdict(list)
    for r in edge.collect():
        texts[r.doc_id].append((r.text or "").encode())
    assert len(rows) == edge.count()
    for r in rows:
        assert (r.size, r.text_crc32) in {(len(t) + 1, zlib.crc32(t)) for t in texts[r.doc_id]}
    places = defaultdict(list)
    for r in rows:
        places[r.shard].append(r.slot)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sharding.shard(empty).count() == 0


def test_shards_are_near_equal_in_bytes(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', cast(1 + pmod(id * 7919, 97) AS int)) AS text")
    load = defaultdict(int)
    for r in sharding.shard(docs).collect():
        load[r.shard] += r.size
    assert len(load) == 8 and max(load.values()) < 1.01 * min(load.values())


def test_rebalancing_moves_little_and_versions_stay(spark, tmp_path):
    sizes = {v: 100 + v % 13 for v in range(sharding.SLOTS)}
    first = sharding.assign(sizes, 8)
    grown = sharding.rebalance(first, sizes, 9)
    moved = [v for v in first if first[v] != grown[v]]
    assert all(grown[v] == 8 for v in moved)
    assert abs(sum(sizes[v] for v in moved) - sum(sizes.values()) / 9) < 200
    shrunk = sharding.rebalance(grown, sizes, 8)
    assert {s for s in shrunk.values()} == set(range(8))
    path = f"{tmp_path}/map"
    sharding.save_map(spark, first, 1, path)
    sharding.save_map(spark, grown, 2, path)
    assert sharding.load_map(spark, path) == (2, grown) and sharding.load_map(spark, path, 1) == (1, first)


def test_every_row_is_placed_as_plain_python_places_it(spark, edge):
    """Sizes and checksums by zlib, places by the map that was stored: shard from the slot, then order within."""
    rows = sharding.shard(edge, map_path=(path := sharding.scratch_path(spark, "test-map"))).collect()
    _, slot_map = sharding.load_map(spark, path)
    told = sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows)
    assert told == sorted((str(r.doc_id), len(t := (r.text or "").encode()) + 1, zlib.crc32(t)) for r in edge.collect())
    assert all(r.shard == slot_map[r.vslot] and r.law == "bytes" for r in rows)
    for s in range(8):
        own = sorted((r for r in rows if r.shard == s), key=lambda r: r.slot)
        assert [r.vslot for r in own] == sorted(r.vslot for r in own) and [r.slot for r in own] == list(range(len(own)))


def test_repeated_rows_and_null_ids_stay_near_equal(spark):
    for doc_id in ("1", "CAST(NULL AS BIGINT)"):
        same = spark.range(4000).selectExpr(f"{doc_id} AS doc_id", "repeat('abc ', 9) AS text")
        other = spark.range(4000).selectExpr("id AS doc_id", "repeat('xyz ', 9) AS text")
        load = defaultdict(int)
        for r in sharding.shard(same.unionByName(other)).collect():
            load[r.shard] += r.size
        assert len(load) == 8 and max(load.values()) < 1.02 * min(load.values())


def test_a_grown_map_moves_few_rows_and_nearly_all_to_the_new_shard(spark, tmp_path):
    docs = spark.range(3000).selectExpr("id AS doc_id", "repeat('ab ', cast(1 + pmod(id * 7919, 97) AS int)) AS text")
    path = f"{tmp_path}/map"
    before = {r.doc_id: r.shard for r in sharding.shard(docs, map_path=path).collect()}
    grown = sharding.shard(docs, 9, map_path=path, version=1).collect()
    moved = [r for r in grown if r.shard != before[r.doc_id]]
    assert {r.version for r in grown} == {2} and sum(r.shard == 8 for r in moved) > 0.9 * len(moved) > 0
    assert len(moved) < len(before) / 7
    load = defaultdict(int)
    for r in grown:
        load[r.shard] += r.size
    assert max(load.values()) < 1.05 * min(load.values())


def test_a_second_call_follows_the_stored_map(spark, tmp_path):
    docs = spark.range(500).selectExpr("id AS doc_id", "repeat('ab ', cast(1 + pmod(id * 7919, 97) AS int)) AS text")
    path = f"{tmp_path}/map"
    first = sorted(map(tuple, sharding.shard(docs, map_path=path).collect()))
    assert sorted(map(tuple, sharding.shard(docs, map_path=path).collect())) == first
    assert sharding.latest_version(spark, path) == 1
    sharding.shard(docs, 9, map_path=path)
    sharding.shard(docs, 10, map_path=path, version=1)
    assert sharding.latest_version(spark, path) == 3
    for wrong in (0, 4):
        with pytest.raises(ValueError):
            sharding.shard(docs, map_path=path, version=wrong)
    with pytest.raises(ValueError):
        sharding.shard(docs, slots=16, map_path=path)


def test_the_map_is_the_greedy_one_of_the_slots_bytes(spark):
    """Slots and map computed from the rows alone: bytes by slot, the heaviest first to the lightest shard, then what still moves."""
    docs = spark.range(700).selectExpr("id AS doc_id", "repeat('x', cast(pmod(id * 31, 211) AS int)) AS text")
    rows = sharding.shard(docs, 5, 64).collect()
    load, sums = [0] * 5, defaultdict(int)
    for r in rows:
        sums[r.vslot] += r.size
    where = {}
    for v in sorted(range(64), key=lambda v: (-sums[v], v)):
        where[v] = min(range(5), key=lambda s: (load[s], s))
        load[where[v]] += sums[v]
    mean = sum(load) / 5
    moved = {r.vslot for r in rows if where[r.vslot] != r.shard}
    assert len(moved) < 10
    now = [sum(r.size for r in rows if r.shard == s) for s in range(5)]
    assert max(now) - min(now) <= max(load) - min(load) and max(now) < 1.1 * mean
