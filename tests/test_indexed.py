"""Stored indexes against scans: the same rows, from a part of what is stored."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.functions import text as T
from gridmill.operators import postings, vector_blocks
from gridmill.plans import search_log as log
from gridmill.sources import index_store


def grams(text):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return [w[i : i + 3] for w in (f"  {x} " for x in words) for i in range(len(w) - 2)]


def likeness(q, name):
    a, t = set(grams(q)), grams(name)
    jaccard = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    word = max((jaccard(a, set(t[i:j])) for i in range(len(t)) for j in range(i + 1, len(t) + 1)), default=0.0)
    return round(word, 9), round(jaccard(a, set(t)), 9)


def scan(queries, names):
    told = {(q, n): likeness(text, n) for q, text in queries for n in names}
    return {k: v for k, v in told.items() if v[0] > 0.3 or v[1] > 0.2}


def found(index, spark, queries):
    df = postings.search(index, spark.createDataFrame(queries, "query_id int, query string"))
    return {(r.query_id, r.name): (round(r.word, 9), round(r.tri, 9)) for r in df.collect()}


@pytest.fixture
def names():
    rng = random.Random(8)
    parts = ["the", "big", "house", "tower", "Tower", "hall", "old", "mill", "gate", "stone", "north", "quay"]
    return sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) + rng.choice(["", " 7", " é"]) for _ in range(150)})


QUERIES = [(1, "the towr"), (2, "old mil gate"), (3, "zzz"), (4, ""), (5, None), (6, "x"), (7, "the the the big hous nort"), (8, "stone é")]


def test_postings_find_what_a_scan_finds(spark, names, tmp_path):
    df = lambda x: spark.createDataFrame([(n,) for n in x], "name string")
    index = postings.build(df([*names[:90], None, names[0]]), str(tmp_path / "a"), 16)
    assert found(index, spark, QUERIES) == scan(QUERIES, names[:90])
    assert postings.add(index, df(names[60:])) and postings.add(index, df(names[60:]))
    assert len(index.segments()) == 2 and found(index, spark, QUERIES) == scan(QUERIES, names)
    postings.refresh(index, df(names[40:]))
    assert found(index, spark, QUERIES) == scan(QUERIES, names[40:])
    postings.refresh(index, df(names))  # what went comes back
    assert found(index, spark, QUERIES) == scan(QUERIES, names)
    whole = postings.compact(index, str(tmp_path / "b"))
    assert len(whole.segments()) == 1 and found(whole, spark, QUERIES) == scan(QUERIES, names)
    empty = postings.build(df([]), str(tmp_path / "c"), 4)
    assert found(empty, spark, QUERIES) == {} and found(index, spark, []) == {}


def test_a_search_reads_its_buckets_and_no_common_trigram(spark, tmp_path):
    names = spark.range(4000).select(F.concat(F.lit("the house "), F.conv(F.hex("id"), 16, 36)).alias("name"))
    index = postings.build(names, str(tmp_path / "a"), 64)
    asked = spark.createDataFrame([(1, "quay")], "query_id int, query string")
    df = postings.search(index, asked)
    plan = df._jdf.queryExecution().toString()
    listed = re.findall(r"PartitionFilters: \[[^\]]*bucket[^\]]*\]", plan)
    assert listed and all("bucket" in x for x in listed)
    trigrams = asked.select(F.explode(T.trigrams(F.col("query"))).alias("gram")).select(postings.bucket_of(F.col("gram"), 64).alias("bucket"))
    read = postings.in_buckets(index.table("postings", postings.POSTINGS), trigrams).select("bucket").distinct().count()
    assert read <= 5  # of 64, as the word has five trigrams
    # Every name has the trigrams of "the"; a name is asked for by the others.
    hits = found(index, spark, [(1, "the house 1Z")])
    assert hits and all(n.startswith("the house ") for _, n in hits)


def test_vector_blocks_find_what_a_scan_finds_and_skip_blocks(spark, tmp_path):
    rng = np.random.default_rng(3)
    middles = rng.normal(size=(40, 8))
    vectors = np.vstack([m + 0.05 * rng.normal(size=(50, 8)) for m in middles] + [np.zeros((3, 8)), middles[:2], middles[:2]])
    rows = [(i, [float(x) for x in v], f"n{i}") for i, v in enumerate(vectors)] + [(9000, None, "x"), (9001, [1.0], "x"), (9002, [float("nan")] * 8, "x")]
    index = vector_blocks.build(spark.createDataFrame(rows, "id long, embedding array<double>, name string").repartition(5), str(tmp_path / "v"), ["name"], blocks=40)
    queries = [(k, [float(x) for x in vectors[k * 50] * 3]) for k in range(12)] + [(90, [0.0] * 8), (91, None)]
    units = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-300)
    for k in (7, 60, 3000):
        got = vector_blocks.nearest(index, spark.createDataFrame(queries, "query_id int, q array<double>"), k)
        hits = {}
        for r in got.hits.orderBy("query_id", "nth").collect():
            assert r.name == f"n{r.id}"
            hits.setdefault(r.query_id, []).append((r.id, round(r.cos, 8)))
        for i, q in queries[:-1]:
            n = np.linalg.norm(q)
            cos = np.round(units @ (np.array(q) / n if n else np.array(q)), 9)
            order = np.lexsort((np.arange(len(cos)), -cos))[:k]
            assert [x for x, _ in hits[i]] == order.tolist()
        assert 91 not in hits
        read, blocks = got.read.count(), index.blocks().count()
        assert read < 0.2 * blocks * 13 or k > 7


def test_queries_and_blocks_meet_without_a_broadcast(spark, tmp_path):
    # Spark took the pairs of queries and blocks for small, by their packed files, and sent them through the driver.
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=(900, 16))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    index = vector_blocks.build(spark.createDataFrame(rows, "id long, embedding array<double>").repartition(1), str(tmp_path / "v"), [], blocks=30)
    got = vector_blocks.nearest(index, spark.createDataFrame(rows[:100], "query_id long, q array<double>"), 5)
    assert "Broadcast" not in got.hits._jdf.queryExecution().executedPlan().toString()
    units = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = np.argsort(-(units[:100] @ units.T), axis=1)[:, :5].tolist()
    hits = [(r.query_id, r.nth, r.id) for r in got.hits.collect()]
    assert sorted(hits) == [(q, n + 1, i) for q, ids in enumerate(want) for n, i in enumerate(ids)]


def test_a_query_text_is_searched_for_once(spark, tmp_path, monkeypatch):
    rows = [(i, f"{'old new big'.split()[i % 3]} house", [float(i % 7), 1.0, float(i % 5)], 0.1) for i in range(30)]
    log.build(spark.createDataFrame(rows, "id long, name string, embedding array<float>, fame double"), str(tmp_path / "c"))
    corpus = log.Corpus(spark, str(tmp_path / "c"), (("id", "bigint"), ("name", "string"), ("fame", "double")), log.by_name(spark.createDataFrame(rows, "id long, name string, embedding array<float>, fame double")).schema)
    met, search = [], postings.search
    monkeypatch.setattr(postings, "search", lambda index, queries, *rest: met.append(queries.count()) or search(index, queries, *rest))
    asked = [(k, ["old hose", "new hous"][k % 2], rows[k][2]) for k in range(12)] + [(99, None, [1.0, 0.0, 0.0])]
    told = log.search(corpus, spark.createDataFrame(asked, "query_id long, query string, q array<float>"), 4).collect()
    assert met == [3] and sorted((r.query_id, r.nth) for r in told if r.query_id != 99) == [(k, n) for k in range(12) for n in range(1, 5)]
    assert all(round(r.lex, 9) == max(likeness(asked[r.query_id][1], rows[r.id][1])) for r in told if r.query_id != 99)


def test_no_vectors(spark, tmp_path):
    none = spark.createDataFrame([], "id long, embedding array<double>")
    index = vector_blocks.build(none, str(tmp_path / "v"), [])
    assert vector_blocks.nearest(index, spark.createDataFrame([(1, [1.0])], "query_id int, q array<double>"), 3).hits.count() == 0


def test_an_index_is_built_once_for_its_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index_store, "home", lambda _: str(tmp_path / "home"))
    spark.range(3).write.parquet(str(tmp_path / "in"))
    built = []

    def build(path):
        built.append(path)
        spark.range(1).write.parquet(path)

    opened = lambda settings="a": index_store.opened("x", [spark.read.parquet(str(tmp_path / "in"))], settings, build)
    assert opened() == opened() and len(built) == 1
    assert opened("b") != opened() and len(built) == 2
    first = opened()
    spark.range(3).write.mode("append").parquet(str(tmp_path / "in"))
    assert opened() != first and len(built) == 3
    # A second builder that comes late gives up its own and leaves the first one's whole.
    late = str(tmp_path / "late")
    spark.range(9).write.parquet(late)
    assert not index_store.publish(spark, late, first)
    assert spark.read.parquet(first).count() == 1 and not index_store.exists(spark, late)
