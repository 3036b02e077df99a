import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from gridmill.llm import substring_dedup, suffix_dedup, units


def gone_of(items, size):
    """For each item of (order key, sequence): flags of what an earlier equal window covers."""
    seen, out = set(), {}
    for k, seq in sorted(items, key=lambda x: x[0]):
        flags = [False] * len(seq)
        for i in range(len(seq) - size + 1):
            window = seq[i : i + size]
            if window in seen:
                flags[i : i + size] = [True] * size
            seen.add(window)
        out[k] = flags
    return out


def corpus(rng, unit):
    """Texts that share passages of many lengths, repeat themselves and overlap; unit makes a piece."""
    passages = ["".join(unit() for _ in range(rng.choice([5, 18, 20, 22, 40, 90]))) for _ in range(12)]
    texts = []
    for _ in range(120):
        parts = [rng.choice(passages) if rng.random() < 0.6 else "".join(unit() for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(0, 5))]
        texts.append("".join(parts))
    return texts + [None, "", "a" * 700, "a" * 350, "ab" * 300, "é" * 200, texts[3], texts[4] or "x", "a a " * 100]


def table_of(spark, texts, rng):
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = [(None if i == 5 else i if i != 9 else 8, t) for i, t in zip(ids, texts)]
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, unit string, row int").coalesce(1), rows


def keyed(rows):
    return [((d is not None, d or 0, k), t or "") for k, (d, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_words_match_brute_force(spark, seed):
    rng = random.Random(seed)
    df, rows = table_of(spark, corpus(rng, lambda: rng.choice("abcdefgh") + rng.choice(["", "q", "É"]) + rng.choice(" \n\t")), rng)
    words = [(k, tuple(re.findall(r"[^\x20\x09-\x0D]+", t))) for k, t in keyed(rows)]
    gone = gone_of(words, 20)
    want = sorted((str(k[1] if k[0] else None), len(w), sum(gone[k]), hashlib.sha256(" ".join(x for x, g in zip(w, gone[k]) if not g).encode()).hexdigest()) for k, w in words)
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup.repeats(df.repartition(1)).collect())
    assert sum(sum(g) for g in gone.values()) > 500
    assert got == want


@pytest.mark.parametrize("seed", [1, 2])
def test_bytes_match_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    df, rows = table_of(spark, corpus(rng, lambda: rng.choice(["the ", "of ", "É", "qu", "x"])), rng)
    raw = [(k, t.encode()) for k, t in keyed(rows)]
    gone = gone_of(raw, 100)
    spans = lambda f: sum(1 for i, g in enumerate(f) if g and not (i and f[i - 1]))
    want = sorted((str(k[1] if k[0] else None), len(b), sum(gone[k]), spans(gone[k]), hashlib.sha256(bytes(x for x, g in zip(b, gone[k]) if not g)).hexdigest()) for k, b in raw)
    got = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.repeats(df.repartition(1)).collect())
    assert sum(sum(g) for g in gone.values()) > 500
    assert got == want


def test_many_units_agree_with_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for module in (suffix_dedup, substring_dedup):
        one = {tuple(r) for r in module.repeats(docs.coalesce(1)).collect()}
        many = {tuple(r) for r in module.repeats(docs.repartition(7)).collect()}
        assert one == many and len(one) == docs.count()


def test_small_units_and_homes_agree_and_no_text_is_shuffled(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    one = [{tuple(r) for r in m.repeats(docs.coalesce(1)).collect()} for m in (suffix_dedup, substring_dedup)]
    monkeypatch.setattr(units, "UNIT_BYTES", 3000)
    monkeypatch.setattr(units, "HOME_BYTES", 20000)
    assert [{tuple(r) for r in m.repeats(docs.repartition(3)).collect()} for m in (suffix_dedup, substring_dedup)] == one
    held = units.units_of(docs)
    sizes = [r.n for r in held.docs.groupBy("home").agg({"text": "count"}).withColumnRenamed("count(text)", "n").collect()]
    assert len(sizes) > 8 and held.docs.select("unit").distinct().count() > 30
    asked = units.first_round(held, lambda unit: pa.Table.from_arrays([pa.array([-1 - unit.number]), pa.array([unit.home]), pa.array([unit.number]), pa.array([b""])], schema=units.MAIL_SCHEMA))
    told = units.materialize(asked, "test")
    plan = units.next_round(held, told, lambda unit, came: came)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapCoGroupsInArrow" in plan


def test_bytes_of_the_smallest_tables(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    gone = gone_of([(r.doc_id, r.text.encode()) for r in rows], 100)
    got = {r.doc_id: r.n_removed for r in suffix_dedup.query(spark, "/root/testdata/sf0.001").collect()}
    assert got == {k: sum(v) for k, v in gone.items()}


def test_edge_rows(edge, empty):
    for module in (suffix_dedup, substring_dedup):
        assert module.repeats(edge).count() == edge.count() and module.repeats(empty).count() == 0


def test_least_key_of_each_stretch():
    keys = np.random.default_rng(1).integers(0, 1 << 60, 500, dtype=np.uint64)
    assert (suffix_dedup.least(keys, 69) == [keys[i : i + 69].min() for i in range(432)]).all()


def test_session_options_are_as_before_and_threads_keep_their_own_scratch(spark, edge):
    import threading

    from gridmill.llm import common, substring_dedup

    keys = ["spark.sql.requireAllClusterKeysForCoPartition", "spark.sql.execution.arrow.maxBytesPerBatch"]
    for k in keys:
        spark.conf.unset(k)
    before = [spark.conf.get(k) for k in keys]
    substring_dedup.repeats(edge)
    assert [spark.conf.get(k) for k in keys] == before
    seen = []
    with common.dropping():
        thread = threading.Thread(target=lambda: seen.append(common.OPEN.get()))
        thread.start()
        thread.join()
    assert seen == [()]
