import hashlib
import pickle
import random
import re
import string

from gridmill.llm import decontaminate as d

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - 9) if b else 0):
            p = b[i : i + 10]
            for s in range(len(w) - len(p) + 1):
                if w[s : s + len(p)] == p:
                    hit |= set(range(s, s + len(p)))
                    if item is not None:
                        found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_same_as_brute_force_with_short_items_and_several_blocks(spark, edge, empty):
    rng = random.Random(4)
    some = lambda n: " ".join(rng.choice(["a", "b", "the", "É", "x9"]) for _ in range(n))
    items = [(1, some(30)), (2, some(12)), (3, "a b the"), (4, "Q"), (5, None), (6, ""), (None, some(11)), (7, some(25)), (7, some(10))]
    texts = []
    for _ in range(150):
        extra = rng.choice(items)[1] or ""
        texts.append(some(rng.randint(0, 60)) + " " + extra.replace(" ", rng.choice([" ", ", ", "-"])).upper() + " " + some(rng.randint(0, 9)))
    texts += [None, "", "q", "..."]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (d.TABLE_BYTES, 600):
        for r in d.contamination(docs, bench, most).collect():
            assert (r.n_words, r.n_hit, r.n_items, r.items_sha256) == brute(texts[r.doc_id], items)
            assert r.contaminated == (r.n_hit > 0)
    assert d.contamination(empty, bench).count() == 0
    assert not d.contamination(edge, bench.where("false")).where("contaminated").count()
    assert d.contamination(edge, bench).count() == edge.count()


def test_shift_tables_skip_what_cannot_match():
    looked = []
    tables = d.Tables({tuple(b"a b c d e f g h i j".split()): ["1"]})

    class Spy(bytes):
        def __getitem__(self, i):
            looked.append(i)
            return super().__getitem__(i)

    tables.steps = Spy(tables.steps)
    assert not list(tables.search([b"z"] * 900)) and len(looked) == 99


def test_tables_take_little_more_than_their_patterns():
    rng = random.Random(1)
    words = [f"word{i:06d}".encode() for i in range(3000)]
    patterns = {tuple(rng.choice(words) for _ in range(10)): [str(i % 500)] for i in range(20_000)}
    tables = d.Searcher([patterns])
    size = sum(len(b" ".join(p)) for p in patterns)
    held = len(pickle.dumps(tables))
    arrays = sum(len(x) * x.itemsize for t in tables.tables for x in (t.rows, t.last, t.first, t.cuts)) + sum(len(t.steps) for t in tables.tables)
    assert held < 2 * size and arrays < 2.5 * size
    some = list(patterns)[7]
    assert [(s, n) for s, n, _ in tables.search([b"x", *some, b"y"])] == [(1, 10)]


def test_several_parts_keep_clashing_columns_and_leave_no_scratch(spark, edge, tmp_path, monkeypatch):
    monkeypatch.setattr(d, "TABLE_BYTES", 30)
    bench = spark.createDataFrame([(i, f"hello big world {i}") for i in range(6)] + [(9, "hello big world")], "item_id long, text string")
    told = d.contamination(edge.withColumnRenamed("kept", "hits"), bench, 40)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.contaminated) for r in told.collect()) == sorted((r.doc_id is None, r.doc_id or 0, (r.text or "").lower() == "hello big world") for r in edge.collect())
