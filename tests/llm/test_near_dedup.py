import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmill.llm import near_dedup as N
from gridmill.llm.components import components

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(FOLD))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent):
    """[(doc_id, set size, component)] with all pairs compared; null ids come last."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(sets[i]), min(groups[find(i)], key=lambda x: (x is None, x))) for i, (d, _) in enumerate(rows)]


def test_components_match_all_pairs(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "ß"]
    bases = [[rng.choice(vocabulary) for _ in range(rng.choice([3, 4, 5, 8, 15, 60, 300]))] for _ in range(30)]
    rows = []
    for i in range(260):
        w = list(rng.choice(bases))
        for _ in range(rng.choice([0, 0, 1, 2, 5])):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = [rng.choice(vocabulary)]
        rows.append((i * 3 % 260, rng.choice([" ", "\n", "  "]).join(w).upper() if i % 5 else " ".join(w)))
    rows += [(1000, None), (1001, ""), (1002, " \n\t"), (None, " ".join(bases[0])), rows[5]]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "doc_id long, text string, node string, u int")
    for percent in (85, 80):
        got = N.near_groups(df, percent).collect()
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(brute(rows, percent), key=str)
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
        assert sum(r.head for r in got if r.n_shingles) == len({str(c) for _, n, c in brute(rows, percent) if n})
    assert N.near_groups(df.where("false")).count() == 0


@pytest.mark.parametrize("hub", [True, False])
def test_one_large_group_of_edited_copies(spark, hub):
    """Copies of a text that most of them are too far from each other to link, copies of copies among them."""
    rng = random.Random(11)
    base = [f"b{i}" for i in range(150)]

    def edited(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"e{rng.randrange(10**9)}"
        return words

    made = [edited(base, rng.choice([1, 1, 2, 3, 4, 6])) for _ in range(140)] + ([base] if hub else [])
    made += [edited(rng.choice(made), rng.choice([0, 1, 1, 2])) for _ in range(80)]
    rng.shuffle(made)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows, 85)
    assert len({c for _, _, c in want}) > 5
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, c) for d, _, c in want)


def test_shorter_copies_in_front_hide_no_links(spark):
    """Every bucket that two near copies share has a shortened copy as its first row, too short to be linked with them."""
    rng = random.Random(0)
    base = [f"b{i}" for i in range(600)]
    made = []
    for _ in range(30):
        at = rng.randrange(501)
        made.append(base[:at] + base[at + 100 :])
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(600), 4):
            words[at] = f"e{rng.randrange(10**9)}"
        made.append(words)
    rows = [(i, " ".join(w)) for i, w in enumerate(made)]
    got = N.near_groups(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    want = brute(rows, 85)
    assert len({c for d, _, c in want if d >= 30}) < 10
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((d, c) for d, _, c in want)


def test_differences_find_links_that_no_star_tested(spark):
    """Only the pair (0, 1) is tested and fails; the links among the other candidates must be found all the same."""
    words = lambda *parts: " ".join(f"v{i}" for a, b in parts for i in range(a, b))
    rows = [(0, words((0, 100))), (1, words((30, 145))), (2, words((32, 145))), (3, words((28, 141))), (4, words((200, 300))), (5, words((203, 300)))]
    texts = spark.createDataFrame(rows, "node long, text string")
    pairs = spark.createDataFrame([(0, k) for k in range(1, 6)], "u long, v long")
    none = pairs.where("false")
    got = {r.node: r.component for r in N.resolve(texts, pairs, none, 85, 5).collect()}
    want = {d: c for d, _, c in brute(rows, 85)}
    assert all(got.get(d, d) == c for d, c in want.items()) and len(set(want.values())) == 3


def test_estimate_and_densification():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64) * np.uint64(2))
    b = np.unique(np.concatenate([a[:1700], rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    s = N.signatures([a, b, a[::700]])
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.15 and set(s[2]) == set(a[::700])


def test_components_of_chains_and_hubs(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(500, 400), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 140)) and got[500] == got[400] == 400


def test_edge_rows_and_stage(spark, edge, empty):
    assert N.near_groups(edge).count() == edge.count() and N.near_groups(empty).count() == 0
    kept = N.stage(spark, edge, "")
    assert kept.columns == edge.columns and kept.where(F.col("doc_id") == 4).count() == 0 and kept.where(F.col("doc_id") == 1).count() == 1
