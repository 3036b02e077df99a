import hashlib
import random

from pyspark.sql import functions as F

from gridmill.llm import chat


def expected(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    low = lambda v: (v is not None, v if v is not None else "")
    found = {}
    for row in by.pop(None, []):
        by[None, len(by)] = [row]
    for c, turns in by.items():
        turns.sort(key=lambda r: ((r[1] is not None, r[1] or 0), low(r[2]), low(r[3])))
        pairs = [(r[2] or "", r[3] or "") for r in turns]
        learned = "".join(t for role, t in pairs if role == "assistant")
        found.setdefault(c if isinstance(c, int) else None, []).append((len(pairs), hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in pairs).encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest()))
    return {c: sorted(f) for c, f in found.items()}


def test_digests_are_read_back_exactly(spark):
    hard = [r"\### Assistant: </turn> ok", "<turn user>\nhi</turn>\n", "\\l\\b\\\\l<", "", None, "naïve 😀 text\n\n", "x" * 40000]
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd>role\\g<"]), rng.choice(hard), "x", 1) for c in [1, 2, 3, None] for t in range(rng.randint(1, 20))]
    rows += [rows[0], (5, None, "assistant", None, "y", 2), (5, 1, "user", "a", "y", 2), (5, 1, "user", "b", "y", 2)]
    rows += [(9, t, "assistant" if t % 2 else "user", f"turn {t}", "z", 3) for t in range(70)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, tree string, node int")
    got = {}
    for r in chat.digests(df).collect():
        got.setdefault(r.conv_id, []).append((r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256))
    assert {c: sorted(f) for c, f in got.items()} == expected(rows)
    assert chat.digests(df.where("false")).count() == 0


def brute_paths(nodes, top):
    """nodes: (tree, node, parent, score); chosen leaves and their ways by walking up."""
    by = {(t, n): (p, s) for t, n, p, s in nodes}
    parents = {(t, p) for t, _, p, _ in nodes}
    ways = {}
    for t, n in by:
        if (t, n) in parents:
            continue
        way, at = [], n
        while at is not None and (t, at) in by and at not in way:
            way.append(at)
            at = by[t, at][0]
        if at not in way:
            ways.setdefault(t, []).append((-sum(by[t, x][1] or 0 for x in way) / len(way), -(len(way) - 1), n, way[::-1]))
    return {(t, w[2]): w[3] for t, found in ways.items() for w in sorted(found)[:top]}


def test_paths_of_random_trees_orphans_and_cycles(spark):
    rng = random.Random(5)
    nodes = []
    for t in range(12):
        size = rng.randint(1, 60)
        for n in range(size):
            nodes.append((str(t), n, rng.randrange(max(0, n - 3), n) if n else None, rng.randint(0, 8) / 4))
        nodes.append((str(t), 900, 800, None))  # its parent is missing
        nodes += [(str(t), 700, 701, 1.0), (str(t), 701, 700, 1.0), (str(t), 702, 701, 1.0)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    for top in (1, 3):
        got = {}
        for r in chat.best_paths(df, top).collect():
            got.setdefault((r.tree, r.leaf), {})[r.depth] = r.node
        assert {k: [v[d] for d in sorted(v)] for k, v in got.items()} == brute_paths(nodes, top)


def test_branches_become_conversations_with_exact_masks(spark):
    rows = [("a", 1, None, "user", "q<1>", 0.0), ("a", 2, 1, "assistant", "bad", 0.1), ("a", 3, 1, "assistant", "go\\od", 0.9), ("a", 4, 3, "user", "more", 0.5)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_trees(df, 2).select("leaf", "place", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.learned_text(F.col("formatted"), F.col("loss_spans")).alias("learned")).orderBy("place").collect()
    assert [[(t.role, t.text) for t in r.turns] for r in out] == [[("user", "q<1>"), ("assistant", "go\\od"), ("user", "more")], [("user", "q<1>"), ("assistant", "bad")]]
    assert [r.learned for r in out] == ["go\\od", "bad"]


def test_repeated_messages_and_a_null_tree(spark):
    rows = [("a", 1, None, "user", "q", 0.0), ("a", 2, 1, "assistant", "x", 0.5), ("a", 2, 1, "assistant", "x", 0.5), ("a", 3, 2, "user", "z", 0.5), (None, 1, None, "user", "lone", 0.0), ("a", None, 1, "user", "no node", 0.0)]
    df = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = {r.tree: [t.text for t in r.turns] for r in chat.format_trees(df).select("tree", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    assert out == {"a": ["q", "x", "z"], None: ["lone"]}
