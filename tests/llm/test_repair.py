import hashlib
import itertools
import random
import re

from gridmill.llm import earley, repair


def cheapest(tokens):
    """The least (cost, audit) over every way to keep, rerole or delete the rows and to insert up to two rows in a gap."""
    best = None
    gaps = ["", "u", "a", "ua", "au"]
    choices = [[("D", "", 4)] if t == "-" else [("D", "", 4), ("K", t.lower(), 3 * t.isupper()), ("R", "u", 3 + 3 * t.isupper()), ("R", "a", 3 + 3 * t.isupper())] for t in tokens]
    for edits in itertools.product(*choices):
        for put in itertools.product(gaps, repeat=len(tokens) + 1):
            roles, audit, cost = put[0], "I" * len(put[0]), 3 * sum(map(len, put))
            for (edit, role, c), more in zip(edits, put[1:]):
                roles, audit, cost = roles + role + more, audit + edit + "I" * len(more), cost + c
            if re.fullmatch("(s?(ua)+)?", roles):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_parse_is_the_cheapest_of_all_edits():
    for n in range(4):
        for tokens in itertools.product("suaxUA-", repeat=n):
            assert earley.repair_of("".join(tokens))[:2] == cheapest(tokens), tokens


def test_long_conversations_are_parsed_whole():
    cost, audit, targets = earley.repair_of("s" + "ua" * 1500 + "u")
    assert (cost, audit) == (3, "K" * 3002 + "I") and targets.endswith("-a")


def plain(rows):
    """What the query returns, in plain Python, for one conversation's rows after damage."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "no")
        seen.add((role, text))
    shape = "".join("-" if f in ("blank", "duplicate") else (lambda k: k.upper() if f == "truncated" else k)(r[:1] if r[:1] in ("s", "u", "a") else "x") for (_, r, _), f in zip(rows, faults))
    cost, audit, targets = earley.repair_of(shape)
    left, out = list(rows), []
    for edit, target in zip(audit, targets):
        row = None if edit == "I" else left.pop(0)
        if edit != "D":
            out.append((repair.ROLES.get(target) or row[1]) + ":" + (row[2] if row else ""))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest()


def test_same_as_plain_python(spark):
    rng = random.Random(3)
    roles, texts = ["user", "assistant", "system", "tool", "", None, "User", "a"], ["Hi.", "Yes!", "cut", "", " \n", None, "Ok?\t ", "é…", "Long. " * 3000]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts), "x") for c in range(60) for _ in range(rng.randint(1, 9))]
    rows += [(99, t, "user" if t % 2 else "assistant", f"{t}.", "y") for t in range(400)]
    rows += rows[:7]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")
    got = {r.conv_id: tuple(r)[1:] for r in repair.digests(docs, docs).collect()}
    assert got == {c: plain([r[1:4] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


def test_conversations_without_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in repair.digests(docs.where("false"), docs).collect()] == [(1, 0, 0, 0, 0, 0, 0, "", repair.EMPTY)]
    assert repair.digests(docs.where("false"), docs.where("false")).count() == 0


def test_damage_by_case(spark):
    rows = [(c, 0, "assistant", "A. b! c?") for c in range(200)] + [(None, None, None, None)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).groupBy("role", "text").count().collect()
    assert {(r.role, r.text) for r in got} >= {("assistant", "A. b! c?"), ("assistant", ""), ("assistant", "A b c"), ("user", "A. b! c?")}


def test_edits_are_real_rows(spark):
    docs = spark.createDataFrame([(1, 0, "assistant", "Hello."), (1, 1, "user", "Why?")], "conv_id long, turn long, role string, text string")
    plans, edits = repair.repaired(docs)
    assert [(r.edit, r.role, r.text) for r in edits.orderBy("step").collect()] == [("I", "user", ""), ("K", "assistant", "Hello."), ("K", "user", "Why?"), ("I", "assistant", "")]
    assert plans.first().cost == 6
