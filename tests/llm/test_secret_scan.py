import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from gridmill.llm import secret_scan
from gridmill.llm.common import LOWER


def brute(text):
    """The base spans by plain search, as the contract words them."""
    text = text or ""
    letters = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
    found = [(m.start(), 0, m.end()) for m in re.finditer(rf"""({letters})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_rows_hold_all_base_spans(spark, edge, empty):
    rng = random.Random(2)
    bits = ["password = hunter22xx", "ToKeN:'abcdefgh1'", "secret=short", "API_KEY==abcdefghij", "api-key=abcdefgh", "AKIA" + "Q" * 16, "AKIAAKIAAKIA1", "0123456789abcdef" * 2, "deadbeef" * 9, "ſecret=abcdefgh", "token=password=abcdefgh", "ghp_" + "a1" * 20, "é" * 5, " ", "\n", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 12))) for _ in range(400)] + [None, "", "é" * 9000 + "token=abcdefghi"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    names = ["assign", "access", "hex"]
    for r in secret_scan.scan(df).collect():
        want = brute(texts[r.doc_id])
        told = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == b for _, k, _ in want) for b in range(3)]
        assert r.base_sha256 == hashlib.sha256(told.encode()).hexdigest()
        assert set(told.split(",")) <= set(r.spans.split(",")) or not told
        assert r.spans.count("code_host:") == len(re.findall(r"gh[pousr]_[A-Za-z0-9]{36,}", texts[r.doc_id] or ""))
    assert secret_scan.scan(edge).count() == edge.count() and secret_scan.scan(empty).count() == 0


def holds(query, text):
    if query is True:
        return True
    if isinstance(query, bytes):
        return query in text
    return (all if query[0] == "and" else any)(holds(q, text) for q in query[1])


@settings(max_examples=150, deadline=None)
@given(st.data())
def test_every_match_satisfies_the_derived_query(data):
    pattern = data.draw(st.sampled_from([r.pattern for r in secret_scan.RULES] + [r"ab(cd|ef)+gh?ij", r"(abc|d.f)xyz[0-9]{2}", r"foo(bar)?baz{2,3}q", r"\bkey-[a-c]x\w+end$", r"a*b+cde"]))
    text = data.draw(st.from_regex(re.compile(pattern, re.ASCII), fullmatch=False))
    query = secret_scan.derive(secret_scan.parser.parse(pattern))[1]
    assert holds(query, text.encode("utf-8", "ignore").translate(LOWER))


def test_rules_of_every_kind_find_what_a_full_scan_finds(spark):
    rules = [
        secret_scan.Rule("plain", "CLÉ-SECRÈTE"), secret_scan.Rule("folded", "clÉ-secrÈte", fold=True), secret_scan.Rule("members", "[ÀÉa]BCD[x-z]"), secret_scan.Rule("either", "ÄÖÜ|ABC{2}"),
        secret_scan.Rule("short", "ÉA"), secret_scan.Rule("repeat", "(?:ÑANDÚ){1,3}!"), secret_scan.Rule("open", "K[^ ]+ÇA"),
    ]
    texts = ["ma CLÉ-SECRÈTE ici", "ma CLÉ-secrÈTE ici", "clé-secrète", "ÉBCDy aBCDx ébcdz", "ÄÖÜ äöü ABCC abcc", "ÉA éa", "ÑANDÚÑANDÚ! ñandú!", "KxxÇA kxxça", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in secret_scan.scan(docs, rules, 2).collect():
        text = texts[r.doc_id] or ""
        want = sorted((m.start(), k, m.end()) for k, rule in enumerate(rules) for m in re.finditer(rule.pattern, text, re.ASCII | (re.IGNORECASE if rule.fold else 0)))
        assert r.spans == ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in want)
