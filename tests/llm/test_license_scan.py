import random
import re
import string

import pytest

from gridmill.llm import license_scan as s

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))


def accepts(parts, w, i):
    """Every end of a match of the parts from word ``i``, by plain backtracking."""
    if not parts:
        return {i}
    (kind, *given), rest = parts[0], parts[1:]
    if kind == "word":
        return accepts(rest, w, i + 1) if i < len(w) and w[i] == given[0].decode() else set()
    if kind == "optional":
        return accepts(given[0] + rest, w, i) | accepts(rest, w, i)
    if kind == "any":
        return set().union(*(accepts(rest, w, i + k) for k in range(given[0], given[1] + 1) if i + k <= len(w)))
    return set().union(*(accepts([("word", x) for x in wording] + rest, w, i) for wording in given[0]))


def brute(text, templates):
    w, spans = words(text), []
    for k, t in enumerate(templates):
        parts, until = s.parts_of(t.markup), 0
        for i in range(len(w)):
            if i >= until and (ends := accepts(parts, w, i)):
                until = max(ends)
                spans.append((i, k, until))
    spans.sort()
    base = [i for i, k, _ in spans if templates[k].base]
    join = lambda some: ",".join(sorted(set(some)))
    covered = [sum(e - i for i, k, e in spans if k == n) for n in range(len(templates))]
    return (
        len(w), len(base), min(base, default=None), max(base, default=None), join(templates[k].label for _, k, _ in spans if templates[k].base), join(templates[k].label for _, k, _ in spans),
        max(covered) / max(len(w), 1), ",".join(f"{templates[k].label}:{i}:{e}" for i, k, e in spans),
    )


SMALL = (
    s.Template("one", "a b", True),
    s.Template("two", "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> d"),
    s.Template("three", "b <<var;words=0-2>> c"),
    s.Template("four", "c <<var;oneof=a|b a|a b>> <<beginOptional>>d<<endOptional>> É"),
    s.Template("two", "d d <<var;words=1-3>> <<var;words=0-1>> a"),
)


def test_same_as_backtracking(spark):
    rng = random.Random(5)
    texts = [rng.choice([" ", ", ", "-"]).join(rng.choice(["a", "B", "c", "D", "É", "x"]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + [None, "", "a", "A-b!", "ab a"]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    for r in s.scan(docs, SMALL).collect():
        assert tuple(r)[1:] == brute(texts[r.doc_id], SMALL), texts[r.doc_id]


def test_license_texts_with_and_without_their_regions(spark):
    texts = {
        "mit": s.MIT.replace("<<beginOptional>>including the next paragraph<<endOptional>>", "(including the next paragraph)"),
        "gpl-3": "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3",
        "": s.MIT.replace("hereby", "not"),
        "cc-by-sa": "CC-BY-SA 4.0",
        "cc-by-nc": "shared under CC BY-NC 4.0.",
        "all-rights-reserved": "Copyright (c) 2001-2004 The Authors of This, All rights reserved.",
        "bsd-2-clause,bsd-3-clause": re.sub(r"<<[^>]*>>", " ", s.TEMPLATES[6].markup.replace("<<var;words=1-20>>", "Some Body")),
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    assert [r.labels for r in s.scan(docs).orderBy("doc_id").collect()] == list(texts)


def test_edge_tables(spark, edge, empty):
    got = s.scan(edge).collect()
    assert len(got) == edge.count() and not any(r.n_base or r.labels or r.spans for r in got)
    assert {r.doc_id: r.score for r in got}[2] == 0 and s.scan(empty).count() == 0
    long = spark.createDataFrame([(1, "filler " * 500_000 + "under the MIT license " * 3)], "doc_id long, text string")
    assert tuple(s.scan(long).first())[1:7] == (500_012, 3, 500_000, 500_008, "mit", "mit")


@pytest.mark.parametrize("markup", ["", "<<beginOptional>>a", "a <<endOptional>>", "<<var;words=0-2>> a", "a <<var;words=3-2>>", "a <<var;words=0-900>>", "a <<var;match=.>>"])
def test_faulty_markup_is_refused(markup):
    with pytest.raises(ValueError):
        s.parts_of(markup)
