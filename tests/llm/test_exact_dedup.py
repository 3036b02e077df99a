import string
from collections import defaultdict

from pyspark.sql import functions as F

from gridmill.llm import exact_dedup

FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def expected(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[(r.text or "").translate(FOLD)].append(r.doc_id)
    return sorted(((d, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for d in g), key=str)


def held(df):
    return sorted(((r.doc_id, r.keep_id, r.group_size) for r in df.collect()), key=str)


def test_edge_rows(edge, empty):
    found = exact_dedup.exact_groups(edge)
    assert held(found) == expected(edge.collect())
    assert found.where("kept").count() == found.select("text_sha256").distinct().count()
    assert exact_dedup.exact_groups(empty).count() == 0


def test_colliding_hashes_are_told_apart(edge):
    """With a hash of the chunk's length alone, most chunks collide and texts must still differ."""
    assert held(exact_dedup.exact_groups(edge, hashed=lambda c: F.length(c).cast("long"))) == expected(edge.collect())


def test_long_texts_that_differ_in_one_place(spark):
    base = "word and more of it " * 2000
    rows = [(i, base[:i] + ("?" if i % 2 else base[i]) + base[i + 1 :]) for i in range(1, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert held(exact_dedup.exact_groups(docs)) == expected(docs.collect())


def test_stage_keeps_columns_and_one_row_of_each_text(spark, edge):
    kept = exact_dedup.stage(spark, edge, "")
    assert kept.columns == edge.columns
    assert kept.count() == len({(r.text or "").translate(FOLD) for r in edge.collect()})
