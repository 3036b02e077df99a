"""Pages of a table of queries: each page is what its query gets alone, whatever else is asked."""

import pytest
from pyspark.sql import functions as F

from gridmill.functions import ranking as R
from gridmill.operators import postings
from gridmill.plans import pages

QUERIES = [(1, "art deco bar", 40.7, -74.0, 900.0), (2, "Red Mill", 40.7, -74.0, 900.0), (3, "gothic towers", 40.7, -74.0, 900.0), (4, "", 40.7, -74.0, None)]


@pytest.fixture
def rows(spark):
    k = F.col("id")
    some = lambda *v: F.element_at(F.array(*map(F.lit, v)), (k % len(v) + 1).cast("int"))
    return spark.range(400).select(
        "id", some("Red Mill", "Deco Bar", "Gothic Hall", "Old Quay", "Red Mill").alias("name"), some("art deco", "gothic", None).alias("style"), some("Bar", "Art Gallery", None, "Church").alias("category"),
        F.array(F.lit("Bar")).alias("labels"), some("Cass Gilbert", None).alias("architect"), some("by the mill", None, "a bar").alias("snippet"), (1850 + k).cast("int").alias("year"), (40.7 + k / 40000).alias("lat"), F.when(k % 50 > 0, F.lit(-74.0)).alias("lng"),
        F.when(k % 3 == 0, (k % 10) / 10.0).alias("fame"), (k % 7 / 7.0).alias("dot"), (k % 4 == 0).alias("novel"), F.when(k % 37 > 0, F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.sin(k * i))).alias("embedding"),
    )


def asked(spark, queries):
    df = spark.createDataFrame(queries, "query_id int, query string, lat double, lng double, metres double")
    return pages.understood(df.withColumn("q", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda i: F.cos(F.col("query_id") * i))))


def answers(spark, rows, queries, tmp_path, name):
    told = asked(spark, queries)
    index = postings.build(rows.select("name"), str(tmp_path / name), 4)
    like = pages.likenesses(index, told)
    found = {c: pages.legs(rows, like, told, 20, c == "buildings") for c in R.CORPORA}
    out = {}
    for r in pages.pages(found, told, 15).collect():
        out.setdefault(r.query_id, []).append((r.score, r.corpus, r.key, r.name, r.why))
    return {k: sorted(v) for k, v in out.items()}


def test_a_page_does_not_depend_on_the_other_queries(spark, rows, tmp_path, monkeypatch):
    together = answers(spark, rows, QUERIES, tmp_path, "all")
    assert set(together) == {1, 2, 3, 4} and all(3 <= len(v) <= 15 for v in together.values())
    monkeypatch.setattr(pages, "TOGETHER", 1)  # every query in a pass of its own
    assert answers(spark, rows, QUERIES, tmp_path, "each") == together
    for q in QUERIES[:2]:
        assert answers(spark, rows, [q], tmp_path, f"one{q[0]}") == {q[0]: together[q[0]]}


def test_a_radius_cuts_hard_intents_alone(spark, rows, tmp_path):
    got = answers(spark, rows, QUERIES, tmp_path, "x")
    near = {str(r.id) for r in rows.where("lng IS NOT NULL AND (lat - 40.7) * 111194.9 <= 900").collect()}
    assert all(key in near for q in (1, 2) for _, _, key, *_ in got[q])
    assert any(key not in near for _, _, key, *_ in got[3])


def test_no_queries_and_no_rows(spark, rows, tmp_path):
    assert answers(spark, rows.where("false"), QUERIES, tmp_path, "a") == {}
    assert answers(spark, rows, [], tmp_path, "b") == {}
