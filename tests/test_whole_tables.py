"""Queries that must read every row of their tables."""

import re

from gridmill.queries import community, searches, texts

D = "/root/testdata/sf0.001"


def test_every_vector_is_searched(spark):
    vectors = spark.read.parquet(f"{D}/embeddings.parquet")
    seen = searches.whole_corpus(spark, D)
    assert vectors.count() == seen.count() == seen.select("id").distinct().count() > spark.read.parquet(f"{D}/part.parquet").count()


def test_every_part_is_explained(spark):
    d = "/root/testdata/sf0.01"
    keys = {r.p_partkey for r in spark.read.parquet(f"{d}/part.parquet").select("p_partkey").collect()}
    assert len(keys) > 500 and {r.p_partkey for r in searches.explanations(spark, d).collect()} == keys


def test_every_contribution_is_voted_on(spark):
    asked = {r.contribution for r in community.votes(spark, D).select("contribution").distinct().collect()}
    told = {r.contribution: r for r in community.edit_votes(spark, D).collect()}
    assert max(asked) > 40 and set(told) == asked


def test_tokens_of_whole_texts(spark):
    told = {r.doc_id: r.n for r in texts.names_whole(spark, D).collect()}
    plain = [r for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect() if r.text and len(r.text) > 80 and re.fullmatch("[a-zA-Z ,.]+", r.text)]
    assert plain and all(told[r.doc_id] == len(re.findall("[a-zA-Z]+", r.text)) for r in plain)
