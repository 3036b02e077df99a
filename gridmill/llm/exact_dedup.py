"""Exact dedup by content-defined chunk recipes, with DataFrame functions only.

Each normalised text is cut where its content says so: a chunk ends at the first cut mark after
``MIN_CHUNK`` characters, or at ``MAX_CHUNK``. Chunks get identifiers that are verified against the
chunk texts, and a document becomes its recipe, the ordered list of its chunk identifiers. Two texts
are equal exactly when their recipes are. The texts move once, chunk by chunk and combined before
the shuffle, to verify the identifiers; all later steps move only recipes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridmill.llm.common import ascii_lower, by_number, dropping, fresh, materialize, numbered, table

#: Characters of a chunk: at least and at most. A cut mark is a blank and a letter from a to h.
MIN_CHUNK, MAX_CHUNK = 256, 1024
CHUNK = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[\x20\n][a-h])|.{{1,{MAX_CHUNK}}}"


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0))


def dictionary(texts: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """(h, chunk): each distinct chunk of ``texts`` once; equal ones meet before the shuffle."""
    return texts.select(F.explode(chunks(F.col("norm"))).alias("chunk")).groupBy(hashed(F.col("chunk")).alias("h"), "chunk").agg(F.count(F.lit(1)).alias("n"))


def recipes(rows: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(doc_id, row, recipe, sha) for each of the written rows (row, doc_id, text): the verified chunk identifiers in order."""
    texts = rows.select("doc_id", "row", ascii_lower(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    sha = F.unhex(F.sha2("norm", 256)).alias("sha")
    plain = materialize(texts.select("doc_id", "row", F.transform(chunks(F.col("norm")), lambda c: F.struct(hashed(c).alias("h"), F.lit(0).alias("k"))).alias("recipe"), sha), "recipes")

    shared = materialize(dictionary(texts, hashed).groupBy("h").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("h"), "shared")
    if not shared.head(1):
        return plain
    # Different chunk texts with one hash: number these texts and write the numbers into the recipes.
    numbers = dictionary(texts, hashed).join(shared, "h").select("h", "chunk", (F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1).alias("k"))
    parts = texts.select("row", F.posexplode(chunks(F.col("norm"))).alias("pos", "chunk")).withColumn("h", hashed(F.col("chunk")))
    told = parts.join(numbers, ["h", "chunk"], "left").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "h", F.coalesce("k", F.lit(0)).alias("k")))).alias("at"))
    told = told.select("row", F.transform("at", lambda x: F.struct(x["h"].alias("h"), x["k"].alias("k"))).alias("told"))
    return materialize(plain.join(told, "row", "left").select("doc_id", "row", F.coalesce("told", "recipe").alias("recipe"), "sha"), "recipes")


def groups_of(rows: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """``exact_groups`` of written rows (row, doc_id, text)."""
    with dropping():
        return materialize(told_groups(rows, hashed), "told", keep=True)


def told_groups(rows: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    listed = recipes(rows, hashed)
    # Written first, as the adaptive split of a hot key needs both sides straight from their shuffles.
    found = materialize(listed.groupBy("recipe").agg(F.max(F.struct("doc_id", "row")).alias("best"), F.count(F.lit(1)).alias("group_size")), "groups")
    joined = listed.join(found, "recipe")
    return joined.select("doc_id", "row", F.col("best.doc_id").alias("keep_id"), "group_size", (F.col("row") == F.col("best.row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def exact_groups(docs: DataFrame, hashed: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """One row per input row: doc_id, row, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null counts as the empty text. The row
    with the largest doc_id stays, a null doc_id is smaller than all others, and of repeated rows
    with that doc_id exactly one stays. Only the columns doc_id and text are read, texts of any length
    whole. An empty table gives an empty result. A group of any size is counted before the shuffle and
    reaches the join as one row; its own rows stream past that row, and Spark's adaptive execution
    splits them over tasks when they are many.
    """
    return groups_of(numbered(docs.select("doc_id", "text")), hashed)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of equal texts, with all columns of ``docs``.

    Nulls, empty and long texts, ties and repeated rows are judged as ``exact_groups`` says.
    """
    row = fresh("row", docs)
    held = numbered(docs, row)
    gone = groups_of(held.select(F.col(row).alias("row"), "doc_id", "text")).where(~F.col("kept")).select(F.col("row").alias(row))
    return by_number(held, gone, row, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).drop("row")


ORACLE = """
WITH t AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
