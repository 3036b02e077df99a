"""The corpus pipeline: stages in order, each over all that the one before it kept.

Nulls, empty texts, ties, repeated rows and empty tables are handled as the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridmill.llm import bpe, decontaminate, exact_dedup, language_id, near_dedup
from gridmill.llm.common import dropping, materialize, table

#: (name, function) in order. All but the last return the columns of documents, rows that they keep.
STAGES = [
    ("language ID", language_id.stage),
    ("exact dedup", exact_dedup.stage),
    ("MinHash near-dedup", near_dedup.stage),
    ("benchmark decontamination", decontaminate.stage),
    ("byte-level BPE", bpe.stage),
]

#: Language identification, densified signatures and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with dropping():
            docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
