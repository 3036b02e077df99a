"""The queries of the corpus operators, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridmill.llm import bpe, chat, decontaminate, exact_dedup, language_id, license_scan, near_dedup, prefix_trie, repair, secret_scan, sharding, substring_dedup, suffix_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_format": chat.query,
        "op2_secret_scan": secret_scan.query,
        "op3_decontaminate": decontaminate.query,
        "op4_suffix_dedup": suffix_dedup.query,
        "op5_exact_dedup": exact_dedup.query,
        "op6_substring_dedup": substring_dedup.query,
        "op7_language_id": language_id.query,
        "op8_sharding": sharding.query,
        "op9_near_dedup": near_dedup.query,
        "op10_bpe": bpe.query,
        "op11_repair": repair.query,
        "op12_prefix_trie": prefix_trie.query,
        "op13_license_scan": license_scan.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_format": chat.ORACLE,
        "op2_secret_scan": secret_scan.oracle(),
        "op3_decontaminate": decontaminate.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op6_substring_dedup": substring_dedup.ORACLE,
        "op11_repair": repair.oracle(),
        "op12_prefix_trie": prefix_trie.ORACLE,
        "op13_license_scan": license_scan.oracle(),
    }
