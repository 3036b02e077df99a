"""All queries of the engine by name, and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridmill.queries import analytics, buildings, community, districts, geometry, indexed, page, places, reports, rollups, rules, searches, shapes, texts, wholes, written
from gridmill.streaming import daily

FLAGSHIP = "search_fused"
MODULES: list = [searches, page, indexed, rules, analytics, community, places, shapes, geometry, texts, reports, districts, rollups, buildings, written, wholes, daily]


#: Small cases on literal rows: the tests run them against the answers beside them. They read no table, so they are no queries.
SMALL = {
    "intents", "ranking_rules", "addresses", "dates_and_numbers", "streets", "table_addresses", "venue_labels", "handles", "web_queries", "lot_records", "number_runs", "canonical_streets", "building_texts",
    "lookup_terms", "relevant_results", "projected",
}

Run = Callable[[SparkSession, str], DataFrame]


def everything() -> dict[str, Run]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def queries() -> dict[str, Run]:
    return {name: run for name, run in everything().items() if name not in SMALL}


def small_cases() -> dict[str, tuple[Run, str]]:
    """Each small case with the SQL of its answers."""
    return {name: (everything()[name], answers()[name]) for name in sorted(SMALL)}


def answers() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, sql in answers().items() if name not in SMALL}
