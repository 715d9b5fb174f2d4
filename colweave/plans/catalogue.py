"""All queries of the reference's own operators, by name, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from colweave.plans import decide_queries, feature_queries, graph_queries, learn_queries, search_queries, sheet_queries, text_queries, validate_queries

MODULES = (text_queries, search_queries, graph_queries, feature_queries, validate_queries, decide_queries, learn_queries, sheet_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
