"""Every query of the engine by name, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import block_queries, boundary_queries, cluster_queries, domain_queries, field_queries, graph_queries, linalg_queries, ordered_queries, range_queries, solver_queries, source_queries, spatial_queries

_MODULES = (linalg_queries, range_queries, ordered_queries, spatial_queries, cluster_queries, graph_queries, solver_queries, domain_queries, block_queries, field_queries, source_queries, boundary_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
