"""Queries over the driver's tables, one for each operator, with the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cinegraph.plans import catalog


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities rolled up from raw mentions."""
    return queries()["entity_group_rollup"](spark, sf_dir)


def _load() -> None:
    from cinegraph.plans import q_community, q_evidence, q_graph, q_relational, q_resolution, q_retrieval, q_scalar, q_search, q_store, q_stream  # noqa: F401


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(catalog.QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(catalog.SQL)
