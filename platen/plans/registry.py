"""All queries of the engine and the SQL that they equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from platen.plans import geometry_queries, layout, pdf_queries


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for module in (layout, geometry_queries, pdf_queries) for q in module.QUERIES}


def oracle_sql() -> dict[str, str]:
    return layout.ORACLES | geometry_queries.ORACLES | pdf_queries.ORACLES
