"""The registered queries of the extraction and crawl operators, with their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import pages, surface, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**pages.query.queries, **tables.query.queries, **surface.query.queries}
ORACLE_SQL: dict[str, str] = {**pages.query.sql, **tables.query.sql, **surface.query.sql}
