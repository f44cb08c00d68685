"""The catalogue of queries over the driver tables and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import event_queries, feed_queries, market_queries, message_queries, more_sql, position_queries, review_queries, sql_catalog, stateful_queries

_PARTS = (feed_queries, market_queries, sql_catalog, more_sql, stateful_queries, event_queries, position_queries, message_queries, review_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for p in _PARTS for k, v in p.ORACLES.items()}
