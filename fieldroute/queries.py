"""Registered queries of the reference-domain operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from fieldroute.plans import actuals, aggregates, cleansing, dispatch, domain, explorer, joins, masters, reports, staffing, streams, walks

_MODULES = (domain, dispatch, cleansing, joins, aggregates, reports, staffing, explorer, streams, walks, actuals, masters)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: f for m in _MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {k: q for m in _MODULES for k, q in m.SQL.items()}
