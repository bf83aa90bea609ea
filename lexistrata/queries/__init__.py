"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lexistrata.queries import changes, kv, lineage, scalars, search, suffix

_MODULES = (search, kv, changes, lineage, suffix, scalars)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
