"""Name to query and name to oracle SQL, for the hazard engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from moraine.plans import catalog, ground, hazard, live, records, terrain, warning

_MODULES = [hazard, warning, terrain, ground, records, live, catalog]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}
