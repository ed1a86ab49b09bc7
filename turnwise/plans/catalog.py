"""Every query of the engine by name, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import artifacts, boards, calls, clusters, gate, intake, judged, pull, recordings, records, shown, talk, timeline, traced, truth, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (artifacts, boards, calls, clusters, gate, intake, judged, pull, recordings, records, shown, talk, timeline, traced, truth, views):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.ORACLE_SQL)
