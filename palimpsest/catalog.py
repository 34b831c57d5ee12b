"""Queries of the engine's own operators, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    """A query over the driver tables; ``sql`` where DuckDB can express it."""

    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def entries() -> dict[str, Entry]:
    from palimpsest.functions import chunks, records, text
    from palimpsest.operators import aggregates, communities, containment, entities, fulltext, graph, joins, predicates, retention, retrieval, scans, served, sets, temporal, windows
    from palimpsest.plans import planner
    from palimpsest.streaming import flows, tail, triggers

    found: dict[str, Entry] = {}
    for module in (aggregates, predicates, joins, windows, sets, text, chunks, fulltext, retrieval, temporal, retention, graph, entities, communities, containment, planner, flows, tail, triggers, records, scans, served):
        found |= module.ENTRIES
    return found


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: e.run for k, e in entries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: e.sql for k, e in entries().items() if e.sql}
