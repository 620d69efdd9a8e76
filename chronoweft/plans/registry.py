"""All registered queries of the engine and the DuckDB SQL that checks them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_MODULES = ("interval_queries", "join_queries", "text_queries", "quality_queries", "catalog_queries", "timeline_queries", "greedy_queries", "similarity_queries", "ledger_queries", "source_queries", "planning_queries", "validation_queries", "cue_queries", "transcript_queries", "script_queries", "check_queries", "command_queries", "edit_queries", "publishing_queries", "inventory_queries", "reading_queries", "document_queries", "scheduling_queries", "alignment_queries", "scan_queries", "revision_queries", "beat_queries", "drift_queries")
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under a name, with its SQL unless SQL can't express it."""

    def keep(f: Query) -> Query:
        if name in _queries:
            raise ValueError(f"{name} is registered twice")
        _queries[name] = f
        if sql is not None:
            _sql[name] = sql
        return f

    return keep


def _load() -> None:
    for m in _MODULES:
        importlib.import_module(f"chronoweft.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
