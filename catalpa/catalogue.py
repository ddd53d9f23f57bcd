"""The registered queries over schema snapshots and rows, with their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from catalpa.operators import batches, conflicts, digests, integrity, intervals, ledger, lint, mentions, metrics, resumable, source_queries, typing_queries, versions
from catalpa.plans import catalog_queries, changes, guards, order, replay, steps
from catalpa.streaming import keyed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

for module in (integrity, intervals, batches, conflicts, resumable, digests, versions, ledger, metrics, mentions, changes, catalog_queries, guards, steps, order, replay, keyed, lint, typing_queries, source_queries):
    QUERIES |= module.QUERIES
    ORACLES |= module.ORACLES

FLAGSHIP = "fk_summary"
