"""Registry of named queries (Spark) and their DuckDB oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Decorator: register ``fn(spark, sf_dir) -> DataFrame`` under ``name`` with optional oracle SQL."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def ratio_sql(num: str, den: str) -> str:
    """SQL for the IEEE ``num / (den + 1)`` used by the packs."""
    d = f"(CAST({den} AS DOUBLE) + 1e0)"
    n = f"CAST({num} AS DOUBLE)"
    return div_sql(n, d)


def div_sql(n: str, d: str) -> str:
    return (f"(CASE WHEN {d} <> 0 THEN {n} / {d} WHEN {d} IS NULL OR {n} IS NULL THEN NULL "
            f"WHEN {n} > 0 THEN CAST('Infinity' AS DOUBLE) WHEN {n} < 0 THEN CAST('-Infinity' AS DOUBLE) "
            f"ELSE NULL END)")


def clip_sql(x: str, lo=None, hi=None) -> str:
    parts = []
    if lo is not None:
        parts.append(f"WHEN {x} < {lo} THEN {lo}")
    if hi is not None:
        parts.append(f"WHEN {x} > {hi} THEN {hi}")
    return f"(CASE {' '.join(parts)} ELSE {x} END)"
