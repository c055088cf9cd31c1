"""Registry of named queries (Spark callables) and their DuckDB oracles."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def register(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``; ``sql`` is
    the equivalent DuckDB query over the driver tables (None = rows-only)."""
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def unpivot_sql(source: str, cols: list[str], cast: str = "double", value: str = "v") -> str:
    """``union all`` unpivot of ``cols`` into (column_name, v)."""
    parts = [f"select '{c}' as column_name, cast({c} as {cast}) as {value} from {source}" for c in cols]
    return "\nunion all ".join(parts)
