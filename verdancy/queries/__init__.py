"""Registered queries: each applies an operator to the given tables, with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from verdancy.queries import cleaning, expressions, grids, models, panels, pipelines, sources, statistics, streams, summaries, windows

_PARTS = (sources, cleaning, expressions, summaries, grids, windows, statistics, models, pipelines, panels, streams)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.found.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.QUERIES.sql.items()}
