"""All queries of the reference's own operators, with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES: list[str] = ["ranking_queries", "table_queries", "stats_queries", "split_queries", "model_queries", "idiom_queries", "job_queries", "result_queries"]


def queries() -> dict[str, Callable]:
    return {k: q for m in MODULES for k, q in import_module(f"tidemark.plans.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f"tidemark.plans.{m}").SQL.items()}
