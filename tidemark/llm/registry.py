"""The queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

MODULES = ["ann", "collocations", "filter_audit", "html_text", "jaccard_join", "katz", "packing", "piece_lattice", "quality", "secrets", "token_counts", "vector_dedup", "winnowing"]


def queries() -> dict[str, Callable]:
    return {k: q for m in MODULES for k, q in import_module(f"tidemark.llm.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in getattr(import_module(f"tidemark.llm.{m}"), "SQL", {}).items()}
