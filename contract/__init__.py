"""Queries over the driver tables, each paired with SQL that computes the same result independently."""

from __future__ import annotations

from importlib import import_module

_MODULES = ["prepare_queries", "text_queries", "profile_queries", "feature_queries", "evaluate_queries", "model_queries", "io_queries"]


def load_queries() -> tuple[dict, dict]:
    """Import every query module and return (queries, oracle SQL)."""
    for module in _MODULES:
        import_module(f"contract.{module}")
    from contract.registry import ORACLE, QUERIES

    return QUERIES, ORACLE
