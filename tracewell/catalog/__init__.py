"""Catalogue of registered queries."""

from .registry import ORACLES, QUERIES


def load() -> tuple[dict, dict]:
    """Import every query module once and return (queries, SQL twins)."""
    from . import attribution_queries, evaluation_queries, model_queries, planning_queries  # noqa: F401

    return QUERIES, ORACLES
