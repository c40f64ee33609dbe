"""Named queries over the driver tables, each with its oracle where SQL can express it."""

from __future__ import annotations

from . import file_queries, function_queries, inference_queries, model_queries, ranking_queries, stats_queries  # noqa: F401
from .registry import COVERS, ORACLES, QUERIES


def queries():
    return QUERIES


def oracle_sql():
    return ORACLES


__all__ = ["COVERS", "oracle_sql", "queries"]
