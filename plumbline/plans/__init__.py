"""Registered queries over the given tables, each with an independent SQL statement where
SQL can express it."""

from plumbline.plans import (  # noqa: F401
    core_queries,
    evidence_queries,
    lineage_queries,
    rule_queries,
    source_queries,
    stream_queries,
    text_queries,
)
from plumbline.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
