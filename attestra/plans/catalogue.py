"""All queries of the library: name -> function(spark, sf_dir), and the SQL
that gives the same rows."""

from __future__ import annotations

from . import evidence_queries, nested_queries, relational, retrieval_queries, rule_queries, scalars, search_queries, source_queries, stream_queries, workflow_queries  # noqa: F401  (they register their queries)
from .registry import ORACLES, QUERIES

FLAGSHIP = "rep01_reconciliation"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
