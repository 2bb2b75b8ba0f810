"""Registered queries of the core engine and the SQL that states the same results."""

from __future__ import annotations

from . import evidence_queries, retrieval_queries, text_queries

QUERIES: dict = {**retrieval_queries.QUERIES, **text_queries.QUERIES, **evidence_queries.QUERIES}
ORACLES: dict[str, str] = {**retrieval_queries.ORACLES, **text_queries.ORACLES, **evidence_queries.ORACLES}
