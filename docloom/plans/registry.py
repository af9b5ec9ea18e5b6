"""All queries of the library, and their SQL."""

from __future__ import annotations

from . import answer_queries, chunk_queries, ingestion_queries, monitoring_queries, search_queries, source_queries, store_queries, text_queries  # noqa: F401  they register their queries
from .suite import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
