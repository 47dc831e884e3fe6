"""All queries of the document-audit operators over the driver tables, with their SQL."""

from __future__ import annotations

from parchment.plans import document_queries, page_queries, table_queries  # noqa: F401  they register themselves
from parchment.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
