"""Queries over the layout and annotation operators, by name, and their SQL."""

from __future__ import annotations

from quire.plans import document_queries, geometry_queries, sequence_queries, store_queries

MODULES = (document_queries, geometry_queries, sequence_queries, store_queries)
FLAGSHIP = "grd_page_summary"
QUERIES: dict = {k: q for m in MODULES for k, q in m.QUERIES.items()}
SQL: dict = {k: s for m in MODULES for k, s in m.SQL.items()}
