"""All queries by name."""

from __future__ import annotations

from codicil.plans import corpus_queries, event_queries, history_queries, manifest_queries, reader_queries, search_queries, statute_queries

_MODULES = (corpus_queries, statute_queries, history_queries, manifest_queries, reader_queries, event_queries, search_queries)

QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "version_reconciliation"
