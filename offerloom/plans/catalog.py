"""All registered queries of the listing engine, by operator id, with their SQL twins."""

from __future__ import annotations

from offerloom.plans import scalar_queries, search_queries, source_queries, stream_queries, table_queries

_MODULES = (scalar_queries, search_queries, table_queries, stream_queries, source_queries)
QUERIES: dict = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
