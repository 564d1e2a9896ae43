"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import job_queries, log_queries, page_queries, search_queries, store_queries

_PARTS = (search_queries, page_queries, store_queries, log_queries, job_queries)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}

flagship = search_queries.retrieve_context
