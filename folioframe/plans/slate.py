"""The registered queries of the library's own operators, with their SQL oracles."""

from __future__ import annotations

from folioframe.plans import extension_queries, library_queries, source_queries, stream_queries, text_queries

QUERIES = library_queries.QUERIES | text_queries.QUERIES | source_queries.QUERIES | stream_queries.QUERIES | extension_queries.QUERIES
ORACLE_SQL = library_queries.ORACLE_SQL | text_queries.ORACLE_SQL | source_queries.ORACLE_SQL | stream_queries.ORACLE_SQL | extension_queries.ORACLE_SQL
