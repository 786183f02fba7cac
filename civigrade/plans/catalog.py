"""All named queries and their SQL twins."""

from __future__ import annotations

from civigrade.plans import (
    catalog_queries,
    geography_queries,
    index_queries,
    publication_queries,
    source_queries,
    value_queries,
)

_PARTS = (value_queries, geography_queries, publication_queries, index_queries, catalog_queries, source_queries)

QUERIES = {name: function for part in _PARTS for name, function in part.query.queries.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.query.oracle.items()}
