"""All registered queries and their SQL."""

from __future__ import annotations

from quillvec.plans import (
    corpus_queries,
    corpus_sql,
    search_queries,
    search_sql,
    vector_queries,
    vector_sql,
)

#: Queries that SQL can't express; the tests compare them with plain versions.
UNCHECKED = search_queries.UNCHECKED
QUERIES = {
    **corpus_queries.QUERIES,
    **vector_queries.QUERIES,
    **search_queries.QUERIES,
    **UNCHECKED,
}
ORACLES = {**corpus_sql.ORACLES, **vector_sql.ORACLES, **search_sql.ORACLES}
